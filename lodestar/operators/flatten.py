"""Feed rows to (fields, lists): every scalar under a stable name, every list as uniform items.

The feed has no schema, so a row is parsed once into a variant and taken apart relationally: its members become rows,
an object's details rows of their own, a list's elements too, and aggregates put fields and lists together again. What
each known list keeps is a table of paths: LISTS. An object is a date, a person, or a value with details around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dates import to_iso

#: Names that carry no meaning outside the feed, and where an object's display value stands.
NOISE = ("id", "investigation_id", "case_id", "staff_department_id")
DISPLAY = ("Name", "name", "Description", "description")
DATE_NAME = r"(^|_)dates?($|_)"
DATE_PARTS = ("date", "isNa")
PERSON = ("Staff First Name", "Staff Last Name")
PERSON_MORE = {"Staff Title": "title", "Email": "email", "Phone Number": "phone"}

#: list -> (attributes as (name, kind, path), identity, what must be there). Kinds: text, raw, date, flag, person.
LISTS = {
    "participants": ([("name", "text", "Participant/Name"), ("participant_id", "raw", "Participant/ID"), ("role", "raw", "Participant Type/name"), ("country", "raw", "Participant/Country/name"), ("disposition", "raw", "Participant Disposition/name"), ("disposition_date", "date", "Participant Disposition Date"), ("active_date", "date", "Active Date"), ("inactive_date", "date", "Inactive Date"), ("is_petitioner", "flag", "Is Petitioner?")], ("name", "role"), ("name",)),
    "staff": ([("name", "person", "Staff Name"), ("role", "raw", "Staff Assigned Type/Name"), ("title", "raw", "Staff Name/Staff Title"), ("is_active", "flag", "Is Active?"), ("active_date", "date", "Staff Active Date")], ("name", "role"), ("name",)),
    "intellectual_property": ([("number", "raw", "Intellectual Property ID/Number"), ("type", "raw", "Intellectual Property ID/Type/Name"), ("expiration_date", "date", "Intellectual Property ID/IP Expiration Date"), ("active_date", "date", "Active Date"), ("inactive_date", "date", "Inactive Date")], ("type", "number"), ("number", "type")),
    "unfair_act": ([("name", "text", "Unfair Act in Notice/name"), ("is_instituted", "flag", "Is Instituted?"), ("active_date", "date", "Active Date"), ("inactive_date", "date", "Inactive Date")], ("name",), ("name",)),
    "hts_number": ([("number", "text", "HTS Number & Description/Name"), ("description", "raw", "HTS Number & Description/Description"), ("is_active", "flag", "Active")], ("number",), ("number",)),
    "historic_hts": ([("number", "text", "Historic HTS Number")], ("number",), ("number",)),
    "associated_litigation": ([("case_number", "raw", "Case Number"), ("case_name", "raw", "Case Name"), ("court", "raw", "Court Forum/Name"), ("status", "raw", "Proceeding Status/Name"), ("docketing_date", "date", "Docketing Date")], ("court", "case_number"), ()),
    "unfair_import_orders": ([("title", "text", "Order Title")], ("title",), ("title",)),
    **{name: ([("name", "text", "Name")], ("name",), ("name",)) for name in ("investigation_categories", "countries", "requestor")},
}

TEXTS = "map<string,string>"
ITEMS = f"array<{TEXTS}>"


def slug(label: Column) -> Column:
    parted = F.regexp_replace(F.replace(label, F.lit(".")), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.regexp_replace(F.regexp_replace(F.lower(parted), r"[^a-z0-9]+", "_"), "^_|_$", "")


def _members(value: Column) -> Column:
    """An object's members as a map; null for what is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: Column) -> Column:
    """A list's elements; null for what is no list."""
    return F.try_variant_get(value, "$", "array<variant>")


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _text(value: Column) -> Column:
    return F.nullif(F.trim(_string(value)), F.lit(""))


def _person(members: Column) -> Column:
    full = F.concat_ws(" ", *[_text(F.element_at(members, k)) for k in PERSON])
    return F.coalesce(F.nullif(full, F.lit("")), _text(F.element_at(members, "Name")))


def _members_of(rows: DataFrame, keys: list[str], objects: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """keys, pos, name, value, elements: the members of each row's object."""
    each = rows.select(*keys, F.posexplode(F.map_entries(objects)).alias("pos", "e"))
    named = each.select(*keys, "pos", slug(F.col("e.key")).alias("name"), F.col("e.value").alias("value"), _elements(F.col("e.value")).alias("elements"))
    return named.filter(~F.col("name").isin(*drop)) if drop else named


def _fields(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fields: the scalars among members, as a map. Of values with one name the last member's own stays, else the
    first detail's."""
    inner = F.col("inner")
    rows = members.filter("elements IS NULL").withColumn("inner", _members(F.col("value")))
    names = F.map_keys(inner)
    rows = rows.withColumn("is_date", F.coalesce(F.size(F.array_except(names, F.array(*map(F.lit, DATE_PARTS)))) == 0, F.lit(False)) & inner.isNotNull())
    rows = rows.withColumn("is_person", F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, PERSON))), F.lit(False)))
    plain = F.transform(F.filter(F.map_entries(inner), lambda m: _members(m["value"]).isNull() & _elements(m["value"]).isNull()), lambda m: F.struct(slug(m["key"]).alias("child"), m["value"].alias("value")))
    of_person = F.array(*[F.struct(F.lit(short).alias("child"), F.element_at(inner, k).alias("value")) for k, short in PERSON_MORE.items()])
    rows = rows.withColumn("plain", plain)
    shown = F.coalesce(*[F.element_at(inner, k) for k in DISPLAY], F.get(F.filter("plain", lambda m: m["child"] == F.col("name")), 0)["value"])
    text = F.when(F.col("is_date"), _string(F.element_at(inner, "date"))).when(F.col("is_person"), _person(inner)).when(inner.isNotNull(), _text(shown)).otherwise(_text(F.col("value")))
    rows = rows.withColumn("text", text)
    nothing = F.when(F.col("is_date") & F.try_variant_get(F.element_at(inner, "isNa"), "$", "boolean"), "N/A")
    own = F.when(F.col("is_date"), F.coalesce(F.substring(to_iso(F.col("text")), 1, 10), nothing)).when(F.col("name").rlike(DATE_NAME) & ~F.col("is_person"), to_iso(F.col("text"))).otherwise(F.col("text"))
    details = F.filter("plain", lambda m: ~m["child"].isin(*NOISE, *DISPLAY) & ~F.endswith(m["child"], F.lit("_id")) & (m["child"] != F.col("name")))
    children = F.when(F.col("is_person"), of_person).when(~F.col("is_date"), details)
    pairs = rows.select(*keys, "pos", "name", own.alias("own"), F.posexplode_outer(children).alias("at", "c"))
    both = pairs.select(*keys, "pos", F.coalesce("at", F.lit(0)).alias("at"), F.inline(F.array(
        F.struct(F.lit(True).alias("itself"), F.col("name"), F.col("own").alias("text")),
        F.struct(F.lit(False).alias("itself"), F.concat(F.col("name"), F.lit("_"), F.col("c.child")).alias("name"), _text(F.col("c.value")).alias("text")))))
    dated = F.when(~F.col("itself") & F.col("name").rlike(DATE_NAME), to_iso(F.col("text"))).otherwise(F.col("text"))
    told = both.withColumn("text", dated).filter("text IS NOT NULL AND name IS NOT NULL")
    turn = F.when(F.col("itself"), F.struct(F.lit(1).alias("own"), F.col("pos").alias("p"), F.col("at").alias("a"))).otherwise(F.struct(F.lit(0).alias("own"), (-F.col("pos")).alias("p"), (-F.col("at")).alias("a")))
    one = told.groupBy(*keys, "name").agg(F.max_by("text", turn).alias("text"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("fields"))  # the members of one object


def _attribute(kind: str, path: str) -> Column:
    """An attribute's text, dates as they are written."""
    item, at = F.col("item"), "$" + "".join(f"['{step}']" for step in path.split("/"))
    text = F.try_variant_get(item, at, "string")
    if kind == "flag":
        return F.coalesce(F.try_variant_get(item, at, "boolean"), F.coalesce(text, F.lit("")) != "").cast("string")
    if kind == "person":
        return _person(F.try_variant_get(item, at, "map<string,variant>"))
    return F.nullif(text if kind == "raw" else F.trim(text), F.lit(""))


def _by_list(make) -> Column:
    """An expression by the name of the known list that a row belongs to."""
    out = None
    for name, spec in LISTS.items():
        out = (F.when if out is None else out.when)(F.col("name") == name, make(name, *spec))
    return out


def _label(name: str, identity: tuple[str, ...]) -> Column:
    x = lambda k: F.element_at("x", k)
    if name == "intellectual_property":
        return F.concat_ws(" ", x("type"), x("number"))
    if name == "associated_litigation":
        return F.concat(F.concat_ws(" ", x("court"), x("case_number")), F.coalesce(F.concat(F.lit(": "), x("case_name")), F.lit("")))
    return x(identity[0])


def _known(elements: DataFrame) -> DataFrame:
    """The items of known lists: the first of each identity, without those that lack what must be there."""
    is_object = _members(F.col("item")).isNotNull()

    def read(name, attributes, identity, needed):
        whole = F.create_map(*[y for a, kind, path in attributes for y in (F.lit(a), _attribute(kind, path))])
        if needed == ("name",) and attributes[0][2] == "Name":
            return F.when(is_object, whole).otherwise(F.create_map(F.lit("name"), _text(F.col("item"))))
        return F.when(is_object, whole)

    rows = elements.withColumn("x", _by_list(read)).filter("x IS NOT NULL")
    rows = rows.withColumn("x", F.transform_values("x", lambda k, v: F.when(F.endswith(k, F.lit("_date")), to_iso(v)).otherwise(v)))
    lacks = _by_list(lambda name, attributes, identity, needed: F.coalesce(*[F.element_at("x", k) for k in needed]).isNull() if needed else F.lit(False))
    key = _by_list(lambda name, attributes, identity, needed: F.concat_ws("\u0001", *[F.lower(F.trim(F.coalesce(F.element_at("x", k), F.lit("")))) for k in identity]))
    rows = rows.filter(~lacks).withColumn("key", key)
    rows = rows.withColumn("label", _by_list(lambda name, attributes, identity, needed: _label(name, identity)))
    kept = F.map_filter("x", lambda _, v: v.isNotNull())
    place = F.struct("pos", "at")
    first = rows.select("k", "name", "key", place.alias("place"), F.map_concat(F.create_map(F.lit("label"), "label"), kept).alias("x"))
    return first.groupBy("k", "name", "key").agg(F.min("place").alias("place"), F.min_by("x", "place").alias("x")).drop("key")


def _other(elements: DataFrame) -> DataFrame:
    """The items of other lists: an object's scalars with a label, or the value as a label."""
    keys, place = ["k", "name", "pos", "at"], F.struct("pos", "at").alias("place")
    inside = elements.withColumn("o", _members(F.col("item")))
    plain = inside.filter("o IS NULL").select("k", "name", place, F.create_map(F.lit("label"), _string(F.col("item"))).alias("x")).filter("x['label'] IS NOT NULL")
    renamed = ["k", "list", "lpos", "lat"]
    members = _members_of(inside.filter("o IS NOT NULL").select(*[F.col(a).alias(b) for a, b in zip(keys, renamed)], "o"), renamed, F.col("o"), NOISE)
    fields = _fields(members, renamed)
    label = F.coalesce(*[F.element_at("fields", k) for k in ("name", "title", "number")], F.get(F.map_values("fields"), 0))
    labelled = F.map_concat(F.map_filter("fields", lambda k, _: k != "label"), F.create_map(F.lit("label"), label))
    return plain.unionByName(fields.select("k", F.col("list").alias("name"), F.struct(F.col("lpos").alias("pos"), F.col("lat").alias("at")).alias("place"), labelled.alias("x")))


def flatten(rows: DataFrame, raw: str = "row") -> DataFrame:
    """rows: one JSON text a row -> number, fields (map), lists (map of arrays of maps). Rows that are no JSON object, or
    have no number, go; a row that is there several times stays several times."""
    text = F.col(raw).cast("string")
    parsed = rows.select(F.md5(text).alias("k"), _members(F.try_parse_json(text)).alias("m")).filter("m IS NOT NULL")
    numbered = parsed.withColumn("number", F.trim(_string(F.element_at("m", "Investigation Number")))).filter("number <> ''")
    times = numbered.groupBy("k", "number").agg(F.count(F.lit(1)).alias("times"))
    members = _members_of(numbered, ["k"], F.col("m"))
    listed = members.filter("elements IS NOT NULL").select("k", "name", "pos", F.posexplode("elements").alias("at", "item"))
    known = F.col("name").isin(*LISTS)
    items = _known(listed.filter(known)).unionByName(_other(listed.filter(~known)))
    held = items.groupBy("k", "name", "place").agg(F.min_by("x", "place").alias("x"))  # rows that are there several times
    gathered = held.groupBy("k", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.map_entries("x").alias("x")))), lambda y: F.map_from_entries(y["x"])).alias("items"))
    lists = gathered.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("lists"))
    both = times.join(_fields(members, ["k"]), "k", "left").join(lists, "k", "left")
    out = both.select("number", F.coalesce("fields", F.create_map().cast(TEXTS)).alias("fields"), F.coalesce("lists", F.create_map().cast(f"map<string,{ITEMS}>")).alias("lists"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n"))
    return out.drop("n")
