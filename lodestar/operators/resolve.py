"""Entity resolution: spellings to keys, candidate pairs, verdicts, merging with vetoes, entities.

Every step is a DataFrame plan over distinct keys. Rules and answers give edges and pairs that must stay apart; groups
are the components of the edges (graph.merge); what no rule decides is a question, and answers to questions come back
as a table, for a second round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.names import company_core, company_form, company_key, company_names, compatible, firm_key, has_suffix, numbered, person
from lodestar.functions.similarity import compare_udf, indel_udf
from lodestar.operators.graph import merge, settled

#: How sure an answer must be, and for a company pair with a word added; and when two attorneys of one firm
#: are one with a typo.
SURE, SURER = 0.85, 0.95
TYPO_NAME, TYPO_SURNAME = 92.0, 80.0

#: What a filer's name says about its kind.
GOVERNMENT = (
    r"(?i)\b(united states|u\.?s\.? (?:department|house|senate|customs|patent|food)|department of|(?<!law )office of|"
    r"commission|congress|senate|house of representatives|court of|state of|embassy|bureau|"
    r"administration|agency|attorney general)\b"
)
ORGANIZATION = (
    r"(?i)\b(association|alliance|coalition|council|chamber|foundation|institute|university|college|"
    r"school|society|federation|cooperative|project|club|hospital|center|centre)\b"
)
LAW = r"(?i)\b(law|legal|attorneys?|counsel|lawyers?|patent)\b"
ENDS_AS_COMPANY = r"(?i)\b(inc|corp|corporation|ltd|limited|co|gmbh|ag)\b\.?,?\s*$"
LAW_SUFFIX = r"(?i)\b(?:L\.?\s?L\.?\s?P|P\.?\s?L\.?\s?L\.?\s?C|P\.\s?C|PC|P\.\s?A|PLC|Chtd)\.?(?=[\s,;)]|$)"
PARTNERS_LTD = r"(?i)(&|\band\b|associates).*\bltd\b\.?\s*$"

EDGES = "a string, b string, rule string, detail string, phase int"
APART = "a string, b string"
DECISIONS = "id string, answer string, confidence double"


def candidate_pairs(keys: DataFrame, cutoff: float = 85.0, q: int = 2) -> DataFrame:
    """a < b: pairs of distinct keys (column key) whose Indel ratio is at least the cutoff, with the ratio.

    A pair that near shares so many q-grams that the rarest grams of both must meet, and has lengths that close. How
    many edits a ratio allows goes by the longest partner a key may have. Both bounds are lossless: no pair is missed,
    and none is formed that shares no rare gram."""
    share = 1 - cutoff / 100
    named = keys.select("key").filter("key IS NOT NULL").distinct().withColumn("n", F.length("key"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - (q - 1), F.lit(1)))
    grams = named.select("key", "n", F.explode(F.transform(starts, lambda i: F.substring(F.col("key"), i, F.lit(q)))).alias("g"))
    nth = F.row_number().over(Window.partitionBy("key", "g").orderBy("n"))
    grams = grams.withColumn("g", F.concat_ws("#", "g", nth.cast("string")))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "g"))
    longest = F.floor(F.col("n") * (2 / (1 - share) - 1) + 1e-9)
    need = F.col("n") - (q - 1) - q * F.floor(share * (F.col("n") + longest) + 1e-9)
    prefix = grams.join(rarity, "g").withColumn("r", rank).filter(F.col("r") <= F.col("n") - (q - 1) - F.greatest(need, F.lit(1)) + 1).select("key", "n", "g")
    a, b = prefix.select("g", F.col("key").alias("a"), F.col("n").alias("na")), prefix.select("g", F.col("key").alias("b"), F.col("n").alias("nb"))
    near = F.least("na", "nb") * (1 + share) >= F.greatest("na", "nb") * (1 - share)
    met = a.join(b, "g").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    # written down, else the ratio goes below the distinct and is computed once for each gram that two keys share; dealt by
    # number, as few bytes take much computing here
    met = settled(met.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b"), "met")
    return met.withColumn("ratio", indel_udf("a", "b")).filter(F.col("ratio") >= cutoff)


def question_id(kind: str) -> Column:
    """Id of the question whether keys a and b are one."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(kind), F.least("a", "b"), F.greatest("a", "b"))), 1, 16)


@dataclass
class Resolution:
    """roots: key, root. merges: a, b, rule, detail, of merges that hold. review: id, kind, a, b, detail, of questions
    that no rule and no answer settles."""

    roots: DataFrame
    merges: DataFrame
    review: DataFrame


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _edges(pairs: DataFrame, rule: str, phase: int, detail: Column | None = None) -> DataFrame:
    return pairs.select("a", "b", F.lit(rule).alias("rule"), (detail if detail is not None else F.lit("")).alias("detail"), F.lit(phase).alias("phase"))


def settle(kind: str, judged: DataFrame, decisions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, pairs apart, open questions) from judged pairs (a, b, verdict, detail): a typo merges; a question goes by
    its answer, if one was given with enough confidence."""
    spark = judged.sparkSession
    asked = judged.filter("verdict IN ('typo', 'review')").withColumn("id", question_id(kind))
    told = asked.join(decisions if decisions is not None else _none(spark, DECISIONS), "id", "left")
    surely = F.when((F.lit(kind) == "company") & (F.col("detail") == "a word added or dropped"), SURER).otherwise(SURE)
    same = (F.col("answer") == "same") & (F.col("confidence") >= surely)
    different = (F.col("answer") == "different") & (F.col("confidence") >= SURE)
    says = F.when(F.col("verdict") == "typo", "typo").when(same, "same").when(different, "different").otherwise("open")
    told = settled(told.select("id", "a", "b", "detail", says.alias("says")), f"{kind}-pairs")
    edges = _edges(told.filter("says = 'typo'"), "typo", 1, F.col("detail")).union(_edges(told.filter("says = 'same'"), "review", 1, F.col("detail")))
    return edges, told.filter("says = 'different'").select("a", "b"), told.filter("says = 'open'").select("id", F.lit(kind).alias("kind"), "a", "b", "detail")


def resolution(nodes: DataFrame, edges: DataFrame, apart: DataFrame, open_: DataFrame) -> Resolution:
    """Groups of keys (nodes: key), and the questions left: those between groups that are not kept apart."""
    edges = settled(edges.filter("a <> b").distinct(), "merges")
    roots = settled(merge(nodes.select(F.col("key").alias("node")), edges, apart).withColumnsRenamed({"node": "key"}), "roots")
    of = lambda c: roots.select(F.col("key").alias(c), F.col("root").alias(f"r{c}"))
    ends = lambda df: df.join(of("a"), "a").join(of("b"), "b")
    held = ends(edges).filter("ra = rb").select("a", "b", "rule", "detail")
    parted = ends(apart.select("a", "b")).select(F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi")).distinct()
    asked = ends(open_).filter("ra <> rb").withColumn("lo", F.least("ra", "rb")).withColumn("hi", F.greatest("ra", "rb")).join(parted, ["lo", "hi"], "left_anti")
    return Resolution(roots, held, asked.select("id", "kind", "a", "b", "detail"))


def two_rounds(resolve: Callable[[DataFrame | None], tuple[DataFrame, Resolution]], ask: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, most: int = 300) -> tuple[DataFrame, Resolution]:
    """Rules, then answers to what they leave open, then rules again with the answers. ask: questions (id, kind, a, b,
    detail), at most `most` of them in the order of their ids, -> id, answer, confidence; known: answers given before."""
    _, first = resolve(known)
    answers = ask(first.review.orderBy("id").limit(most)).select("id", "answer", "confidence")
    return resolve(answers if known is None else known.select("id", "answer", "confidence").join(answers.select("id"), "id", "left_anti").unionByName(answers))


def pair_context(review: DataFrame, seen: DataFrame) -> DataFrame:
    """What a person needs to answer each question: by side the spellings, cases, firms and years of the key. seen: key,
    spelling, case_id and, where there are any, firm and year."""
    has = set(seen.columns)
    told = seen.groupBy("key").agg(
        F.array_sort(F.collect_set("spelling")).alias("spellings"), F.count_distinct("case_id").alias("cases"),
        F.array_sort(F.collect_set("firm") if "firm" in has else F.collect_set(F.lit(None).cast("string"))).alias("firms"),
        (F.min("year") if "year" in has else F.lit(None).cast("int")).alias("first_year"), (F.max("year") if "year" in has else F.lit(None).cast("int")).alias("last_year"),
    )
    side = lambda c: told.select(F.col("key").alias(c), F.struct(*[x for x in told.columns if x != "key"]).alias(f"about_{c}"))
    return review.join(side("a"), "a").join(side("b"), "b").select("id", "kind", "a", "b", "detail", "about_a", "about_b")


# ---- firms


def fragment_pairs(keyed: DataFrame) -> DataFrame:
    """short, long: keys of two words or more that end another, all of whose cases are that one's. keyed: key, case_id."""
    held = keyed.select("key", "case_id").distinct()
    keys = held.select("key").distinct()
    parts = F.split("key", " ")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), " "))
    longer = keys.filter(F.size(parts) > 2).select(F.col("key").alias("long"), F.explode(ends).alias("short"))
    pairs = longer.join(keys.select(F.col("key").alias("short")), "short").filter(F.size(F.split("short", " ")) > 1)
    apart = pairs.join(held.select(F.col("key").alias("short"), "case_id"), "short").join(held.select(F.col("key").alias("long"), "case_id"), ["long", "case_id"], "left_anti")
    return pairs.join(apart.select("short", "long").distinct(), ["short", "long"], "left_anti")


def short_forms(roots: DataFrame) -> DataFrame:
    """short, long: names that begin just one group's name, two words or more longer. roots: key, root."""
    names = roots.select("root").distinct()
    parts = F.split("root", " ")
    begins = F.transform(F.sequence(F.lit(2), F.size(parts) - 2), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    longer = names.filter(F.size(parts) > 3).select(F.col("root").alias("long"), F.explode(begins).alias("short"))
    return longer.join(names.select(F.col("root").alias("short")), "short").groupBy("short").agg(F.min("long").alias("long"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("short", "long")


def spellings_of(seen: DataFrame) -> DataFrame:
    """The distinct spellings, written down before any key is made of them.

    Else the filter on the key goes below the distinct and into the joins of seen, and the key is made for every row."""
    return settled(seen.select("spelling").distinct(), "spellings")


def keyed_by(seen: DataFrame, key: Column) -> DataFrame:
    """seen with the key of its spelling, computed once for each spelling; rows without a key go."""
    keys = settled(spellings_of(seen).withColumn("key", key), "keys").filter("key <> ''")
    return settled(seen.join(keys, "spelling"), "keyed")  # read several times


def entities(seen: DataFrame, found: Resolution, prefix: str) -> DataFrame:
    """id, root, name, keys, cases, spellings: one row an entity. seen: key, spelling, case_id, ord.

    The name is the spelling seen most that is not all lower case, the first of equals; ids come from the name's
    slug, with -2 for each that is taken, in the order of the roots."""
    of = seen.join(found.roots, "key")
    per = of.groupBy("root", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    named = per.groupBy("root").agg(F.max_by("spelling", F.struct((F.col("spelling") != F.lower("spelling")).alias("cased"), "n", -F.col("ord"))).alias("name"), F.array_sort(F.collect_set("spelling")).alias("spellings"))
    keys = of.select("root", "key").distinct().groupBy("root").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    held = of.groupBy("root").agg(F.count_distinct("case_id").alias("cases"))  # by itself: beside it a set would be kept for each case
    both = numbered(named.join(held, "root").join(keys, "root"), "name", "root")
    return both.select(F.concat(F.lit(f"{prefix}:"), "slug").alias("id"), "root", "name", "keys", "cases", "spellings")


def resolve_firms(spark: SparkSession, seen: DataFrame, decisions: DataFrame | None = None, apart: DataFrame | None = None, given: DataFrame | None = None) -> tuple[DataFrame, Resolution]:
    """seen: spelling, case_id, ord; apart, given: pairs of keys a, b that a person set apart or together."""
    keyed = keyed_by(seen, firm_key(F.col("spelling")))
    nodes = keyed.select("key").distinct()
    v = compare_udf("a", "b")
    judged = candidate_pairs(nodes).withColumn("v", v).select("a", "b", "v.verdict", "v.detail")
    edges, kept, open_ = settle("firm", judged, decisions)
    kept = kept.union(apart.select("a", "b")) if apart is not None else kept
    edges = edges.union(_edges(given, "given", 0)) if given is not None else edges
    first = merge(nodes.withColumnRenamed("key", "node"), edges, kept).withColumnRenamed("node", "key")
    shorter = _edges(short_forms(first).select(F.col("short").alias("a"), F.col("long").alias("b")), "short form", 2)
    ends = _edges(fragment_pairs(keyed).select(F.col("short").alias("a"), F.col("long").alias("b")), "fragment", 3)
    found = resolution(nodes, edges.union(shorter).union(ends), kept, open_)
    return entities(keyed, found, "firm"), found


def kinds(firms: DataFrame, parties: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """id, kind of each firm entity (id, name, spellings): law_firm, self_represented, government, organization or
    company. parties: firm, name, of the parties each acts for; forced: key, kind, set by a person.

    A filer acts for itself if a party has its name, or, where it is named like a company, its family's."""
    core = F.regexp_replace(company_core(F.col("name")), " .*", "")
    text = F.array_join("spellings", " ")
    suffix = F.exists("spellings", has_suffix)
    law = (text.rlike(LAW) & ~text.rlike(GOVERNMENT)) | F.exists("spellings", lambda s: s.rlike(LAW_SUFFIX) | s.rlike(PARTNERS_LTD))
    named = firms.select("id", "name", text.alias("text"), suffix.alias("suffix"), law.alias("law"), firm_key(F.col("name")).alias("key"))
    family = F.when(F.col("name").rlike(ENDS_AS_COMPANY) & ~F.col("suffix") & (F.length(core) > 1), core)
    named = named.withColumn("family", family)
    acts = parties.select(F.col("firm").alias("id"), company_core(F.col("name")).alias("core"), F.regexp_replace(company_core(F.col("name")), " .*", "").alias("family_of")).distinct()
    own = named.join(acts, "id").filter((F.col("core") == F.col("key")) | (F.col("family") == F.col("family_of"))).select("id", F.lit(True).alias("itself")).distinct()
    kind = (
        F.when(F.col("law"), "law_firm").when(F.col("itself"), "self_represented").when(F.col("text").rlike(GOVERNMENT), "government")
        .when(F.col("text").rlike(ORGANIZATION) & ~F.col("suffix"), "organization").when(F.col("name").rlike(ENDS_AS_COMPANY) & ~F.col("suffix"), "company").otherwise("law_firm")
    )
    out = named.join(own, "id", "left").select("id", "key", kind.alias("kind"))
    if forced is not None:
        out = out.join(forced.select("key", F.col("kind").alias("set")), "key", "left").withColumn("kind", F.coalesce("set", "kind"))
    return out.select("id", "kind")


def successions(links: DataFrame, roots: DataFrame) -> DataFrame:
    """predecessor, successor: pairs of roots, from names a person linked (predecessor, successor); links within one
    entity, or to names that are none, go. roots: key, root."""
    of = lambda c: roots.select(F.col("key").alias(f"k_{c}"), F.col("root").alias(f"r_{c}"))
    keyed = links.select(firm_key(F.col("predecessor")).alias("k_p"), firm_key(F.col("successor")).alias("k_s"))
    return keyed.join(of("p"), "k_p").join(of("s"), "k_s").filter("r_p <> r_s").select(F.col("r_p").alias("predecessor"), F.col("r_s").alias("successor")).distinct()


# ---- companies


def resolve_companies(spark: SparkSession, seen: DataFrame, decisions: DataFrame | None = None, apart: DataFrame | None = None, given: DataFrame | None = None) -> tuple[DataFrame, Resolution]:
    """Companies merge by key, by a former name, and as typos within one corporate form."""
    # each step is written down, else the next takes in its expressions once for each mention
    named = settled(spellings_of(seen).withColumn("c", company_names(F.col("spelling"))), "company-names")
    spellings = settled(named.withColumn("key", company_key(F.col("c.primary"))), "company-spellings").filter("key <> ''")
    keyed = settled(seen.join(spellings.select("spelling", "key"), "spelling"), "keyed")
    nodes = settled(spellings.select("key", company_core(F.col("c.primary")).alias("core"), company_form(F.col("c.primary")).alias("form")).distinct(), "company-keys")
    former = spellings.select("key", F.explode("c.former").alias("f")).withColumn("old", company_key(F.col("f"))).join(nodes.select(F.col("key").alias("old")), "old").filter("old <> key")
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("core").alias(f"core_{c}"), F.col("form").alias(f"form_{c}"))
    pairs = candidate_pairs(nodes).join(side("a"), "a").join(side("b"), "b").filter("form_a = form_b")
    judged = pairs.withColumn("v", compare_udf("core_a", "core_b")).select("a", "b", "v.verdict", "v.detail")
    edges, kept, open_ = settle("company", judged, decisions)
    kept = kept.union(apart.select("a", "b")) if apart is not None else kept
    edges = edges.union(_edges(given, "given", 0)) if given is not None else edges
    edges = edges.union(_edges(former.select(F.col("key").alias("a"), F.col("old").alias("b")), "former name", 0))
    found = resolution(nodes.select("key"), edges, kept, open_)
    return entities(keyed, found, "company"), found


# ---- attorneys


def alike(people: DataFrame) -> DataFrame:
    """a < b: pairs of names of one surname that may be one person. people: key, p (struct of names.person).

    Names meet by surname and first name, and an initial with the names it may stand for: no pair is formed of names
    whose first names differ."""
    named = people.select("key", "p", F.col("p.last").alias("last"), F.col("p.first").alias("first"))
    side = lambda df, c: df.select("last", "at", F.col("key").alias(c), F.col("p").alias(f"p{c}"))
    full = named.withColumn("at", F.col("first"))
    short = named.filter(F.length("first") == 1).withColumn("at", F.col("first"))
    long = named.filter(F.length("first") > 1).withColumn("at", F.substring("first", 1, 1))
    same = side(full, "x").join(side(full, "y"), ["last", "at"]).filter("x < y")
    initial = side(short, "x").join(side(long, "y"), ["last", "at"])
    met = same.unionByName(initial).filter(compatible(F.col("px"), F.col("py")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def resolve_attorneys(spark: SparkSession, seen: DataFrame, decisions: DataFrame | None = None, apart: DataFrame | None = None, given: DataFrame | None = None) -> tuple[DataFrame, Resolution]:
    """seen: spelling, case_id, firm, ord. Of names that may be one person, those that share a firm merge; so do those
    where every name of the surname that either first name fits may be both; so do those with equal middle names; any
    other pair is a question. Names of one firm that a typo in the surname sets apart merge."""
    p = F.col("p")
    spellings = settled(spellings_of(seen).withColumn("p", person(F.col("spelling"))), "person-names").filter("p IS NOT NULL")
    spellings = spellings.withColumn("key", F.array_join(F.concat(F.array(p["first"]), p["middles"], F.array(p["last"])), " "))
    keyed = settled(seen.join(spellings, "spelling"), "keyed")
    people = settled(keyed.groupBy("key").agg(F.first("p").alias("p"), F.array_sort(F.collect_set("firm")).alias("firms")), "people")
    near = settled(alike(people), "alike")
    both = near.union(near.select("b", "a")).toDF("a", "b")
    # around a name: those it may be, and how many names its first name fits, which a clash makes more
    around = both.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near"))
    initial = F.substring(p["first"], 1, 1)
    base = people.select("key", p["last"].alias("last"), p["first"].alias("first"), initial.alias("i"), (F.length(p["first"]) == 1).alias("lone"))
    by_first = base.groupBy("last", "first").agg(F.count(F.lit(1)).alias("n_first"))
    by_initial = base.groupBy("last", "i").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("lone").alias("n_lone"))
    fits = base.join(by_first, ["last", "first"]).join(by_initial, ["last", "i"])
    fits = fits.select("key", F.when(F.col("lone"), F.col("n_all")).otherwise(F.col("n_first") + F.col("n_lone")).alias("fits"))
    told = people.join(fits, "key").join(around.withColumnRenamed("a", "key"), "key", "left")
    side = lambda c: told.select(F.col("key").alias(c), F.col("p").alias(f"p{c}"), F.col("firms").alias(f"f{c}"), F.col("fits").alias(f"n{c}"), F.col("near").alias(f"near{c}"))
    pairs = near.join(side("a"), "a").join(side("b"), "b")
    # every name that a's first name fits may be a (as many near as fit, itself apart), and all of those may be b
    no_clash = (F.size("neara") == F.col("na") - 1) & (F.size(F.array_except("neara", F.concat("nearb", F.array("b")))) == 0)
    middles = (F.size("pa.middles") > 0) & (F.col("pa.middles") == F.col("pb.middles"))
    rule = F.when(F.arrays_overlap("fa", "fb"), "same firm").when(no_clash, "one person by name").when(middles, "same middle names")
    ruled = settled(pairs.select("a", "b", rule.alias("rule")), "attorney-pairs")
    judged = ruled.filter("rule IS NULL").select("a", "b", F.lit("review").alias("verdict"), F.lit("same surname").alias("detail"))
    edges, kept, open_ = settle("attorney", judged, decisions)
    kept = kept.union(apart.select("a", "b")) if apart is not None else kept
    edges = edges.union(_edges(given, "given", 0)) if given is not None else edges
    edges = edges.union(ruled.filter("rule IS NOT NULL").select("a", "b", "rule", F.lit("").alias("detail"), F.lit(1).alias("phase")))
    # typos within one firm
    close = candidate_pairs(people, TYPO_NAME).select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("fa", "fb"))
    close = close.filter((F.col("pa.last") != F.col("pb.last")) & (F.substring("pa.first", 1, 1) == F.substring("pb.first", 1, 1)))
    typo = close.select("a", "b", F.col("pa.last").alias("la"), F.col("pb.last").alias("lb")).withColumn("r", indel_udf("la", "lb")).filter(F.col("r") >= TYPO_SURNAME)
    edges = edges.union(_edges(typo, "typo", 2, F.concat_ws("/", "la", "lb")))
    found = resolution(people.select("key"), edges, kept, open_)
    return entities(keyed, found, "attorney"), found


def represented(reps: DataFrame, firms: DataFrame, attorneys: DataFrame, companies: DataFrame) -> DataFrame:
    """Representations with the ids of all three kinds: reps (case_id, firm_key, firm, attorneys array, parties array of
    name, role) -> case_id, firm_key, firm_id, attorney_ids, party_ids. firms, attorneys, companies: entities (id, keys);
    what no entity knows is left out."""
    table = lambda e, c: e.select(F.col("id").alias(c), F.explode("keys").alias("key"))
    base = reps.join(table(firms, "firm_id").withColumnRenamed("key", "firm_key"), "firm_key", "left")
    p = person(F.col("x"))
    name = F.array_join(F.concat(F.array(p["first"]), p["middles"], F.array(p["last"])), " ")
    people = reps.select("case_id", "firm_key", F.explode("attorneys").alias("x")).withColumn("key", name).join(table(attorneys, "i"), "key").groupBy("case_id", "firm_key").agg(F.array_sort(F.collect_set("i")).alias("attorney_ids"))
    sides = reps.select("case_id", "firm_key", F.explode("parties.name").alias("x")).withColumn("key", company_key(company_names(F.col("x"))["primary"])).join(table(companies, "i"), "key").groupBy("case_id", "firm_key").agg(F.array_sort(F.collect_set("i")).alias("party_ids"))
    none = F.array().cast("array<string>")
    both = base.join(people, ["case_id", "firm_key"], "left").join(sides, ["case_id", "firm_key"], "left")
    return both.select("case_id", "firm_key", "firm_id", F.coalesce("attorney_ids", none).alias("attorney_ids"), F.coalesce("party_ids", none).alias("party_ids"))
