"""Queries that run the domain operators over the driver tables, read as in README's table of stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.claims import sentences
from lodestar.functions.names import company_key, firm_key, person
from lodestar.operators import bundle, cases, counsel, docket, evidence, fields, matrix, resolve, summary
from lodestar.operators.calendar import business_days, period_end
from lodestar.operators.flatten import flatten
from lodestar.operators.graph import scratch
from lodestar.plans.registry import frame_query
from lodestar.session import ship, table
from lodestar.sinks import tables
from lodestar.streaming import incremental


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as feed rows, an order's priority its phase and its customer the complainant."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda x, key="Name": F.struct(x.alias(key))
    party = F.struct(F.struct(F.col("c_name").alias("Name"), F.col("c_custkey").alias("ID")).alias("Participant"), name(F.lit("Complainant"), "name").alias("Participant Type"), (F.col("c_custkey") % 2 == 0).alias("Is Petitioner?"))
    row = F.struct(
        F.concat(F.lit("337-"), F.col("o_orderkey")).alias("Investigation Number"), F.col("o_orderkey").alias("Investigation ID"), name(F.when(F.col("o_orderpriority") < "3", "Violation").otherwise("Remand")).alias("Investigation Phase"),
        name(F.col("o_orderstatus")).alias("Investigation Status"), F.date_format("o_orderdate", "MM-dd-yyyy").alias("Start Date"), F.concat(F.lit("Certain Goods; Inv. No. "), F.col("o_orderkey")).alias("Full Title"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(False).alias("isNa")).alias("Target Date"), F.array(party, party).alias("Participants"),
    )
    return o.join(c, o.o_custkey == c.c_custkey).select(F.to_json(row).alias("row"))


def case_records(spark, sf_dir):
    """Feed rows flattened and folded into cases, and fields of them by declarative specs."""
    ship(spark)
    folded = cases.fold(flatten(_feed(spark, sf_dir)))
    specs = [fields.Field.from_dict(x) for x in ({"source": "title"}, {"source": "target_date"}, {"source": "participants", "where": {"role": "complainant"}}, {"source": "investigation_status", "stage": "current"})]
    got = fields.project(folded, specs, keep=("phase", "date_initiated", "stage_count"))
    return got.toDF("number", "phase", "date_initiated", "stage_count", "title", "target_date", "complainants", "status").withColumn("stage_count", F.col("stage_count").cast("int"))


frame_query("case_records", case_records, """
SELECT concat('337-', CAST(o_orderkey AS STRING)) AS number, 'Certain Goods' AS title, strftime(o_orderdate, '%Y-%m-%d') AS target_date, c_name AS complainants, o_orderstatus AS status,
  CASE WHEN o_orderpriority < '3' THEN 'Violation' ELSE 'Remand' END AS phase, strftime(o_orderdate, '%Y-%m-%d') AS date_initiated, 1 AS stage_count
FROM orders JOIN customer ON c_custkey = o_custkey""")


def participants_of_cases(spark, sf_dir):
    ship(spark)
    return cases.participants(cases.fold(flatten(_feed(spark, sf_dir)))).select("number", "name", "role")


frame_query("participants_of_cases", participants_of_cases, """
SELECT concat('337-', CAST(o_orderkey AS STRING)) AS number, c_name AS name, 'Complainant' AS role FROM orders JOIN customer ON c_custkey = o_custkey""")


def _spellings(spark, sf_dir):
    """Firm names of parts and suppliers in several spellings, with a dropped letter here and there."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    bare = F.initcap(F.concat_ws(" ", "p_name", F.lower("p_type")))
    variant = F.element_at(F.array(F.concat(bare, F.lit(" LLP")), F.upper(bare), F.concat(bare, F.lit(", P.C.")), F.regexp_replace(bare, "dget", "gdet"), F.concat(F.lit("The "), bare)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return l.join(p, l.l_partkey == p.p_partkey).select(variant.alias("spelling"), F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_orderkey").alias("ord"))


def firm_keys(spark, sf_dir):
    """Distinct spellings and their keys."""
    ship(spark)
    return _spellings(spark, sf_dir).select("spelling").distinct().withColumn("firm_key", firm_key(F.col("spelling"))).withColumn("company_key", company_key(F.col("spelling")))


frame_query("firm_keys", firm_keys)


def similar_firm_pairs(spark, sf_dir):
    """Pairs of firm keys with an Indel ratio of 85 or more."""
    ship(spark)
    keys = _spellings(spark, sf_dir).select("spelling").distinct().withColumn("key", firm_key(F.col("spelling")))
    return resolve.candidate_pairs(keys).withColumn("ratio", F.round("ratio", 6))


frame_query("similar_firm_pairs", similar_firm_pairs)


def firm_entities(spark, sf_dir):
    """Firm spellings merged into entities."""
    ship(spark)
    ents, _ = resolve.resolve_firms(spark, _spellings(spark, sf_dir))
    return ents.select("id", "name", F.size("spellings").alias("spellings"), "cases")


frame_query("firm_entities", firm_entities)


def person_names(spark, sf_dir):
    ship(spark)
    n = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("name")).distinct()
    return n.withColumn("p", person(F.col("name"))).select("name", F.col("p.first").alias("first"), F.array_join("p.middles", " ").alias("middles"), F.col("p.last").alias("last"))


frame_query("person_names", person_names, """
WITH n AS (SELECT DISTINCT concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS name FROM part)
SELECT name, lower(split_part(name, ' ', 1)) AS first, '' AS middles, lower(split_part(name, ' ', 2)) AS last FROM n""")


def _claim_events(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    action = F.when(F.col("l_returnflag") == "N", "instituted").when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "A", "found_infringed").otherwise("found_not_infringed")).otherwise(F.when(F.col("l_returnflag") == "A", "withdrawn").otherwise("found_invalid"))
    stage = F.when(F.col("l_returnflag") == "N", "instituted").when(F.col("l_linestatus") == "O", "final_id").otherwise("hearing")
    key = F.xxhash64("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    return l.select(F.col("l_suppkey").cast("string").alias("case_id"), key.cast("string").alias("id"), F.pmod(key, F.lit(1 << 30)).cast("int").alias("ord"), action.alias("action"), stage.alias("stage"), F.lit("tribunal_ruling").alias("speaker"), F.concat(F.lit("p"), F.col("l_orderkey") % 3).alias("patent"),
                    F.array((F.col("l_partkey") % 20).cast("int")).alias("claims"), F.array(F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("R"), F.col("l_orderkey") % 2)).otherwise("ALL")).alias("respondents"), F.lit("ok").alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("effective_date"), F.lit(None).cast("string").alias("sentence"), F.lit(False).alias("case_wide"))


def _respondents(spark, sf_dir):
    """Two respondents a case; every third line of an order names one of them."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"), F.array(F.lit("R0"), F.lit("R1")).alias("respondents"))


def claims_matrix(spark, sf_dir):
    """Claims by stage after all events, a supplier's lines the events of a case."""
    ship(spark)
    return matrix.wide(matrix.matrix(_claim_events(spark, sf_dir), _respondents(spark, sf_dir)))


frame_query("claims_matrix", claims_matrix)


def claims_matrix_counts(spark, sf_dir):
    ship(spark)
    return matrix.counts(matrix.matrix(_claim_events(spark, sf_dir), _respondents(spark, sf_dir)))


frame_query("claims_matrix_counts", claims_matrix_counts)


def claim_contradictions(spark, sf_dir):
    """Rulings on claims that have left the case or were never instituted, counted by case."""
    events = _claim_events(spark, sf_dir)
    return matrix.contradictions(events).join(events.select("id", "case_id"), "id").groupBy("case_id", "note").agg(F.count(F.lit(1)).alias("n"))


frame_query("claim_contradictions", claim_contradictions)


#: What each kind of event stands for on a docket: the document's type and title.
FILINGS = {
    "view": ("Notice", "Determination Not to Review an Initial Determination Terminating the Investigation as to Certain Respondents"),
    "click": ("Order", "Order Staying the Case for Ten Days"),
    "purchase": ("Order", "Order Lifting the Stay"),
    "signup": ("ID/RD - Other Than Final on Violation", "Initial Determination Terminating the Investigation as to Acme Based on Settlement"),
    "error": ("Order", "Order Extending the Target Date"),
}


def _filings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in FILINGS.items() for x in (k, v[i])]), F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("case_id"), F.format_string("%09d", "event_id").alias("id"), of(0).alias("document_type"), of(1).alias("title"), F.col("ts").cast("date").alias("day"), (F.col("event_id") % 2 == 0).alias("public"))


_EVENTS = "f AS (SELECT CAST(user_id AS STRING) AS case_id, printf('%09d', event_id) AS id, CAST(ts AS DATE) AS day, event_type, event_id % 2 = 0 AS public FROM events)"


def case_history(spark, sf_dir):
    """Events of each case's docket, versions of one event together."""
    ship(spark)
    return docket.versions(_filings(spark, sf_dir)).select("case_id", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "first_id", "link", "versions")


frame_query("case_history", case_history, f"""
WITH RECURSIVE {_EVENTS},
e AS (SELECT *, CASE event_type WHEN 'view' THEN 'not_reviewed' ELSE 'termination' END AS kind FROM f WHERE event_type IN ('view', 'signup') AND day IS NOT NULL),
r(case_id, kind, first) AS (SELECT case_id, kind, min(day) FROM e GROUP BY case_id, kind
  UNION ALL SELECT r.case_id, r.kind, min(e.day) FROM r JOIN e ON e.case_id = r.case_id AND e.kind = r.kind AND e.day > r.first + 60 GROUP BY r.case_id, r.kind, r.first),
m AS (SELECT e.*, r.first FROM e JOIN r ON r.case_id = e.case_id AND r.kind = e.kind AND e.day BETWEEN r.first AND r.first + 60)
SELECT case_id, kind, strftime(min(day), '%Y-%m-%d') AS day, split_part(min(strftime(day, '%Y-%m-%d') || '|' || id), '|', 2) AS first_id,
  coalesce(split_part(max(CASE WHEN public THEN strftime(day, '%Y-%m-%d') || '|' || id END), '|', 2), split_part(min(strftime(day, '%Y-%m-%d') || '|' || id), '|', 2)) AS link, CAST(count(*) AS BIGINT) AS versions
FROM m GROUP BY case_id, kind, first""")


def stays_now(spark, sf_dir):
    return docket.whole_stays(_filings(spark, sf_dir), "2024-01-20").select("case_id", F.date_format("since", "yyyy-MM-dd").alias("since"), F.date_format("until", "yyyy-MM-dd").alias("until"), "extended", "active", "ended")


frame_query("stays_now", stays_now, f"""
WITH {_EVENTS},
s AS (SELECT case_id, day FROM f WHERE event_type = 'click' AND day IS NOT NULL), l AS (SELECT case_id, day FROM f WHERE event_type = 'purchase' AND day IS NOT NULL),
t AS (SELECT case_id, max(day) AS latest FROM s GROUP BY case_id),
b AS (SELECT t.case_id, t.latest, max(CASE WHEN l.day <= t.latest THEN l.day END) AS before, coalesce(max(CASE WHEN l.day >= t.latest THEN 1 ELSE 0 END), 0) = 1 AS lifted FROM t LEFT JOIN l ON l.case_id = t.case_id GROUP BY t.case_id, t.latest),
r AS (SELECT b.*, s.day FROM b JOIN s ON s.case_id = b.case_id AND (b.before IS NULL OR s.day >= b.before)),
x AS (SELECT case_id, min(day) AS since, latest + 10 AS until, count(*) > 1 AS extended, CASE WHEN lifted THEN 'lifted' WHEN latest + 10 < DATE '2024-01-20' THEN concat('ran to ', strftime(latest + 10, '%Y-%m-%d')) END AS ended FROM r GROUP BY case_id, latest, lifted)
SELECT case_id, strftime(since, '%Y-%m-%d') AS since, strftime(until, '%Y-%m-%d') AS until, extended, ended IS NULL AS active, ended FROM x""")


def final_exits(spark, sf_dir):
    """Who left each case, and whether that is final."""
    return docket.final_exits(_filings(spark, sf_dir)).select("case_id", "id", "who", "how", F.date_format("day", "yyyy-MM-dd").alias("day"), "final")


frame_query("final_exits", final_exits, f"""
WITH {_EVENTS},
t AS (SELECT case_id, id, day, row_number() OVER (PARTITION BY case_id ORDER BY day, id) AS n FROM f WHERE event_type = 'signup' AND day IS NOT NULL)
SELECT t.case_id, t.id, 'Acme' AS who, 'terminated' AS how, strftime(t.day, '%Y-%m-%d') AS day, count(v.id) > 0 AS final
FROM t LEFT JOIN f v ON v.case_id = t.case_id AND v.event_type = 'view' AND v.day - t.day BETWEEN 0 AND 90 WHERE t.n = 1 GROUP BY t.case_id, t.id, t.day""")


def schedule_readings(spark, sf_dir):
    """Documents that set a case's dates: here the latest public order that moves the target date."""
    return docket.schedule_documents(_filings(spark, sf_dir)).select("case_id", "id", F.date_format("day", "yyyy-MM-dd").alias("day"))


frame_query("schedule_readings", schedule_readings, f"""
WITH {_EVENTS}
SELECT case_id, id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY day DESC, id DESC) AS n FROM f WHERE event_type = 'error' AND public AND day IS NOT NULL) x WHERE n = 1""")


def latest_versions(spark, sf_dir):
    """The latest of the versions of each title of a case, 45 days apart at most."""
    return summary.latest_versions(_filings(spark, sf_dir)).select("case_id", "id", F.date_format("day", "yyyy-MM-dd").alias("day"))


frame_query("latest_versions", latest_versions, f"""
WITH {_EVENTS},
g AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 45 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY case_id, event_type ORDER BY day, id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id, event_type ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT case_id, id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY case_id, event_type, run ORDER BY day DESC, id DESC) AS n FROM r) x WHERE n = 1""")


def _counsel(spark, sf_dir):
    """Lines as filings: a supplier files for the order's customer, who is the complainant."""
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    name = F.concat(F.lit("Client "), F.regexp_replace("c_name", "#", " "), F.lit(", Inc."))
    firm = F.concat(F.regexp_replace("s_name", "#", " "), F.when(F.col("l_linenumber") % 2 == 0, " LLP").otherwise(" & Associates, P.C."))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    docs = rows.select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").cast("string").alias("id"), F.col("l_linenumber").cast("int").alias("ord"), F.when(F.col("l_returnflag") == "N", "Notice of Appearance").otherwise("Motion").alias("title"),
        F.concat(F.lit("Ann "), F.lit("No"), F.col("l_partkey")).alias("filed_by"), name.alias("on_behalf_of"), firm.alias("firm"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
    )
    parties = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").cast("string").alias("case_id"), name.alias("name"), F.lit("Complainant").alias("role"))
    return docs, parties


def attorney_entities(spark, sf_dir):
    """Attorneys, named by parts with initials here and there, merged within and across firms."""
    ship(spark)
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    words = F.split("p_name", " ")
    name = F.initcap(F.concat_ws(" ", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.substring(F.get(words, 0), 1, 1), F.lit("."))).otherwise(F.get(words, 0)), F.when(F.col("l_linenumber") % 4 == 0, F.substring("p_brand", 1, 1)), F.get(words, 1)))
    seen = l.join(p, l.l_partkey == p.p_partkey).select(name.alias("spelling"), F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_suppkey").cast("string").alias("firm"), F.col("l_orderkey").alias("ord"))
    ents, _ = resolve.resolve_attorneys(spark, seen)
    return ents.select("id", "name", F.size("spellings").alias("spellings"), "cases")


frame_query("attorney_entities", attorney_entities)


def company_entities(spark, sf_dir):
    """Companies, named by parts with forms, former names and a dropped letter here and there, merged."""
    ship(spark)
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    bare = F.initcap(F.concat_ws(" ", "p_name", F.lower("p_type")))
    spelled = F.array(F.concat(bare, F.lit(" Inc.")), F.concat(F.upper(bare), F.lit(", Incorporated")), F.concat(F.regexp_replace(bare, "dget", "gdet"), F.lit(" Inc.")), F.concat(bare, F.lit(" Holdings LLC f/k/a "), bare, F.lit(" Inc.")))
    named = p.select("p_partkey", spelled.alias("spelled"))  # once a part, not once a line
    one = F.element_at("spelled", (F.col("l_linenumber") % 4 + 1).cast("int"))
    seen = l.join(named, l.l_partkey == named.p_partkey).select(one.alias("spelling"), F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_orderkey").alias("ord"))
    ents, _ = resolve.resolve_companies(spark, seen)
    return ents.select("id", "name", F.size("spellings").alias("spellings"), "cases")


frame_query("company_entities", company_entities)


def firm_kinds(spark, sf_dir):
    """Kind of filer of each supplier, by its name and the customers it acts for."""
    s, l, o, c = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "orders", "customer"))
    named = F.concat(F.lit("Number "), F.regexp_extract("s_name", "([0-9]+)", 1), F.element_at(F.array(*map(F.lit, (" & Partners LLP", " Goods Inc.", " Institute", " Bureau"))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    firms = s.select(F.col("s_suppkey").cast("string").alias("id"), named.alias("name"), F.array(named).alias("spellings"))
    parties = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(F.col("l_suppkey").cast("string").alias("firm"), F.concat(F.col("c_mktsegment"), F.lit(" Corp.")).alias("name")).distinct()
    return resolve.kinds(firms, parties)


frame_query("firm_kinds", firm_kinds, """
SELECT CAST(s_suppkey AS STRING) AS id, CASE s_suppkey % 4 WHEN 0 THEN 'law_firm' WHEN 1 THEN 'company' WHEN 2 THEN 'organization' ELSE 'government' END AS kind FROM supplier""")


def representations(spark, sf_dir):
    """Who acts for whom in each case."""
    ship(spark)
    reps, _ = counsel.representations(*_counsel(spark, sf_dir))
    return reps.select("case_id", "firm_key", "first_filed", "last_filed", "filings", "appeared", F.array_join("parties.name", "; ").alias("parties"), F.size("attorneys").alias("attorneys"))


frame_query("representations", representations, """
WITH r AS (SELECT CAST(l_orderkey AS STRING) AS case_id, lower(replace(s_name, '#', ' ')) || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE ' associates' END AS firm_key, strftime(l_shipdate, '%Y-%m-%d') AS day,
    concat_ws('|', l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag = 'N' AS appears, l_partkey AS person, concat('Client ', replace(c_name, '#', ' '), ', Inc.') AS party
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
f AS (SELECT case_id, firm_key, min(day) AS first_filed, max(day) AS last_filed, CAST(count(DISTINCT id) AS BIGINT) AS filings, bool_or(appears) AS appeared, any_value(party) AS parties, CAST(count(DISTINCT person) AS INT) AS attorneys FROM r GROUP BY case_id, firm_key),
own AS (SELECT DISTINCT p.case_id, p.firm_key FROM r p WHERE NOT EXISTS (SELECT 1 FROM r o JOIN f ON f.case_id = o.case_id AND f.firm_key = o.firm_key AND f.appeared WHERE o.case_id = p.case_id AND o.person = p.person AND o.firm_key <> p.firm_key))
SELECT f.* FROM f WHERE f.appeared OR EXISTS (SELECT 1 FROM own WHERE own.case_id = f.case_id AND own.firm_key = f.firm_key)""")


def rule_periods(spark, sf_dir):
    """Ends of 5- and 12-day periods after each order date, by the federal calendar."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    cal = business_days(spark, 1994, 2003)
    both = period_end(period_end(days.withColumn("five", F.lit(5)).withColumn("twelve", F.lit(12)), cal, "day", "five", "end5"), cal, "day", "twelve", "end12")
    return both.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day", "end5", "end12")])


frame_query("rule_periods", rule_periods, """
WITH RECURSIVE d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
f AS (SELECT d, isodow(d) AS w, month(d) AS m, day(d) AS n FROM d),
fixed AS (SELECT d, w FROM f WHERE (m = 1 AND n = 1) OR (m = 7 AND n = 4) OR (m = 11 AND n = 11) OR (m = 12 AND n = 25)),
h AS (SELECT CASE w WHEN 6 THEN CAST(d - 1 AS DATE) WHEN 7 THEN CAST(d + 1 AS DATE) ELSE d END AS d FROM fixed
  UNION SELECT d FROM f WHERE (m = 1 AND w = 1 AND n BETWEEN 15 AND 21) OR (m = 2 AND w = 1 AND n BETWEEN 15 AND 21) OR (m = 5 AND w = 1 AND n > 24) OR (m = 9 AND w = 1 AND n < 8) OR (m = 10 AND w = 1 AND n BETWEEN 8 AND 14) OR (m = 11 AND w = 4 AND n BETWEEN 22 AND 28)),
o AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM f WHERE w < 6 AND d NOT IN (SELECT d FROM h)),
nxt AS (SELECT f.d, min(o.d) AS s FROM f ASOF JOIN o ON f.d <= o.d GROUP BY f.d),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT strftime(x.day, '%Y-%m-%d') AS day, strftime(e.d, '%Y-%m-%d') AS end5, strftime(l.s, '%Y-%m-%d') AS end12
FROM days x JOIN nxt n ON n.d = x.day + 1 JOIN o b ON b.d = n.s JOIN o e ON e.k = b.k + 4 JOIN nxt l ON l.d = n.s + 11""")


def sentences_of_documents(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(sentences(F.col("text"))).alias("sentences"))


frame_query("sentences_of_documents", sentences_of_documents)


def candidate_sentences(spark, sf_dir):
    """Sentences that name claims and hold a ruling's words, orders' lines written out as prose."""
    ship(spark)
    l = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("Order No. "), F.col("l_linenumber"), F.lit(" "), F.when(F.col("l_returnflag") == "R", "GRANTED it").otherwise("noted it"), F.lit(" as to claims "), F.col("l_partkey") % 20 + 1, F.lit("-"), F.col("l_partkey") % 20 + 3, F.lit(" of the '294 patent."))
    text = l.groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set(s)), " ").alias("text"))
    return evidence.candidates(text, ["GRANTED", "hereby"]).select("doc_id", "n", "sentence", "context")


frame_query("candidate_sentences", candidate_sentences)


def claim_facts(spark, sf_dir):
    """Facts of each case by action and patent, claims as ranges."""
    events = _claim_events(spark, sf_dir).withColumn("source", F.col("stage"))
    return summary.claim_facts(events).select("case_id", "number", "action", "patent", "who", "source", "text", "date")


frame_query("claim_facts", claim_facts)


def reading_list(spark, sf_dir):
    """What a summary of each case would read."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "Answer to Complaint", "click": "Notice", "purchase": "Opinion, Commission", "signup": "Complaint", "error": "ID/RD - Other Than Final on Violation"}.items() for x in kv]), F.col("event_type"))
    title = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "Answer", "click": "Notice of Institution", "purchase": "Commission Opinion", "signup": "Complaint", "error": "Granting Summary Determination"}.items() for x in kv]), F.col("event_type"))
    docs = e.select(F.col("user_id").cast("string").alias("case_id"), F.format_string("%09d", "event_id").alias("id"), kind.alias("document_type"), title.alias("title"), F.lit("Public").alias("security_level"), F.col("ts").cast("date").alias("day"), F.concat(F.lit("f"), F.col("event_id") % 7).alias("firm"), F.lit(None).cast("string").alias("on_behalf_of"))
    return summary.selection(docs).select("case_id", "id", "section", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "read", "turn")


frame_query("reading_list", reading_list)


def streamed_users(spark, sf_dir):
    """The events table read as a stream and merged by user: each user's latest event."""
    ship(spark)
    at = scratch(spark, "streamed")
    src = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ord"))
    src.write.parquet(f"{at}/in")
    incremental.merge_stream(spark, f"{at}/in", "user_id long, event_type string, ord long", f"{at}/table", "user_id", f"{at}/mark").awaitTermination()
    return tables.load_buckets(spark, f"{at}/table", src.schema)


frame_query("streamed_users", streamed_users, """
SELECT user_id, event_type, ord FROM (SELECT user_id, event_type, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1""")


def windowed_events(spark, sf_dir):
    got = incremental.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


frame_query("windowed_events", windowed_events, """
SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")



def bundle_positions(spark, sf_dir):
    """Firms by position, as the packed bundle numbers them."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    ents = l.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("cases")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "cases")
    return bundle.positions(ents)


frame_query("bundle_positions", bundle_positions, """
SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name, n AS cases, CAST(row_number() OVER (ORDER BY n DESC, lower(s_name), CAST(s_suppkey AS STRING)) - 1 AS BIGINT) AS ix
FROM (SELECT l_suppkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey) x JOIN supplier ON s_suppkey = l_suppkey""")
