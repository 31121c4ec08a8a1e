"""Windows, as-of and interval joins, replays and running flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.graph import components
from lodestar.plans.registry import frame_query, sql_query
from lodestar.session import table

DAY = "DATE '2001-08-02'"

sql_query("finality_within_90_days", "orders lineitem", """
WITH term AS (SELECT l_orderkey AS k, l_suppkey AS firm, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
notice AS (SELECT DISTINCT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'N')
SELECT t.k AS case_id, t.firm, t.n AS line, t.p AS part, @iso(t.d) AS day, coalesce(max(CASE WHEN @days(t.d, x.d) BETWEEN 0 AND 90 THEN 1 ELSE 0 END), 0) = 1 AS final
FROM term t LEFT JOIN notice x ON x.k = t.k GROUP BY t.k, t.firm, t.n, t.p, t.d""")
sql_query("version_dedupe_45d", "lineitem", """
WITH v AS (SELECT DISTINCT l_suppkey AS firm, l_returnflag AS title, CAST(l_shipdate AS DATE) AS d FROM lineitem),
g AS (SELECT firm, title, d, CASE WHEN lag(d) OVER (PARTITION BY firm, title ORDER BY d) IS NULL OR @days(lag(d) OVER (PARTITION BY firm, title ORDER BY d), d) > 45 THEN 1 ELSE 0 END AS fresh FROM v),
s AS (SELECT firm, title, d, sum(fresh) OVER (PARTITION BY firm, title ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event FROM g)
SELECT firm, title, CAST(event AS BIGINT) AS event, @iso(min(d)) AS day, @iso(max(d)) AS latest, CAST(count(*) AS BIGINT) AS versions FROM s GROUP BY firm, title, event""")
sql_query("effective_date_asof", "orders lineitem", """
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'A'),
notice AS (SELECT DISTINCT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'N')
SELECT e.k AS case_id, e.n AS line, e.p AS part, e.s AS firm, @iso(coalesce(min(CASE WHEN x.d >= e.d THEN x.d END), e.d)) AS effective FROM e LEFT JOIN notice x ON x.k = e.k GROUP BY e.k, e.n, e.p, e.s, e.d""")
sql_query("previous_filing_asof", "lineitem", """
WITH d AS (SELECT DISTINCT l_suppkey AS firm, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT firm, @iso(d) AS day, @days(lag(d) OVER (PARTITION BY firm ORDER BY d), d) AS gap, @iso(lead(d) OVER (PARTITION BY firm ORDER BY d)) AS following FROM d""")
sql_query("array_overlap_corroboration", "lineitem", """
WITH e AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS action, l_suppkey AS claim FROM lineitem),
pairs AS (SELECT x.k, x.action AS a, y.action AS b, CAST(count(*) AS BIGINT) AS shared FROM e x JOIN e y ON x.k = y.k AND x.claim = y.claim AND x.action < y.action GROUP BY x.k, x.action, y.action)
SELECT k AS case_id, a, b, shared, CASE WHEN a = 'A' AND b = 'R' THEN 'disputed' ELSE 'corroborated' END AS verdict FROM pairs""")
sql_query("running_exit_flag", "lineitem", """
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x, l_shipdate AS d, l_returnflag AS f FROM lineitem)
SELECT k AS case_id, n AS line, p AS part, s AS firm, coalesce(max(CASE WHEN f = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY k, s ORDER BY d, n, p, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_exit FROM e""")
sql_query("partial_stay_latest", "lineitem", f"""
WITH s AS (SELECT l_orderkey AS k, l_suppkey AS who, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n, CAST(l_quantity AS INT) AS q, l_returnflag AS f, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS r FROM lineitem)
SELECT k AS case_id, who, @iso(d) AS since, @iso(@plus(d, q * 10)) AS until FROM s WHERE r = 1 AND f <> 'R' AND @plus(d, q * 10) >= {DAY}""")
sql_query("whole_stay_state", "lineitem", """
WITH e AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS lifted FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
g AS (SELECT k, d, lifted, sum(lifted) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM e),
s AS (SELECT k, coalesce(run, 0) AS run, min(d) AS since, max(d) AS latest, max(lifted) AS ended FROM g GROUP BY k, coalesce(run, 0))
SELECT k AS firm, CAST(run AS BIGINT) AS run, @iso(since) AS since, @iso(latest) AS latest, ended = 1 AS lifted FROM s""")
sql_query("next_deadline", "orders lineitem", f"""
WITH e AS (SELECT l_orderkey AS k, @plus(CAST(l_shipdate AS DATE), 60) AS d, l_linenumber AS n, l_returnflag = 'R' AS on_hold FROM lineitem)
SELECT o.o_orderkey AS case_id, @iso(min(CASE WHEN e.d >= {DAY} AND NOT e.on_hold THEN e.d END)) AS next_date, @days({DAY}, min(CASE WHEN e.d >= {DAY} AND NOT e.on_hold THEN e.d END)) AS days_left
FROM orders o LEFT JOIN e ON e.k = o.o_orderkey WHERE o.o_orderstatus = 'O' GROUP BY o.o_orderkey""")
sql_query("due_next_7_days", "lineitem", f"""
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, @plus(CAST(l_shipdate AS DATE), 30) AS d FROM lineitem WHERE l_returnflag <> 'R')
SELECT @iso(d) AS day, k AS case_id, n AS line, p AS part, @days({DAY}, d) AS days_left FROM e WHERE @days({DAY}, d) BETWEEN 0 AND 7 ORDER BY d, k, n, p LIMIT 8""")
sql_query("upcoming_window", "lineitem", f"""
WITH e AS (SELECT @plus(CAST(l_shipdate AS DATE), 30) AS d, l_returnflag = 'R' AS on_hold FROM lineitem) SELECT @iso(d) AS day, on_hold, CAST(count(*) AS BIGINT) AS n FROM e WHERE @days({DAY}, d) BETWEEN -7 AND 35 GROUP BY d, on_hold""")
sql_query("sole_alias_firms", "lineitem supplier", """
WITH fa AS (SELECT DISTINCT l_suppkey AS firm, l_partkey AS attorney FROM lineitem), quiet AS (SELECT s_suppkey AS firm FROM supplier WHERE s_acctbal < 2500), others AS (SELECT DISTINCT f.attorney FROM fa f LEFT JOIN quiet q ON q.firm = f.firm WHERE q.firm IS NULL),
shared AS (SELECT f.firm, CAST(count(*) AS BIGINT) AS attorneys, CAST(count(o.attorney) AS BIGINT) AS elsewhere FROM fa f JOIN quiet q ON q.firm = f.firm LEFT JOIN others o ON o.attorney = f.attorney GROUP BY f.firm)
SELECT firm, attorneys, attorneys = elsewhere AS is_alias FROM shared""")
sql_query("short_form_prefix_join", "part", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, split_part(name, ' ', 1) AS first_word FROM names), short AS (SELECT first_word AS name, CAST(count(*) AS BIGINT) AS longer FROM w GROUP BY first_word)
SELECT s.name AS short_form, w.name AS long_form FROM short s JOIN w ON w.first_word = s.name WHERE s.longer >= 1""")
def _answer_groups(spark, sf_dir):
    """Answers share a group with answers of their nation whose balances lie close, directly or through others.

    The balance is cut in bands as wide as the distance, so the join is an equality on (nation, band) with the
    neighbouring bands, never a join of all pairs of a nation.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    band = F.floor(F.col("bal") / 1500)
    left = s.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    right = s.select(F.col("node").alias("b"), "nation", F.col("bal").alias("other"), band.alias("band"))
    edges = left.join(right, ["nation", "band"]).filter((F.col("node") < F.col("b")) & (F.abs(F.col("bal") - F.col("other")) < 1500)).select(F.col("node").alias("a"), "b")
    found = components(s.select("node"), edges)
    return found.select(F.col("node").alias("answer"), F.col("component").alias("grp"))


frame_query("connected_answer_groups", _answer_groups, """
WITH RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND abs(a.s_acctbal - b.s_acctbal) < 1500),
r(node, reach) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node AS answer, min(reach) AS grp FROM r GROUP BY node""")
sql_query("budget_prefix_sum", "events", """
WITH c AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events), s AS (SELECT user_id, event_id, cents, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM c)
SELECT user_id, event_id, CAST(spent AS BIGINT) AS spent, spent <= 5000 AS allowed FROM s""")
sql_query("batch_chunks", "documents", """
SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 25.0) AS INT) AS chunk, source FROM documents""")
sql_query("note_numbers", "conversations", """
SELECT conv_id, turn, concat(CASE WHEN role = 'user' THEN 'n' WHEN role = 'assistant' THEN 't' ELSE 'c' END, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS STRING)) AS number FROM conversations""")
sql_query("previous_context", "conversations", """
SELECT conv_id, turn, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 600) AS context, length(text) AS size FROM conversations""".replace("length(text) AS size", "CAST(length(text) AS INT) AS size"))
sql_query("sentence_candidates", "documents", """
WITH s AS (SELECT doc_id, @each(@all_matches(text, '[^.\\n]+[.]')) AS sentence FROM documents)
SELECT doc_id, trim(sentence) AS sentence, CAST(count(*) AS BIGINT) AS times FROM s WHERE @matches(lower(sentence), '(^|[^a-z])(claim|patent|stupid|idiot|trash)([^a-z]|$)') AND length(sentence) <= 2500 GROUP BY doc_id, trim(sentence)""")
sql_query("patent_stage_rollup", "lineitem", """
SELECT CASE WHEN grouping(l_suppkey) = 1 THEN -1 ELSE l_suppkey END AS patent, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS asserted, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS remaining
FROM lineitem GROUP BY ROLLUP (l_suppkey)""")
sql_query("matrix_pivot", "lineitem", """
WITH e AS (SELECT l_orderkey AS k, l_suppkey AS claim, l_returnflag AS stage, l_linestatus AS status, row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_returnflag ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS r FROM lineitem)
SELECT k AS case_id, claim, max(CASE WHEN stage = 'N' THEN status END) AS instituted, max(CASE WHEN stage = 'A' THEN status END) AS hearing, max(CASE WHEN stage = 'R' THEN status END) AS final_id FROM e WHERE r = 1 GROUP BY k, claim""")
sql_query("exit_blocks_later_events", "lineitem", """
WITH e AS (SELECT l_orderkey AS k, l_suppkey AS claim, CAST(l_shipdate AS DATE) AS d, l_returnflag AS f FROM lineitem), x AS (SELECT k, claim, min(CASE WHEN f = 'R' THEN d END) AS left_on FROM e GROUP BY k, claim)
SELECT e.k AS case_id, e.claim, CAST(count(*) AS BIGINT) AS events, CAST(sum(CASE WHEN x.left_on IS NULL OR e.d <= x.left_on THEN 1 ELSE 0 END) AS BIGINT) AS applied FROM e JOIN x ON x.k = e.k AND x.claim = e.claim GROUP BY e.k, e.claim""")
sql_query("as_of_overlay", "lineitem", """
WITH s AS (SELECT l_orderkey AS k, l_suppkey AS event, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS r, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS orders_ FROM lineitem)
SELECT k AS case_id, event, @iso(@plus(d, q)) AS date_, CAST(orders_ - 1 AS BIGINT) AS replaced FROM s WHERE r = 1""")
sql_query("quantity_conditions_antijoin", "orders lineitem", """
SELECT o.o_orderkey AS case_id FROM orders o WHERE o.o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
sql_query("price_usage_cost", "events", """
WITH rates AS (SELECT 'view' AS model, 3 AS r_in, 15 AS r_out UNION ALL SELECT 'click', 1, 5 UNION ALL SELECT 'purchase', 15, 75)
SELECT e.user_id, CAST(sum(CAST(@json(e.props, '$.k') AS INT) * r.r_in + CAST(floor(e.value) AS INT) * r.r_out) AS BIGINT) AS micro_usd FROM events e JOIN rates r ON r.model = e.event_type GROUP BY e.user_id""")
sql_query("daily_counts", "events", """
SELECT @iso(CAST(ts AS DATE)) AS day, event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY CAST(ts AS DATE), event_type""")
sql_query("sessions_by_gap", "events", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS events, min(event_id) AS first_event FROM s GROUP BY user_id, session""")
