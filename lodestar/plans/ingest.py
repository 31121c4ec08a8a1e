"""Snapshot differences, upserts, key lookups and refresh rules.

Two snapshots of the case feed are made from orders: the earlier lacks the last month's orders and has an older
status for the months before; the later lacks small orders and has a newer phase for large ones.
"""

from __future__ import annotations

from lodestar.plans.registry import sql_query

DAY = "DATE '2001-08-02'"

SNAPSHOTS = """
old_s AS (SELECT o_orderkey AS k, CASE WHEN o_orderdate >= TIMESTAMP '2001-05-01 00:00:00' THEN 'P' ELSE o_orderstatus END AS status, o_orderpriority AS phase, o_totalprice AS total FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01 00:00:00'),
new_s AS (SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_totalprice > 400000 THEN '1-URGENT' ELSE o_orderpriority END AS phase, o_totalprice AS total FROM orders WHERE o_totalprice >= 20000)"""

sql_query("snapshot_diff", "orders", f"""
WITH {SNAPSHOTS} SELECT coalesce(n.k, o.k) AS case_id,
  CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.status <> n.status THEN 'status' ELSE 'changed' END AS change, o.status AS before, n.status AS after
FROM old_s o FULL JOIN new_s n ON n.k = o.k WHERE o.k IS NULL OR n.k IS NULL OR o.status <> n.status OR o.phase <> n.phase""")
sql_query("snapshot_diff_counts", "orders", f"""
WITH {SNAPSHOTS}, d AS (SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.status <> n.status THEN 'status' WHEN o.phase <> n.phase THEN 'changed' ELSE 'same' END AS change
  FROM old_s o FULL JOIN new_s n ON n.k = o.k) SELECT change, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY change""")
sql_query("withdrawn_carry", "orders", f"""
WITH {SNAPSHOTS} SELECT k, status, phase, FALSE AS withdrawn FROM new_s
UNION ALL SELECT o.k, o.status, o.phase, TRUE FROM old_s o WHERE NOT EXISTS (SELECT 1 FROM new_s n WHERE n.k = o.k)""")
sql_query("removal_guard", "orders", f"""
WITH {SNAPSHOTS}, c AS (SELECT CAST(count(*) AS BIGINT) AS listed, CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM new_s n WHERE n.k = o.k) THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM old_s o)
SELECT listed, removed, removed > 10 AND removed * 50 > listed AS refused FROM c""".replace("CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM new_s n WHERE n.k = o.k) THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM old_s o", "CAST(sum(CASE WHEN n.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM old_s o LEFT JOIN new_s n ON n.k = o.k"))
sql_query("docket_migration", "orders", """
WITH cases AS (SELECT concat('337-', CAST(o_orderkey AS STRING)) AS number, o_orderkey AS docket FROM orders WHERE o_orderstatus <> 'P'),
docs AS (SELECT CAST(o_orderkey AS STRING) AS k, o_custkey AS n FROM orders WHERE o_orderpriority <> '5-LOW'),
kept AS (SELECT concat('337-', CAST(o_orderkey AS STRING)) AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
SELECT d.k AS old_key, c.number AS new_key, d.n FROM docs d JOIN cases c ON CAST(c.docket AS STRING) = d.k
WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.k = c.number)""")
sql_query("number_key_lookup", "orders", """
WITH cases AS (SELECT concat('337-TA-', CAST(o_orderkey AS STRING)) AS number, CAST(o_orderkey AS STRING) AS serial FROM orders),
wanted AS (SELECT concat('No. 337/', CAST(o_orderkey AS STRING)) AS w FROM orders UNION ALL SELECT CAST(o_orderkey AS STRING) FROM orders UNION ALL SELECT 'unknown 999999999'),
keys AS (SELECT w, CASE WHEN @matches(w, '[0-9]+[^0-9]+[0-9]+') THEN @group(w, '([0-9]+)[^0-9]+([0-9]+)', 2) ELSE @group(w, '([0-9]+)', 1) END AS serial FROM wanted)
SELECT k.w AS wanted, c.number FROM keys k LEFT JOIN cases c ON c.serial = k.serial""")
sql_query("missing_lists_newest_first", "orders lineitem", """
WITH m AS (SELECT o.o_orderkey AS case_id, o.o_orderdate AS start FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL)
SELECT case_id, @iso(start) AS start, CAST(row_number() OVER (ORDER BY start DESC, case_id) AS INT) AS turn FROM m""")

LATEST = "latest AS (SELECT o.o_orderkey AS case_id, o.o_orderstatus AS status, CAST(max(l.l_shipdate) AS DATE) AS last_filing FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderstatus)"
sql_query("refresh_cadence", "orders lineitem", f"""
WITH {LATEST}, f AS (SELECT case_id, status = 'O' AS open, case_id % 2 = 0 AS backfilled, last_filing IS NULL OR @days(last_filing, {DAY}) > 730 AS quiet FROM latest)
SELECT case_id, CASE WHEN backfilled AND NOT open THEN NULL WHEN backfilled AND quiet THEN 30 WHEN backfilled THEN 1 WHEN quiet OR NOT open THEN 7 ELSE 1 END AS every_days FROM f""")
sql_query("dormant_cases", "orders lineitem", f"""
WITH {LATEST} SELECT case_id, @iso(last_filing) AS last_filing, @days(last_filing, {DAY}) AS idle FROM latest WHERE @days(last_filing, {DAY}) > 730""")
sql_query("full_relist_due", "orders lineitem", f"""
WITH {LATEST} SELECT case_id, last_filing IS NULL OR @days(last_filing, {DAY}) >= 7 AS due FROM latest""")
sql_query("new_activity_antijoin", "lineitem", """
WITH ids AS (SELECT l_orderkey AS case_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS id, l_returnflag FROM lineitem),
seen AS (SELECT DISTINCT case_id, id FROM ids WHERE l_returnflag <> 'R')
SELECT i.case_id, CAST(count(DISTINCT i.id) AS BIGINT) AS fresh FROM ids i LEFT JOIN seen s ON s.case_id = i.case_id AND s.id = i.id WHERE s.id IS NULL GROUP BY i.case_id""")
sql_query("incremental_merge", "lineitem", """
WITH previous AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY l_orderkey, l_linenumber),
fresh AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01 00:00:00' GROUP BY l_orderkey, l_linenumber)
SELECT k, n, q, 'fresh' AS origin FROM fresh UNION ALL SELECT p.k, p.n, p.q, 'kept' FROM previous p WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.k = p.k AND f.n = p.n)""")
sql_query("store_summary_full_outer", "orders lineitem", """
WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '5-LOW'), d AS (SELECT l_orderkey AS k, CAST(count(*) AS BIGINT) AS documents, CAST(sum(l_linenumber) AS BIGINT) AS attachments FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
SELECT coalesce(c.k, d.k) AS case_id, c.status, coalesce(d.documents, 0) AS documents, coalesce(d.attachments, 0) AS attachments FROM c FULL JOIN d ON d.k = c.k""")
sql_query("latest_snapshot_of_day", "events", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, ts, event_id FROM events WHERE event_type = 'view')
SELECT @iso(day) AS day, event_id FROM (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY ts DESC, event_id DESC) AS n FROM s) x WHERE n = 1""")
sql_query("retention_keep_days", "events", """
WITH d AS (SELECT event_id, CAST(ts AS DATE) AS day, dense_rank() OVER (ORDER BY CAST(ts AS DATE) DESC) AS r FROM events) SELECT @iso(day) AS day, CAST(count(*) AS BIGINT) AS files, r <= 14 AS kept FROM d GROUP BY day, r""")
sql_query("ingest_report", "orders lineitem", """
WITH c AS (SELECT o.o_orderkey AS k, count(l.l_orderkey) AS stages FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)
SELECT CAST(count(*) AS BIGINT) AS cases, CAST(sum(stages) AS BIGINT) AS stages, CAST(sum(CASE WHEN stages > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_stage, CAST(max(stages) AS BIGINT) AS longest FROM c""")
sql_query("case_fold", "orders lineitem", """
WITH s AS (SELECT l_orderkey AS k, l_returnflag AS phase, l_shipdate AS d,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS first_n,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS last_n FROM lineitem)
SELECT o.o_orderkey AS case_id, o.o_orderstatus AS status, max(CASE WHEN s.first_n = 1 THEN s.phase END) AS primary_phase, max(CASE WHEN s.last_n = 1 THEN s.phase END) AS current_phase,
  @iso(least(o.o_orderdate, coalesce(min(s.d), o.o_orderdate))) AS start, coalesce(@set(s.phase), '') AS phases, CAST(count(s.k) AS BIGINT) AS stages
FROM orders o LEFT JOIN s ON s.k = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderstatus, o.o_orderdate""")
sql_query("primary_current_stage", "lineitem", """
SELECT l_orderkey AS case_id, l_partkey AS stage, @iso(l_shipdate) AS start, a = 1 AS is_first, z = 1 AS is_current FROM (
  SELECT l_orderkey, l_partkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS z FROM lineitem) s WHERE a = 1 OR z = 1""")
sql_query("stage_differences", "lineitem", """
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linestatus AS status, l_returnflag AS flag, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a FROM lineitem),
base AS (SELECT k, status, flag FROM s WHERE a = 1)
SELECT s.k AS case_id, s.n AS stage, s.l_partkey AS part, s.l_suppkey AS firm, CASE WHEN s.status <> b.status THEN s.status END AS status, CASE WHEN s.flag <> b.flag THEN s.flag END AS flag
FROM s JOIN base b ON b.k = s.k WHERE s.a > 1 AND (s.status <> b.status OR s.flag <> b.flag)""")
sql_query("category_filter", "orders", """
SELECT o_orderkey AS case_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR (o_orderpriority = '4-NOT SPECIFIED' AND @starts(CAST(o_orderkey AS STRING), '7'))""")
sql_query("run_log_tail", "events", """
SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")
sql_query("cost_log_total", "events", """
SELECT event_type, CAST(count(*) AS BIGINT) AS runs, round(sum(CAST(value AS DECIMAL(18, 6))), 6) AS cost FROM events GROUP BY event_type""".replace("round(sum(CAST(value AS DECIMAL(18, 6))), 6)", "CAST(round(sum(CAST(value AS DECIMAL(18, 6))), 2) AS DOUBLE)"))
sql_query("field_coverage", "events", """
WITH f AS (SELECT 'k' AS source, @json(props, '$.k') AS v FROM events UNION ALL SELECT 'missing', @json(props, '$.missing') FROM events UNION ALL SELECT 'value', CAST(CAST(value AS INT) AS STRING) FROM events)
SELECT source, CAST(count(v) AS BIGINT) AS present, CAST(count(*) AS BIGINT) AS total, min(v) AS sample FROM f GROUP BY source""")
sql_query("case_universe", "orders lineitem", """
SELECT k AS case_id FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT o_custkey FROM orders) u""")
sql_query("set_ops", "lineitem", """
WITH a AS (SELECT DISTINCT l_suppkey AS firm FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS firm FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49)
SELECT 'both' AS kind, firm FROM (SELECT firm FROM a INTERSECT SELECT firm FROM b) x UNION ALL SELECT 'only a', firm FROM (SELECT firm FROM a EXCEPT SELECT firm FROM b) y UNION ALL SELECT 'only b', firm FROM (SELECT firm FROM b EXCEPT SELECT firm FROM a) z""")
sql_query("union_entities", "customer supplier part", """
SELECT 'company' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'firm', s_suppkey, s_name FROM supplier UNION ALL SELECT 'attorney', p_partkey, p_name FROM part""")
sql_query("processed_documents_left", "documents labels", """
SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
