"""String, date, array, map, JSON and hashing functions, applied to whole tables."""

from __future__ import annotations

from lodestar.plans.registry import sql_query

sql_query("slug", "part customer", """
WITH n AS (SELECT DISTINCT concat(p_brand, ' / ', p_type, '. ', p_name) AS label FROM part UNION SELECT c_mktsegment FROM customer)
SELECT label, trim(BOTH '_' FROM @replace_all(lower(@replace_all(replace(label, '.', ''), '([a-z0-9])([A-Z])', '$1_$2')), '[^a-z0-9]+', '_')) AS slug FROM n""",
    oracle=r"""
WITH n AS (SELECT DISTINCT concat(p_brand, ' / ', p_type, '. ', p_name) AS label FROM part UNION SELECT c_mktsegment FROM customer)
SELECT label, trim(regexp_replace(lower(regexp_replace(replace(label, '.', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM n""")
sql_query("iso_dates", "orders", """
WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN @iso(o_orderdate) WHEN 1 THEN concat(substr(@iso(o_orderdate), 6, 5), '-', substr(@iso(o_orderdate), 1, 4)) WHEN 2 THEN replace(@iso(o_orderdate), '-', '/') ELSE '2026/13/45' END AS raw FROM orders)
SELECT k, raw, CASE WHEN @matches(raw, '^[0-9]{4}[-/][01][0-9][-/][0-3][0-9]$') AND CAST(substr(raw, 6, 2) AS INT) <= 12 THEN replace(raw, '/', '-') WHEN @matches(raw, '^[0-9]{2}-[0-9]{2}-[0-9]{4}$') THEN concat(substr(raw, 7, 4), '-', substr(raw, 1, 5)) ELSE raw END AS iso FROM t""")
sql_query("months_before", "orders", """
SELECT DISTINCT @iso(o_orderdate) AS day, date_format(add_months(CAST(o_orderdate AS DATE), -4), 'yyyy-MM-dd') AS before FROM orders""", oracle="""
SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(CAST(o_orderdate AS DATE) - INTERVAL 4 MONTH, '%Y-%m-%d') AS before FROM orders""")
sql_query("display_dates", "orders", """
SELECT DISTINCT @iso(o_orderdate) AS day, date_format(o_orderdate, 'dd MMM yyyy') AS shown, CAST(weekday(o_orderdate) AS INT) AS weekday FROM orders""", oracle="""
SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d %b %Y') AS shown, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders""")
sql_query("json_props_flatten", "events", """
SELECT event_id, CAST(@json(props, '$.k') AS INT) AS k, @json(props, '$.none') AS none FROM events""")
sql_query("numeric_case_sort", "orders", """
SELECT concat('337-', CAST(o_orderkey % 1000 AS STRING), '-', CAST(o_custkey AS STRING)) AS number, CAST(row_number() OVER (ORDER BY o_orderkey % 1000, o_custkey, o_orderkey) AS INT) AS position FROM orders""")
sql_query("search_blob", "orders customer", """
SELECT o.o_orderkey AS case_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' AND position('00012' IN lower(concat_ws(' ', c.c_name, o.o_orderpriority, CAST(o.o_orderkey AS STRING)))) > 0""")
sql_query("entity_search", "customer supplier", """
SELECT 'company' AS kind, c_name AS name FROM customer WHERE position('99' IN lower(c_name)) > 0 UNION ALL SELECT 'firm', s_name FROM supplier WHERE position('99' IN lower(s_name)) > 0""")
sql_query("sha1_event_id", "lineitem", """
SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, substr(sha1(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING))), 1, 12) AS id FROM lineitem""")
sql_query("content_fingerprints", "documents", """
SELECT doc_id, substr(sha2(text, 256), 1, 16) AS fingerprint, CAST(length(text) AS INT) AS size FROM documents""", oracle="""
SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint, CAST(length(text) AS INT) AS size FROM documents""")
sql_query("loose_text", "documents", """
SELECT doc_id, @replace_all(lower(text), '[^a-z0-9]', '') AS loose FROM documents""")
sql_query("loose_names", "part", """
SELECT DISTINCT p_name, replace(@replace_all(lower(p_name), '[^a-z0-9]', ''), 'o', '0') AS ocr FROM part""")
sql_query("claim_expand", "part", """
WITH c AS (SELECT p_partkey AS k, p_size AS lo, p_size + p_partkey % 9 AS hi FROM part), e AS (SELECT k, @rows(lo, hi) AS claim FROM c)
SELECT k, CAST(claim AS INT) AS claim FROM e""")
sql_query("claim_ranges_islands", "lineitem", """
WITH c AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS n FROM lineitem), g AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS island FROM c),
r AS (SELECT k, min(n) AS lo, max(n) AS hi FROM g GROUP BY k, island) SELECT k, CASE WHEN lo = hi THEN CAST(lo AS STRING) ELSE concat(CAST(lo AS STRING), '-', CAST(hi AS STRING)) END AS claims FROM r""")
sql_query("patent_digits", "part", """
SELECT DISTINCT p_brand, @replace_all(p_brand, '[^0-9A-Za-z]', '') AS bare, @replace_all(p_brand, '[^0-9]', '') AS digits FROM part""")
sql_query("side_of_roles", "lineitem", """
WITH r AS (SELECT l_orderkey AS k, @set(l_returnflag) AS roles FROM lineitem GROUP BY l_orderkey) SELECT k, CASE roles WHEN 'R' THEN 'C' WHEN 'A' THEN 'R' WHEN 'N' THEN 'N' ELSE 'O' END AS side FROM r""")
sql_query("safe_filenames", "pages", """
SELECT page_id, @replace_all(url, '[^A-Za-z0-9._-]+', '_') AS file FROM pages""")
sql_query("strip_tags", "pages", """
SELECT page_id, trim(@replace_all(@replace_all(html, '<[^>]+>', ' '), '[ \\n]+', ' ')) AS text FROM pages""")
sql_query("page_hosts", "pages", """
SELECT @group(url, '^https?://([^/:?#]+)', 1) AS host, CAST(count(*) AS BIGINT) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1""")
sql_query("word_differences", "part", """
WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b FROM n)
SELECT x.name AS one, y.name AS other, CASE WHEN x.a = y.a THEN y.b ELSE y.a END AS differs FROM w x JOIN w y ON x.name < y.name AND (x.a = y.a OR x.b = y.b)""")
sql_query("wanted_pages", "documents", """
WITH p AS (SELECT doc_id, CAST(ceil(n_chars / 500.0) AS INT) AS total FROM documents), e AS (SELECT doc_id, total, @rows(1, greatest(total, 1)) AS page FROM p)
SELECT doc_id, CAST(page AS INT) AS page FROM e WHERE page <= 3 OR page > total - 2""")
sql_query("ratio_and_clamp", "orders", """
SELECT o_orderkey AS k, CAST(least(greatest(floor(o_totalprice / 1000), 5), 300) AS INT) AS clamped, CAST(round(100.0 * (o_orderkey % 7) / 7) AS INT) AS percent FROM orders""")
sql_query("canonical_json_hash", "orders", """
SELECT o_orderkey AS k, sha1(concat('{"date":"', @iso(o_orderdate), '","key":', CAST(o_orderkey AS STRING), ',"status":"', o_orderstatus, '"}')) AS h FROM orders""")
sql_query("array_sets", "lineitem", """
WITH s AS (SELECT l_orderkey AS k, array_sort(collect_set(l_suppkey)) AS a, array_sort(collect_set(CASE WHEN l_returnflag = 'R' THEN l_suppkey END)) AS b FROM lineitem GROUP BY l_orderkey)
SELECT k, CAST(size(a) AS BIGINT) AS firms, CAST(size(array_intersect(a, b)) AS BIGINT) AS exits, CAST(size(array_except(a, b)) AS BIGINT) AS others, element_at(a, 1) AS first_firm FROM s""", oracle="""
WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey))) AS a, list_distinct(list(CASE WHEN l_returnflag = 'R' THEN l_suppkey END)) AS b FROM lineitem GROUP BY l_orderkey)
SELECT k, CAST(len(a) AS BIGINT) AS firms, CAST(len(list_intersect(a, b)) AS BIGINT) AS exits, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS others, a[1] AS first_firm FROM s""")
sql_query("business_day_period_end", "orders", """
WITH cal AS (SELECT CAST(d AS DATE) AS d, weekday(CAST(d AS DATE)) < 5 AND date_format(CAST(d AS DATE), 'MM-dd') NOT IN ('01-01', '06-19', '07-04', '11-11', '12-25') AS open FROM (SELECT explode(sequence(DATE '1995-01-01', DATE '2001-12-31')) AS d) x),
days AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM cal WHERE open), ahead AS (SELECT c.d, min(CASE WHEN c.open THEN c.d END) OVER (ORDER BY c.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM cal c),
starts AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT date_format(s.d, 'yyyy-MM-dd') AS day, date_format(e.d, 'yyyy-MM-dd') AS five_days, date_format(l.nxt, 'yyyy-MM-dd') AS twelve_days
FROM starts s JOIN ahead a ON a.d = date_add(s.d, 1) JOIN days b ON b.d = a.nxt JOIN days e ON e.n = b.n + 4 JOIN ahead l ON l.d = date_add(a.nxt, 11)""", oracle="""
WITH cal AS (SELECT CAST(d AS DATE) AS d, isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '06-19', '07-04', '11-11', '12-25') AS open FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d) x),
days AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM cal WHERE open), ahead AS (SELECT c.d, min(CASE WHEN c.open THEN c.d END) OVER (ORDER BY c.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM cal c),
starts AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(s.d, '%Y-%m-%d') AS day, strftime(e.d, '%Y-%m-%d') AS five_days, strftime(l.nxt, '%Y-%m-%d') AS twelve_days
FROM starts s JOIN ahead a ON a.d = CAST(s.d + 1 AS DATE) JOIN days b ON b.d = a.nxt JOIN days e ON e.n = b.n + 4 JOIN ahead l ON l.d = CAST(a.nxt + 11 AS DATE)""")
