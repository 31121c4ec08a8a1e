"""Leaderboards, co-counsel, disputes and caseload over representations.

An order is a case, a supplier a firm, a customer the complainant company; a firm's side in a case comes from
the set of its lines' flags (see README). The viewing day and year are parameters of the text, never today.
"""

from __future__ import annotations

from lodestar.plans.registry import sql_query

YEAR = 2001

#: One row per (case, firm): its side from the set of roles it filed in, first and last filing.
REP = """
  SELECT l_orderkey AS case_id, l_suppkey AS firm,
         CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'O'
              WHEN max(l_returnflag) = 'R' THEN 'C'
              WHEN max(l_returnflag) = 'A' THEN 'R' ELSE 'N' END AS side,
         min(l_shipdate) AS first_filed, max(l_shipdate) AS last_filed, CAST(count(*) AS BIGINT) AS filings
  FROM lineitem GROUP BY l_orderkey, l_suppkey"""

BOARD = f"""
WITH rep AS ({REP}),
j AS (SELECT r.firm, r.case_id, r.side, o.o_orderstatus = 'O' AS open FROM rep r JOIN orders o ON o.o_orderkey = r.case_id WHERE {{where}}),
n AS (SELECT firm, CAST(count(DISTINCT case_id) AS BIGINT) AS cases,
        CAST(count(DISTINCT CASE WHEN side = 'C' THEN case_id END) AS BIGINT) AS as_complainant,
        CAST(count(DISTINCT CASE WHEN side = 'R' THEN case_id END) AS BIGINT) AS as_respondent,
        CAST(count(DISTINCT CASE WHEN open THEN case_id END) AS BIGINT) AS open_cases
      FROM j GROUP BY firm)
SELECT CAST(row_number() OVER (ORDER BY cases DESC, firm) AS INT) AS rank, firm, cases, as_complainant, as_respondent, open_cases
FROM n ORDER BY cases DESC, firm LIMIT 25"""

sql_query("firm_leaderboard", "lineitem orders", BOARD.format(where="TRUE"))
sql_query("firm_leaderboard_years", "lineitem orders", BOARD.format(where="CAST(year(o.o_orderdate) AS INT) BETWEEN 1997 AND 1999 AND r.side IN ('C', 'R')"))

sql_query("attorney_leaderboard", "lineitem", """
WITH stint AS (SELECT l_partkey AS attorney, l_suppkey AS firm, min(l_shipdate) AS first_filed FROM lineitem GROUP BY l_partkey, l_suppkey),
current_firm AS (SELECT attorney, firm FROM (SELECT attorney, firm, row_number() OVER (PARTITION BY attorney ORDER BY first_filed DESC, firm) AS n FROM stint) s WHERE n = 1),
board AS (SELECT l_partkey AS attorney, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS cases FROM lineitem GROUP BY l_partkey)
SELECT b.attorney, c.firm AS current_firm, b.cases FROM board b JOIN current_firm c ON c.attorney = b.attorney ORDER BY b.cases DESC, b.attorney LIMIT 25""")

sql_query("company_board", "orders customer", """
SELECT c.c_custkey AS company, c.c_name AS name, CAST(count(DISTINCT o.o_orderkey) AS BIGINT) AS cases,
  CAST(count(DISTINCT CASE WHEN o.o_orderstatus = 'O' THEN o.o_orderkey END) AS BIGINT) AS open_cases,
  CAST(count(DISTINCT CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_orderkey END) AS BIGINT) AS urgent
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name ORDER BY cases DESC, company LIMIT 25""")

#: Companies that can stand on both sides: a unit of nation and balance band, of customers and of suppliers.
UNITS = """
comp AS (SELECT o.o_orderkey AS case_id, concat(CAST(c.c_nationkey AS STRING), '-', CAST(CAST(floor(greatest(c.c_acctbal, 0) / 2500) AS INT) AS STRING)) AS unit, c.c_nationkey AS nation
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
resp AS (SELECT DISTINCT l.l_orderkey AS case_id, concat(CAST(s.s_nationkey AS STRING), '-', CAST(CAST(floor(greatest(s.s_acctbal, 0) / 2500) AS INT) AS STRING)) AS unit, s.s_nationkey AS nation
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""

for role, rel in (("complainants", "comp"), ("respondents", "resp")):
    sql_query(f"frequent_{role}", "orders customer lineitem supplier", f"""
WITH {UNITS} SELECT CAST(row_number() OVER (ORDER BY n DESC, unit) AS INT) AS rank, unit, n
FROM (SELECT unit, CAST(count(DISTINCT case_id) AS BIGINT) AS n FROM {rel} GROUP BY unit) x ORDER BY n DESC, unit LIMIT 20""")
    sql_query(f"frequent_{role}_family", "orders customer lineitem supplier nation", f"""
WITH {UNITS} SELECT CAST(row_number() OVER (ORDER BY n DESC, family) AS INT) AS rank, family, n
FROM (SELECT n_name AS family, CAST(count(DISTINCT case_id) AS BIGINT) AS n FROM {rel} JOIN nation ON n_nationkey = nation GROUP BY n_name) x ORDER BY n DESC, family""")

sql_query("suits", "orders customer lineitem supplier", f"""
WITH {UNITS} SELECT c.unit AS complainant, r.unit AS respondent, CAST(count(DISTINCT c.case_id) AS BIGINT) AS cases
FROM comp c JOIN resp r ON r.case_id = c.case_id WHERE c.unit <> r.unit GROUP BY c.unit, r.unit""")

TWO_WAY = f"""
WITH {UNITS}, suits AS (SELECT c.unit AS a, r.unit AS b, CAST(count(DISTINCT c.case_id) AS BIGINT) AS n
  FROM comp c JOIN resp r ON r.case_id = c.case_id WHERE c.unit <> r.unit GROUP BY c.unit, r.unit)"""
sql_query("two_way_disputes", "orders customer lineitem supplier", f"""{TWO_WAY}
SELECT x.a AS one, x.b AS other, x.n AS one_sued, y.n AS other_sued FROM suits x JOIN suits y ON y.a = x.b AND y.b = x.a WHERE x.a <= x.b""")
sql_query("two_way_disputes_of", "orders customer lineitem supplier", f"""{TWO_WAY}
SELECT x.a AS unit, x.b AS other, x.n AS sued, y.n AS was_sued FROM suits x JOIN suits y ON y.a = x.b AND y.b = x.a""")

sql_query("company_opponents_direction", "orders customer lineitem supplier", f"""
WITH {UNITS}, pairs AS (SELECT c.unit AS company, r.unit AS opponent, 'sued' AS direction, c.case_id FROM comp c JOIN resp r ON r.case_id = c.case_id WHERE c.unit <> r.unit
  UNION ALL SELECT r.unit, c.unit, 'was sued by', c.case_id FROM comp c JOIN resp r ON r.case_id = c.case_id WHERE c.unit <> r.unit)
SELECT company, opponent, direction, CAST(count(DISTINCT case_id) AS BIGINT) AS cases FROM pairs GROUP BY company, opponent, direction""")

sql_query("clients_of_firm", "lineitem orders", f"""
WITH rep AS ({REP}) SELECT r.firm, o.o_custkey AS client, @set(r.side) AS sides, CAST(count(DISTINCT r.case_id) AS BIGINT) AS cases
FROM rep r JOIN orders o ON o.o_orderkey = r.case_id WHERE r.side = 'C' GROUP BY r.firm, o.o_custkey""")

sql_query("opponents_of_firm", "lineitem orders", f"""
WITH rep AS ({REP}), own AS (SELECT DISTINCT r.firm, o.o_custkey AS client FROM rep r JOIN orders o ON o.o_orderkey = r.case_id WHERE r.side = 'C')
SELECT r.firm, o.o_custkey AS opponent, CAST(count(DISTINCT r.case_id) AS BIGINT) AS cases
FROM rep r JOIN orders o ON o.o_orderkey = r.case_id LEFT ANTI JOIN own w ON w.firm = r.firm AND w.client = o.o_custkey
WHERE r.side = 'R' GROUP BY r.firm, o.o_custkey""", oracle=f"""
WITH rep AS ({REP}), own AS (SELECT DISTINCT r.firm, o.o_custkey AS client FROM rep r JOIN orders o ON o.o_orderkey = r.case_id WHERE r.side = 'C')
SELECT r.firm, o.o_custkey AS opponent, CAST(count(DISTINCT r.case_id) AS BIGINT) AS cases
FROM rep r JOIN orders o ON o.o_orderkey = r.case_id
WHERE r.side = 'R' AND NOT EXISTS (SELECT 1 FROM own w WHERE w.firm = r.firm AND w.client = o.o_custkey) GROUP BY r.firm, o.o_custkey""")

COCOUNSEL = f"""
WITH rep AS ({REP}), side AS (SELECT case_id, firm, side FROM rep WHERE side IN ('C', 'R') {{law}}),
pairs AS (SELECT x.firm AS a, y.firm AS b, x.case_id FROM side x JOIN side y ON x.case_id = y.case_id AND x.side = y.side AND x.firm < y.firm)
SELECT a, b, CAST(count(DISTINCT case_id) AS BIGINT) AS cases FROM pairs GROUP BY a, b"""
sql_query("cocounsel_pairs", "lineitem", COCOUNSEL.format(law=""))
sql_query("cocounsel_pairs_law", "lineitem supplier", COCOUNSEL.format(law="AND firm IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 2500)"))
sql_query("cocounsel_of", "lineitem", f"""
WITH rep AS ({REP}), side AS (SELECT case_id, firm, side FROM rep WHERE side IN ('C', 'R'))
SELECT x.firm, y.firm AS partner, CAST(count(DISTINCT x.case_id) AS BIGINT) AS cases FROM side x JOIN side y ON y.case_id = x.case_id AND y.side = x.side AND y.firm <> x.firm GROUP BY x.firm, y.firm""")

SPAN = f"""
span AS (SELECT o.o_orderkey AS case_id, CAST(year(o.o_orderdate) AS INT) AS lo, o.o_orderstatus = 'O' AS open,
  greatest(CAST(year(o.o_orderdate) AS INT), coalesce(max(CAST(year(l.l_shipdate) AS INT)), CASE WHEN max(o.o_orderstatus) = 'O' THEN {YEAR} ELSE CAST(year(o.o_orderdate) AS INT) END)) AS hi
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderdate, o.o_orderstatus)"""
sql_query("caseload_by_year", "orders lineitem", f"""
WITH {SPAN}, years AS (SELECT case_id, open, @rows(lo, least(hi, {YEAR})) AS y FROM span)
SELECT CAST(y AS INT) AS y, CAST(count(*) AS BIGINT) AS cases, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) AS BIGINT) AS open_cases FROM years GROUP BY y""")
sql_query("caseload_of_firms", "orders lineitem", f"""
WITH rep AS ({REP}), span AS (SELECT r.firm, r.case_id, least(CAST(year(r.first_filed) AS INT), CAST(year(o.o_orderdate) AS INT)) AS lo,
  greatest(CAST(year(r.first_filed) AS INT), CAST(year(r.last_filed) AS INT)) AS hi, o.o_orderstatus = 'O' AS open FROM rep r JOIN orders o ON o.o_orderkey = r.case_id),
years AS (SELECT firm, open, @rows(lo, least(hi, {YEAR})) AS y FROM span)
SELECT firm, CAST(y AS INT) AS y, CAST(count(*) AS BIGINT) AS cases, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) AS BIGINT) AS open_cases FROM years GROUP BY firm, y""")
sql_query("litigation_by_year", "lineitem orders", f"""
WITH rep AS ({REP}) SELECT CAST(year(o.o_orderdate) AS INT) AS y, r.side, CAST(count(DISTINCT r.case_id) AS BIGINT) AS cases
FROM rep r JOIN orders o ON o.o_orderkey = r.case_id GROUP BY CAST(year(o.o_orderdate) AS INT), r.side""")
sql_query("yearly_gapfill", "orders", """
WITH n AS (SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY CAST(year(o_orderdate) AS INT)),
span AS (SELECT min(y) AS lo, max(y) AS hi FROM n), years AS (SELECT @rows(lo, hi) AS y FROM span),
filled AS (SELECT CAST(s.y AS INT) AS y, coalesce(n.n, 0) AS n FROM years s LEFT JOIN n ON n.y = s.y)
SELECT y, CAST(n AS BIGINT) AS n, n = max(n) OVER () AS peak FROM filled""")

sql_query("status_headline", "orders", """
WITH n AS (SELECT o_orderpriority AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority),
top AS (SELECT status, n, row_number() OVER (ORDER BY n DESC, status) AS r FROM n)
SELECT status, n FROM top WHERE r <= 4 UNION ALL SELECT 'total', CAST(count(*) AS BIGINT) FROM orders""")
sql_query("party_groups", "orders lineitem", """
WITH g AS (SELECT o.o_orderkey AS case_id, coalesce(@set(l.l_suppkey), '') AS firms FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)
SELECT CASE WHEN firms = '' THEN 'counsel not identified' ELSE firms END AS counsel, CAST(count(*) AS BIGINT) AS cases, min(case_id) AS first_case FROM g GROUP BY firms""")
sql_query("rank_with_ties", "lineitem", """
WITH n AS (SELECT l_suppkey AS firm, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey)
SELECT firm, n, CAST(row_number() OVER (ORDER BY n DESC, firm) AS INT) AS position, CAST(rank() OVER (ORDER BY n DESC) AS INT) AS tied FROM n""")
sql_query("topk_labels", "lineitem", """
WITH c AS (SELECT DISTINCT l_suppkey AS firm, l_orderkey AS case_id FROM lineitem),
r AS (SELECT firm, case_id, row_number() OVER (PARTITION BY firm ORDER BY case_id DESC) AS n, count(*) OVER (PARTITION BY firm) AS total FROM c)
SELECT firm, max(CASE WHEN n = 1 THEN case_id END) AS c1, max(CASE WHEN n = 2 THEN case_id END) AS c2, max(CASE WHEN n = 3 THEN case_id END) AS c3, max(CASE WHEN n = 4 THEN case_id END) AS c4,
  CAST(greatest(max(total) - 4, 0) AS BIGINT) AS more FROM r GROUP BY firm""")
sql_query("firm_pairs_case_set", "lineitem", f"""
WITH rep AS ({REP}), side AS (SELECT case_id, firm, side FROM rep WHERE side = 'C'),
pairs AS (SELECT x.firm AS a, y.firm AS b, x.case_id FROM side x JOIN side y ON x.case_id = y.case_id AND x.firm < y.firm)
SELECT a, b, @set(case_id) AS cases FROM pairs GROUP BY a, b""")
sql_query("known_set_having", "lineitem supplier", """
SELECT l_suppkey AS firm FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_acctbal HAVING max(s_acctbal) >= 9000 OR count(DISTINCT l_orderkey) >= 500""")
sql_query("shared_family_having", "customer nation", """
WITH f AS (SELECT c.c_custkey AS company, n.n_name AS family, count(*) OVER (PARTITION BY n.n_name, c.c_mktsegment) AS members FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT company, CASE WHEN company % 10 = 0 THEN 'pinned' WHEN members > 1 THEN family END AS family FROM f""")
sql_query("stints", "lineitem", """
SELECT l_partkey AS attorney, l_suppkey AS firm, @iso(min(l_shipdate)) AS first_filed, @iso(max(l_shipdate)) AS last_filed, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS cases, @set(l_orderkey) AS case_set
FROM lineitem GROUP BY l_partkey, l_suppkey""")
sql_query("case_status_by_party_role", "orders customer nation region", """
SELECT r.r_name AS region, o.o_orderstatus AS status, CAST(count(*) AS BIGINT) AS cases, CAST(count(DISTINCT o.o_custkey) AS BIGINT) AS companies
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, o.o_orderstatus""")
sql_query("entity_counts", "lineitem orders", """
SELECT CAST(count(DISTINCT l_orderkey) AS BIGINT) AS cases_with_counsel, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS firms, CAST(count(DISTINCT l_partkey) AS BIGINT) AS attorneys,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS companies FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
sql_query("largest_entities", "lineitem", """
SELECT l_suppkey AS firm, CAST(count(*) AS BIGINT) AS spellings, @set(l_returnflag) AS roles FROM lineitem GROUP BY l_suppkey ORDER BY spellings DESC, firm LIMIT 15""")

#: The views of the web application, one named query each.
sql_query("firm_view", "lineitem orders", f"""
WITH rep AS ({REP}) SELECT r.firm, r.case_id, r.side, o.o_orderstatus AS status, @iso(r.first_filed) AS first_filed, r.filings FROM rep r JOIN orders o ON o.o_orderkey = r.case_id""")
sql_query("attorney_view", "lineitem", """
SELECT l_partkey AS attorney, l_suppkey AS firm, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS cases, @iso(min(l_shipdate)) AS first_filed, @iso(max(l_shipdate)) AS last_filed FROM lineitem GROUP BY l_partkey, l_suppkey""")
sql_query("company_view", "orders lineitem", """
SELECT o.o_custkey AS company, o.o_orderkey AS case_id, o.o_orderstatus AS status, coalesce(@set(l.l_suppkey), '') AS firms FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey, o.o_orderstatus""")
sql_query("family_view", "customer orders nation", """
SELECT n.n_name AS family, c.c_custkey AS company, c.c_name AS name, CAST(count(o.o_orderkey) AS BIGINT) AS cases FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name, c.c_custkey, c.c_name""")
