"""DuckDB text of the travel views, used as a common WITH prefix by the oracle SQL.

The same derivation rules as ``sources.fixtures`` and ``sources.loaders``,
written independently in DuckDB's dialect so that the two engines check each
other.
"""

VIEWS = r"""
WITH np AS (
  SELECT n_nationkey,
         replace(n_name, '_', ' ') || ' (' || chr(CAST(65 + n_nationkey AS INTEGER))
           || chr(CAST(65 + n_regionkey AS INTEGER)) || ')' AS place
  FROM nation
),
flights AS (
  SELECT o.o_orderkey AS travelCode,
         o.o_custkey + CASE WHEN o.o_orderkey % 89 = 0 THEN 1000000 ELSE 0 END AS userCode,
         nf.place AS "from",
         nt.place AS "to",
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'firstClass'
              WHEN o.o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'premium'
              ELSE 'economic' END AS flightType,
         CAST(100 + 37 * abs(c.c_nationkey - CAST(o.o_orderkey % 25 AS INTEGER)) AS DOUBLE) / 2
           + CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1500
                  WHEN o.o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 700 ELSE 280 END
           + CAST(floor(o.o_totalprice) AS BIGINT) % 100 AS price,
         CAST(100 + 37 * abs(c.c_nationkey - CAST(o.o_orderkey % 25 AS INTEGER)) AS DOUBLE) / 512 AS "time",
         CAST(100 + 37 * abs(c.c_nationkey - CAST(o.o_orderkey % 25 AS INTEGER)) AS DOUBLE) AS distance,
         CASE o.o_orderstatus WHEN 'P' THEN 'CloudFy' WHEN 'F' THEN 'FlyingDrops' ELSE 'Rainbow' END AS agency,
         CASE WHEN o.o_orderkey % 97 = 0 THEN 'bad-date' ELSE strftime(o.o_orderdate, '%m/%d/%Y') END AS "date"
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN np nf ON nf.n_nationkey = c.c_nationkey
  LEFT JOIN np nt ON nt.n_nationkey = CAST(o.o_orderkey % 25 AS INTEGER)
),
hotels AS (
  SELECT l.l_orderkey AS travelCode,
         o.o_custkey AS userCode,
         p.p_brand AS name,
         np.place AS place,
         l.l_linenumber AS days,
         CAST(floor(p.p_retailprice) AS DOUBLE) - 880 + 8 * CAST(substr(p.p_brand, 7) AS INTEGER) AS price,
         (CAST(floor(p.p_retailprice) AS DOUBLE) - 880 + 8 * CAST(substr(p.p_brand, 7) AS INTEGER)) * l.l_linenumber AS total,
         strftime(l.l_shipdate, '%m/%d/%Y') AS "date"
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN np ON np.n_nationkey = CAST(substr(p.p_brand, 7) AS INTEGER) - 1
),
users AS (
  SELECT c_custkey AS code,
         c_mktsegment AS company,
         CASE WHEN c_custkey % 71 = 0 THEN NULL
              ELSE (CASE c_custkey % 6 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Bruno' WHEN 2 THEN 'Carla'
                                       WHEN 3 THEN 'Diego' WHEN 4 THEN 'Elisa' ELSE 'Fabio' END) || ' ' || c_name
         END AS name,
         CASE WHEN c_custkey % 10 = 9 THEN 'none' WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
         CASE WHEN c_custkey % 53 = 0 THEN NULL
              ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 88 + 16 AS INTEGER) END AS age
  FROM customer
),
tflights AS (
  SELECT travelCode, userCode, "from", "to", flightType, price, "time", distance, agency,
         CAST(try_strptime("date", '%m/%d/%Y') AS DATE) AS "date",
         round_even(price * 83.0, 0) AS price_inr,
         CASE WHEN regexp_matches("from", '^(.*?)\s*\(') THEN regexp_extract("from", '^(.*?)\s*\(', 1) ELSE "from" END AS from_city,
         CASE WHEN regexp_matches("to", '^(.*?)\s*\(') THEN regexp_extract("to", '^(.*?)\s*\(', 1) ELSE "to" END AS to_city
  FROM flights
),
thotels AS (
  SELECT travelCode, userCode, name, place, days, price, total,
         CAST(try_strptime("date", '%m/%d/%Y') AS DATE) AS "date",
         round_even(price * 83.0, 0) AS price_inr,
         round_even(total * 83.0, 0) AS total_inr,
         CASE WHEN regexp_matches(place, '^(.*?)\s*\(') THEN regexp_extract(place, '^(.*?)\s*\(', 1) ELSE place END AS city,
         nullif(regexp_extract(place, '\(([A-Z]{2})\)', 1), '') AS state_code
  FROM hotels
)
"""


def with_views(select_sql: str) -> str:
    return VIEWS + select_sql
