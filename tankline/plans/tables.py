"""The model's tables as projections of the given ones; one text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

TABLES: dict[str, str] = {
    "stop": """
        SELECT o_orderkey AS stop_id, o_custkey AS card_id, CASE WHEN o_custkey % 20 <> 0 THEN o_custkey END AS driver_id,
               CASE WHEN o_custkey % 15 <> 0 THEN o_custkey % 200 END AS truck_id,
               CASE WHEN o_custkey % 13 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN '0' || CAST(o_custkey % 200 AS VARCHAR(9)) WHEN o_orderkey % 11 = 0 THEN CAST(o_custkey % 190 AS VARCHAR(9)) ELSE CAST(o_custkey % 200 AS VARCHAR(9)) END AS unit_raw,
               CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE c_name END AS driver_raw,
               CASE WHEN o_orderkey % 25 <> 0 THEN o_orderkey % 100 END AS station_id,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INT) AS occurred_at,
               CAST(o_orderdate AS DATE) AS day, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS total_c,
               CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'missing' END AS status,
               CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end, CASE WHEN n_regionkey = 1 THEN 'USD' ELSE 'CAD' END AS currency
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "line": """
        SELECT l_orderkey AS stop_id, l_partkey AS part_id, l_suppkey AS station_id, CASE l_returnflag WHEN 'A' THEN 'TA' WHEN 'N' THEN 'DF' ELSE 'S' END AS product,
               CAST(ROUND(l_quantity * 100) AS BIGINT) AS qty_c, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS amount_c,
               CAST(FLOOR(l_extendedprice / l_quantity * 10000 + 0.5) AS BIGINT) AS billed_t, CAST(ROUND(l_discount * 100) AS BIGINT) AS disc_p, CAST(ROUND(l_tax * 100) AS BIGINT) AS tax_p,
               CAST(l_shipdate AS DATE) AS day, l_linestatus AS line_status
        FROM lineitem""",
    "station": """
        SELECT s_suppkey AS station_id, s_name AS site_name, s_nationkey AS lane_id, n_name AS city, CASE WHEN n_regionkey = 1 THEN 'US' ELSE 'CA' END AS country,
               CAST(30 + s_suppkey % 17 + s_suppkey % 10 / 16.0 AS DOUBLE) AS lat, CAST(-120 + s_suppkey % 43 + s_suppkey % 7 / 8.0 AS DOUBLE) AS lng,
               CASE s_suppkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'city' ELSE 'unresolved' END AS resolution
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "driver": "SELECT c_custkey AS driver_id, c_name AS driver_name, c_nationkey AS home_id FROM customer",
    "fx": """
        SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end,
               CASE WHEN EXTRACT(MONTH FROM CAST(date_trunc('week', o_orderdate) AS DATE) + 6) <> 2 THEN 1250000 + 1000 * CAST(EXTRACT(DAY FROM CAST(date_trunc('week', o_orderdate) AS DATE) + 6) AS BIGINT) END AS rate_micro
        FROM orders""",
    "published": """
        SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS valid_on, CAST(MIN(FLOOR(l_extendedprice / l_quantity * 10000 + 0.5)) AS BIGINT) AS price_t, COUNT(*) AS n_prices
        FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "assignment": """
        SELECT c_custkey AS driver_id, c_custkey % 200 + y.k AS truck_id, make_date(1995 + 2 * y.k, 1, 1) AS valid_from, CASE WHEN y.k < 3 THEN make_date(1996 + 2 * y.k, 12, 31) END AS valid_to
        FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) y WHERE c_custkey % 9 <> 0""",
    "event": "SELECT event_id, CAST(ts AS TIMESTAMP) AS happened, user_id, event_type, CAST(ROUND(value * 100) AS BIGINT) AS value_c, props FROM events",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of the model, from Parquet."""
    out = []
    for name in names:
        if name in BASE:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            continue
        used = [b for b in BASE if b in TABLES[name].replace("(", " ").split()]
        text = TABLES[name]
        for b in used:
            text = text.replace(f"FROM {b}", f"FROM {{{b}}}").replace(f"JOIN {b} ", f"JOIN {{{b}}} ")
        text = text.replace("VARCHAR(9)", "STRING")
        out.append(spark.sql(text, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used}))
    return out


def twin(sql: str, *names: str) -> str:
    """DuckDB text: the named tables as common table expressions before `sql` (which may begin with its own)."""
    head = ", ".join(f"{n} AS ({TABLES[n]})" for n in names)
    if not head:
        return sql
    if sql.strip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql.strip()[15:]}"
    return f"WITH {head}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {head} {sql}"
