"""Pieces of DuckDB SQL that the oracles share: populations, their geometry, and the graph."""

from __future__ import annotations


def geometry(rows: str, key: str, dimensions: list[str], name: str = "geo", kinds: dict[str, str] | None = None, extra: str = "", percentile: float = 0.95) -> str:
    """CTEs from `rows` (key and a column per dimension) to `name` with shapes, deltas, norm, theta, flag and ranks."""
    kinds = kinds or {}
    maxima, shapes = [], []
    for d in dimensions:
        kind = kinds.get(d, "continuous")
        if kind == "continuous":
            maxima.append(f"greatest(1.0e0, coalesce(floor(quantile_cont(CASE WHEN {d} > 0 THEN {d}::DOUBLE END, 0.99e0)), 1.0e0)) AS em_{d}")
            shapes.append(f"least(greatest(coalesce({d}::DOUBLE, 0.0e0), 0.0e0), em_{d}) / em_{d} AS shape_{d}")
        elif kind == "event":
            maxima.append(f"greatest(1e-9, coalesce(quantile_cont(CASE WHEN {d} > 0 THEN {d}::DOUBLE END, 0.99e0), 1.0e0)) AS em_{d}")
            shapes.append(f"least(greatest(coalesce({d}::DOUBLE, 0.0e0) / em_{d}, 0.0e0), 3.0e0) AS shape_{d}")
        elif kind == "binary":
            shapes.append(f"CASE WHEN {d} IS NOT NULL AND {d}::VARCHAR <> '' THEN 1.0e0 ELSE 0.0e0 END AS shape_{d}")
        else:
            shapes.append(f"CASE WHEN {d} IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END AS shape_{d}")
    floors = {d: 0.2 if kinds.get(d) == "property" else 0.01 for d in dimensions}
    moments = ", ".join(f"avg(shape_{d}) AS mu_{d}, greatest(stddev_pop(shape_{d}), {floors[d]}e0) AS sd_{d}" for d in dimensions)
    deltas = ", ".join(f"(shape_{d} - mu_{d}) / sd_{d} AS delta_{d}" for d in dimensions)
    square = " + ".join(f"delta_{d} * delta_{d}" for d in dimensions)
    tails = ", ".join(f"quantile_cont(abs(delta_{d}), 0.99e0) AS tail_{d}" for d in dimensions)
    wide = " + ".join(f"(round(abs(delta_{d}), 9) > round(tail_{d}, 9))::INT" for d in dimensions)
    em = f"{name}_em AS (SELECT {', '.join(maxima)} FROM {rows})," if maxima else f"{name}_em AS (SELECT 1 AS em_none),"
    return f"""
{em}
{name}_shape AS (SELECT r.*, {', '.join(shapes)} FROM {rows} r CROSS JOIN {name}_em),
{name}_stats AS (SELECT {moments} FROM {name}_shape),
{name}_delta AS (SELECT s.*, {deltas} FROM {name}_shape s CROSS JOIN {name}_stats),
{name}_norm AS (SELECT *, sqrt({square}) AS norm FROM {name}_delta),
{name}_theta AS (SELECT quantile_cont(norm, {percentile}e0) AS theta, {tails}, count(*) AS n_rows FROM {name}_norm),
{name} AS (SELECT *, theta > 0 AND round(norm, 9) >= round(theta, 9) AS is_anomaly,
  (rank() OVER (ORDER BY round(norm, 9)) - 1) / n_rows::DOUBLE * 100 AS delta_rank_pct,
  1 - (rank() OVER (ORDER BY round(norm, 9)) - 1) / n_rows::DOUBLE AS conformal_p,
  {wide} AS n_anomalous_dims FROM {name}_norm CROSS JOIN {name}_theta)
"""


CUSTOMER_DIMS = ["order_count", "order_sum", "order_mean", "order_max"]
SUPPLIER_DIMS = ["line_count", "qty_sum", "price_mean", "part_count"]
SALES_DIMS = ["customer", "price", "day"]

CUSTOMERS = """customers AS (SELECT c.*, coalesce(o.order_count, 0.0e0) AS order_count, coalesce(o.order_sum, 0.0e0) AS order_sum,
  coalesce(o.order_mean, 0.0e0) AS order_mean, coalesce(o.order_max, 0.0e0) AS order_max
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS order_count, sum(o_totalprice) AS order_sum, avg(o_totalprice) AS order_mean, max(o_totalprice) AS order_max
    FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1) o ON c_custkey = o_custkey)"""
SUPPLIERS = """suppliers AS (SELECT s.*, coalesce(l.line_count, 0.0e0) AS line_count, coalesce(l.qty_sum, 0.0e0) AS qty_sum,
  coalesce(l.price_mean, 0.0e0) AS price_mean, coalesce(l.part_count, 0.0e0) AS part_count
  FROM supplier s LEFT JOIN (SELECT l_suppkey, count(*)::DOUBLE AS line_count, sum(l_quantity) AS qty_sum, avg(l_extendedprice) AS price_mean, count(DISTINCT l_partkey)::DOUBLE AS part_count
    FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1) l ON s_suppkey = l_suppkey)"""
SALES = "sales AS (SELECT *, o_custkey AS customer, o_totalprice AS price, day(o_orderdate)::DOUBLE AS day FROM orders)"
SALES_KINDS = {"customer": "binary", "price": "event", "day": "event"}

CUSTOMER_GEO = CUSTOMERS + "," + geometry("customers", "c_custkey", CUSTOMER_DIMS, "geo")
SUPPLIER_GEO = SUPPLIERS + "," + geometry("suppliers", "s_suppkey", SUPPLIER_DIMS, "sgeo")
SALES_GEO = SALES + "," + geometry("sales", "o_orderkey", SALES_DIMS, "egeo", SALES_KINDS)

EDGES = """edges AS (SELECT l_suppkey AS from_key, to_key, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_key, epoch_us(l_shipdate) / 1e6 AS timestamp, l_extendedprice AS amount
  FROM (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS to_key FROM lineitem) WHERE to_key IS NOT NULL)"""
