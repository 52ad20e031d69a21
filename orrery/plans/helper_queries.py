"""Queries on smaller helpers: overlays, migrations, counts, batches, repair sets, grouping hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators import graph as G
from orrery.operators import observe, similar, temporal
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans import graph_queries as GR
from orrery.plans import time_queries as T
from orrery.plans.registry import query

K, DIMS, DELTAS = "c_custkey", S.CUSTOMER_DIMS, L.CUSTOMERS.deltas
GEO = f"WITH {S.CUSTOMER_GEO}"


def geo(spark, sf_dir):
    return L.customer_geometry(spark, sf_dir)[0]


@query("migrate_shapes", f"{GEO} SELECT c_custkey, {', '.join(f'round(least(greatest(delta_{d} * sd_{d} + mu_{d}, 0), 1), 6) AS shape_{d}' for d in DIMS)} FROM geo, geo_stats")
def migrate_shapes(spark, sf_dir):
    rows, c = L.customer_geometry(spark, sf_dir)
    return rows.select(K, *(F.round(F.least(F.greatest(F.col(d) * s + m, F.lit(0.0)), F.lit(1.0)), 6).alias(n) for d, m, s, n in zip(DELTAS, c.mu, c.sigma, L.CUSTOMERS.shapes)))


@query("alias_population_count", f"{GEO} SELECT count(*) AS n FROM geo WHERE delta_order_count - 0.5e0 > 0")
def alias_population_count(spark, sf_dir):
    inside = X.signed_distance([F.col(d) for d in DELTAS], (1.0, 0.0, 0.0, 0.0), 0.5) > 0
    return geo(spark, sf_dir).where(inside).agg(F.count(F.lit(1)).alias("n"))


@query("agent_overlay", "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE user_id % 2 = 0 UNION ALL SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1")
def agent_overlay(spark, sf_dir):
    events = L.table(spark, sf_dir, "events").select("user_id", "event_type")
    return events.where("user_id % 2 = 0").unionByName(events.where("event_type = 'click'")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("contagion_score_batch", f"""WITH {S.SUPPLIER_GEO}, {S.EDGES}, nb AS (SELECT DISTINCT * FROM (SELECT from_key AS key, to_key AS other FROM edges WHERE from_key <> to_key UNION ALL SELECT to_key, from_key FROM edges WHERE from_key <> to_key)),
c AS (SELECT key, avg(coalesce(is_anomaly, false)::INT) AS r FROM nb LEFT JOIN sgeo ON s_suppkey = other GROUP BY 1) SELECT count(*) AS n, round(avg(r), 6) AS mean_ratio, round(max(r), 6) AS max_ratio, count(*) FILTER (r >= 0.5) AS high FROM c""")
def contagion_score_batch(spark, sf_dir):
    stats = G.contagion(L.hand_overs(spark, sf_dir), L.supplier_geometry(spark, sf_dir)[0], "s_suppkey")
    return stats.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("contagion_ratio"), 6).alias("mean_ratio"), F.round(F.max("contagion_ratio"), 6).alias("max_ratio"), F.count(F.when(F.col("contagion_ratio") >= 0.5, 1)).alias("high"))


@query("repair_sets", f"""{GEO}, x AS (SELECT c_custkey, theta, norm, unnest([{', '.join(f"{{'s': round(delta_{d} * delta_{d}, 9), 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(DIMS))}]) AS z FROM geo WHERE is_anomaly AND norm > theta + 1e-6),
c AS (SELECT c_custkey, theta, norm, z.n AS n, z.i AS i, z.s AS s, coalesce(sum(z.s) OVER (PARTITION BY c_custkey ORDER BY z.s DESC, z.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT c_custkey, string_agg(n, ',' ORDER BY s DESC, i) AS repair FROM c WHERE norm * norm - before >= theta * theta GROUP BY 1""")
def repair_sets(spark, sf_dir):
    rows = similar.explain(geo(spark, sf_dir).where("norm > theta + 1e-6"), K, DIMS, DELTAS)
    return rows.select(K, F.array_join("repair", ",").alias("repair"))


@query("grouping_properties", "SELECT * FROM (SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS n FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer) WHERE n BETWEEN 2 AND 50")
def grouping_properties(spark, sf_dir):
    rows = L.table(spark, sf_dir, "customer")
    strings = [c for c, kind in rows.dtypes if kind == "string"]
    counts = rows.agg(*(F.count_distinct(c).alias(c) for c in strings))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in strings))).alias("x")).select("x.*").where("n between 2 and 50")


@query("trajectory_cosine", f"""{T.WITH}, t AS (SELECT c_custkey, {', '.join(f'avg(delta_{d}) AS m_{d}' for d in DIMS)} FROM slices GROUP BY 1)
SELECT b.c_custkey, round((({' + '.join(f'a.m_{d} * b.m_{d}' for d in DIMS)}) / (sqrt({' + '.join(f'a.m_{d} * a.m_{d}' for d in DIMS)}) * sqrt({' + '.join(f'b.m_{d} * b.m_{d}' for d in DIMS)})) + 1) / 2, 6) AS alignment FROM t a, t b WHERE a.c_custkey = 17 AND b.c_custkey <> 17""")
def trajectory_cosine(spark, sf_dir):
    rows = temporal.trajectories(T.slices(spark, sf_dir)[0], K, DELTAS)
    names = [f"mean_{d}" for d in DELTAS]
    point = rows.where(F.col(K) == 17).select(*(F.col(n).alias(f"p_{n}") for n in names))
    a, b = [F.col(f"p_{n}") for n in names], [F.col(n) for n in names]
    cosine = X.dot(a, b) / (X.norm(a) * X.norm(b))
    return rows.where(F.col(K) != 17).join(F.broadcast(point)).select(K, F.round((cosine + 1) / 2, 6).alias("alignment"))


@query("witness_overlap", f"""{GEO}, x AS (SELECT c_custkey, theta, unnest([{', '.join(f"{{'s': round(delta_{d} * delta_{d}, 9), 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(DIMS))}]) AS z FROM geo WHERE is_anomaly AND norm > theta + 1e-6),
c AS (SELECT c_custkey, theta, z.n AS n, z.s AS s, coalesce(sum(z.s) OVER (PARTITION BY c_custkey ORDER BY z.s DESC, z.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x), w AS (SELECT c_custkey, list(n) AS w FROM c WHERE before < theta * theta GROUP BY 1)
SELECT c_custkey, round(len(list_intersect(w, ['order_sum', 'order_count'])) / len(list_distinct(list_concat(w, ['order_sum', 'order_count'])))::DOUBLE, 6) AS overlap FROM w""")
def witness_overlap(spark, sf_dir):
    rows = similar.explain(geo(spark, sf_dir).where("norm > theta + 1e-6"), K, DIMS, DELTAS)
    return rows.select(K, F.round(X.jaccard(F.col("witness"), F.array(F.lit("order_sum"), F.lit("order_count"))), 6).alias("overlap"))


@query("chains_of_entities", f"{GR._chains_sql('7', 2)} SELECT key, count(*) AS n_chains FROM (SELECT DISTINCT ev, unnest(keys) AS key FROM chains) GROUP BY 1")
def chains_of_entities(spark, sf_dir):
    chains = G.discover_chains(L.hand_overs(spark, sf_dir), [7], hops=2).withColumn("chain_id", F.sha2(F.array_join("event_keys", ","), 256))
    return G.chain_members(chains).groupBy("key").agg(F.count_distinct("chain_id").alias("n_chains"))


@query("geometry_mode", f"{GEO} " + " UNION ALL ".join(f"SELECT 'shape_{d}' AS dimension, CASE WHEN count(DISTINCT round(shape_{d}, 6)) <= 3 THEN 'binary' WHEN count(DISTINCT round(shape_{d}, 6)) > 5 THEN 'continuous' ELSE 'mixed' END AS mode FROM geo" for d in DIMS))
def geometry_mode(spark, sf_dir):
    rows = geo(spark, sf_dir)
    return spark.createDataFrame([(d, observe.geometry_mode(rows, d)) for d in L.CUSTOMERS.shapes], "dimension string, mode string")


@query("stale_forecasts", f"{T.WITH} SELECT c_custkey, (9.9e8 - max(window_start)) / 86400 > 180 AS is_stale FROM slices GROUP BY 1")
def stale_forecasts(spark, sf_dir):
    last = T.slices(spark, sf_dir)[0].groupBy(K).agg(F.max("window_start").alias("last"))
    return last.select(K, temporal.stale(F.col("last"), F.lit(9.9e8)).alias("is_stale"))


@query("driving_dimensions_of_each", f"""{GEO}, x AS (SELECT c_custkey, unnest([{', '.join(f"{{'s': round(-(delta_{d} * delta_{d}) / greatest({' + '.join(f'delta_{e} * delta_{e}' for e in DIMS)}, 1e-300), 9), 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(DIMS))}]) AS z FROM geo WHERE is_anomaly),
r AS (SELECT c_custkey, z.n AS n, z.s AS s, z.i AS i, row_number() OVER (PARTITION BY c_custkey ORDER BY z.s, z.i) AS k FROM x WHERE z.s < -0.05) SELECT c_custkey, string_agg(n, ',' ORDER BY k) AS driving FROM r WHERE k <= 3 GROUP BY 1""")
def driving_dimensions_of_each(spark, sf_dir):
    return similar.explain(geo(spark, sf_dir), K, DIMS, DELTAS).select(K, F.array_join("driving", ",").alias("driving"))
