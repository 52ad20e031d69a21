"""Queries in delta space: anomalies, boundaries, neighbours, clusters, summaries, screening and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators import graph as G
from orrery.operators import observe as O
from orrery.operators import scan, similar
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans.registry import query

K, DIMS, DELTAS, SHAPES = "c_custkey", S.CUSTOMER_DIMS, L.CUSTOMERS.deltas, L.CUSTOMERS.shapes
REF = 17
GEO = f"WITH {S.CUSTOMER_GEO}"
SQUARES = " + ".join(f"pow(a.delta_{d} - b.delta_{d}, 2)" for d in DIMS)


def geo(spark, sf_dir):
    return L.customer_geometry(spark, sf_dir)[0]


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("pi5_attract_anomaly", f"{GEO} SELECT c_custkey, round(norm, 6) AS norm FROM geo WHERE theta > 0 AND round(norm, 9) >= round(theta * 1.2, 9) ORDER BY norm DESC, c_custkey LIMIT 10 OFFSET 3")
def pi5_attract_anomaly(spark, sf_dir):
    return similar.anomalies(geo(spark, sf_dir), K, 1.2, 10, 3).select(K, *r("norm"))


@query("pi6_attract_boundary", f"{GEO}, m AS (SELECT c_custkey, (delta_order_count - delta_order_mean - 0.5e0) / sqrt(2.0e0) AS d FROM geo) SELECT c_custkey, round(d, 6) AS signed_distance FROM m WHERE d < 0 ORDER BY abs(d), c_custkey LIMIT 10")
def pi6_attract_boundary(spark, sf_dir):
    return similar.boundary(geo(spark, sf_dir), K, DELTAS, (1.0, 0.0, -1.0, 0.0), 0.5, "out").select(K, *r("signed_distance"))


HUB = " + ".join(f"least(greatest(shape_{d}, 0), 1) * em_{d}" for d in DIMS)


@query("pi7_attract_hub", f"{GEO} SELECT c_custkey, round({HUB}, 2) AS hub_score, is_anomaly FROM geo CROSS JOIN geo_em ORDER BY {HUB} DESC, c_custkey LIMIT 10")
def pi7_attract_hub(spark, sf_dir):
    rows, c = L.customer_geometry(spark, sf_dir)
    return O.hubs(rows, K, SHAPES, [c.edge_max[d] for d in DIMS]).select(K, F.round("hub_score", 2).alias("hub_score"), "is_anomaly")


@query("hub_score_stats", f"{GEO}, h AS (SELECT {HUB} AS h FROM geo CROSS JOIN geo_em) SELECT round(avg(h), 4) AS mean, round(stddev_pop(h), 4) AS std, round(max(h), 4) AS max, " + ", ".join(f"round(quantile_cont(h, {q}e0), 4) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95)) + f", round(max(h) / (SELECT {' + '.join('em_' + d for d in DIMS)} FROM geo_em), 6) AS share_of_ceiling FROM h")
def hub_score_stats(spark, sf_dir):
    rows, c = L.customer_geometry(spark, sf_dir)
    return O.hub_statistics(rows, SHAPES, [c.edge_max[d] for d in DIMS])


@query("pi8_attract_cluster")
def pi8_attract_cluster(spark, sf_dir):
    return similar.clusters(geo(spark, sf_dir), K, DELTAS, 5)[1]


@query("find_optimal_k")
def find_optimal_k(spark, sf_dir):
    return spark.createDataFrame([(similar.best_k(geo(spark, sf_dir), DELTAS, 6),)], "k int")


@query("find_similar_entities", f"{GEO} SELECT b.c_custkey, round(sqrt({SQUARES}), 6) AS distance FROM geo a, geo b WHERE a.c_custkey = {REF} AND b.c_custkey <> {REF} ORDER BY sqrt({SQUARES}), b.c_custkey LIMIT 5")
def find_similar_entities(spark, sf_dir):
    return similar.nearest(geo(spark, sf_dir), K, DELTAS, REF).select(K, *r("distance"))


@query("find_similar_filtered", f"{GEO} SELECT b.c_custkey, round(sqrt({SQUARES}), 6) AS distance FROM geo a, geo b WHERE a.c_custkey = {REF} AND b.c_custkey <> {REF} AND b.c_mktsegment = 'BUILDING' ORDER BY sqrt({SQUARES}), b.c_custkey LIMIT 5")
def find_similar_filtered(spark, sf_dir):
    return similar.nearest(geo(spark, sf_dir), K, DELTAS, REF, 5, F.col("c_mktsegment") == "BUILDING").select(K, *r("distance"))


@query("nearest_of_many", f"{GEO}, d AS (SELECT a.c_custkey AS query, b.c_custkey, sqrt({SQUARES}) AS distance FROM geo a JOIN geo b ON a.c_custkey <> b.c_custkey WHERE a.c_custkey % 50 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, c_custkey) AS rank FROM d) SELECT query, c_custkey, round(distance, 6) AS distance, rank FROM n WHERE rank <= 3")
def nearest_of_many(spark, sf_dir):
    rows = geo(spark, sf_dir)
    got = similar.neighbours_of(rows, rows.where(F.col(K) % 50 == 0), K, DELTAS, 3)
    return got.select("query", K, F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


CONTRAST = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, round(avg(delta_{d}) FILTER (is_anomaly), 6) AS mean_a, round(avg(delta_{d}) FILTER (NOT is_anomaly), 6) AS mean_b, round(avg(delta_{d}) FILTER (is_anomaly) - avg(delta_{d}) FILTER (NOT is_anomaly), 6) AS diff, "
    f"round((avg(delta_{d}) FILTER (is_anomaly) - avg(delta_{d}) FILTER (NOT is_anomaly)) / sqrt((var_pop(delta_{d}) FILTER (is_anomaly) + var_pop(delta_{d}) FILTER (NOT is_anomaly)) / 2), 6) AS effect FROM geo"
    for d in DIMS
)


@query("contrast_populations", f"{GEO} {CONTRAST}")
def contrast_populations(spark, sf_dir):
    return similar.contrast(geo(spark, sf_dir), DIMS, DELTAS, F.col("is_anomaly")).select("dimension", *r("mean_a", "mean_b", "diff", "effect"))


CENTROIDS = ", ".join(f"avg(delta_{d}) AS c_{d}" for d in DIMS)


@query("centroid_map", f"{GEO}, g AS (SELECT {', '.join(f'avg(delta_{d}) AS g_{d}' for d in DIMS)} FROM geo), c AS (SELECT c_mktsegment, count(*) AS size, avg(norm) AS radius, stddev_pop(norm) AS spread, {CENTROIDS} FROM geo GROUP BY 1) "
    f"SELECT c_mktsegment, size, round(radius, 6) AS radius, round(spread, 6) AS spread, round(sqrt({' + '.join(f'pow(c_{d} - g_{d}, 2)' for d in DIMS)}), 6) AS distance_to_global FROM c, g")
def centroid_map(spark, sf_dir):
    return similar.centroid_map(geo(spark, sf_dir), DELTAS, "c_mktsegment").select("c_mktsegment", "size", *r("radius", "spread", "distance_to_global"))


@query("centroid_distances", f"{GEO}, c AS (SELECT c_mktsegment, {CENTROIDS} FROM geo GROUP BY 1) SELECT a.c_mktsegment AS group_a, b.c_mktsegment AS group_b, round(sqrt({' + '.join(f'pow(a.c_{d} - b.c_{d}, 2)' for d in DIMS)}), 6) AS distance FROM c a JOIN c b ON a.c_mktsegment < b.c_mktsegment")
def centroid_distances(spark, sf_dir):
    return similar.centroid_distances(similar.centroid_map(geo(spark, sf_dir), DELTAS, "c_mktsegment"), DELTAS, "c_mktsegment").select("group_a", "group_b", *r("distance"))


@query("compare_intraclass", f"{GEO}, d AS (SELECT sqrt({SQUARES}) AS distance FROM geo a, geo b WHERE a.c_custkey = 3 AND b.c_custkey = 8) SELECT round(distance, 6) AS distance, CASE WHEN distance = 0 THEN 'identical shapes' WHEN distance < 0.1 THEN 'very similar' WHEN distance < 0.5 THEN 'similar' WHEN distance < 1 THEN 'moderately different' ELSE 'very different' END AS interpretation FROM d")
def compare_intraclass(spark, sf_dir):
    near = similar.nearest(geo(spark, sf_dir), K, DELTAS, 3, 1, F.col(K) == 8)
    return near.select(F.round("distance", 6).alias("distance"), X.distance_band(F.col("distance")).alias("interpretation"))


ROUNDED = ", ".join(f"round(delta_{d}, 1) AS delta_{d}" for d in DIMS)
LABEL = "concat_ws(',', " + ", ".join(f"CASE WHEN round(delta_{d}, 1) > 1 THEN '{d} elevated' WHEN round(delta_{d}, 1) < -1 THEN '{d} missing' END" for d in DIMS) + ")"


@query("classify_anomalies", f"{GEO}, a AS (SELECT {ROUNDED} FROM geo WHERE is_anomaly) SELECT *, count(*) AS count, any_value({LABEL}) AS label FROM a GROUP BY ALL")
def classify_anomalies(spark, sf_dir):
    return similar.classify_anomalies(geo(spark, sf_dir), DIMS, DELTAS)


@query("anomaly_clusters", f"{GEO} SELECT {ROUNDED}, count(*) AS size, round(avg(norm), 6) AS mean_norm FROM geo WHERE norm >= theta GROUP BY ALL ORDER BY size DESC, 1, 2, 3, 4 LIMIT 20")
def anomaly_clusters(spark, sf_dir):
    return O.anomaly_clusters(geo(spark, sf_dir), DELTAS)


@query("anomaly_histogram", f"{GEO} SELECT CASE WHEN norm / theta >= 1.5 THEN 1.5 WHEN norm / theta >= 1 THEN 1.0 WHEN norm / theta >= 0.75 THEN 0.75 WHEN norm / theta >= 0.5 THEN 0.5 WHEN norm / theta >= 0.25 THEN 0.25 ELSE 0.0 END::DOUBLE AS from_ratio, count(*) AS count FROM geo GROUP BY 1")
def anomaly_histogram(spark, sf_dir):
    return O.norm_histogram(geo(spark, sf_dir))


SUMS = " + ".join(f"sum(delta_{d} * delta_{d})" for d in DIMS)


@query("anomaly_driving_dimensions", f"{GEO} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(sum(delta_{d} * delta_{d}) / ({SUMS}), 6) AS share FROM geo WHERE norm >= theta" for d in DIMS) + ") WHERE share > 0.03")
def anomaly_driving_dimensions(spark, sf_dir):
    return O.driving_dimensions(geo(spark, sf_dir), DIMS, DELTAS)


@query("geometry_stats", f"{GEO} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, " + ", ".join(f"round(quantile_cont(norm, 0.{p}e0), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", round(max(norm), 6) AS max FROM geo")
def geometry_stats(spark, sf_dir):
    rows, c = L.customer_geometry(spark, sf_dir)
    return O.geometry_stats(rows, c.theta).select("total", "anomalies", *r("p50", "p75", "p90", "p95", "p99", "max"))


@query("sphere_overview", f"""WITH {S.CUSTOMER_GEO}, {S.SUPPLIER_GEO}, a AS (SELECT 'customers' AS pattern, count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies FROM geo UNION ALL SELECT 'suppliers', count(*), count(*) FILTER (is_anomaly) FROM sgeo)
SELECT pattern, total, anomalies, round(anomalies / total::DOUBLE, 6) AS rate, CASE WHEN anomalies / total::DOUBLE > 0.3 OR anomalies / total::DOUBLE < 0.001 THEN 'poor' WHEN anomalies / total::DOUBLE > 0.2 OR anomalies / total::DOUBLE < 0.01 THEN 'suspect' ELSE 'good' END AS health FROM a""")
def sphere_overview(spark, sf_dir):
    return O.sphere_overview({"customers": geo(spark, sf_dir), "suppliers": L.supplier_geometry(spark, sf_dir)[0]}).select("pattern", "total", "anomalies", *r("rate"), "health")


@query("line_geometry_stats", f"WITH {S.SALES_GEO} SELECT CASE WHEN o_custkey IS NOT NULL THEN 1 ELSE 0 END AS edges, count(*) AS count, round(avg(abs(delta_price)), 6) AS mean_abs_delta FROM egeo GROUP BY 1")
def line_geometry_stats(spark, sf_dir):
    return O.line_geometry_stats(L.sales_geometry(spark, sf_dir)[0], ["o_custkey"], "delta_price")


@query("dead_dimensions", f"WITH {S.SALES_GEO} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(var_pop(delta_{d}), 6) AS variance, var_pop(delta_{d}) < 0.01 AS is_dead FROM egeo" for d in S.SALES_DIMS))
def dead_dimensions(spark, sf_dir):
    return O.dead_dimensions(L.sales_geometry(spark, sf_dir)[0], L.SALES.names, L.SALES.deltas)


QUALITY = ["SELECT 'anomaly_rate' AS \"check\", avg(is_anomaly::INT) AS value, avg(is_anomaly::INT) > 0.3 AS is_issue FROM geo", "SELECT 'no_anomalies', avg(is_anomaly::INT), avg(is_anomaly::INT) = 0 AND count(*) > 1000 FROM geo",
    "SELECT 'degenerate', avg((norm = 0)::INT), avg((norm = 0)::INT) > 0.1 FROM geo", "SELECT 'ceiling', avg((norm >= 0.75 * theta)::INT), avg((norm >= 0.75 * theta)::INT) > 0.5 FROM geo", "SELECT 'norm_mismatch', 0.0, false",
    *(f"SELECT 'coverage_{d}', avg((shape_{d} > 0)::INT), avg((shape_{d} > 0)::INT) < 0.5 FROM geo" for d in DIMS)]


@query("data_quality", f'{GEO} SELECT "check", round(value, 6)::DOUBLE AS value, is_issue FROM ({" UNION ALL ".join(QUALITY)})')
def data_quality(spark, sf_dir):
    return O.data_quality(geo(spark, sf_dir), DIMS, SHAPES, DELTAS)


@query("check_alerts", f"""{GEO}, n AS (SELECT count(*)::DOUBLE AS n, avg(is_anomaly::INT) AS r FROM geo), m AS (SELECT count(*)::DOUBLE AS m, avg(is_anomaly::INT) AS q FROM geo WHERE c_custkey % 2 = 0)
SELECT 'rate_spike' AS alert, round(r - q, 6) AS value, r - q > 0.05 AS raised FROM n, m UNION ALL SELECT 'size_shock', round((n - m) / m, 6), abs(n - m) / m > 0.1 FROM n, m UNION ALL SELECT 'high_rate', round(r, 6), r > 0.3 FROM n UNION ALL SELECT 'very_high_rate', round(r, 6), r > 0.5 FROM n UNION ALL SELECT 'zero_rate', round(r, 6), r = 0 AND n > 1000 FROM n""")
def check_alerts(spark, sf_dir):
    rows = geo(spark, sf_dir)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"))
    return O.alerts(count(rows), count(rows.where(F.col(K) % 2 == 0)))


@query("segment_shift", f"""{GEO}, o AS (SELECT avg(is_anomaly::INT) AS overall FROM geo), s AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS size, avg(is_anomaly::INT) AS rate FROM geo GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*), avg(is_anomaly::INT) FROM geo GROUP BY 2)
SELECT "column", value, size, round(rate, 6) AS rate, round(rate / overall, 6) AS ratio FROM s, o WHERE value IS NOT NULL AND rate / overall >= 1.2""")
def segment_shift(spark, sf_dir):
    return O.segment_shifts(geo(spark, sf_dir), ["c_mktsegment", "c_nationkey", "c_name"], least_ratio=1.2)


@query("event_rate_anomaly", f"""WITH {S.CUSTOMER_GEO}, {S.SALES_GEO}, e AS (SELECT o_custkey, count(*) AS n_events, avg(is_anomaly::INT) AS event_rate FROM egeo GROUP BY 1)
SELECT c_custkey, n_events, round(event_rate, 6) AS event_rate FROM geo JOIN e ON o_custkey = c_custkey WHERE NOT is_anomaly AND n_events >= 5 AND event_rate > 0.15""")
def event_rate_anomaly(spark, sf_dir):
    return O.event_rate_divergence(geo(spark, sf_dir), K, L.sales_geometry(spark, sf_dir)[0], "o_custkey").select(K, "n_events", *r("event_rate"))


@query("witness_sets", f"""{GEO}, x AS (SELECT c_custkey, theta, unnest([{', '.join(f"{{'s': round(delta_{d} * delta_{d}, 9), 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(DIMS))}]) AS z FROM geo WHERE is_anomaly),
c AS (SELECT c_custkey, theta, z.n AS n, z.i AS i, z.s AS s, coalesce(sum(z.s) OVER (PARTITION BY c_custkey ORDER BY z.s DESC, z.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT c_custkey, string_agg(n, ',' ORDER BY s DESC, i) AS witness FROM c WHERE before < theta * theta GROUP BY 1""")
def witness_sets(spark, sf_dir):
    return similar.explain(geo(spark, sf_dir), K, DIMS, DELTAS).select(K, F.array_join("witness", ",").alias("witness"))


@query("explain_anomaly", f"{GEO} SELECT c_custkey, CASE WHEN norm / theta >= 2.5 THEN 'extreme' WHEN norm / theta >= 1.5 THEN 'high' WHEN norm / theta >= 1.1 THEN 'medium' ELSE 'low' END AS severity, round(conformal_p, 6) AS conformal_p FROM geo WHERE is_anomaly")
def explain_anomaly(spark, sf_dir):
    return similar.explain(geo(spark, sf_dir), K, DIMS, DELTAS).select(K, "severity", *r("conformal_p"))


@query("assess_false_positive", f"{GEO}, s AS (SELECT c_custkey, least(greatest((norm / theta - 0.95) / 0.1, 0), 1) AS above, is_anomaly FROM geo), t AS (SELECT c_custkey, CASE WHEN is_anomaly THEN above ELSE 1 - above END AS stability FROM s) SELECT c_custkey, round(stability, 5) AS stability FROM t")
def assess_false_positive(spark, sf_dir):
    return similar.false_positive_stability(geo(spark, sf_dir)).select(K, *r("stability", digits=5))


@query("find_witness_cohort")
def find_witness_cohort(spark, sf_dir):
    rows, c = L.supplier_geometry(spark, sf_dir)
    connected = G.both_ways(L.hand_overs(spark, sf_dir).where("amount > 90000")).where(F.col("key") == 7).select("other")
    return similar.cohort(rows, "s_suppkey", L.SUPPLIERS.names, L.SUPPLIERS.deltas, 7, c.theta, connected)


def _knn(name: str, queries: str, k: int = 10) -> str:
    """CTE: the k nearest of each row of `queries` (c_custkey and deltas), ties to the smaller key."""
    distance = "sqrt(" + " + ".join(f"pow(g.delta_{d} - q.delta_{d}, 2)" for d in DIMS) + ")"
    return f"{name} AS (SELECT * FROM (SELECT q.c_custkey AS query, g.c_custkey, g.is_anomaly, row_number() OVER (PARTITION BY q.c_custkey ORDER BY {distance}, g.c_custkey) AS rank FROM {queries} q JOIN geo g ON g.c_custkey <> q.c_custkey) WHERE rank <= {k})"


def _next_sql(step: int) -> str:
    """CTE: the nearest anomaly to the one met in the step before, among those not met."""
    distance = "sqrt(" + " + ".join(f"pow(g.delta_{d} - q.delta_{d}, 2)" for d in DIMS) + ")"
    met = " UNION ALL ".join(f"SELECT c_custkey FROM s{i}" for i in range(step))
    return f"s{step} AS (SELECT g.* FROM geo g, s{step - 1} q WHERE g.is_anomaly AND g.c_custkey NOT IN ({met}) ORDER BY {distance}, g.c_custkey LIMIT 1)"


@query("neighbor_contamination", f"""{GEO}, seeds AS (SELECT * FROM geo WHERE is_anomaly ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 20), {_knn('around', 'seeds')}, suspects AS (SELECT * FROM geo WHERE NOT is_anomaly AND c_custkey IN (SELECT c_custkey FROM around)), {_knn('own', 'suspects')}
SELECT query AS c_custkey, round(avg(is_anomaly::INT), 6) AS contamination FROM own GROUP BY 1 HAVING avg(is_anomaly::INT) >= 0.5""")
def neighbor_contamination(spark, sf_dir):
    return similar.contaminated(geo(spark, sf_dir), K, DELTAS).withColumn("contamination", F.round("contamination", 6))


_HUB = " + ".join(f"least(greatest(shape_{d}, 0), 1) * em_{d}" for d in DIMS)


@query("hub_anomaly_concentration", f"""{GEO}, hubs AS (SELECT geo.* FROM geo, geo_em ORDER BY {_HUB} DESC, c_custkey LIMIT 20), {_knn('own', 'hubs')} SELECT query AS c_custkey, round(avg(is_anomaly::INT), 6) AS anomalous_share FROM own GROUP BY 1 HAVING avg(is_anomaly::INT) >= 0.5""")
def hub_anomaly_concentration(spark, sf_dir):
    rows, c = L.customer_geometry(spark, sf_dir)
    found = similar.hub_concentration(rows, O.hubs(rows, K, SHAPES, [c.edge_max[d] for d in DIMS], 20), K, DELTAS)
    return found.withColumn("anomalous_share", F.round("anomalous_share", 6))


@query("explain_anomaly_chain", f"{GEO}, s0 AS (SELECT * FROM geo WHERE c_custkey = {REF}), {', '.join(map(_next_sql, (1, 2, 3)))} " + " UNION ALL ".join(f"SELECT {i} AS step, c_custkey FROM s{i}" for i in range(4)))
def explain_anomaly_chain(spark, sf_dir):
    keys = similar.explanation_chain(geo(spark, sf_dir), K, DELTAS, REF)
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "step int, c_custkey long")


FTS = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'that')) AS t0, len(list_filter(w, lambda x: x = 'with')) AS t1 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM d),
b AS (SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM d, s)"""


@query("search_fts", f"WITH {FTS} SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 20")
def search_fts(spark, sf_dir):
    return similar.bm25(L.table(spark, sf_dir, "documents"), "doc_id", ["text"], "That with").select("doc_id", *r("score"))


def embedding_rows(spark, sf_dir):
    return L.table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))


EMBEDDED = [f"e{i}" for i in range(64)]


@query("embedding_neighbours", "WITH p AS (SELECT a.vec_id AS query, b.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM p) SELECT query, vec_id, round(distance, 5) AS distance, rank FROM n WHERE rank <= 10")
def embedding_neighbours(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    got = similar.neighbours_of(rows, rows.where("vec_id % 50 = 0"), "vec_id", EMBEDDED, 10)
    return got.select("query", "vec_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


_NEAR = "sqrt(list_sum(list_transform(list_zip(a.embedding, e.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))))"


@query("search_hybrid", f"""WITH {FTS}, near AS (SELECT e.vec_id AS doc_id, {_NEAR} AS distance FROM embeddings a, embeddings e WHERE a.vec_id = 0 AND e.vec_id <> 0 ORDER BY distance, e.vec_id LIMIT 20), tx AS (SELECT doc_id, score AS bm25 FROM b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50),
j AS (SELECT doc_id, distance, bm25 FROM near FULL JOIN tx USING (doc_id)), m AS (SELECT max(distance) AS md, max(bm25) AS ms FROM j), v AS (SELECT doc_id, coalesce(CASE WHEN md > 0 THEN 1 - distance / md WHEN distance IS NOT NULL THEN 1 END, 0) AS v, coalesce(CASE WHEN ms > 0 THEN bm25 / ms END, 0) AS w FROM j, m)
SELECT doc_id, round(v, 4) AS vector_score, round(w, 4) AS text_score, round(0.7 * v + 0.3 * w, 4) AS final_score FROM v ORDER BY final_score DESC, doc_id LIMIT 10""")
def search_hybrid(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    near = similar.nearest(rows, "vec_id", EMBEDDED, 0, 20).select(F.col("vec_id").alias("doc_id"), "distance")
    return similar.hybrid(near, similar.bm25(L.table(spark, sf_dir, "documents"), "doc_id", ["text"], "that with", 50), "doc_id")


def _sources(spark, sf_dir):
    rows = geo(spark, sf_dir)
    customers = L.table(spark, sf_dir, "customer")
    return [scan.direct(rows, "geometry", K), scan.borderline(rows, "borderline", K, 90.0), scan.points(customers, "balance", K, ["c_acctbal < 0", "c_nationkey = 7"], "OR"), scan.compound(rows, customers, "compound", K, K, ["c_acctbal > 5000"])]


HITS = "h AS (SELECT 'geometry' AS source, c_custkey::VARCHAR AS key, norm / theta AS i FROM geo WHERE is_anomaly UNION ALL SELECT 'borderline', c_custkey::VARCHAR, norm / theta FROM geo WHERE delta_rank_pct >= 90 AND NOT is_anomaly UNION ALL SELECT 'balance', c_custkey::VARCHAR, 1.0 FROM customer WHERE c_acctbal < 0 OR c_nationkey = 7 UNION ALL SELECT 'compound', c_custkey::VARCHAR, norm / theta FROM geo WHERE is_anomaly AND c_acctbal > 5000)"


@query("passive_scan", f"{GEO}, {HITS} SELECT key, count(DISTINCT source) AS score, round(sum(i), 6) AS weighted, string_agg(source, ',' ORDER BY source) AS sources FROM h GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def passive_scan(spark, sf_dir):
    return scan.screen(_sources(spark, sf_dir), 2).select("key", "score", *r("weighted"), "sources")


@query("cross_pattern_discrepancy", f"{GEO}, {HITS} SELECT key, any_value(source) AS source, round(sum(i), 6) AS weighted FROM h GROUP BY 1 HAVING count(DISTINCT source) = 1")
def cross_pattern_discrepancy(spark, sf_dir):
    return scan.discrepancies(_sources(spark, sf_dir)).select("key", "source", *r("weighted"))


@query("screening_density", f"WITH {S.CUSTOMER_GEO}, {S.SALES_GEO}, {HITS}, c AS (SELECT key, count(DISTINCT source) AS score FROM h GROUP BY 1), d AS (SELECT o_custkey::VARCHAR AS key, avg(is_anomaly::INT) AS density FROM egeo GROUP BY 1) SELECT key, score + (coalesce(density, 0) >= 0.05)::INT AS score, round(coalesce(density, 0), 6) AS density FROM c LEFT JOIN d USING (key) WHERE score + (coalesce(density, 0) >= 0.05)::INT >= 2")
def screening_density(spark, sf_dir):
    got = scan.with_density(scan.screen(_sources(spark, sf_dir)), L.sales_geometry(spark, sf_dir)[0], "o_custkey", threshold=2)
    return got.select("key", "score", *r("density"))


@query("composite_risk", f"""WITH {S.CUSTOMER_GEO}, {S.SALES_GEO}, e AS (SELECT o_custkey, min(conformal_p) AS p FROM egeo GROUP BY 1), j AS (SELECT c_custkey, conformal_p AS p, e.p AS q FROM geo LEFT JOIN e ON o_custkey = c_custkey),
x AS (SELECT c_custkey, q IS NOT NULL AS two, -ln(greatest(p, 1e-15)) - CASE WHEN q IS NULL THEN 0 ELSE ln(greatest(q, 1e-15)) END AS h FROM j) SELECT c_custkey::VARCHAR AS key, CASE WHEN two THEN 2 ELSE 1 END AS n_patterns, round(exp(-h) * CASE WHEN two THEN 1 + h ELSE 1 END, 9) AS combined_p FROM x""")
def composite_risk(spark, sf_dir):
    events = L.sales_geometry(spark, sf_dir)[0].groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.min("conformal_p").alias("p"))
    own = geo(spark, sf_dir).select(F.col(K).cast("string").alias("key"), F.col("conformal_p").alias("p"))
    return scan.combined_risk([own, events]).withColumn("combined_p", F.round("combined_p", 9))


@query("cross_pattern_profile", f"WITH {S.CUSTOMER_GEO}, {S.SALES_GEO}, h AS (SELECT c_custkey::VARCHAR AS key, 'direct' AS source, 1.0 AS v FROM geo WHERE is_anomaly UNION ALL SELECT o_custkey::VARCHAR, 'events', avg(is_anomaly::INT) FROM egeo GROUP BY 1 HAVING bool_or(is_anomaly)) SELECT key, round(sum(v), 6) AS risk_score, count(DISTINCT source) AS source_count FROM h GROUP BY 1")
def cross_pattern_profile(spark, sf_dir):
    events = L.sales_geometry(spark, sf_dir)[0].groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("related"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalous")).where("anomalous > 0")
    of_events = events.select(F.lit("events").alias("source"), "key", F.lit(0.0).alias("intensity"), "related", "anomalous")
    return scan.risk_profile([scan.direct(geo(spark, sf_dir), "direct", K), of_events]).select("key", *r("risk_score"), "source_count")


@query("scan_composite", "WITH p AS (SELECT l_partkey::VARCHAR || '→' || l_suppkey::VARCHAR AS pk, l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b, count(*)::DOUBLE AS norm FROM lineitem GROUP BY ALL), m AS (SELECT a AS key, norm FROM p UNION ALL SELECT b, norm FROM p WHERE a <> b) SELECT 'pairs' AS source, key, max(norm) / 3 AS intensity, count(*) AS related, count(*) FILTER (norm >= 3) AS anomalous FROM m GROUP BY 2 HAVING count(*) FILTER (norm >= 3) > 0")
def scan_composite(spark, sf_dir):
    key = X.composite_key([F.col("l_partkey"), F.col("l_suppkey")])
    rows = L.table(spark, sf_dir, "lineitem").groupBy(key.alias("primary_key")).agg(F.count(F.lit(1)).cast("double").alias("norm")).withColumn("theta", F.lit(3.0)).withColumn("is_anomaly", F.col("norm") >= 3)
    return scan.composite(rows, "pairs", "primary_key")


@query("scan_graph", f"WITH {S.SUPPLIER_GEO}, {S.EDGES}, nb AS (SELECT DISTINCT * FROM (SELECT from_key AS key, to_key AS other FROM edges WHERE from_key <> to_key UNION ALL SELECT to_key, from_key FROM edges WHERE from_key <> to_key)), c AS (SELECT key, count(*) AS n, count(*) FILTER (is_anomaly) AS a FROM nb LEFT JOIN sgeo ON s_suppkey = other GROUP BY 1) SELECT 'contagion' AS source, key::VARCHAR AS key, round(a / n::DOUBLE, 6) AS intensity, n AS related, a AS anomalous FROM c WHERE a / n::DOUBLE >= 0.05")
def scan_graph(spark, sf_dir):
    stats = G.contagion(L.hand_overs(spark, sf_dir), L.supplier_geometry(spark, sf_dir)[0], "s_suppkey")
    return scan.contagious(stats, "contagion", "key", 0.05).withColumn("intensity", F.round("intensity", 6))


@query("co_dispersion", f"""{GEO}, {S.SALES_GEO}, j AS (SELECT geo.c_custkey, round(geo.norm, 9) AS na, round(e.norm, 9) AS nb FROM geo JOIN (SELECT o_custkey, max(norm) AS norm FROM egeo GROUP BY 1) e ON o_custkey = geo.c_custkey),
x AS (SELECT row_number() OVER (ORDER BY na, c_custkey) AS x, row_number() OVER (ORDER BY nb, c_custkey) AS y FROM j) SELECT count(*) AS n, round(corr(x, y), 5) AS spearman FROM x""")
def co_dispersion(spark, sf_dir):
    events = L.sales_geometry(spark, sf_dir)[0].groupBy(F.col("o_custkey").alias(K)).agg(F.max("norm").alias("norm"))
    return scan.co_dispersion(geo(spark, sf_dir), events, K).withColumn("spearman", F.round("spearman", 5))


@query("subgroup_inflation", f"{GEO}, o AS (SELECT avg(conformal_p) AS overall FROM geo) SELECT c_nationkey AS group_key, count(*) AS size, round(avg(conformal_p), 6) AS mean_p, round(any_value(overall) / avg(conformal_p), 6) AS inflation FROM geo, o GROUP BY 1 HAVING any_value(overall) / avg(conformal_p) >= 1.1")
def subgroup_inflation(spark, sf_dir):
    return scan.subgroup_inflation(geo(spark, sf_dir), "c_nationkey", 1.1).select("group_key", "size", *r("mean_p", "inflation"))


@query("dimension_percentiles", "SELECT 'c_acctbal' AS \"column\", " + ", ".join(f"round(quantile_cont(c_acctbal, {q}e0), 4) AS {n}" for n, q in (("min", 0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99), ("max", 1))) + " FROM customer")
def dimension_percentiles(spark, sf_dir):
    return O.dimension_percentiles(L.table(spark, sf_dir, "customer"), ["c_acctbal"])
