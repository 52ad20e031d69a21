"""Queries on sources, derived dimensions, calibration and the windows they need."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import expressions as X
from orrery.operators import calibrate, derived
from orrery.operators.quantiles import with_global_rank
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans.registry import query
from orrery.plans.spec import Alias, Dimension, Pattern

GEO_COLUMNS = ["norm", "delta_rank_pct", "conformal_p"]


def rounded(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def rounded_sql(*names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


GEO_SQL = f"c_custkey, {rounded_sql(*GEO_COLUMNS)}, is_anomaly, n_anomalous_dims"


@query("customer_anomaly_ranking", f"WITH {S.CUSTOMER_GEO} SELECT {GEO_SQL}, {rounded_sql(*['delta_' + d for d in S.CUSTOMER_DIMS], digits=5)} FROM geo")
def customer_anomaly_ranking(spark, sf_dir):
    geo, _ = L.customer_geometry(spark, sf_dir)
    return geo.select("c_custkey", *rounded(*GEO_COLUMNS), "is_anomaly", "n_anomalous_dims", *rounded(*L.CUSTOMERS.deltas, digits=5))


@query("event_geometry", f"WITH {S.SALES_GEO} SELECT o_orderkey, {rounded_sql(*GEO_COLUMNS)}, is_anomaly, n_anomalous_dims FROM egeo")
def event_geometry(spark, sf_dir):
    geo, _ = L.sales_geometry(spark, sf_dir)
    return geo.select("o_orderkey", *rounded(*GEO_COLUMNS), "is_anomaly", "n_anomalous_dims")


@query("supplier_geometry", f"WITH {S.SUPPLIER_GEO} SELECT s_suppkey, {rounded_sql(*GEO_COLUMNS)}, is_anomaly, n_anomalous_dims FROM sgeo")
def supplier_geometry(spark, sf_dir):
    geo, _ = L.supplier_geometry(spark, sf_dir)
    return geo.select("s_suppkey", *rounded(*GEO_COLUMNS), "is_anomaly", "n_anomalous_dims")


@query(
    "calibration_statistics",
    f"WITH {S.CUSTOMER_GEO} "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, (SELECT em_{d} FROM geo_em) AS edge_max, round(mu_{d}, 6) AS mu, round(sd_{d}, 6) AS sigma, (SELECT round(theta, 6) FROM geo_theta) AS theta FROM geo_stats" for d in S.CUSTOMER_DIMS),
)
def calibration_statistics(spark, sf_dir):
    c = calibrate.calibrate(L.customers(spark, sf_dir), L.CUSTOMERS)
    rows = [(d, float(c.edge_max[d]), round(m, 6), round(s, 6), round(c.theta, 6)) for d, m, s in zip(L.CUSTOMERS.names, c.mu, c.sigma)]
    return spark.createDataFrame(rows, "dimension string, edge_max double, mu double, sigma double, theta double")


@query(
    "derived_batch",
    "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(round(s, 2), 0) AS s, coalesce(round(a + 1e-7, 4), 0) AS a, coalesce(round(d, 4), 0) AS d, coalesce(x, 0) AS x, coalesce(u, 0) AS u FROM customer LEFT JOIN "
    "(SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS d, max(o_totalprice) AS x, count(DISTINCT o_orderpriority)::DOUBLE AS u FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
def derived_batch(spark, sf_dir):
    price = "o_totalprice"
    specs = {"n": ("count", None), "s": ("sum", price), "a": ("mean", price), "d": ("std", price), "x": ("max", price), "u": ("count_distinct", "o_orderpriority")}
    got = derived.derived_batch(L.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", L.table(spark, sf_dir, "orders"), "o_custkey", specs)
    return got.select("c_custkey", "n", F.round("s", 2).alias("s"), F.when(F.col("a") != 0, F.round(F.col("a") + 1e-7, 4)).otherwise(0.0).alias("a"), F.round("d", 4).alias("d"), "x", "u")


def _windowed(combine: str):
    def run(spark, sf_dir):
        events = L.table(spark, sf_dir, "events")
        users = events.select("user_id").distinct()
        got = derived.windowed(users, "user_id", events, "user_id", X.epoch(F.col("ts")), "1d", "value", ("sum", "value"), combine)
        return got.select("user_id", F.round(F.col("value") + 1e-7, 4).alias("value"))

    return run


WINDOWED_SQL = """WITH b AS (SELECT user_id, floor((epoch_us(ts) / 1e6 - (SELECT min(epoch_us(ts)) / 1e6 FROM events)) / 86400) AS bucket, sum(value) AS v FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
SELECT user_id, round({agg} + 1e-7, 4) AS value FROM b GROUP BY 1"""
for _name, _agg in (("max", "max(v)"), ("mean", "avg(v)"), ("last", "arg_max(v, bucket)")):
    query(f"derived_window_{_name}", WINDOWED_SQL.format(agg=_agg))(_windowed(_name))


@query(
    "derived_inter_event_times",
    "WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) "
    "SELECT user_id, coalesce(round(avg(gap), 3), 0) AS iet_mean, coalesce(round(stddev_pop(gap), 3), 0) AS iet_std, coalesce(round(min(gap), 3), 0) AS iet_min FROM g GROUP BY 1",
)
def derived_inter_event_times(spark, sf_dir):
    events = L.table(spark, sf_dir, "events")
    got = derived.inter_event_times(events.select("user_id").distinct(), "user_id", events, "user_id", X.epoch(F.col("ts")), tie="event_id")
    return got.select("user_id", *rounded(*derived.GAPS, digits=3))


@query("composite_line", "SELECT DISTINCT l_partkey::VARCHAR || '→' || l_suppkey::VARCHAR AS primary_key, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
def composite_line(spark, sf_dir):
    return derived.composite_line(L.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("composite_derived", "SELECT l_partkey::VARCHAR || '→' || l_suppkey::VARCHAR AS primary_key, count(*)::DOUBLE AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1")
def composite_derived(spark, sf_dir):
    items = L.table(spark, sf_dir, "lineitem")
    anchors = derived.composite_line(items, ["l_partkey", "l_suppkey"]).select("primary_key")
    key = X.composite_key([F.col("l_partkey"), F.col("l_suppkey")])
    got = derived.derived_batch(anchors, "primary_key", items, key, {"n": ("count", None), "qty": ("sum", "l_quantity")})
    return got.select("primary_key", "n", F.round("qty", 2).alias("qty"))


@query(
    "graph_features",
    f"""WITH {S.EDGES}, p AS (SELECT DISTINCT from_key AS f, to_key AS t FROM edges), o AS (SELECT f, count(*)::DOUBLE AS od FROM p GROUP BY 1), i AS (SELECT t, count(*)::DOUBLE AS idg FROM p GROUP BY 1),
b AS (SELECT a.f, count(*)::DOUBLE AS bi FROM p a JOIN p z ON a.f = z.t AND a.t = z.f GROUP BY 1)
SELECT s_suppkey, coalesce(od, 0) AS out_degree, coalesce(idg, 0) AS in_degree, CASE WHEN coalesce(od, 0) > 0 AND coalesce(idg, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reciprocity,
round(CASE WHEN coalesce(od, 0) + coalesce(idg, 0) - coalesce(bi, 0) > 0 THEN coalesce(bi, 0) / (coalesce(od, 0) + coalesce(idg, 0) - coalesce(bi, 0)) ELSE 0 END, 6) AS counterpart_overlap
FROM supplier LEFT JOIN o ON s_suppkey = o.f LEFT JOIN i ON s_suppkey = i.t LEFT JOIN b ON s_suppkey = b.f""",
)
def graph_features(spark, sf_dir):
    edges = L.hand_overs(spark, sf_dir)
    got = derived.graph_features(L.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", edges, "from_key", "to_key")
    return got.select("s_suppkey", "out_degree", "in_degree", "reciprocity", F.round("counterpart_overlap", 6).alias("counterpart_overlap"))


@query("edge_maxima", "SELECT 'order_count' AS name, greatest(1, floor(quantile_cont(n, 0.99e0)))::DOUBLE AS edge_max FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def edge_maxima(spark, sf_dir):
    counts = L.table(spark, sf_dir, "orders").groupBy("o_custkey").count()
    found = derived.edge_maxima(counts, ["count"])
    return spark.createDataFrame([("order_count", found["count"])], "name string, edge_max double")


GROUPED = Pattern("customers_by_segment", "c_custkey", L.CUSTOMERS.dimensions, group_by="c_mktsegment")
_G_MOMENTS = ", ".join(f"avg(shape_{d}) AS gm_{d}, greatest(stddev_pop(shape_{d}), 0.01e0) AS gs_{d}" for d in S.CUSTOMER_DIMS)
_G_SQUARE = " + ".join(f"((shape_{d} - gm_{d}) / gs_{d}) * ((shape_{d} - gm_{d}) / gs_{d})" for d in S.CUSTOMER_DIMS)


@query(
    "calibration_by_group",
    f"""WITH {S.CUSTOMERS}, {S.geometry('customers', 'c_custkey', S.CUSTOMER_DIMS, 'geo')}, gstats AS (SELECT c_mktsegment, {_G_MOMENTS} FROM geo_shape GROUP BY 1),
gnorm AS (SELECT s.c_custkey, s.c_mktsegment, sqrt({_G_SQUARE}) AS norm FROM geo_shape s JOIN gstats USING (c_mktsegment)),
gtheta AS (SELECT c_mktsegment, quantile_cont(norm, 0.95e0) AS theta FROM gnorm GROUP BY 1)
SELECT c_custkey, round(norm, 6) AS norm, round(theta, 6) AS theta, theta > 0 AND round(norm, 9) >= round(theta, 9) AS is_anomaly FROM gnorm JOIN gtheta USING (c_mktsegment)""",
)
def calibration_by_group(spark, sf_dir):
    geo = calibrate.geometry(L.customers(spark, sf_dir), GROUPED, ranks=False)
    return geo.select("c_custkey", *rounded("norm", "theta"), "is_anomaly")


WEIGHTED = Pattern("customers_weighted", "c_custkey", L.CUSTOMERS.dimensions, weights="kurtosis")
_W = ", ".join(f"greatest(1.0e0, avg(pow(delta_{d}, 4)) / 3) AS w_{d}" for d in S.CUSTOMER_DIMS)


@query("calibration_kurtosis_weights", f"WITH {S.CUSTOMER_GEO}, w AS (SELECT {_W} FROM geo) SELECT c_custkey, round(sqrt({' + '.join(f'pow(delta_{d} * w_{d}, 2)' for d in S.CUSTOMER_DIMS)}), 6) AS norm FROM geo CROSS JOIN w")
def calibration_kurtosis_weights(spark, sf_dir):
    return calibrate.geometry(L.customers(spark, sf_dir), WEIGHTED, ranks=False).select("c_custkey", *rounded("norm"))


@query("calibration_mahalanobis")
def calibration_mahalanobis(spark, sf_dir):
    pattern = Pattern("customers_mahalanobis", "c_custkey", L.CUSTOMERS.dimensions, mahalanobis=True)
    return calibrate.geometry(L.customers(spark, sf_dir), pattern, ranks=False).select("c_custkey", *rounded("norm"), "is_anomaly")


PROPERTIES = Pattern("tracked", "doc_id", (Dimension("lang", "property"), Dimension("quality", "property"), Dimension("n_chars", "event")))


@query(
    "property_dimensions",
    "WITH d AS (SELECT documents.doc_id, lang, n_chars, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = documents.doc_id), "
    + S.geometry("d", "doc_id", ["lang", "quality", "n_chars"], "pgeo", {"lang": "property", "quality": "property", "n_chars": "event"})
    + " SELECT doc_id, round(norm, 6) AS norm, is_anomaly FROM pgeo",
)
def property_dimensions(spark, sf_dir):
    labels = L.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = L.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return calibrate.geometry(rows, PROPERTIES, ranks=False).select("doc_id", *rounded("norm"), "is_anomaly")


@query("alias_statistics", f"WITH {S.CUSTOMER_GEO}, a AS (SELECT * FROM geo WHERE delta_order_count >= 1.0e0), m AS (SELECT count(*) AS population, {', '.join(f'avg(delta_{d}) AS m_{d}' for d in S.CUSTOMER_DIMS)} FROM a) "
    f"SELECT any_value(population) AS population, round(quantile_cont(sqrt({' + '.join(f'pow(delta_{d} - m_{d}, 2)' for d in S.CUSTOMER_DIMS)}), 0.95e0), 6) AS theta FROM a CROSS JOIN m")
def alias_statistics(spark, sf_dir):
    geo, _ = L.customer_geometry(spark, sf_dir)
    alias = Alias.of_dimension("busy", L.CUSTOMERS, "order_count", 1.0)
    found = calibrate.alias_statistics(geo, L.CUSTOMERS, alias)
    return spark.createDataFrame([(found["population"], round(found["theta"], 6))], "population long, theta double")


@query("win_delta_rank_pct", "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) - 1) / count(*) OVER ()::DOUBLE * 100, 6) AS rank_pct FROM orders")
def win_delta_rank_pct(spark, sf_dir):
    ranked = with_global_rank(L.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "below", "n")
    return ranked.select("o_orderkey", F.round(F.col("below") / F.col("n") * 100, 6).alias("rank_pct"))


@query("win_walk_line", "SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next_key, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS previous_key FROM customer")
def win_walk_line(spark, sf_dir):
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return L.table(spark, sf_dir, "customer").select("c_custkey", F.lead("c_custkey").over(order).alias("next_key"), F.lag("c_custkey").over(order).alias("previous_key"))


@query("recalibrate", f"WITH {S.CUSTOMER_GEO} SELECT round(theta, 6) AS theta, n_rows FROM geo_theta")
def recalibrate(spark, sf_dir):
    geo, old = L.customer_geometry(spark, sf_dir)
    fresh = calibrate.recalibrate(geo, L.CUSTOMERS, old)
    return spark.createDataFrame([(round(fresh.theta, 6), fresh.rows)], "theta double, n_rows long")
