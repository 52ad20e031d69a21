"""Queries over time slices of customers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators import calibrate, temporal
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans.registry import query

K, DIMS, DELTAS, SHAPES = "c_custkey", S.CUSTOMER_DIMS, L.CUSTOMERS.deltas, L.CUSTOMERS.shapes
DAYS = 90
WIDTH = DAYS * 86_400.0
EPOCH = "epoch_us(o_orderdate) / 1e6"
_AGG = "count(*)::DOUBLE AS order_count, sum(o_totalprice) AS order_sum, avg(o_totalprice) AS order_mean, max(o_totalprice) AS order_max"
_SHAPE = ", ".join(f"least(greatest({d}, 0.0e0), em_{d}) / em_{d} AS shape_{d}" for d in DIMS)
_DELTA = ", ".join(f"(shape_{d} - mu_{d}) / sd_{d} AS delta_{d}" for d in DIMS)
SLICES = f"""{S.CUSTOMER_GEO}, f AS (SELECT min({EPOCH}) AS f FROM orders), g AS (SELECT o_custkey AS c_custkey, floor(({EPOCH} - f) / {WIDTH})::BIGINT AS slice, any_value(f) AS f0, {_AGG} FROM orders, f WHERE o_custkey IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT c_custkey, slice, f0 + slice * {WIDTH} AS window_start, {_SHAPE} FROM g, geo_em), de AS (SELECT sh.*, {_DELTA} FROM sh, geo_stats),
no AS (SELECT *, sqrt({' + '.join(f'delta_{d} * delta_{d}' for d in DIMS)}) AS norm FROM de), slices AS (SELECT no.*, round(norm, 9) >= round(theta, 9) AS is_anomaly FROM no, geo_theta)"""
WITH = f"WITH {SLICES}"
A, B = (8.0e8, 8.8e8), (8.8e8, 1.1e9)
STEP = "sqrt(" + " + ".join(f"pow(delta_{d} - lag(delta_{d}) OVER w, 2)" for d in DIMS) + ")"


def slices(spark, sf_dir):
    calibration = calibrate.calibrate(L.customers(spark, sf_dir), L.CUSTOMERS)
    return temporal.snapshots(L.table(spark, sf_dir, "orders"), "o_custkey", K, X.epoch(F.col("o_orderdate")), WIDTH, L.ORDER_METRICS, calibration.edge_max, calibration, DIMS), calibration


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("temporal_snapshots", f"{WITH} SELECT c_custkey, slice, window_start, round(norm, 6) AS norm, is_anomaly FROM slices")
def temporal_snapshots(spark, sf_dir):
    return slices(spark, sf_dir)[0].select(K, "slice", "window_start", *r("norm"), "is_anomaly")


@query("temporal_read", f"{WITH} SELECT c_custkey, slice FROM slices WHERE window_start >= {A[0]} AND window_start < {A[1]} AND year(to_timestamp(window_start)) IN (1996, 1997)")
def temporal_read(spark, sf_dir):
    return temporal.between(slices(spark, sf_dir)[0], A[0], A[1], [1996, 1997]).select(K, "slice")


@query("temporal_as_of", f"{WITH} SELECT c_custkey, max(slice) AS slice, round(arg_max(norm, slice), 6) AS norm FROM slices WHERE window_start <= {A[1]} GROUP BY 1")
def temporal_as_of(spark, sf_dir):
    return temporal.as_of(slices(spark, sf_dir)[0], K, A[1]).select(K, "slice", *r("norm"))


@query("temporal_centroids", f"{WITH} SELECT slice, window_start, count(*) AS entity_count, round(avg(is_anomaly::INT), 6) AS anomaly_rate, {', '.join(f'round(avg(delta_{d}), 6) AS delta_{d}' for d in DIMS)} FROM slices GROUP BY 1, 2")
def temporal_centroids(spark, sf_dir):
    return temporal.centroids(slices(spark, sf_dir)[0], DELTAS).select("slice", "window_start", "entity_count", *r("anomaly_rate", *DELTAS))


@query("trajectories", f"{WITH} SELECT c_custkey, count(*) AS num_slices, round(avg(delta_order_sum), 6) AS mean_delta_order_sum, round(stddev_pop(delta_order_sum), 6) AS std_delta_order_sum, round(sqrt({' + '.join(f'pow(arg_max(delta_{d}, slice) - arg_min(delta_{d}, slice), 2)' for d in DIMS)}), 6) AS displacement FROM slices GROUP BY 1")
def trajectories(spark, sf_dir):
    return temporal.trajectories(slices(spark, sf_dir)[0], K, DELTAS).select(K, "num_slices", *r("mean_delta_order_sum", "std_delta_order_sum", "displacement"))


@query("pi9_attract_drift", f"""{WITH}, st AS (SELECT c_custkey, slice, {', '.join('delta_' + d for d in DIMS)}, {STEP} AS step FROM slices WINDOW w AS (PARTITION BY c_custkey ORDER BY slice)),
dr AS (SELECT c_custkey, count(*) AS num_slices, sqrt({' + '.join(f'pow(arg_max(delta_{d}, slice) - arg_min(delta_{d}, slice), 2)' for d in DIMS)}) AS displacement, sum(step) AS path_length, avg(step) AS m, stddev_pop(step) AS s FROM st GROUP BY 1 HAVING count(*) >= 2)
SELECT c_custkey, num_slices, round(displacement, 6) AS displacement, round(path_length, 6) AS path_length, round(CASE WHEN path_length > 0 THEN displacement / path_length ELSE 0 END, 6) AS ratio, round(CASE WHEN num_slices >= 3 THEN CASE WHEN m > 0 THEN least(greatest(1 - s / m, 0), 1) ELSE 0 END END, 6) AS steadiness FROM dr""")
def pi9_attract_drift(spark, sf_dir):
    return temporal.drift(slices(spark, sf_dir)[0], K, DELTAS).select(K, "num_slices", *r("displacement", "path_length", "ratio", "steadiness"))


@query("pi10_attract_trajectory")
def pi10_attract_trajectory(spark, sf_dir):
    from orrery.operators import similar

    rows = temporal.trajectories(slices(spark, sf_dir)[0], K, DELTAS).where("num_slices >= 2")
    return similar.nearest(rows, K, [f"{p}_{d}" for p in ("mean", "std") for d in DELTAS], 17).select(K, *r("distance"))


_IN = [f"window_start >= {a} AND window_start < {b}" for a, b in (A, B)]
_SHIFT = "sqrt(" + " + ".join(f"pow(avg(delta_{d}) FILTER ({_IN[0]}) - avg(delta_{d}) FILTER ({_IN[1]}), 2)" for d in DIMS) + ")"


@query("pi11_population_compare", f"{WITH} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, round(avg(delta_{d}) FILTER ({_IN[0]}), 6) AS mean_a, round(avg(delta_{d}) FILTER ({_IN[1]}), 6) AS mean_b, round(avg(delta_{d}) FILTER ({_IN[1]}) - avg(delta_{d}) FILTER ({_IN[0]}), 6) AS change, round({_SHIFT}, 6) AS shift, CASE WHEN {_SHIFT} > 0.5 THEN 'significant' WHEN {_SHIFT} > 0.05 THEN 'minor' ELSE 'none' END AS significance FROM slices" for d in DIMS))
def pi11_population_compare(spark, sf_dir):
    return temporal.population_shift(slices(spark, sf_dir)[0], DIMS, DELTAS, A, B).select("dimension", *r("mean_a", "mean_b", "change", "shift"), "significance")


@query("pi12_regime_change", f"""{WITH}, ce AS (SELECT slice, window_start, {', '.join(f'avg(delta_{d}) AS delta_{d}' for d in DIMS)} FROM slices GROUP BY 1, 2), mv AS (SELECT slice, window_start, {STEP} AS shift FROM ce WINDOW w AS (ORDER BY slice)), q AS (SELECT avg(shift) AS m, stddev_pop(shift) AS s FROM mv)
SELECT slice, window_start, round(shift, 6) AS shift FROM mv, q WHERE shift > m + 1.5 * s ORDER BY mv.shift DESC, slice LIMIT 3""")
def pi12_regime_change(spark, sf_dir):
    return temporal.regime_changes(slices(spark, sf_dir)[0], DELTAS).select("slice", "window_start", *r("shift"))


@query("solid_reputation", f"""{WITH}, i AS (SELECT c_custkey, is_anomaly, row_number() OVER (PARTITION BY c_custkey ORDER BY slice) - row_number() OVER (PARTITION BY c_custkey, is_anomaly ORDER BY slice) AS g FROM slices), n AS (SELECT c_custkey, is_anomaly, count(*) AS n FROM i GROUP BY c_custkey, is_anomaly, g)
SELECT c_custkey, sum(n)::BIGINT AS num_slices, round((coalesce(sum(n) FILTER (is_anomaly), 0) + 1) / (sum(n) + 2)::DOUBLE, 6) AS reputation, coalesce(max(n) FILTER (is_anomaly), 0) AS longest_run FROM n GROUP BY 1""")
def solid_reputation(spark, sf_dir):
    return temporal.reputation(slices(spark, sf_dir)[0], K).select(K, "num_slices", *r("reputation"), "longest_run")


@query("temporal_quality_summary", f"""{WITH}, n AS (SELECT is_anomaly, lead(is_anomaly) OVER (PARTITION BY c_custkey ORDER BY slice) AS nx FROM slices), c AS (SELECT count(*) AS transitions, count(*) FILTER (nx) AS persisted FROM n WHERE is_anomaly AND nx IS NOT NULL)
SELECT transitions, persisted, round(persisted / greatest(transitions, 1)::DOUBLE, 6) AS persistence, CASE WHEN persisted / greatest(transitions, 1)::DOUBLE >= 0.7 THEN 'persistent' WHEN persisted / greatest(transitions, 1)::DOUBLE <= 0.3 THEN 'transient' ELSE 'mixed' END AS signal FROM c""")
def temporal_quality_summary(spark, sf_dir):
    return temporal.temporal_quality(slices(spark, sf_dir)[0], K).select("transitions", "persisted", *r("persistence"), "signal")


def _forecast_sql(select: str) -> str:
    """`select` over `q`: each customer's slices, predicted norm, mean fit and theta."""
    sums = ", ".join(f"sum(w * delta_{d}) AS sy_{d}, sum(w * i * delta_{d}) AS sty_{d}, sum(w * delta_{d} * delta_{d}) AS syy_{d}" for d in DIMS)
    slope = {d: f"CASE WHEN abs(sw * stt - st * st) > 1e-12 THEN (sw * sty_{d} - st * sy_{d}) / (sw * stt - st * st) ELSE 0 END" for d in DIMS}
    point = " + ".join(f"pow((sy_{d} - {slope[d]} * st) / sw + {slope[d]} * (n + 1), 2)" for d in DIMS)
    whole = {d: f"(syy_{d} - sy_{d} * sy_{d} / sw)" for d in DIMS}
    fits = " + ".join(f"CASE WHEN {whole[d]} > 1e-12 THEN least(greatest(pow({slope[d]}, 2) * (stt - st * st / sw) / {whole[d]}, 0), 1) ELSE 1 END" for d in DIMS)
    return f"""{WITH}, p AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY slice)::DOUBLE AS i, count(*) OVER (PARTITION BY c_custkey)::DOUBLE AS n FROM slices), w AS (SELECT *, exp(-0.3e0 * (n - i)) AS w FROM p),
a AS (SELECT c_custkey, max(n) AS n, sum(w) AS sw, sum(w * i) AS st, sum(w * i * i) AS stt, {sums} FROM w GROUP BY 1 HAVING max(n) >= 3), q AS (SELECT c_custkey, n::BIGINT AS num_slices, sqrt({point}) AS predicted_norm, ({fits}) / {len(DIMS)} AS fit, theta FROM a, geo_theta) {select}"""


@query("solid_forecast", _forecast_sql("SELECT c_custkey, num_slices, round(predicted_norm, 5) AS predicted_norm FROM q"))
def solid_forecast(spark, sf_dir):
    rows, calibration = slices(spark, sf_dir)
    return temporal.forecast(rows, K, DELTAS, calibration.theta).select(K, "num_slices", *r("predicted_norm", digits=5))


_BAND = "CASE WHEN num_slices >= 10 AND fit >= 0.7 THEN 'high' WHEN num_slices >= 5 OR fit >= 0.4 THEN 'medium' ELSE 'low' END"


@query("forecast_reliability", _forecast_sql(f"SELECT {_BAND} AS reliability, predicted_norm >= theta AS crosses, count(*) AS count FROM q GROUP BY 1, 2"))
def forecast_reliability(spark, sf_dir):
    rows, calibration = slices(spark, sf_dir)
    return temporal.forecast(rows, K, DELTAS, calibration.theta).groupBy("reliability", "crosses").count()


@query("emerging_anomalies", _forecast_sql("SELECT c_custkey, round(predicted_norm, 5) AS predicted_norm FROM q JOIN geo USING (c_custkey) WHERE predicted_norm >= q.theta AND NOT is_anomaly"))
def emerging_anomalies(spark, sf_dir):
    rows, calibration = slices(spark, sf_dir)
    return temporal.emerging(rows, L.customer_geometry(spark, sf_dir)[0], K, DELTAS, calibration.theta).select(K, *r("predicted_norm", digits=5))


@query("forecast_segment_crossing", f"""{WITH}, sx AS (SELECT c_custkey, delta_order_sum + 2.0e0 AS signed, row_number() OVER (PARTITION BY c_custkey ORDER BY slice)::DOUBLE AS i FROM slices),
fx AS (SELECT c_custkey, count(*) AS n, regr_slope(signed, i) AS b, regr_intercept(signed, i) AS a, arg_max(signed, i) AS now FROM sx GROUP BY 1 HAVING count(*) >= 3), zx AS (SELECT *, -a / b AS zero FROM fx WHERE b <> 0)
SELECT c_custkey, n, round(now, 6) AS now, ceil(zero - n)::BIGINT AS slices_to_crossing FROM zx WHERE zero > n AND sign(now) <> sign(a + b * (zero + 1))""")
def forecast_segment_crossing(spark, sf_dir):
    rows, _ = slices(spark, sf_dir)
    found = temporal.segment_crossing(rows, K, DELTAS, (0.0, 1.0, 0.0, 0.0), -2.0).where("slices_to_crossing is not null")
    return found.select(K, "n", *r("now"), F.col("slices_to_crossing").cast("long").alias("slices_to_crossing"))


@query("temporal_hint", f"{WITH} SELECT count(*) AS num_slices, strftime(to_timestamp(max(window_start)), '%Y-%m-%dT%H:%M:%S+00:00') AS last_timestamp FROM slices WHERE c_custkey = 17 HAVING count(*) > 0")
def temporal_hint(spark, sf_dir):
    from orrery.operators import observe

    return observe.temporal_hint(slices(spark, sf_dir)[0], K, 17)


@query("temporal_burst", """WITH m AS (SELECT user_id, max(n) AS max_events FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS n FROM events WHERE user_id IS NOT NULL) GROUP BY 1), s AS (SELECT avg(max_events) AS m, stddev_pop(max_events) AS s FROM m)
SELECT user_id, max_events, round((max_events - m) / s, 6) AS z, (max_events - m) / s >= 2 AS is_burst FROM m, s""")
def temporal_burst(spark, sf_dir):
    return temporal.bursts(L.table(spark, sf_dir, "events"), "user_id", "ts", 3, 2.0).withColumn("z", F.round("z", 6))


_Z = ", ".join(f"abs(shape_{d} - avg(shape_{d}) OVER w) / greatest(stddev_pop(shape_{d}) OVER w, 0.01e0)" for d in DIMS)


@query("max_rolling_z", f"{WITH}, z AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY slice) AS i, greatest({_Z}) AS z FROM slices WINDOW w AS (PARTITION BY c_custkey ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT c_custkey, round(max(z) FILTER (i > 2), 4) AS max_rolling_z FROM z GROUP BY 1")
def max_rolling_z(spark, sf_dir):
    return temporal.max_rolling_z(slices(spark, sf_dir)[0], K, SHAPES).select(K, *r("max_rolling_z", digits=4))


@query("trajectory_anomaly")
def trajectory_anomaly(spark, sf_dir):
    return temporal.trajectory_shapes(slices(spark, sf_dir)[0], K).select(K, "shape", *r("detour"))


@query("hub_score_history", f"{WITH} SELECT slice, round({' + '.join(f'least(greatest(shape_{d}, 0), 1) * em_{d}' for d in DIMS)} + 1e-5, 2) AS hub_score FROM slices, geo_em WHERE c_custkey = 17")
def hub_score_history(spark, sf_dir):
    from orrery.operators import observe

    rows, calibration = slices(spark, sf_dir)
    return rows.where(F.col(K) == 17).select("slice", F.round(observe.hub_score(SHAPES, [calibration.edge_max[d] for d in DIMS]) + 1e-5, 2).alias("hub_score"))


@query("compare_temporal")
def compare_temporal(spark, sf_dir):
    got = temporal.dtw(slices(spark, sf_dir)[0], K, DELTAS, 3, 8)
    return got.select(F.round("distance", 4).alias("distance"), X.history_band(F.col("distance")).alias("interpretation"))


@query("collective_drift")
def collective_drift(spark, sf_dir):
    drifts = temporal.drift(slices(spark, sf_dir)[0], K, DELTAS)
    return temporal.drift_clusters(drifts, K, [d.replace("delta_", "diff_") for d in DELTAS])
