"""Snapshots over time: slices, centroids, trajectories, drift, regimes, forecasts, reputation, bursts."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import expressions as X
from orrery.operators.derived import metric

STALE_DAYS = 180


def snapshots(events: DataFrame, foreign_key: str, key: str, time: Column, width: float, specs: dict[str, tuple[str, str | None]], edge_max: dict[str, float], calibration, names: list[str]) -> DataFrame:
    """One row per entity and bucket with events: (key, slice, window_start, shapes, deltas, norm).

    Buckets of `width` seconds begin at the data's first moment. Shapes use the lifetime maxima and deltas the frozen
    mean and spread.
    """
    stamped = events.where(F.col(foreign_key).isNotNull() & time.isNotNull()).withColumn("__t", time)
    first = stamped.agg(F.min("__t").alias("__first"))
    placed = stamped.join(F.broadcast(first)).withColumn("slice", F.floor((F.col("__t") - F.col("__first")) / width)).withColumn("window_start", F.col("__first") + F.col("slice") * width)
    grouped = placed.groupBy(F.col(foreign_key).alias(key), "slice", "window_start").agg(*(metric(*specs[n]).alias(n) for n in names))
    shaped = grouped.select(key, "slice", "window_start", *(X.continuous_shape(F.col(n), edge_max[n]).alias(f"shape_{n}") for n in names))
    deltas = shaped.select("*", *(((F.col(f"shape_{n}") - F.lit(m)) / F.lit(s)).alias(f"delta_{n}") for n, m, s in zip(names, calibration.mu, calibration.sigma)))
    return deltas.withColumn("norm", X.norm([F.col(f"delta_{n}") for n in names])).withColumn("is_anomaly", F.round("norm", 9) >= F.round(F.lit(calibration.theta), 9))


def between(slices: DataFrame, start=None, end=None, years=None) -> DataFrame:
    """Slices from `start` on and before `end` (epoch seconds), in one of the years."""
    if start is not None:
        slices = slices.where(F.col("window_start") >= start)
    if end is not None:
        slices = slices.where(F.col("window_start") < end)
    if years:
        slices = slices.where(F.year(F.timestamp_seconds("window_start")).isin(list(years)))
    return slices


def as_of(slices: DataFrame, key: str, moment: float) -> DataFrame:
    """Each entity's last slice that does not begin after the moment."""
    held = slices.where(F.col("window_start") <= moment)
    rest = [c for c in slices.columns if c != key]
    return held.groupBy(key).agg(F.max_by(F.struct(*rest), "window_start").alias("s")).select(key, "s.*")


def centroids(slices: DataFrame, deltas: list[str]) -> DataFrame:
    """Per window: active entities, mean deltas and the share of anomalies."""
    return slices.groupBy("slice", "window_start").agg(F.count(F.lit(1)).alias("entity_count"), F.avg(F.col("is_anomaly").cast("int")).alias("anomaly_rate"), *(F.avg(d).alias(d) for d in deltas))


def trajectories(slices: DataFrame, key: str, deltas: list[str]) -> DataFrame:
    """Per entity the mean and spread of deltas over slices, displacement between the ends, and number of slices."""
    first, last = [F.min_by(d, "slice") for d in deltas], [F.max_by(d, "slice") for d in deltas]
    return slices.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_slices"), *(F.avg(d).alias(f"mean_{d}") for d in deltas), *(F.stddev_pop(d).alias(f"std_{d}") for d in deltas), X.distance(last, first).alias("displacement"), F.min("window_start").alias("first_time"), F.max("window_start").alias("last_time")
    )


def drift(slices: DataFrame, key: str, deltas: list[str]) -> DataFrame:
    """Of entities with two slices or more: displacement, path length, their ratio, steadiness and differences.

    Steadiness is 1 minus the coefficient of variation of the steps, between 0 and 1, from three slices on.
    """
    order = Window.partitionBy(key).orderBy("slice")
    step = X.distance([F.col(d) for d in deltas], [F.lag(d).over(order) for d in deltas])
    walked = slices.withColumn("__step", step)
    grouped = walked.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_slices"), F.sum("__step").alias("path_length"), F.avg("__step").alias("__mean"), F.stddev_pop("__step").alias("__std"),
        *(F.max_by(d, "slice").alias(f"__last_{d}") for d in deltas), *(F.min_by(d, "slice").alias(f"__first_{d}") for d in deltas),
    ).where("num_slices >= 2")
    moved = {d.replace("delta_", "diff_"): F.col(f"__last_{d}") - F.col(f"__first_{d}") for d in deltas}
    measured = grouped.withColumns(moved).withColumn("displacement", X.norm([F.col(m) for m in moved]))
    steady = F.when(F.col("num_slices") >= 3, F.when(F.col("__mean") > 0, F.least(F.greatest(1 - F.col("__std") / F.col("__mean"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    return measured.select(key, "num_slices", "displacement", "path_length", F.when(F.col("path_length") > 0, F.col("displacement") / F.col("path_length")).otherwise(0.0).alias("ratio"), steady.alias("steadiness"), *moved)


def population_shift(slices: DataFrame, names: list[str], deltas: list[str], a: tuple, b: tuple) -> DataFrame:
    """Per dimension the mean delta in two spans of time and its change; `shift` is the distance of the centroids."""
    inside = lambda w: (F.col("window_start") >= w[0]) & (F.col("window_start") < w[1])
    row = slices.agg(*(x for n, d in zip(names, deltas) for x in (F.avg(F.when(inside(a), F.col(d))).alias(f"a_{n}"), F.avg(F.when(inside(b), F.col(d))).alias(f"b_{n}"))))
    shift = X.distance([F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names])
    rows = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"a_{n}").alias("mean_a"), F.col(f"b_{n}").alias("mean_b"), (F.col(f"b_{n}") - F.col(f"a_{n}")).alias("change"), shift.alias("shift")) for n in names))
    listed = row.select(F.explode(rows).alias("x")).select("x.*")
    return listed.withColumn("significance", F.when(F.col("shift") > 0.5, "significant").when(F.col("shift") > 0.05, "minor").otherwise("none"))


def regime_changes(slices: DataFrame, deltas: list[str], top: int = 3) -> DataFrame:
    """Windows whose centroid moved by more than mean + 1.5 spreads of all moves; the largest moves."""
    order = Window.orderBy("slice")
    # One row a window.
    moved = centroids(slices, deltas).withColumn("shift", X.distance([F.col(d) for d in deltas], [F.lag(d).over(order) for d in deltas])).where("shift is not null")
    stats = moved.agg(F.avg("shift").alias("m"), F.stddev_pop("shift").alias("s"))
    return moved.join(F.broadcast(stats)).where(F.col("shift") > F.col("m") + 1.5 * F.col("s")).select("slice", "window_start", "shift").orderBy(F.desc("shift"), "slice").limit(top)


def reputation(slices: DataFrame, key: str) -> DataFrame:
    """(anomalous + 1) / (slices + 2) and the longest run of anomalous slices of each entity."""
    order = Window.partitionBy(key).orderBy("slice")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, "is_anomaly").orderBy("slice"))
    runs = slices.withColumn("__island", island).groupBy(key, "is_anomaly", "__island").agg(F.count(F.lit(1)).alias("__n"))
    return runs.groupBy(key).agg(
        F.sum("__n").alias("num_slices"), ((F.sum(F.when(F.col("is_anomaly"), F.col("__n")).otherwise(0)) + 1) / (F.sum("__n") + 2)).alias("reputation"), F.coalesce(F.max(F.when(F.col("is_anomaly"), F.col("__n"))), F.lit(0)).alias("longest_run")
    )


def temporal_quality(slices: DataFrame, key: str) -> DataFrame:
    """Of steps from an anomalous slice, how many stay anomalous, and a band for their share."""
    after = F.lead("is_anomaly").over(Window.partitionBy(key).orderBy("slice"))
    steps = slices.withColumn("__after", after).where("is_anomaly and __after is not null")
    counted = steps.agg(F.count(F.lit(1)).alias("transitions"), F.count(F.when(F.col("__after"), 1)).alias("persisted"))
    rate = F.col("persisted") / F.greatest("transitions", F.lit(1))
    return counted.withColumn("persistence", rate).withColumn("signal", F.when(rate >= 0.7, "persistent").when(rate <= 0.3, "transient").otherwise("mixed"))


def forecast(slices: DataFrame, key: str, deltas: list[str], theta: float, horizon: int = 1, least: int = 3) -> DataFrame:
    """Weighted linear regression of each dimension over an entity's slices, and the norm it predicts.

    The k-th last slice weighs exp(-0.3 (k - 1)). Rows: key, num_slices, predicted_norm, r_squared, crosses, reliability.
    """
    order = Window.partitionBy(key).orderBy("slice")
    whole = Window.partitionBy(key)
    placed = slices.withColumn("__i", F.row_number().over(order).cast("double")).withColumn("__n", F.count(F.lit(1)).over(whole).cast("double")).withColumn("__w", F.exp(-X.FORECAST_DECAY * (F.col("__n") - F.col("__i"))))
    w, t = F.col("__w"), F.col("__i")
    sums = [F.max("__n").alias("n"), F.sum(w).alias("sw"), F.sum(w * t).alias("st"), F.sum(w * t * t).alias("stt")]
    for i, d in enumerate(deltas):
        sums += [F.sum(w * F.col(d)).alias(f"sy{i}"), F.sum(w * t * F.col(d)).alias(f"sty{i}"), F.sum(w * F.col(d) * F.col(d)).alias(f"syy{i}")]
    grouped = placed.groupBy(key).agg(*sums).where(F.col("n") >= least)
    spread = F.col("sw") * F.col("stt") - F.col("st") * F.col("st")
    predicted, fits = [], []
    for i in range(len(deltas)):
        slope = F.when(F.abs(spread) > 1e-12, (F.col("sw") * F.col(f"sty{i}") - F.col("st") * F.col(f"sy{i}")) / spread).otherwise(0.0)
        start = (F.col(f"sy{i}") - slope * F.col("st")) / F.col("sw")
        predicted.append(start + slope * (F.col("n") + horizon))
        whole_ss = F.col(f"syy{i}") - F.col(f"sy{i}") * F.col(f"sy{i}") / F.col("sw")
        explained = slope * slope * (F.col("stt") - F.col("st") * F.col("st") / F.col("sw"))
        fits.append(F.when(whole_ss > 1e-12, F.least(F.greatest(explained / whole_ss, F.lit(0.0)), F.lit(1.0))).otherwise(1.0))
    scored = grouped.select(key, F.col("n").cast("long").alias("num_slices"), X.norm(predicted).alias("predicted_norm"), (X.total(fits) / len(deltas)).alias("r_squared"))
    return scored.withColumn("crosses", F.col("predicted_norm") >= theta).withColumn("reliability", X.reliability(F.col("num_slices"), F.col("r_squared")))


class ForecastProvider(Protocol):
    """A forecaster of one's own: of an entity's history (slices x dimensions, in order) and of a population's series."""

    def forecast_entity(self, key, history: np.ndarray, horizon: int) -> np.ndarray | None: ...

    def forecast_population(self, series: list[float], horizon: int) -> float | None: ...


class Extrapolation:
    """The engine's own provider: weighted linear regression of each dimension and of a population's series."""

    def _ahead(self, values: np.ndarray, horizon: int) -> np.ndarray:
        n = len(values)
        at = np.arange(1, n + 1)
        weights = np.exp(-X.FORECAST_DECAY * (n - at))
        slope, start = np.polyfit(at, values, 1, w=np.sqrt(weights))
        return start + slope * (n + horizon)

    def forecast_entity(self, key, history: np.ndarray, horizon: int) -> np.ndarray | None:
        return self._ahead(history, horizon) if len(history) >= 3 else None

    def forecast_population(self, series: list[float], horizon: int) -> float | None:
        return float(self._ahead(np.asarray(series, float), horizon)) if len(series) >= 3 else None


def forecast_with(slices: DataFrame, key: str, deltas: list[str], provider: ForecastProvider, horizon: int = 1) -> DataFrame:
    """key, num_slices and predicted_norm of each entity that the provider has a forecast for.

    An entity's slices are as many as its time windows; they meet in one Python group.
    """
    kind = dict(slices.dtypes)[key]

    def one(pdf):
        import pandas as pd

        own = pdf.sort_values("slice")
        found = provider.forecast_entity(own[key].iloc[0], own[deltas].to_numpy(), horizon)
        rows = [] if found is None else [(own[key].iloc[0], len(own), float(np.linalg.norm(found)))]
        return pd.DataFrame(rows, columns=[key, "num_slices", "predicted_norm"])

    return slices.select(key, "slice", *deltas).groupBy(key).applyInPandas(one, f"`{key}` {kind}, num_slices long, predicted_norm double")


def forecast_population(slices: DataFrame, provider: ForecastProvider, horizon: int = 1) -> DataFrame:
    """The anomaly rate that the provider expects `horizon` windows ahead, from the rates of all windows, a row each."""
    series = [r.rate for r in slices.groupBy("slice").agg(F.avg(F.col("is_anomaly").cast("int")).alias("rate")).orderBy("slice").collect()]
    return slices.sparkSession.createDataFrame([(len(series), provider.forecast_population(series, horizon))], "windows int, expected_rate double")


def emerging(slices: DataFrame, geo: DataFrame, key: str, deltas: list[str], theta: float, horizon: int = 1) -> DataFrame:
    """Entities that are no anomalies and whose forecast crosses theta."""
    calm = geo.where("not is_anomaly").select(key)
    return forecast(slices, key, deltas, theta, horizon).where("crosses").join(calm, key, "left_semi")


def segment_crossing(slices: DataFrame, key: str, deltas: list[str], normal, bias: float, theta: float = math.inf) -> DataFrame:
    """Slices until an entity's signed distance from a hyperplane is predicted to change its sign; null if it never does."""
    signed = slices.withColumn("signed", X.signed_distance([F.col(d) for d in deltas], normal, bias))
    w = Window.partitionBy(key).orderBy("slice")
    placed = signed.withColumn("i", F.row_number().over(w).cast("double"))
    fit = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("signed", "i").alias("slope"), F.regr_intercept("signed", "i").alias("start"), F.max_by("signed", "i").alias("now")).where("n >= 3")
    zero = -F.col("start") / F.col("slope")
    steps = F.when((F.col("slope") != 0) & (zero > F.col("n")) & (F.signum("now") != F.signum(F.col("start") + F.col("slope") * (zero + 1))), F.ceil(zero - F.col("n")))
    return fit.select(key, "n", "now", steps.alias("slices_to_crossing"))


def stale(last_time: Column, now: Column) -> Column:
    """Forecasts from slices older than 180 days are of low reliability."""
    return (now - last_time) / 86_400 > STALE_DAYS


def bursts(events: DataFrame, key: str, time: str, window_days: float = 30, threshold: float = 3.0) -> DataFrame:
    """The most events of each entity in any trailing window, and how many spreads that lies above the mean."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    trailing = Window.partitionBy(key).orderBy("__t").rangeBetween(-int(window_days * 86_400_000_000), 0)
    most = events.where(F.col(key).isNotNull()).select(key, micros.alias("__t")).withColumn("__n", F.count(F.lit(1)).over(trailing)).groupBy(key).agg(F.max("__n").alias("max_events"))
    stats = most.agg(F.avg("max_events").alias("m"), F.stddev_pop("max_events").alias("s"))
    scored = most.join(F.broadcast(stats)).withColumn("z", F.when(F.col("s") > 0, (F.col("max_events") - F.col("m")) / F.col("s")).otherwise(0.0))
    return scored.select(key, "max_events", "z", (F.col("z") >= threshold).alias("is_burst"))


def max_rolling_z(slices: DataFrame, key: str, shapes: list[str], floor: float = 0.01) -> DataFrame:
    """The largest deviation of a slice's shape from the mean of the entity's slices before it, in their spreads."""
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    z = [F.abs(F.col(s) - F.avg(s).over(before)) / F.greatest(F.stddev_pop(s).over(before), F.lit(floor)) for s in shapes]
    numbered = slices.select(key, "slice", F.row_number().over(Window.partitionBy(key).orderBy("slice")).alias("__i"), (F.greatest(*z) if len(z) > 1 else z[0]).alias("__z"))
    return numbered.groupBy(key).agg(F.max(F.when(F.col("__i") > 2, F.col("__z"))).alias("max_rolling_z"))


# Limits of the shapes of norm sequences, on norms scaled to 0..1 and places scaled by their number.
FLAT_SPAN = 1e-4
MIDDLE = (0.2, 0.8)
ARCH_ENDS, VALLEY_ENDS = 0.6, 0.4
SPIKE_BEFORE, SPIKE_START, SPIKE_END = 0.3, 0.5, 0.4
RISING = 0.7


def classify_norms(norms: Column) -> Column:
    """Shape of a sequence of norms: the first that fits of insufficient_data, flat, arch, v_shape, spike_recovery and
    linear_drift, else other."""
    n, low, high = F.size(norms), F.array_min(norms), F.array_max(norms)
    scaled = lambda i: (F.element_at(norms, i) - low) / (high - low)
    peak, trough = F.array_position(norms, high) - 1, F.array_position(norms, low) - 1
    middle = lambda at: (at / n > MIDDLE[0]) & (at / n < MIDDLE[1])
    rises = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(norms, i) > F.get(norms, i - 1)))
    return (
        F.when(n < 3, "insufficient_data")
        .when(high - low < FLAT_SPAN, "flat")
        .when(middle(peak) & (scaled(1) < ARCH_ENDS) & (scaled(-1) < ARCH_ENDS), "arch")
        .when(middle(trough) & (scaled(1) > VALLEY_ENDS) & (scaled(-1) > VALLEY_ENDS), "v_shape")
        .when((peak < n * SPIKE_BEFORE) & (scaled(1) < SPIKE_START) & (scaled(-1) < SPIKE_END), "spike_recovery")
        .when(rises > RISING * (n - 1), "linear_drift")
        .otherwise("other")
    )


def trajectory_shapes(slices: DataFrame, key: str) -> DataFrame:
    """Each entity's norms in order, their shape, and how much longer their path is than their displacement."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slice", "norm"))), lambda x: x["norm"])
    listed = slices.groupBy(key).agg(ordered.alias("norms"))
    path = F.aggregate(F.sequence(F.lit(1), F.size("norms") - 1), F.lit(0.0), lambda s, i: s + F.abs(F.get("norms", i) - F.get("norms", i - 1)))
    return listed.where("size(norms) >= 2").select(key, classify_norms(F.col("norms")).alias("shape"), (path - F.abs(F.element_at("norms", -1) - F.element_at("norms", 1))).alias("detour"))


def dtw(slices: DataFrame, key: str, deltas: list[str], a, b) -> DataFrame:
    """Dynamic-time-warping distance between the delta sequences of two entities."""

    def warp(pdf):
        import numpy as np
        import pandas as pd

        parts = [pdf[pdf["k"] == k].sort_values("slice")[deltas].to_numpy() for k in (a, b)]
        x, y = parts
        cost = np.full((len(x) + 1, len(y) + 1), np.inf)
        cost[0, 0] = 0.0
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                cost[i, j] = np.linalg.norm(x[i - 1] - y[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
        return pd.DataFrame({"distance": [float(cost[-1, -1])]})

    two = slices.where(F.col(key).isin([a, b])).select(F.col(key).alias("k"), "slice", *deltas)  # the slices of two entities
    return two.withColumn("pair", F.lit(1)).groupBy("pair").applyInPandas(warp, "distance double")


def drift_clusters(drifts: DataFrame, key: str, names: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Spherical k-means on the directions of drift: size and mean cosine to the centre of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    moved = drifts.where("displacement > 0").select(key, *((F.col(n) / F.col("displacement")).alias(n) for n in names))
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(moved)
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster", distanceMeasure="cosine").fit(vectors)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    centre = F.element_at(centres, F.col("cluster") + 1)
    length = F.sqrt(F.aggregate(centre, F.lit(0.0), lambda s, x: s + x * x))
    cosine = F.aggregate(F.zip_with(vector_to_array("v"), centre, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / length
    return model.transform(vectors).withColumn("cosine", cosine).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("cosine").alias("mean_cosine"))
