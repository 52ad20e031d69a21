"""Profiles, population summaries, hub statistics, data-quality checks and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators.quantiles import exact_quantiles

# Limits of checks and alerts.
HISTOGRAM = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5)
RATE_SPIKE, SIZE_SHOCK, HIGH_RATE, VERY_HIGH_RATE = 0.05, 0.10, 0.30, 0.50
DRIFT_SOFT, DRIFT_HARD = 0.05, 0.20


def search_entities(points: DataFrame, key: str, name: str, value, limit: int = 20) -> DataFrame:
    """The first `limit` keys whose property equals the value, and the number of all of them."""
    kind = dict(points.dtypes)[name]
    found = points.where(F.col(name) == F.lit(value).cast(kind))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.select(key).orderBy(key).limit(limit).join(F.broadcast(total))


def profile_categorical(points: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The most frequent values with their counts, all rows, and the number of distinct values, null being one."""
    value = F.coalesce(F.col(name).cast("string"), F.lit("(null)"))
    counts = points.groupBy(value.alias("value")).count()
    totals = counts.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("distinct_values"))
    return counts.orderBy(F.desc("count"), "value").limit(limit).join(F.broadcast(totals))


def profile_numeric(points: DataFrame, name: str, digits: int = 4) -> DataFrame:
    quartiles = exact_quantiles(points, {n: (F.col(name), q) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))})
    column = F.col(name)
    return points.agg(
        F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count(column)).alias("nulls"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.round(F.avg(column), digits).alias("mean"), F.round(F.stddev_pop(column), digits).alias("std"), *(F.round(F.lit(v).cast("double"), digits).alias(n) for n, v in quartiles.items()),
    )


def profile_temporal(points: DataFrame, name: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return points.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count(name)).alias("nulls"), text(F.min(name)).alias("min"), text(F.max(name)).alias("max"))


def profile_numeric_grouped(points: DataFrame, name: str, group: str, digits: int = 4) -> DataFrame:
    return points.groupBy(F.col(group).alias("group_key")).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(name), digits).alias("mean"), F.round(F.percentile(name, F.lit(0.5)), digits).alias("median"))


def dimension_percentiles(points: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """min, p25, p50, p75, p99 and max of numeric columns, NaN left out: a row for each."""
    shares = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "max": 1.0}
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    found = exact_quantiles(points, {f"{c}|{n}": (clean[c], q) for c in columns for n, q in shares.items()})
    rows = [(c, *(None if found[f"{c}|{n}"] is None else round(found[f"{c}|{n}"], digits) for n in shares)) for c in columns]
    return points.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{n} double" for n in shares))


def geometry_stats(geo: DataFrame, theta: float) -> DataFrame:
    """Totals, norm percentiles, maximum and inactive share of a population.

    The inactive share is that of the norms up to the fullest of 50 equal bins, if that bin holds over a quarter of
    the rows and lies below the median; else 0.
    """
    shares = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = exact_quantiles(geo, {n: (F.col("norm"), q) for n, q in shares.items()})
    head = geo.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anomaly"), 1)).alias("a"), F.min("norm").alias("lo"), F.max("norm").alias("hi")).first()
    inactive = 0.0
    if head["n"] and head["hi"] > head["lo"]:
        width = (head["hi"] - head["lo"]) / 50
        bin_ = F.least(F.floor((F.col("norm") - head["lo"]) / width), F.lit(49))
        bins = {r["b"]: r["count"] for r in geo.groupBy(bin_.alias("b")).count().collect()}  # 50 rows
        top = max(sorted(bins), key=bins.get)
        if bins[top] > 0.25 * head["n"] and head["lo"] + (top + 0.5) * width < found["p50"]:
            inactive = sum(v for b, v in bins.items() if b <= top) / head["n"]
    row = (head["n"], head["a"], *(found[n] for n in shares), head["hi"], float(inactive), float(theta))
    return geo.sparkSession.createDataFrame([row], "total long, anomalies long, p50 double, p75 double, p90 double, p95 double, p99 double, max double, inactive_ratio double, theta double")


def sphere_overview(geos: dict[str, DataFrame]) -> DataFrame:
    """pattern, total, anomalies (norm >= theta), rate and calibration health of each population."""
    out = None
    for name, geo in sorted(geos.items()):
        row = geo.agg(F.count(F.lit(1)).alias("total"), F.count(F.when((F.col("theta") > 0) & (F.round("norm", 9) >= F.round("theta", 9)), 1)).alias("anomalies"))
        row = row.withColumn("rate", F.col("anomalies") / F.greatest("total", F.lit(1))).select(F.lit(name).alias("pattern"), "*")
        row = row.withColumn("health", X.health(F.col("rate"), F.col("total")))
        out = row if out is None else out.unionByName(row)
    return out


def geometry_mode(geo: DataFrame, column: str) -> str:
    """binary, continuous or mixed, by the number of a dimension's values (at six digits) in all rows.

    Few values meet in one small aggregate; of many, partial aggregates keep a sketch, which tells 5 from more.
    """
    distinct = geo.agg(F.approx_count_distinct(F.round(column, 6), 0.01)).first()[0]
    return "binary" if distinct <= 3 else "continuous" if distinct > 5 else "mixed"


def norm_histogram(geo: DataFrame) -> DataFrame:
    """Rows by norm over theta: bins from 0, .25, .5, .75, 1 and 1.5 on."""
    ratio = F.col("norm") / F.col("theta")
    at = F.lit(0)
    for i, edge in enumerate(HISTOGRAM):
        at = F.when(ratio >= edge, i).otherwise(at)
    return geo.groupBy(F.element_at(F.array(*map(F.lit, HISTOGRAM)), at + 1).alias("from_ratio")).count()


def anomaly_clusters(geo: DataFrame, deltas: list[str], most: int = 20) -> DataFrame:
    """Anomalies (norm >= theta) with equal deltas to one digit: size and mean norm of the largest groups."""
    held = geo.where("norm >= theta")
    keys = [F.round(F.col(d), 1).alias(d) for d in deltas]
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("norm"), 6).alias("mean_norm")).orderBy(F.desc("size"), *deltas).limit(most)


def driving_dimensions(geo: DataFrame, names: list[str], deltas: list[str], least: float = 0.03) -> DataFrame:
    """Each dimension's share of the anomalies' squared norms, where above `least`."""
    held = geo.where("norm >= theta")
    sums = held.agg(*(F.sum(F.col(d) * F.col(d)).alias(n) for n, d in zip(names, deltas)))
    whole = X.total([F.col(n) for n in names])
    shares = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), (F.col(n) / whole).alias("share")) for n in names))).alias("x"))
    return shares.select("x.dimension", F.round("x.share", 6).alias("share")).where(F.col("share") > least)


def line_geometry_stats(geo: DataFrame, slots: list[str], delta: str) -> DataFrame:
    """Rows by their number of alive edges to a line (0, 1, 2, 3 or more) and the mean absolute delta."""
    edges = X.total([F.when(F.coalesce(X.alive(F.col(s)), F.lit(False)), 1).otherwise(0) for s in slots])
    return geo.groupBy(F.least(edges, F.lit(3)).alias("edges")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(F.abs(delta)), 6).alias("mean_abs_delta"))


def dead_dimensions(geo: DataFrame, names: list[str], deltas: list[str], least: float = 0.01) -> DataFrame:
    """Variance of each dimension and whether it is too small to tell entities apart."""
    row = geo.agg(*(F.var_pop(d).alias(n) for n, d in zip(names, deltas)))
    listed = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("variance")) for n in names))).alias("x"))
    return listed.select("x.dimension", F.round("x.variance", 6).alias("variance"), (F.col("x.variance") < least).alias("is_dead"))


def hub_score(shapes: list[str], edge_max: list[float]):
    """Sum of the shares times their maxima: an entity's capped connections."""
    return X.total([F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(1.0)) * F.lit(float(m)) for s, m in zip(shapes, edge_max)])


def hubs(geo: DataFrame, key: str, shapes: list[str], edge_max: list[float], top: int = 10) -> DataFrame:
    return geo.select(key, hub_score(shapes, edge_max).alias("hub_score"), "is_anomaly").orderBy(F.desc("hub_score"), key).limit(top)


def hub_statistics(geo: DataFrame, shapes: list[str], edge_max: list[float]) -> DataFrame:
    """Mean, spread, percentiles and maximum of hub scores, and the maximum as a share of the highest possible."""
    scored = geo.select(hub_score(shapes, edge_max).alias("h"))
    found = exact_quantiles(scored, {n: (F.col("h"), q) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))})
    return scored.agg(
        F.round(F.avg("h"), 4).alias("mean"), F.round(F.stddev_pop("h"), 4).alias("std"), F.round(F.max("h"), 4).alias("max"),
        *(F.round(F.lit(v).cast("double"), 4).alias(n) for n, v in found.items()), F.round(F.max("h") / sum(edge_max), 6).alias("share_of_ceiling"),
    )


def data_quality(geo: DataFrame, names: list[str], shapes: list[str], deltas: list[str]) -> DataFrame:
    """One row a check: name, value, and whether it is an issue."""
    total = F.count(F.lit(1))
    recomputed = X.norm([F.col(d) for d in deltas])
    row = geo.agg(
        total.alias("n"),
        (F.count(F.when(F.col("is_anomaly"), 1)) / total).alias("rate"),
        (F.count(F.when(F.col("norm") == 0, 1)) / total).alias("zero_norms"),
        (F.count(F.when(F.col("norm") >= 0.75 * F.col("theta"), 1)) / total).alias("ceiling"),
        F.count(F.when(F.abs(recomputed - F.col("norm")) > 0.01, 1)).alias("mismatch"),
        *((F.count(F.when(F.col(s) > 0, 1)) / total).alias(f"c_{n}") for n, s in zip(names, shapes)),
    )
    check = lambda name, value, issue: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), issue.alias("is_issue"))
    checks = [
        check("anomaly_rate", F.col("rate"), F.col("rate") > HIGH_RATE),
        check("no_anomalies", F.col("rate"), (F.col("rate") == 0) & (F.col("n") > 1000)),
        check("degenerate", F.col("zero_norms"), F.col("zero_norms") > 0.10),
        check("ceiling", F.col("ceiling"), F.col("ceiling") > 0.50),
        check("norm_mismatch", F.col("mismatch"), F.col("mismatch") > 0),
        *(check(f"coverage_{n}", F.col(f"c_{n}"), F.col(f"c_{n}") < 0.50) for n in names),
    ]
    return row.select(F.explode(F.array(*checks)).alias("x")).select("x.check", F.round("x.value", 6).alias("value"), "x.is_issue")


def alerts(now: DataFrame, before: DataFrame) -> DataFrame:
    """Alerts from two rows (total, anomalies): rate spike, size shock, high and zero rate."""
    joined = now.select(F.col("total").alias("n"), (F.col("anomalies") / F.col("total")).alias("r")).join(F.broadcast(before.select(F.col("total").alias("m"), (F.col("anomalies") / F.col("total")).alias("q"))))
    alert = lambda name, value, raised: F.struct(F.lit(name).alias("alert"), value.alias("value"), raised.alias("raised"))
    growth = (F.col("n") - F.col("m")) / F.col("m")
    found = [
        alert("rate_spike", F.col("r") - F.col("q"), F.col("r") - F.col("q") > RATE_SPIKE),
        alert("size_shock", growth, F.abs(growth) > SIZE_SHOCK),
        alert("high_rate", F.col("r"), F.col("r") > HIGH_RATE),
        alert("very_high_rate", F.col("r"), F.col("r") > VERY_HIGH_RATE),
        alert("zero_rate", F.col("r"), (F.col("r") == 0) & (F.col("n") > 1000)),
    ]
    return joined.select(F.explode(F.array(*found)).alias("x")).select("x.alert", F.round("x.value", 6).alias("value"), "x.raised")


def regime_alert(changes: DataFrame, now: float, days: int = 90, time: str = "window_start") -> DataFrame:
    """The alert that a regime change (`time` in seconds) lies in the last `days` before `now`; value is their number."""
    recent = changes.where((F.col(time) >= now - days * 86_400) & (F.col(time) <= now)).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return recent.select(F.lit("regime_changepoint").alias("alert"), "value", (F.col("value") > 0).alias("raised"))


def staleness_alerts(drift: float, soft: float = DRIFT_SOFT, hard: float = DRIFT_HARD) -> list[tuple[str, float, bool]]:
    """Alerts of a calibration that has drifted: blocked beyond `hard`, else stale beyond `soft`."""
    return [("calibration_blocked", round(drift, 6), drift > hard), ("calibration_stale", round(drift, 6), soft < drift <= hard)]


def temporal_hint(slices: DataFrame, key: str, entity, time: str = "window_start") -> DataFrame:
    """Number of an entity's slices and the time of the last; no row without any."""
    own = slices.where(F.col(key) == entity).agg(F.count(F.lit(1)).alias("num_slices"), F.max(time).alias("last"))
    return own.where("num_slices > 0").select("num_slices", X.iso(F.col("last") * 1_000_000).alias("last_timestamp"))


def effective_sample_size(population: int, share: float) -> int:
    """Rows of a sample that is a share of the population, 1 at least."""
    return max(1, int(population * share))


def segment_shifts(geo: DataFrame, columns: list[str], most_values: int | None = 50, least_ratio: float = 2.0) -> DataFrame:
    """Segments (column, value) whose anomaly rate is at least `least_ratio` times the population's; columns of more than
    `most_values` values are names rather than segments and left out, unless it is None."""
    kept = columns
    if most_values is not None:
        counts = geo.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
        kept = [c for c in columns if counts[c] <= most_values]
    overall = geo.agg((F.count(F.when(F.col("is_anomaly"), 1)) / F.count(F.lit(1))).alias("overall"))
    listed = geo.select("is_anomaly", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in kept))).alias("s"))
    rates = listed.where("s.value is not null").groupBy("s.column", "s.value").agg(F.count(F.lit(1)).alias("size"), (F.count(F.when(F.col("is_anomaly"), 1)) / F.count(F.lit(1))).alias("rate"))
    return rates.join(F.broadcast(overall)).withColumn("ratio", F.col("rate") / F.col("overall")).where(F.col("ratio") >= least_ratio).select("column", "value", "size", F.round("rate", 6).alias("rate"), F.round("ratio", 6).alias("ratio"))


def event_rate_divergence(anchors: DataFrame, key: str, events: DataFrame, slot: str, least_events: int = 5, threshold: float = 0.15) -> DataFrame:
    """Anchors that are not anomalous although over `threshold` of their events, `least_events` at least, are."""
    rates = events.where(F.col(slot).isNotNull()).groupBy(F.col(slot).alias(key)).agg(F.count(F.lit(1)).alias("n_events"), (F.count(F.when(F.col("is_anomaly"), 1)) / F.count(F.lit(1))).alias("event_rate"))
    calm = anchors.where("not is_anomaly").select(key, "norm")
    return calm.join(rates, key).where((F.col("n_events") >= least_events) & (F.col("event_rate") > threshold))
