"""Calibration: shapes, mean and spread, deltas, norms, thresholds, ranks, conformal p-values and flags.

Statistics are small and live on the driver; the geometry itself is one lazy plan of scalar columns, which stays
inside generated code. The array form is put together at the end only.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators.derived import edge_maxima, event_maxima
from orrery.operators.quantiles import exact_quantiles, with_global_rank
from orrery.plans.spec import Alias, Calibration, Pattern

SIGMA_FLOOR = 0.01
PROPERTY_SIGMA_FLOOR = 0.2
#: Fill rates outside of which a property is no dimension; the upper one does not hold for text.
LEAST_FILL, MOST_FILL = 0.05, 0.999
RIDGE = 1e-4
#: Groups whose statistics the driver keeps.
MOST_GROUPS = 10_000


def resolve_edge_maxima(df: DataFrame, pattern: Pattern) -> dict[str, float]:
    fixed = {d.name: float(d.edge_max) for d in pattern.dimensions if d.edge_max != "auto"}
    for kind, maker in (("continuous", edge_maxima), ("event", event_maxima)):
        for percentile in sorted({d.percentile for d in pattern.dimensions if d.kind == kind and d.name not in fixed}):
            own = [d for d in pattern.dimensions if d.kind == kind and d.name not in fixed and d.percentile == percentile]
            found = maker(df, [d.source for d in own], percentile)
            fixed |= {d.name: found[d.source] for d in own}
    return fixed


def shape_columns(pattern: Pattern, edge_max: dict[str, float]) -> list[Column]:
    makers = {
        "self": lambda d: F.lit(1.0),
        "binary": lambda d: X.relation_shape(F.col(d.source)),
        "continuous": lambda d: X.continuous_shape(F.col(d.source), edge_max[d.name]),
        "event": lambda d: X.event_shape(F.col(d.source), edge_max[d.name]),
        "property": lambda d: X.property_shape(F.col(d.source)),
    }
    return [makers[d.kind](d).alias(s) for d, s in zip(pattern.dimensions, pattern.shapes)]


def tracked_properties(df: DataFrame, columns: list[str]) -> list[str]:
    """The properties whose fill rate makes them dimensions."""
    kinds = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns)).first()
    fill = {c: row[c] / row["n"] if row["n"] else 0.0 for c in columns}
    return [c for c in columns if fill[c] >= LEAST_FILL and (fill[c] < MOST_FILL or kinds[c] in ("string", "binary"))]


def _moments(shaped: DataFrame, pattern: Pattern) -> tuple[list[float], list[float], list[float], int]:
    aggregates = [F.count(F.lit(1)).alias("n")]
    for s in pattern.shapes:
        aggregates += [F.avg(s).alias(f"m_{s}"), F.stddev_pop(s).alias(f"d_{s}")]
    row = shaped.agg(*aggregates).first()
    raw = [row[f"d_{s}"] or 0.0 for s in pattern.shapes]
    floors = [PROPERTY_SIGMA_FLOOR if d.kind == "property" else SIGMA_FLOOR for d in pattern.dimensions]
    return [row[f"m_{s}"] or 0.0 for s in pattern.shapes], [max(r, f) for r, f in zip(raw, floors)], raw, row["n"]


def kurtosis_weights(shaped: DataFrame, pattern: Pattern, mu: list[float], sigma: list[float], raw: list[float]) -> list[float]:
    """max(1, E[z^4] / 3) of each dimension; 1 where the spread is below the floor."""
    row = shaped.agg(*(F.avg(F.pow((F.col(s) - m) / d, 4.0)).alias(s) for s, m, d in zip(pattern.shapes, mu, sigma))).first()
    return [max(1.0, (row[s] or 0.0) / 3.0) if r >= SIGMA_FLOOR else 1.0 for s, r in zip(pattern.shapes, raw)]


def cholesky_inverse(shaped: DataFrame, pattern: Pattern) -> list[list[float]] | None:
    """Inverse of the Cholesky factor of the sample covariance, slightly ridged; None where it has none."""
    names = pattern.shapes
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = shaped.agg(*(F.covar_samp(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs)).first()
    covariance = np.zeros((len(names), len(names)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c_{i}_{j}"] or 0.0
    try:
        return np.linalg.inv(np.linalg.cholesky(covariance + RIDGE * np.eye(len(names)))).tolist()
    except np.linalg.LinAlgError:
        return None


def delta_columns(pattern: Pattern, calibration: Calibration) -> list[Column]:
    """Deltas from shape columns with frozen statistics."""
    moved = [F.col(s) - F.lit(m) for s, m in zip(pattern.shapes, calibration.mu)]
    if calibration.cholesky_inverse:
        deltas = [X.total([F.lit(w) * c for w, c in zip(row, moved)]) for row in calibration.cholesky_inverse]
    else:
        deltas = [c / F.lit(s) for c, s in zip(moved, calibration.sigma)]
    if calibration.weights:
        deltas = [c * F.lit(w) for c, w in zip(deltas, calibration.weights)]
    return [c.alias(n) for c, n in zip(deltas, pattern.deltas)]


def calibrate(df: DataFrame, pattern: Pattern) -> Calibration:
    """Statistics of a population: edge maxima, mean, spread, weights, Cholesky factor, threshold and groups."""
    edge_max = resolve_edge_maxima(df, pattern)
    shaped = df.select("*", *shape_columns(pattern, edge_max))
    mu, sigma, raw, rows = _moments(shaped, pattern)
    calibration = Calibration(edge_max, mu, sigma, 0.0, rows)
    if pattern.mahalanobis:
        calibration.cholesky_inverse = cholesky_inverse(shaped, pattern)
    if pattern.weights == "kurtosis":
        calibration.weights = kurtosis_weights(shaped, pattern, mu, sigma, raw)
    elif pattern.weights:
        calibration.weights = list(pattern.weights)
    share = pattern.anomaly_percentile / 100
    normed = shaped.select("*", *delta_columns(pattern, calibration)).withColumn("norm", X.norm([F.col(d) for d in pattern.deltas]))
    calibration.theta = exact_quantiles(normed, {"theta": (F.col("norm"), share)})["theta"] or 0.0
    if pattern.group_by:
        calibration.groups = group_statistics(shaped, pattern, share)
    return calibration


def group_statistics(shaped: DataFrame, pattern: Pattern, share: float) -> dict[str, dict]:
    """mu, sigma, theta and size of each group; groups of one row have no threshold."""
    group = F.coalesce(F.col(pattern.group_by).cast("string"), F.lit("")).alias("__group")
    aggregates = [F.count(F.lit(1)).alias("n")]
    for s in pattern.shapes:
        aggregates += [F.avg(s).alias(f"m_{s}"), F.greatest(F.stddev_pop(s), F.lit(SIGMA_FLOOR)).alias(f"d_{s}")]
    per_group = shaped.select(group, *pattern.shapes).groupBy("__group").agg(*aggregates)
    grouped = shaped.select(group, *pattern.shapes).join(per_group, "__group")
    norm = X.norm([(F.col(s) - F.col(f"m_{s}")) / F.col(f"d_{s}") for s in pattern.shapes])
    thetas = grouped.select("__group", norm.alias("norm")).groupBy("__group").agg(F.percentile("norm", F.lit(share)).alias("theta"))
    rows = per_group.join(thetas, "__group").limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return {
        r["__group"]: {
            "mu": [r[f"m_{s}"] for s in pattern.shapes],
            "sigma": [r[f"d_{s}"] if r["n"] > 1 else SIGMA_FLOOR for s in pattern.shapes],
            "theta": r["theta"] if r["n"] > 1 else 0.0,
            "rows": r["n"],
        }
        for r in rows
    }


def component_calibration(df: DataFrame, pattern: Pattern, components: int = 5, seed: int = 42, rounds: int = 30) -> tuple[DataFrame, Calibration]:
    """k-means components of the shapes, each with its own mean, spread and threshold: the rows with `component`, and a
    calibration by that group, which score() takes with pattern.group_by = "component"."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    edge_max = resolve_edge_maxima(df, pattern)
    shaped = df.select("*", *shape_columns(pattern, edge_max))
    vectors = VectorAssembler(inputCols=pattern.shapes, outputCol="__v").transform(shaped)
    model = KMeans(k=components, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="component").fit(vectors)
    placed = model.transform(vectors).drop("__v")
    own = replace(pattern, group_by="component")
    mu, sigma, _, rows = _moments(placed, own)
    calibration = Calibration(edge_max, mu, sigma, 0.0, rows)
    calibration.groups = group_statistics(placed, own, pattern.anomaly_percentile / 100)
    return placed.drop(*pattern.shapes), calibration


def group_deltas(df: DataFrame, pattern: Pattern, calibration: Calibration) -> DataFrame:
    """Deltas and `theta` of each row by its group's statistics, joined from a table of groups."""
    spark = df.sparkSession
    fields = ["__group", "theta", *(f"m_{s}" for s in pattern.shapes), *(f"d_{s}" for s in pattern.shapes)]
    rows = [(g, float(x["theta"]), *map(float, x["mu"]), *map(float, x["sigma"])) for g, x in calibration.groups.items()]
    table = spark.createDataFrame(rows, "__group string, " + ", ".join(f"`{f}` double" for f in fields[1:]))
    joined = df.withColumn("__group", F.coalesce(F.col(pattern.group_by).cast("string"), F.lit(""))).join(F.broadcast(table), "__group", "left")
    deltas = {d: (F.col(s) - F.col(f"m_{s}")) / F.col(f"d_{s}") for s, d in zip(pattern.shapes, pattern.deltas)}
    return joined.withColumns(deltas).drop("__group", *fields[2:])


def score(df: DataFrame, pattern: Pattern, calibration: Calibration) -> DataFrame:
    """Shapes, deltas, norm, theta and flag of rows against frozen statistics."""
    shaped = df.select("*", *shape_columns(pattern, calibration.edge_max))
    if calibration.groups:
        measured = group_deltas(shaped, pattern, calibration)
    else:
        measured = shaped.select("*", *delta_columns(pattern, calibration), F.lit(float(calibration.theta)).alias("theta"))
    measured = measured.withColumn("norm", X.norm([F.col(d) for d in pattern.deltas]))
    return measured.withColumn("is_anomaly", (F.col("theta") > 0) & (F.round("norm", 9) >= F.round("theta", 9)))


def geometry(df: DataFrame, pattern: Pattern, calibration: Calibration | None = None, ranks: bool = True) -> DataFrame:
    """The population's geometry: `df` with shapes, deltas, norm, theta, is_anomaly and, with ranks, delta_rank_pct,
    conformal_p and n_anomalous_dims."""
    calibration = calibration or calibrate(df, pattern)
    scored = score(df, pattern, calibration)
    if not ranks:
        return scored
    tails = exact_quantiles(scored, {d: (F.abs(F.col(d)), 0.99) for d in pattern.deltas})
    ranked = with_global_rank(scored.withColumn("__norm", F.round("norm", 9)), "__norm", "__below", "__rows")
    return ranked.withColumns(
        {
            "delta_rank_pct": F.col("__below") / F.col("__rows") * 100,
            "conformal_p": 1 - F.col("__below") / F.col("__rows"),
            "n_anomalous_dims": X.total([(F.round(F.abs(F.col(d)), 9) > F.round(F.lit(tails[d] or 0.0), 9)).cast("int") for d in pattern.deltas]),
        }
    ).drop("__below", "__rows", "__norm")


def with_delta_array(df: DataFrame, pattern: Pattern) -> DataFrame:
    return df.withColumn("delta", F.array(*pattern.deltas))


def alias_statistics(geo: DataFrame, pattern: Pattern, alias: Alias, percentile: float = 95.0) -> dict:
    """Mean, spread and threshold of the sub-population on the alias's side; raises ValueError if it is empty."""
    inside = geo.where(X.signed_distance([F.col(d) for d in pattern.deltas], alias.normal, alias.bias) >= 0)
    aggregates = [F.count(F.lit(1)).alias("n")]
    for d in pattern.deltas:
        aggregates += [F.avg(d).alias(f"m_{d}"), F.stddev_pop(d).alias(f"d_{d}")]
    row = inside.agg(*aggregates).first()
    if not row["n"]:
        raise ValueError(f"alias {alias.alias_id} is empty")
    mu = [row[f"m_{d}"] for d in pattern.deltas]
    moved = inside.select(X.norm([F.col(d) - m for d, m in zip(pattern.deltas, mu)]).alias("norm"))
    return {"population": row["n"], "mu": mu, "sigma": [max(row[f"d_{d}"], 1e-9) for d in pattern.deltas], "theta": exact_quantiles(moved, {"t": (F.col("norm"), percentile / 100)})["t"]}


def recalibrate(geo: DataFrame, pattern: Pattern, calibration: Calibration, percentile: float = 95.0) -> Calibration:
    """New statistics from stored deltas alone: shapes are solved back, then calibrated at the percentile."""
    back = geo.select(*((F.col(d) * F.lit(s) + F.lit(m)).alias(n) for d, m, s, n in zip(pattern.deltas, calibration.mu, calibration.sigma, pattern.shapes)))
    mu, sigma, _, rows = _moments(back, pattern)
    fresh = Calibration(calibration.edge_max, mu, sigma, 0.0, rows)
    normed = back.select(*delta_columns(pattern, fresh)).select(X.norm([F.col(d) for d in pattern.deltas]).alias("norm"))
    fresh.theta = exact_quantiles(normed, {"t": (F.col("norm"), percentile / 100)})["t"] or 0.0
    return fresh
