"""Event aggregates per anchor: counts, amounts, windows, inter-event times, composite keys and graph features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.expressions import composite_key, seconds
from orrery.operators.quantiles import exact_quantiles

METRICS = ("count", "count_distinct", "sum", "max", "mean", "std")
GAPS = ("iet_mean", "iet_std", "iet_min")


def metric(name: str, column: str | None = None) -> Column:
    """The aggregate expression of a metric; std is that of a population."""
    if name == "count":
        return F.count(F.lit(1)).cast("double")
    if column is None:
        raise ValueError(f"metric {name} needs a column")
    value = F.col(column)
    makers = {
        "count_distinct": lambda: F.count_distinct(value).cast("double"),
        "sum": lambda: F.sum(value.cast("double")),
        "max": lambda: F.max(value.cast("double")),
        "mean": lambda: F.avg(value.cast("double")),
        "std": lambda: F.stddev_pop(value.cast("double")),
    }
    if name not in makers:
        raise ValueError(f"unknown metric: {name}")
    return makers[name]()


def scatter(anchors: DataFrame, key: str, grouped: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every anchor with its aggregates; missing and null ones are 0."""
    joined = anchors.join(grouped, key, "left")
    return joined.select(*anchors.columns, *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names))


def derived_batch(anchors: DataFrame, key: str, events: DataFrame, foreign_key: Column | str, specs: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Several metrics {dimension: (metric, column)} in one aggregation, left-joined to the anchors."""
    fk = F.col(foreign_key) if isinstance(foreign_key, str) else foreign_key
    grouped = events.where(fk.isNotNull()).groupBy(fk.alias(key)).agg(*(metric(*spec).alias(n) for n, spec in specs.items()))
    return scatter(anchors, key, grouped, list(specs))


def windowed(anchors: DataFrame, key: str, events: DataFrame, foreign_key: str, time: Column, window: str, name: str, spec: tuple[str, str | None], combine: str = "max") -> DataFrame:
    """A metric per anchor and bucket of `window` from the data's first moment on, combined over buckets with events."""
    width = seconds(window)
    stamped = events.where(F.col(foreign_key).isNotNull() & time.isNotNull()).withColumn("__t", time)
    first = stamped.agg(F.min("__t").alias("__first"))
    bucketed = stamped.join(F.broadcast(first)).withColumn("__bucket", F.floor((F.col("__t") - F.col("__first")) / width))
    per_bucket = bucketed.groupBy(F.col(foreign_key).alias(key), "__bucket").agg(metric(*spec).alias("__v"))
    makers = {"max": F.max("__v"), "mean": F.avg("__v"), "last": F.max_by("__v", "__bucket")}
    if combine not in makers:
        raise ValueError(f"unknown window aggregation: {combine}")
    return scatter(anchors, key, per_bucket.groupBy(key).agg(makers[combine].alias(name)), [name])


def inter_event_times(anchors: DataFrame, key: str, events: DataFrame, foreign_key: str, time: Column, names: Sequence[str] = GAPS, tie: str | None = None) -> DataFrame:
    """Mean, standard deviation and minimum of the gaps between an anchor's consecutive events, in seconds; 0 for one event."""
    order = Window.partitionBy(key).orderBy("__t", *([tie] if tie else []))
    stamped = events.where(F.col(foreign_key).isNotNull() & time.isNotNull()).select(F.col(foreign_key).alias(key), time.alias("__t"), *([tie] if tie else []))
    gaps = stamped.withColumn("__gap", F.col("__t") - F.lag("__t").over(order)).where("__gap is not null")
    makers = {"iet_mean": F.avg("__gap"), "iet_std": F.stddev_pop("__gap"), "iet_min": F.min("__gap")}
    return scatter(anchors, key, gaps.groupBy(key).agg(*(makers[n].alias(n) for n in names)), names)


def composite_line(events: DataFrame, columns: Sequence[str], separator: str = "→") -> DataFrame:
    """Distinct key tuples without nulls, as primary_key and the parts."""
    return events.select(*columns).dropna().distinct().select(composite_key([F.col(c) for c in columns], separator).alias("primary_key"), *columns)


def graph_features(anchors: DataFrame, key: str, events: DataFrame, source: str, target: str) -> DataFrame:
    """out_degree, in_degree, reciprocity (1 if both sender and receiver) and counterpart_overlap of each anchor."""
    pairs = events.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("f"), F.col(target).alias("t")).distinct()
    back = pairs.select(F.col("t").alias("f"), F.col("f").alias("t"), F.lit(1).alias("both"))
    out = pairs.join(back, ["f", "t"], "left").groupBy(F.col("f").alias(key)).agg(F.count(F.lit(1)).cast("double").alias("out_degree"), F.count("both").cast("double").alias("bidirectional"))
    into = pairs.groupBy(F.col("t").alias(key)).agg(F.count(F.lit(1)).cast("double").alias("in_degree"))
    joined = scatter(scatter(anchors, key, out, ["out_degree", "bidirectional"]), key, into, ["in_degree"])
    both = joined["bidirectional"]
    union = F.col("out_degree") + F.col("in_degree") - both
    return joined.withColumns(
        {
            "reciprocity": F.when((F.col("out_degree") > 0) & (F.col("in_degree") > 0), 1.0).otherwise(0.0),
            "counterpart_overlap": F.when(union > 0, both / union).otherwise(0.0),
        }
    ).drop("bidirectional")


def edge_maxima(df: DataFrame, columns: Sequence[str], percentile: float = 99.0) -> dict[str, float]:
    """For each count or amount, max(1, the whole part of the percentile of its positive values)."""
    found = exact_quantiles(df, {c: (F.when(F.col(c) > 0, F.col(c)), percentile / 100) for c in columns})
    return {c: max(1.0, float(int(v))) if v is not None else 1.0 for c, v in found.items()}


def event_maxima(df: DataFrame, columns: Sequence[str], percentile: float = 99.0) -> dict[str, float]:
    """For each numeric event column, the percentile of its positive values, at least 1e-9; 1 without any."""
    found = exact_quantiles(df, {c: (F.when(F.col(c) > 0, F.col(c)), percentile / 100) for c in columns})
    return {c: max(1e-9, v) if v is not None else 1.0 for c, v in found.items()}
