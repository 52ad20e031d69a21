"""Multi-source screening, and evidence from several populations combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import expressions as X
from orrery.operators.aggregate import simple_filter

HIT = ("source", "key", "intensity", "related", "anomalous")


def _hits(frame: DataFrame, name: str, key: Column, intensity: Column, related: Column | None = None, anomalous: Column | None = None) -> DataFrame:
    return frame.select(
        F.lit(name).alias("source"), key.cast("string").alias("key"), intensity.cast("double").alias("intensity"), (related if related is not None else F.lit(1)).cast("long").alias("related"), (anomalous if anomalous is not None else F.lit(1)).cast("long").alias("anomalous")
    )


def direct(geo: DataFrame, name: str, key: str) -> DataFrame:
    """Anomalous entities; the intensity is norm over theta."""
    return _hits(geo.where("is_anomaly"), name, F.col(key), F.col("norm") / F.col("theta"))


def borderline(geo: DataFrame, name: str, key: str, rank: float = 80.0) -> DataFrame:
    """Entities of a high rank that are not anomalous."""
    return _hits(geo.where((F.col("delta_rank_pct") >= rank) & ~F.col("is_anomaly")), name, F.col(key), F.col("norm") / F.col("theta"))


def composite(geo: DataFrame, name: str, key: str, separator: str = "→") -> DataFrame:
    """Members of composite keys with an anomalous one: anomalous and all their keys, and the largest intensity."""
    members = geo.select(F.explode(F.array_distinct(F.split(F.col(key), F.lit(separator)))).alias("member"), "is_anomaly", (F.col("norm") / F.col("theta")).alias("ratio"))
    grouped = members.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anomaly"), 1)).alias("a"), F.max(F.when(F.col("is_anomaly"), F.col("ratio"))).alias("r")).where("a > 0")
    return _hits(grouped, name, F.col("member"), F.col("r"), F.col("n"), F.col("a"))


def chains(geo: DataFrame, name: str, keys: str, condition: str | None = None) -> DataFrame:
    """Members of chains (an array column) with an anomalous one."""
    held = geo.where(simple_filter(condition)) if condition else geo
    members = held.select(F.explode(F.array_distinct(F.col(keys))).alias("member"), "is_anomaly", (F.col("norm") / F.col("theta")).alias("ratio"))
    grouped = members.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anomaly"), 1)).alias("a"), F.max(F.when(F.col("is_anomaly"), F.col("ratio"))).alias("r")).where("a > 0")
    return _hits(grouped, name, F.col("member"), F.col("r"), F.col("n"), F.col("a"))


def points(frame: DataFrame, name: str, key: str, rules: list[str], combine: str = "AND") -> DataFrame:
    """Rows that fulfil all or any of the rules; a rule on a null does not hold."""
    if combine not in ("AND", "OR"):
        raise ValueError("combine is AND or OR")
    held = [F.coalesce(simple_filter(r), F.lit(False)) for r in rules]
    condition = held[0]
    for h in held[1:]:
        condition = condition & h if combine == "AND" else condition | h
    return _hits(frame.where(condition), name, F.col(key), F.lit(1.0))


def compound(geo: DataFrame, frame: DataFrame, name: str, geo_key: str, key: str, rules: list[str], combine: str = "AND") -> DataFrame:
    """Anomalous entities that fulfil the rules too."""
    ruled = points(frame, name, key, rules, combine).select("key")
    return direct(geo, name, geo_key).join(ruled, "key", "left_semi")


def contagious(stats: DataFrame, name: str, key: str, threshold: float = 0.3) -> DataFrame:
    """Entities whose share of anomalous neighbours reaches the threshold."""
    held = stats.where(F.col("contagion_ratio") >= threshold)
    return _hits(held, name, F.col(key), F.col("contagion_ratio"), F.col("neighbor_count"), F.col("anomalous_neighbor_count"))


def screen(sources: list[DataFrame], threshold: int = 1, top: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Entities by the number of sources that hit them: score, weighted sum of intensities, and the sources' names."""
    hits = sources[0]
    for s in sources[1:]:
        hits = hits.unionByName(s)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    value = F.when(F.col("intensity") > 0, F.col("intensity")).otherwise(F.col("anomalous") / F.col("related"))
    scored = hits.groupBy("key").agg(F.count_distinct("source").alias("score"), F.sum(value * weight).alias("weighted"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where(F.col("score") >= threshold)
    return scored if top is None else scored.orderBy(F.desc("score"), F.desc("weighted"), "key").limit(top)


def discrepancies(sources: list[DataFrame]) -> DataFrame:
    """Entities that exactly one of several sources flags."""
    return screen(sources).where("score = 1").select("key", F.col("sources").alias("source"), "weighted")


def with_density(screened: DataFrame, events: DataFrame, slot: str, least: float = 0.05, hard: bool = False, threshold: int = 3) -> DataFrame:
    """Screened entities with the share of anomalous events; a share of `least` adds 1 to the score, or is required."""
    rates = events.where(F.col(slot).isNotNull()).groupBy(F.col(slot).cast("string").alias("key")).agg((F.count(F.when(F.col("is_anomaly"), 1)) / F.count(F.lit(1))).alias("density"))
    joined = screened.join(rates, "key", "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    boosted = joined.withColumn("score", F.col("score") + (F.col("density") >= least).cast("long")).where(F.col("score") >= threshold)
    return boosted.where(F.col("density") >= least) if hard else boosted


def combined_risk(signals: list[DataFrame]) -> DataFrame:
    """Fisher's combined p of each key over signals (key, p), and the number of them."""
    all_ = signals[0]
    for s in signals[1:]:
        all_ = all_.unionByName(s)
    grouped = all_.groupBy("key").agg(F.count(F.lit(1)).alias("n_patterns"), F.array_sort(F.collect_list("p")).alias("ps"))
    return grouped.select("key", "n_patterns", X.fisher_p(F.col("ps")).alias("combined_p"))


def risk_profile(hits: list[DataFrame]) -> DataFrame:
    """Per entity the sum over sources of anomalous over related, and the number of sources."""
    all_ = hits[0]
    for h in hits[1:]:
        all_ = all_.unionByName(h)
    return all_.groupBy("key").agg(F.sum(F.col("anomalous") / F.col("related")).alias("risk_score"), F.count_distinct("source").alias("source_count"))


def connected_risk(geo: DataFrame, key: str, entity: str, ranks: DataFrame, rank_key: str, separator: str = "→", most: int | None = 50) -> DataFrame:
    """Mean rank of an entity's counterparties in anomalous composite keys; of the first `most`, or of all if it is None."""
    parts = F.split(F.col(key), F.lit(separator))
    held = geo.where(F.col("is_anomaly") & F.array_contains(parts, entity)).select(F.explode(parts).alias("other")).where(F.col("other") != entity).distinct()
    if most is not None:
        held = held.orderBy("other").limit(most)
    return held.join(ranks.select(F.col(rank_key).cast("string").alias("other"), "delta_rank_pct"), "other").agg(F.count(F.lit(1)).alias("counterparties"), F.avg("delta_rank_pct").alias("mean_rank"))


def composite_profile(geo: DataFrame, key: str, entity: str, separator: str = "→", most: int = 20) -> DataFrame:
    """Of the composite keys that an entity begins or ends: their number, the anomalous ones, their largest norm and the
    first `most` anomalous keys in order; no row without any."""
    own = geo.where(F.col(key).startswith(f"{entity}{separator}") | F.col(key).endswith(f"{separator}{entity}"))
    worst = own.where("is_anomaly").orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias("anomalous_keys"))
    counted = own.agg(F.count(F.lit(1)).alias("related"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalous"), F.round(F.coalesce(F.max(F.when(F.col("is_anomaly"), F.col("norm"))), F.lit(0.0)), 4).alias("max_norm"))
    return counted.where("related > 0").join(F.broadcast(worst))


def key_type(geo: DataFrame, key: str, separator: str = "→") -> str:
    """How a population's keys name entities: chain, if it has chain_keys; composite, if a key holds the separator; else direct."""
    if "chain_keys" in geo.columns:
        return "chain"
    return "composite" if dict(geo.dtypes)[key] == "string" and geo.where(F.col(key).contains(separator)).take(1) else "direct"


def co_dispersion(a: DataFrame, b: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Spearman correlation of two populations' norms over the entities of both; null for fewer than `least`.

    Ranks are ordinal: ties are in order of key.
    """
    from orrery.operators.quantiles import with_global_rank

    joined = a.select(key, F.round("norm", 9).alias("na")).join(b.select(key, F.round("norm", 9).alias("nb")), key)
    ra = with_global_rank(joined, "na", "ra")
    rb = with_global_rank(ra, "nb", "rb")
    # Rows of one value are put in order of key; a value that many rows share is one task.
    exact = rb
    for rank, x in (("ra", "x"), ("rb", "y")):
        exact = exact.withColumn(x, F.col(rank) + F.row_number().over(Window.partitionBy(rank).orderBy(key)))
    return exact.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r")).select("n", F.when(F.col("n") >= least, F.col("r")).alias("spearman"))


def subgroup_inflation(geo: DataFrame, group: str, least: float = 1.5) -> DataFrame:
    """Groups whose mean conformal p is smaller than the population's by a factor of `least` or more."""
    overall = geo.agg(F.avg("conformal_p").alias("overall"))
    grouped = geo.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_key")).agg(F.count(F.lit(1)).alias("size"), F.avg("conformal_p").alias("mean_p"))
    return grouped.join(F.broadcast(overall)).withColumn("inflation", F.col("overall") / F.greatest("mean_p", F.lit(1e-12))).where(F.col("inflation") >= least).select("group_key", "size", "mean_p", "inflation")
