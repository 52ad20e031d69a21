"""Graph operators over an edge table (from_key, to_key, event_key, timestamp, amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import expressions as X
from orrery.sources.store import materialise

EDGE_COLUMNS = ("from_key", "to_key", "event_key", "timestamp", "amount")


def extract_edges(events: DataFrame, source: str, target: str, event: str, time: Column | None = None, amount: str | None = None) -> DataFrame:
    """The edge table of events; rows without either end are dropped, a null amount is 0."""
    ends = X.alive(F.col(source)) & X.alive(F.col(target))
    stamp = F.lit(0.0) if time is None else F.coalesce(time.cast("double"), F.lit(0.0))
    value = F.lit(0.0) if amount is None else F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    return events.where(F.coalesce(ends, F.lit(False))).select(F.col(source).alias("from_key"), F.col(target).alias("to_key"), F.col(event).alias("event_key"), stamp.alias("timestamp"), value.alias("amount"))


def infer_columns(schema) -> tuple[str | None, str | None]:
    """Time and amount columns of an event table, by type and name."""
    names = {f.name: f.dataType.typeName() for f in schema}
    times = [n for n, t in names.items() if t.startswith("timestamp") or t == "date"] or [n for n in names if any(w in n.lower() for w in ("timestamp", "date", "time"))]
    numbers = [n for n, t in names.items() if t in ("double", "float", "decimal", "integer", "long")]
    amounts = [n for n in numbers if any(w in n.lower() for w in ("amount", "value", "price", "total"))]
    return (times or [None])[0], (amounts or [None])[0]


def read_edges(edges: DataFrame, from_keys=None, to_keys=None, time_from=None, time_to=None) -> DataFrame:
    """Edges with ends in the lists and a time in the range, both ends of which count."""
    if from_keys is not None:
        edges = edges.where(F.col("from_key").isin(list(from_keys)))
    if to_keys is not None:
        edges = edges.where(F.col("to_key").isin(list(to_keys)))
    if time_from is not None:
        edges = edges.where(F.col("timestamp") >= time_from)
    if time_to is not None:
        edges = edges.where(F.col("timestamp") <= time_to)
    return edges


def edge_statistics(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct("from_key").alias("n_from"), F.count_distinct("to_key").alias("n_to"),
        F.min("timestamp").alias("min_time"), F.max("timestamp").alias("max_time"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        (F.count(F.lit(1)) / F.count_distinct("from_key")).alias("mean_out_degree"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours (key, other), without loops."""
    kept = edges.where("from_key <> to_key")
    return kept.select(F.col("from_key").alias("key"), F.col("to_key").alias("other")).union(kept.select("to_key", "from_key")).distinct()


def contagion(edges: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Neighbours, anomalous neighbours and their share of each entity on an edge."""
    anomalous = flags.where("is_anomaly").select(F.col(key).alias("other"), F.lit(1).alias("bad"))
    counted = both_ways(edges).join(anomalous, "other", "left").groupBy("key").agg(F.count(F.lit(1)).alias("neighbor_count"), F.count("bad").alias("anomalous_neighbor_count"))
    return counted.withColumn("contagion_ratio", F.col("anomalous_neighbor_count") / F.col("neighbor_count"))


def counterparties(edges: DataFrame, key, flags: DataFrame | None = None, flag_key: str = "key", top: int = 20, cutoff=None) -> DataFrame:
    """The entity's counterparties by direction: events, summed and largest amount, flag; the most frequent first."""
    edges = read_edges(edges, time_to=cutoff)
    out = edges.where(F.col("from_key") == key).select(F.lit("out").alias("direction"), F.col("to_key").alias("other"), "amount")
    into = edges.where(F.col("to_key") == key).select(F.lit("in").alias("direction"), F.col("from_key").alias("other"), "amount")
    grouped = out.union(into).groupBy("direction", "other").agg(F.count(F.lit(1)).alias("tx_count"), F.sum("amount").alias("amount_sum"), F.max("amount").alias("amount_max"))
    order = Window.partitionBy("direction").orderBy(F.desc("tx_count"), "other")
    best = grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    if flags is None:
        return best
    return best.join(flags.select(F.col(flag_key).alias("other"), "is_anomaly"), "other", "left")


def entity_flow(edges: DataFrame, cutoff=None) -> DataFrame:
    """Outgoing, incoming and net amounts of every entity, and the direction of the net."""
    edges = read_edges(edges, time_to=cutoff)
    out = edges.groupBy(F.col("from_key").alias("key")).agg(F.sum("amount").alias("out_total"))
    into = edges.groupBy(F.col("to_key").alias("key")).agg(F.sum("amount").alias("in_total"))
    joined = out.join(into, "key", "full").select("key", F.coalesce("out_total", F.lit(0.0)).alias("out_total"), F.coalesce("in_total", F.lit(0.0)).alias("in_total"))
    net = F.round(F.col("in_total") - F.col("out_total"), 2)
    return joined.withColumn("net", net).withColumn("direction", F.when(F.col("net") > 0, "in").when(F.col("net") < 0, "out").otherwise("even"))


def counterparty_flow(edges: DataFrame, key, top: int = 20, cutoff=None) -> DataFrame:
    """Net amounts between one entity and each counterparty, the largest first."""
    edges = read_edges(edges, time_to=cutoff).where((F.col("from_key") == key) | (F.col("to_key") == key))
    other = F.when(F.col("from_key") == key, F.col("to_key")).otherwise(F.col("from_key"))
    signed = edges.groupBy(other.alias("other")).agg(F.sum(F.when(F.col("to_key") == key, F.col("amount")).otherwise(0.0)).alias("in_total"), F.sum(F.when(F.col("from_key") == key, F.col("amount")).otherwise(0.0)).alias("out_total"))
    return signed.withColumn("net", F.round(F.col("in_total") - F.col("out_total"), 2)).orderBy(F.desc(F.abs("net")), "other").limit(top)


def degree_velocity(edges: DataFrame, buckets: int = 4, cutoff=None) -> DataFrame:
    """Distinct counterparties of each entity in the first and last of `buckets` equal time spans, and their ratio."""
    edges = read_edges(edges, time_to=cutoff)
    span = edges.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    placed = edges.join(F.broadcast(span)).withColumn("bucket", F.least(F.floor((F.col("timestamp") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / buckets, F.lit(1e-9))), F.lit(buckets - 1)))
    sides = placed.select(F.col("from_key").alias("key"), F.col("to_key").alias("other"), "bucket").union(placed.select("to_key", "from_key", "bucket"))
    counted = sides.groupBy("key").agg(F.count_distinct(F.when(F.col("bucket") == 0, F.col("other"))).alias("first_degree"), F.count_distinct(F.when(F.col("bucket") == buckets - 1, F.col("other"))).alias("last_degree"))
    return counted.withColumn("velocity", F.col("last_degree") / F.greatest("first_degree", F.lit(1)))


def investigation_coverage(edges: DataFrame, key, explored: DataFrame, flags: DataFrame, flag_key: str) -> DataFrame:
    """Neighbours of an entity, how many are explored, their share, and anomalous ones that are not."""
    own = both_ways(edges).where(F.col("key") == key).select("other")
    seen = explored.select(F.col(explored.columns[0]).alias("other"), F.lit(1).alias("seen")).distinct()
    bad = flags.where("is_anomaly").select(F.col(flag_key).alias("other"), F.lit(1).alias("bad"))
    joined = own.join(seen, "other", "left").join(bad, "other", "left")
    counted = joined.agg(F.count(F.lit(1)).alias("neighbors"), F.count("seen").alias("explored"), F.count(F.when(F.col("seen").isNull(), F.col("bad"))).alias("unexplored_anomalies"))
    return counted.withColumn("coverage", F.col("explored") / F.greatest("neighbors", F.lit(1)))


def anomalous_edges(edges: DataFrame, a, b, events: DataFrame, event_key: str, top: int = 10) -> DataFrame:
    """Events between two entities, either way, with the largest norms of the event population."""
    between = edges.where(((F.col("from_key") == a) & (F.col("to_key") == b)) | ((F.col("from_key") == b) & (F.col("to_key") == a)))
    return between.join(events.select(F.col(event_key).alias("event_key"), "norm", "is_anomaly"), "event_key").orderBy(F.desc("norm"), "event_key").limit(top)


# Weights of the cosine, of shared high dimensions and of the norms' ratio in a hop's score.
HOP_WEIGHTS = (0.4, 0.3, 0.3)


def hop_score(scoring: str, a: list[Column], b: list[Column], theta: list[float] | float, amount: Column | None = None, most: Column | None = None) -> Column:
    """Score of a hop between two points: geometric, amount, anomaly or shortest."""
    limits = theta if isinstance(theta, list) else [theta] * len(a)
    if scoring == "shortest":
        return F.lit(1.0)
    if scoring == "anomaly":
        return X.norm(b)
    na, nb = X.norm(a), X.norm(b)
    cosine = F.when((na > 0) & (nb > 0), X.dot(a, b) / (na * nb)).otherwise(0.0)
    high_a, high_b = [F.abs(x) > t for x, t in zip(a, limits)], [F.abs(x) > t for x, t in zip(b, limits)]
    both = X.total([(p & q).cast("int") for p, q in zip(high_a, high_b)])
    either = X.total([(p | q).cast("int") for p, q in zip(high_a, high_b)])
    ratio = F.when(F.greatest(na, nb) > 0, F.least(na, nb) / F.greatest(na, nb)).otherwise(0.0)
    geometric = HOP_WEIGHTS[0] * cosine + HOP_WEIGHTS[1] * F.when(either > 0, both / either).otherwise(0.0) + HOP_WEIGHTS[2] * ratio
    if scoring == "geometric":
        return geometric
    if scoring == "amount":
        return geometric * (1 + F.log1p(amount) / F.greatest(F.log1p(most), F.lit(1e-9)))
    raise ValueError(f"unknown scoring: {scoring}")


def propagate_influence(edges: DataFrame, geo: DataFrame, key: str, deltas: list[str], theta: float, seeds: list, depth: int = 3, decay: float = 0.7, least: float = 0.001, most: int | None = None) -> DataFrame:
    """key, score, depth and tx_count of the entities that seeds influence: the best score over paths of at most `depth`
    steps, and of the path that gives it the length and the events of its last step.

    A step multiplies the score by decay, by the geometric hop score (0.01 at least) and by 1 + ln(events between its
    ends). An entity whose score a later path improves is carried on from again; seeds are never reached. Each step is a
    written table of one row an entity. All reached entities are returned; `most` keeps only those of the best scores.
    """
    pairs = edges.where("from_key <> to_key").select(F.col("from_key").alias("a"), F.col("to_key").alias("b"), "event_key")
    linked = pairs.union(pairs.select("b", "a", "event_key")).groupBy("a", "b").agg(F.count_distinct("event_key").alias("n"))
    left = geo.select(F.col(key).alias("a"), *(F.col(d).alias(f"x{i}") for i, d in enumerate(deltas)))
    right = geo.select(F.col(key).alias("b"), *(F.col(d).alias(f"y{i}") for i, d in enumerate(deltas)))
    xs, ys = [[F.col(f"{s}{i}") for i in range(len(deltas))] for s in "xy"]
    hop = F.greatest(hop_score("geometric", xs, ys, theta / len(deltas) ** 0.5), F.lit(0.01))
    steps = linked.where(~F.col("b").isin(seeds)).join(left, "a").join(right, "b")
    factors = materialise(steps.select("a", F.col("b").alias("key"), "n", (hop * (1 + F.log("n")) * decay).alias("factor")))
    frontier = materialise(geo.where(F.col(key).isin(seeds)).select(F.col(key).alias("a"), F.lit(1.0).alias("score")).distinct())
    reached = None
    for step in range(1, depth + 1):
        pushed = frontier.join(factors, "a").select("key", (F.col("score") * F.col("factor")).alias("score"), F.lit(step).alias("depth"), F.col("n").alias("tx_count"))
        found = pushed.where(F.col("score") >= least).groupBy("key").agg(F.max(F.struct("score", "depth", "tx_count")).alias("best")).select("key", "best.*")
        if reached is None:
            reached = better = materialise(found)
        else:
            old = reached.select("key", F.col("score").alias("old"))
            better = materialise(found.join(old, "key", "left").where("old is null or score > old").drop("old"))
            reached = materialise(reached.join(better.select("key"), "key", "left_anti").unionByName(better))
        frontier = better.select(F.col("key").alias("a"), "score")
    return reached if most is None else reached.orderBy(F.desc("score"), "key").limit(most)


def discover_chains(edges: DataFrame, seeds: list, hops: int = 3, least: int = 2, window_hours: float = 168, direction: str = "forward") -> DataFrame:
    """All simple paths from the seeds in time order, each hop within the window of the last; each hop is a written table.

    Rows: seed, keys, event_keys, amounts, hop_count, span_hours, is_cyclic, amount_decay. A path that returns to its
    seed is cyclic and ends there.
    """
    if direction == "backward":
        edges = edges.select(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"), "event_key", (-F.col("timestamp")).alias("timestamp"), "amount")
    window = window_hours * 3600
    step = edges.where("from_key <> to_key").select(F.col("from_key").alias("f"), F.col("to_key").alias("t"), F.col("event_key").alias("e"), F.col("timestamp").alias("ts"), F.col("amount").alias("am"))
    start = step.where(F.col("f").isin(seeds)).select(
        F.col("f").alias("seed"), F.array("f", "t").alias("keys"), F.array("e").alias("event_keys"), F.array("am").alias("amounts"), F.col("ts").alias("first"), F.col("ts").alias("last"), F.col("t").alias("end")
    )
    paths = materialise(start)
    found = paths
    for _ in range(hops - 1):
        open_ = paths.where(F.col("end") != F.col("seed"))
        near = (F.col("end") == F.col("f")) & (F.col("ts") >= F.col("last")) & (F.col("ts") - F.col("last") <= window)
        longer = open_.join(step, near).where((F.col("t") == F.col("seed")) | ~F.array_contains("keys", F.col("t"))).where(~F.array_contains("event_keys", F.col("e")))
        longer = longer.select("seed", F.array_append("keys", F.col("t")).alias("keys"), F.array_append("event_keys", F.col("e")).alias("event_keys"), F.array_append("amounts", F.col("am")).alias("amounts"), "first", F.col("ts").alias("last"), F.col("t").alias("end"))
        paths = materialise(longer)
        found = found.unionByName(paths)
    kept = found.where(F.size("event_keys") >= least).withColumn("events", F.array_sort("event_keys"))
    one = kept.groupBy("events").agg(F.min_by(F.struct("seed", "keys", "event_keys", "amounts", "first", "last", "end"), F.struct("seed", "event_keys")).alias("p")).select("p.*")
    amounts = F.col("amounts")
    return one.select(
        "seed", "keys", "event_keys", "amounts", F.size("event_keys").alias("hop_count"), ((F.col("last") - F.col("first")) / 3600).alias("span_hours"), (F.col("end") == F.col("seed")).alias("is_cyclic"),
        F.when(F.element_at(amounts, 1) != 0, F.element_at(amounts, -1) / F.element_at(amounts, 1)).alias("amount_decay"),
    )


def chain_members(chains: DataFrame) -> DataFrame:
    """(key, chain_id) of each member of chains with an id and keys."""
    return chains.select("chain_id", F.explode("keys").alias("key"))


def chain_statistics(chains: DataFrame) -> DataFrame:
    """Amount statistics of each chain: mean, population spread, coefficient of variation, extremes, distinct keys."""
    n = F.size("amounts")
    mean = F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x) / n
    squares = F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x * x) / n
    spread = F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))
    return chains.select("*", mean.alias("amount_mean"), spread.alias("amount_std"), F.when(mean != 0, spread / mean).otherwise(0.0).alias("amount_cv"), F.array_min("amounts").alias("amount_min"), F.array_max("amounts").alias("amount_max"), F.size(F.array_distinct("keys")).alias("n_keys"))


def chain_seeds(edges: DataFrame, percentile: float = 0.95, least_in: int = 2, least_out: int = 2, least_events: int = 5) -> DataFrame:
    """Entities to start chains from: a fan-out in the top share, or passing through."""
    from orrery.operators.quantiles import exact_quantiles

    out = edges.groupBy(F.col("from_key").alias("key")).agg(F.count_distinct("to_key").alias("out_degree"), F.count(F.lit(1)).alias("out_events"))
    into = edges.groupBy(F.col("to_key").alias("key")).agg(F.count_distinct("from_key").alias("in_degree"), F.count(F.lit(1)).alias("in_events"))
    joined = out.join(into, "key", "full").fillna(0)
    limit = exact_quantiles(joined, {"p": (F.col("out_degree"), percentile)})["p"] or 0.0
    passing = (F.col("in_degree") >= least_in) & (F.col("out_degree") >= least_out) & (F.col("in_events") + F.col("out_events") >= least_events)
    return joined.select("key", "out_degree", "in_degree", (F.col("out_degree") >= limit).alias("is_fan_out"), passing.alias("is_pass_through")).where("is_fan_out or is_pass_through")


def geometric_path(edges: DataFrame, geo: DataFrame, key: str, deltas: list[str], theta: float, source, target, depth: int = 5, beam: int | None = 10, scoring: str = "geometric") -> DataFrame:
    """Paths of the first depth that reaches the target, best mean hop score first; `beam` paths go on at each depth, all if it is None."""
    left = geo.select(F.col(key).alias("key"), *(F.col(d).alias(f"x{i}") for i, d in enumerate(deltas)))
    right = geo.select(F.col(key).alias("other"), *(F.col(d).alias(f"y{i}") for i, d in enumerate(deltas)))
    xs, ys = [[F.col(f"{s}{i}") for i in range(len(deltas))] for s in "xy"]
    each = theta / len(deltas) ** 0.5
    hops = materialise(both_ways(edges).join(left, "key").join(right, "other").select("key", "other", hop_score(scoring, xs, ys, each).alias("hop")))
    paths = materialise(hops.where(F.col("key") == source).select(F.array("key", "other").alias("path"), F.col("hop").alias("total"), F.col("other").alias("end")))
    for step in range(1, depth + 1):
        done = paths.where(F.col("end") == target)
        if done.take(1) or step == depth:
            return done.select("path", F.lit(step).alias("n_hops"), (F.col("total") / step).alias("score")).orderBy(F.desc("score"), F.array_join(F.col("path").cast("array<string>"), ","))
        best = paths if beam is None else paths.orderBy(F.desc("total"), F.array_join(F.col("path").cast("array<string>"), ",")).limit(beam)
        longer = best.join(hops, best["end"] == hops["key"]).where(~F.array_contains("path", F.col("other")))
        paths = materialise(longer.select(F.array_append("path", F.col("other")).alias("path"), (F.col("total") + F.col("hop")).alias("total"), F.col("other").alias("end")))
    return done


def neighborhood(edges: DataFrame, key, hops: int = 2, most: int = 100) -> DataFrame:
    """Entities within `hops` steps of one, with their distance; the nearest `most`."""
    pairs = materialise(both_ways(edges))
    reached = materialise(pairs.where(F.col("key") == key).select("key").distinct().withColumn("hops", F.lit(0)))
    frontier = reached
    for step in range(1, hops + 1):
        new = frontier.join(pairs, "key").select(F.col("other").alias("key")).distinct().join(reached.select("key"), "key", "left_anti")
        frontier = materialise(new.withColumn("hops", F.lit(step)))
        reached = reached.unionByName(frontier)
    return reached.where("hops > 0").orderBy("hops", "key").limit(most)


def cluster_bridges(edges: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """Edges between clusters (key, cluster) by pair of clusters: number of edges and of entities on them."""
    a = edges.join(clusters.select(F.col("key").alias("from_key"), F.col("cluster").alias("ca")), "from_key").join(clusters.select(F.col("key").alias("to_key"), F.col("cluster").alias("cb")), "to_key")
    across = a.where("ca <> cb").select(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high"), "from_key", "to_key")
    ends = across.select("low", "high", F.explode(F.array("from_key", "to_key")).alias("key"), F.lit(0.5).alias("half"))
    return ends.groupBy("low", "high").agg(F.sum("half").cast("long").alias("n_edges"), F.count_distinct("key").alias("n_entities")).orderBy(F.desc("n_edges"), "low", "high").limit(top)


def edge_columns(events: DataFrame, relations: dict[str, str], explicit: dict | None = None, graph_features: dict | None = None, disabled: bool = False) -> dict | None:
    """Which columns make an event line's edges: source, target, time and amount; None if there are none.

    The first that applies of: edges are disabled; a declaration; the columns of declared graph features; the first two of
    the event line's foreign keys (column to line) that refer to one line. Time and amount are inferred where not given.
    """
    if disabled:
        return None
    time, amount = infer_columns(events.schema)
    if explicit:
        return {"time": time, "amount": amount} | explicit
    if graph_features:
        return {"source": graph_features["source"], "target": graph_features["target"], "time": time, "amount": amount}
    by_line: dict[str, list[str]] = {}
    for column, line in relations.items():
        by_line.setdefault(line, []).append(column)
    ends = next((columns for columns in by_line.values() if len(columns) >= 2), None)
    return {"source": ends[0], "target": ends[1], "time": time, "amount": amount} if ends else None


#: Features of a chain and what divides them, so that they are shares of a cap.
CHAIN_FEATURES = {"hop_count": 10.0, "is_cyclic": 1.0, "n_keys": 10.0, "amount_decay": 2.0}


def chain_line(chains: DataFrame, features: dict[str, float] | None = None) -> DataFrame:
    """An anchor table of chains: primary_key (a hash of the events), chain_keys and chain_events comma-joined, and features
    from 0 to 1, capped at the values of `features`; a null one is 0."""
    caps = CHAIN_FEATURES if features is None else features
    counted = chains.withColumn("n_keys", F.size(F.array_distinct("keys")))
    events = F.array_join(F.col("event_keys").cast("array<string>"), ",")
    shares = [F.coalesce(F.least(F.greatest(F.col(n).cast("double") / cap, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias(n) for n, cap in caps.items()]
    return counted.select(F.sha2(events, 256).alias("primary_key"), F.array_join(F.col("keys").cast("array<string>"), ",").alias("chain_keys"), events.alias("chain_events"), *shares)
