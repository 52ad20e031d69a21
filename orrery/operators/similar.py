"""Anomalies, boundaries, neighbours, clusters, contrasts, centroids and cohorts in delta space; text search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import expressions as X
from orrery.sources.store import materialise

#: Rows of the query side that a block of an all-pairs search broadcasts, on average.
QUERY_ROWS = 2_000
#: With at most so many dimensions a search goes through trees instead, as boxes hardly prune in more.
TREE_DIMENSIONS = 8
#: Queries of a block that is sent to all trees, points of a tree, points of a leaf.
TREE_QUERIES, TREE_POINTS, LEAF = 100_000, 100_000, 64
#: Queries, and pairs of a query and a leaf, that a tree works on at a time.
TREE_BATCH, TREE_PAIRS = 4_096, 8_192
BM25_K1, BM25_B = 1.2, 0.75


def anomalies(geo: DataFrame, key: str, radius: float = 1.0, top: int = 10, offset: int = 0) -> DataFrame:
    """Entities with norm >= radius x theta, the largest first."""
    held = geo.where((F.col("theta") > 0) & (F.round("norm", 9) >= F.round(F.col("theta") * radius, 9)))
    return held.orderBy(F.desc("norm"), key).offset(offset).limit(top)


def boundary(geo: DataFrame, key: str, deltas: list[str], normal, bias: float, direction: str = "both", top: int = 10) -> DataFrame:
    """Entities nearest to a hyperplane, on the side in (>= 0), out (< 0) or both."""
    measured = geo.withColumn("signed_distance", X.signed_distance([F.col(d) for d in deltas], normal, bias))
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    if direction != "both":
        measured = measured.where(F.col("signed_distance") >= 0 if direction == "in" else F.col("signed_distance") < 0)
    return measured.select(key, "signed_distance").orderBy(F.abs("signed_distance"), key).limit(top)


def nearest(geo: DataFrame, key: str, deltas: list[str], reference, top: int = 5, condition: Column | None = None) -> DataFrame:
    """The entities nearest to the one with key `reference` under the Euclidean distance, itself left out."""
    point = geo.where(F.col(key) == reference).select(*deltas).first()
    if point is None:
        from orrery.plans.spec import EntityNotFound

        raise EntityNotFound(str(reference))
    rows = geo.where(F.col(key) != reference)
    if condition is not None:
        rows = rows.where(condition)
    return rows.withColumn("distance", X.distance([F.col(d) for d in deltas], [F.lit(point[d]) for d in deltas])).orderBy("distance", key).limit(top)


def neighbours_of(geo: DataFrame, queries: DataFrame, key: str, deltas: list[str], top: int = 5) -> DataFrame:
    """(query, key, distance, rank): the nearest entities of each query; ties go to smaller keys.

    Up to TREE_DIMENSIONS dimensions, each part of the points becomes a k-d tree that all queries go through, and
    entities with a component that is null or not finite take no part. In more, all pairs are measured: hash blocks of
    some QUERY_ROWS queries are broadcast one by one; each partition keeps its best before anything is shuffled.
    """
    if len(deltas) <= TREE_DIMENSIONS:
        return _tree_neighbours(geo, queries, key, deltas, top)
    held = queries.select(F.col(key).alias("query"), *(F.col(d).alias(f"q_{d}") for d in deltas))
    blocks = -(-held.count() // QUERY_ROWS) or 1
    if blocks > 1:
        geo, held = materialise(geo), materialise(held)
    order = Window.partitionBy("query").orderBy("distance", key)

    def block(part: DataFrame) -> DataFrame:
        pairs = geo.join(F.broadcast(part), F.col(key) != F.col("query"))
        measured = pairs.select("query", key, X.distance([F.col(d) for d in deltas], [F.col(f"q_{d}") for d in deltas]).alias("distance"))
        return measured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    if blocks == 1:
        return block(held)
    return reduce(DataFrame.unionByName, (block(held.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)) for i in range(blocks)))


def _tree_neighbours(geo: DataFrame, queries: DataFrame, key: str, deltas: list[str], top: int) -> DataFrame:
    """Of entities at one point, top + 1 of the smallest keys can be among a query's nearest; only these go into trees."""
    spark = geo.sparkSession
    finite = reduce(lambda a, b: a & b, (F.abs(F.col(d)) < float("inf") for d in deltas))
    columns = [F.col(key), *(F.col(d).cast("double").alias(d) for d in deltas)]
    at_point = Window.partitionBy(*deltas).orderBy(key)
    points = geo.where(finite).select(*columns).withColumn("__n", F.row_number().over(at_point)).where(F.col("__n") <= top + 1).drop("__n")
    points, held = materialise(points), materialise(queries.where(finite).select(*columns))
    points = points.repartition(-(-points.count() // TREE_POINTS) or 1, key)
    kind = points.schema[key].dataType.simpleString()
    blocks = -(-held.count() // TREE_QUERIES) or 1

    def block(part: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(part.toArrow().combine_chunks())
        return points.mapInArrow(lambda batches: _nearest_batches(batches, sent.value, top + 1), f"query {kind}, `{key}` {kind}, distance double")

    found = reduce(DataFrame.unionByName, (block(held.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)) for i in range(blocks)))
    order = Window.partitionBy("query").orderBy("distance", key)
    return found.where(F.col(key) != F.col("query")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _matrix(table: pa.Table) -> np.ndarray:
    """The columns after the first, one row a column."""
    return np.array([table.column(i).to_numpy() for i in range(1, table.num_columns)])


def _nearest_batches(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, components) in any batches to (query, key, distance): the k nearest of each tree, and what ties with the last."""
    asked, names, waiting, rows = _matrix(queries), None, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        keys = table.column(0).combine_chunks()
        tree = Tree(_matrix(table), k)
        for start in range(0, queries.num_rows, TREE_BATCH):
            query, row, distance = tree.nearest(asked[:, start : start + TREE_BATCH])
            yield pa.RecordBatch.from_arrays([queries.column(0).combine_chunks().take(pa.array(query + start)), keys.take(pa.array(row)), pa.array(distance)], names=["query", names[0], "distance"])

    for batch in batches:
        names = batch.schema.names
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= 2 * TREE_POINTS:
            yield from out()
            waiting, rows = [], 0
    if waiting:
        yield from out()


class Tree:
    """A balanced k-d tree of points, one row a dimension, with the box of each node; node i has the children 2i and 2i + 1.

    Distances are summed dimension by dimension in doubles, gaps to boxes likewise; rounding keeps order, so no gap
    exceeds the distance of a point in the box.
    """

    def __init__(self, points: np.ndarray, k: int):
        n, self.k = points.shape[1], k
        self.levels = max(0, int(n / max(LEAF, 2 * k)).bit_length() - 1)
        order, bounds = np.arange(n), [0, n]
        for _ in range(self.levels):
            split = [0]
            for start, end in zip(bounds[:-1], bounds[1:]):
                own, middle = order[start:end], (end - start) // 2
                widest = int(np.argmax(np.ptp(points[:, own], axis=1)))
                order[start:end] = own[np.argpartition(points[widest, own], middle)]
                split += [start + middle, end]
            bounds = split
        self.order, self.points = order, points[:, order]
        self.starts, self.ends = np.array(bounds[:-1]), np.array(bounds[1:])
        self.width = int((self.ends - self.starts).max())
        lows, highs = [np.minimum.reduceat(self.points, self.starts, axis=1)], [np.maximum.reduceat(self.points, self.starts, axis=1)]
        for _ in range(self.levels):
            lows.insert(0, np.minimum(lows[0][:, ::2], lows[0][:, 1::2]))
            highs.insert(0, np.maximum(highs[0][:, ::2], highs[0][:, 1::2]))
        root = np.zeros((len(points), 1))  # there is no node 0
        self.low, self.high = np.concatenate([root, *lows], axis=1), np.concatenate([root, *highs], axis=1)

    def gap(self, queries: np.ndarray, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        total = np.zeros(len(query))
        for q, low, high in zip(queries, self.low, self.high):
            x = q[query]
            total += np.maximum(np.maximum(low[node] - x, x - high[node]), 0.0) ** 2
        return np.sqrt(total)

    def distances(self, queries: np.ndarray, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of a leaf's points, one row a pair; infinite where the leaf has fewer than others."""
        leaf = node - (1 << self.levels)
        rows = self.starts[leaf][:, None] + np.arange(self.width)
        beyond = rows >= self.ends[leaf][:, None]
        rows[beyond] = 0
        total = np.zeros(rows.shape)
        for q, p in zip(queries, self.points):
            total += (p[rows] - q[query][:, None]) ** 2
        total[beyond] = np.inf
        return rows, np.sqrt(total)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of each query's k nearest points, and of all that tie with the last of them."""
        n = queries.shape[1]
        every, node = np.arange(n), np.ones(n, dtype=np.int64)
        for _ in range(self.levels):
            left, right = self.gap(queries, every, 2 * node), self.gap(queries, every, 2 * node + 1)
            node = 2 * node + (right < left)
        bound = np.full(n, np.inf)
        if self.width >= self.k:
            for start in range(0, n, TREE_PAIRS):
                part = every[start : start + TREE_PAIRS]
                bound[part] = np.partition(self.distances(queries, part, node[part])[1], self.k - 1, axis=1)[:, self.k - 1]
        query, node = every, np.ones(n, dtype=np.int64)
        for _ in range(self.levels):
            query, node = np.repeat(query, 2), (2 * node[:, None] + np.arange(2)).ravel()
            near = self.gap(queries, query, node) <= bound[query]
            query, node = query[near], node[near]
        found = []
        for start in range(0, len(query), TREE_PAIRS):
            part = query[start : start + TREE_PAIRS]
            rows, far = self.distances(queries, part, node[start : start + TREE_PAIRS])
            pair, place = np.nonzero((far <= bound[part][:, None]) & (far < np.inf))
            found.append((part[pair], rows[pair, place], far[pair, place]))
        query, row, distance = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        by = np.lexsort((distance, query))
        query, row, distance = query[by], row[by], distance[by]
        first = np.searchsorted(query, every)
        last = np.minimum(first + self.k, np.searchsorted(query, every, "right")) - 1
        kept = distance <= distance[last[query]] if len(query) else np.empty(0, bool)
        return query[kept], self.order[row[kept]], distance[kept]


def array_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def contrast(geo: DataFrame, names: list[str], deltas: list[str], in_a: Column, in_b: Column | None = None) -> DataFrame:
    """Per dimension the means of two groups, their difference and Cohen's d; B is A's complement if not given."""
    a = F.coalesce(in_a, F.lit(False))
    b = ~a if in_b is None else F.coalesce(in_b, F.lit(False))
    row = geo.agg(*(x for n, d in zip(names, deltas) for x in (F.avg(F.when(a, F.col(d))).alias(f"ma_{n}"), F.avg(F.when(b, F.col(d))).alias(f"mb_{n}"), F.var_pop(F.when(a, F.col(d))).alias(f"va_{n}"), F.var_pop(F.when(b, F.col(d))).alias(f"vb_{n}"))))
    rows = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"ma_{n}").alias("mean_a"), F.col(f"mb_{n}").alias("mean_b"), F.sqrt((F.col(f"va_{n}") + F.col(f"vb_{n}")) / 2).alias("pooled")) for n in names))
    listed = row.select(F.explode(rows).alias("x")).select("x.*").withColumn("diff", F.col("mean_a") - F.col("mean_b"))
    return listed.withColumn("effect", F.when(F.col("pooled") > 0, F.col("diff") / F.col("pooled")).otherwise(F.col("diff"))).drop("pooled")


def centroid_map(geo: DataFrame, deltas: list[str], group: str) -> DataFrame:
    """Per group: size, centroid, mean and spread of norms, and the centroid's distance to the population's."""
    overall = geo.agg(*(F.avg(d).alias(f"g_{d}") for d in deltas))
    grouped = geo.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.avg("norm").alias("radius"), F.stddev_pop("norm").alias("spread"), *(F.avg(d).alias(d) for d in deltas))
    return grouped.join(F.broadcast(overall)).withColumn("distance_to_global", X.distance([F.col(d) for d in deltas], [F.col(f"g_{d}") for d in deltas])).drop(*(f"g_{d}" for d in deltas))


def centroid_distances(centroids: DataFrame, deltas: list[str], group: str) -> DataFrame:
    """Distances between every two groups' centroids; groups are as few as the property's values."""
    a = centroids.select(F.col(group).alias("group_a"), *(F.col(d).alias(f"a_{d}") for d in deltas))
    b = centroids.select(F.col(group).alias("group_b"), *(F.col(d).alias(f"b_{d}") for d in deltas))
    return a.join(F.broadcast(b), F.col("group_a") < F.col("group_b")).select("group_a", "group_b", X.distance([F.col(f"a_{d}") for d in deltas], [F.col(f"b_{d}") for d in deltas]).alias("distance"))


def clusters(geo: DataFrame, key: str, deltas: list[str], k: int = 5, seed: int = 42, cosine: bool = False) -> tuple[DataFrame, DataFrame]:
    """k-means on deltas: (key, cluster, distance) of every entity, and per cluster size, anomaly rate, norms and the
    entity nearest to the centre. Clusters are numbered from the largest on."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=deltas, outputCol="__v").transform(geo.select(key, "norm", "is_anomaly", *deltas))
    if cosine:
        vectors = vectors.where(X.norm([F.col(d) for d in deltas]) > 0)
    model = KMeans(k=k, seed=seed, maxIter=100, featuresCol="__v", predictionCol="__c", distanceMeasure="cosine" if cosine else "euclidean").fit(vectors)
    centres = np.array(model.clusterCenters())
    assigned = model.transform(vectors)
    sizes = {r["__c"]: r["count"] for r in assigned.groupBy("__c").count().collect()}
    number = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}
    cluster = F.element_at(F.create_map(*[F.lit(x) for c, i in number.items() for x in (c, i)]), F.col("__c"))
    centre = F.element_at(F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in centres)), F.col("__c") + 1)
    members = assigned.select(key, "norm", "is_anomaly", cluster.alias("cluster"), array_distance(vector_to_array("__v"), centre).alias("distance"))
    summary = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg(F.col("is_anomaly").cast("int")).alias("anomaly_rate"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"), F.min_by(key, F.struct("distance", key)).alias("representative")
    )
    return members.select(key, "cluster", "distance"), summary


def best_k(geo: DataFrame, deltas: list[str], k_max: int = 15, seed: int = 42, rows: int = 5000) -> int:
    """The number of clusters with the largest silhouette on a hash-ordered sample of `rows`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    sample = geo.select(*deltas).orderBy(F.xxhash64(*deltas)).limit(rows)
    vectors = VectorAssembler(inputCols=deltas, outputCol="features").transform(sample).cache()
    n = vectors.count()
    judge = ClusteringEvaluator()
    scores = {k: judge.evaluate(KMeans(k=k, seed=seed).fit(vectors).transform(vectors)) for k in range(2, max(3, min(k_max, int(n**0.5)) + 1))}
    vectors.unpersist()
    return max(scores, key=lambda k: (scores[k], -k))


def classify_anomalies(geo: DataFrame, names: list[str], deltas: list[str], high: float = 1.0) -> DataFrame:
    """Anomalies by deltas rounded to one digit: number, and which dimensions are elevated or missing."""
    keys = [F.round(F.col(d), 1).alias(d) for d in deltas]
    grouped = geo.where("is_anomaly").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    labels = F.concat_ws(",", *(F.when(F.col(d) > high, F.lit(f"{n} elevated")).when(F.col(d) < -high, F.lit(f"{n} missing")) for n, d in zip(names, deltas)))
    return grouped.withColumn("label", labels)


def common_relations(a: Column, b: Column) -> Column:
    """Alive (line, key) pairs that two arrays of edges share."""
    return F.array_intersect(a, b)


def cohort(geo: DataFrame, key: str, names: list[str], deltas: list[str], reference, theta: float, connected: DataFrame, pool: int = 100, top: int = 10) -> DataFrame:
    """Entities like the reference that are not connected to it: closeness, shared witnesses and rank, weighted."""
    near = nearest(geo, key, deltas, reference, pool)
    point = geo.where(F.col(key) == reference).select(X.witness_set([F.col(d) for d in deltas], names, theta).alias("w")).first()
    own = F.array(*map(F.lit, point["w"])) if point["w"] else F.array().cast("array<string>")
    free = near.join(connected.select(F.col(connected.columns[0]).alias(key)), key, "left_anti")
    witness = X.jaccard(X.witness_set([F.col(d) for d in deltas], names, theta), own)
    similarity = F.exp(-F.col("distance") / max(theta, 1e-9))
    scored = free.select(key, "distance", X.link_score(similarity, witness, None, F.col("delta_rank_pct") / 100).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(top)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def bm25(points: DataFrame, key: str, columns: list[str], query: str, limit: int | None = 20) -> DataFrame:
    """(key, score) of the rows that hold a term of the query, by BM25 over the columns' joined text.

    Documents are reduced to the query's terms before anything is shuffled; a hot term costs one row a document.
    """
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    rows = points.select(key, tokens(F.concat_ws(" ", *columns)).alias("tokens"))

    def uses(word: str) -> Column:
        return F.size(F.filter("tokens", lambda t: t == word))

    sized = rows.select(key, F.size("tokens").alias("dl"), *(uses(w).alias(f"t{i}") for i, w in enumerate(terms)))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    joined = sized.join(F.broadcast(stats))
    parts = []
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"t{i}")
        parts.append(idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))))
    scored = joined.select(key, X.total(parts).alias("score")).where("score > 0") if parts else joined.select(key, F.lit(0.0).alias("score")).limit(0)
    return scored if limit is None else scored.orderBy(F.desc("score"), key).limit(limit)


def hybrid(near: DataFrame, text: DataFrame, key: str, alpha: float = 0.7, top: int = 10) -> DataFrame:
    """Candidates of a vector search (key, distance) and a text search (key, score), by a weighted sum of both."""
    joined = near.select(key, "distance").join(text.select(key, F.col("score").alias("bm25")), key, "full")
    largest = joined.agg(F.max("distance").alias("max_d"), F.max("bm25").alias("max_s"))
    vector = F.coalesce(F.when(F.col("max_d") > 0, 1 - F.col("distance") / F.col("max_d")).otherwise(F.when(F.col("distance").isNotNull(), 1.0)), F.lit(0.0))
    words = F.coalesce(F.when(F.col("max_s") > 0, F.col("bm25") / F.col("max_s")), F.lit(0.0))
    scored = joined.join(F.broadcast(largest)).select(key, F.round(vector, 4).alias("vector_score"), F.round(words, 4).alias("text_score"), F.round(alpha * vector + (1 - alpha) * words, 4).alias("final_score"))
    return scored.orderBy(F.desc("final_score"), key).limit(top)


def contaminated(geo: DataFrame, key: str, deltas: list[str], k: int = 10, sample: int = 20, threshold: float = 0.5) -> DataFrame:
    """Normal neighbours of a hash-ordered sample of anomalies whose own neighbours are mostly anomalous."""
    seeds = geo.where("is_anomaly").orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(sample)
    around = neighbours_of(geo, seeds, key, deltas, k).select(F.col(key)).distinct()
    suspects = geo.where("not is_anomaly").join(around, key, "left_semi")
    shares = neighbours_of(geo, suspects, key, deltas, k).join(geo.select(key, "is_anomaly"), key).groupBy(F.col("query").alias(key)).agg(F.avg(F.col("is_anomaly").cast("int")).alias("contamination"))
    return shares.where(F.col("contamination") >= threshold)


def hub_concentration(geo: DataFrame, hubs: DataFrame, key: str, deltas: list[str], k: int = 10, least: float = 0.5) -> DataFrame:
    """Hubs with the share of anomalous entities among their nearest, where it is at least `least`."""
    own = geo.join(hubs.select(key), key, "left_semi")
    shares = neighbours_of(geo, own, key, deltas, k).join(geo.select(key, "is_anomaly"), key).groupBy(F.col("query").alias(key)).agg(F.avg(F.col("is_anomaly").cast("int")).alias("anomalous_share"))
    return shares.where(F.col("anomalous_share") >= least)


def explanation_chain(geo: DataFrame, key: str, deltas: list[str], reference, hops: int = 3) -> list:
    """Keys met by going on to the nearest anomaly not met yet, `hops` times at most."""
    met = [reference]
    for _ in range(hops):
        row = nearest(geo, key, deltas, met[-1], 1, F.col("is_anomaly") & ~F.col(key).isin(met)).first()
        if row is None:
            break
        met.append(row[key])
    return met


def explain(geo: DataFrame, key: str, names: list[str], deltas: list[str]) -> DataFrame:
    """Of every anomaly: severity, witnesses, repair set, driving dimensions and conformal p-value."""
    columns = [F.col(d) for d in deltas]
    return geo.where("is_anomaly").select(
        key, X.severity(F.col("norm"), F.col("theta")).alias("severity"), X.witness_set(columns, names, F.col("theta")).alias("witness"), X.repair_set(columns, names, F.col("theta")).alias("repair"),
        X.driving_dimensions(columns, names).alias("driving"), "conformal_p",
    )


def false_positive_stability(geo: DataFrame, jitter: float = 0.05) -> DataFrame:
    """Chance that an entity keeps its flag if theta moves uniformly by up to +-jitter, and a band for it."""
    ratio = F.col("norm") / F.col("theta")
    above = F.least(F.greatest((ratio - (1 - jitter)) / (2 * jitter), F.lit(0.0)), F.lit(1.0))
    stability = F.when(F.col("is_anomaly"), above).otherwise(1 - above)
    return geo.withColumn("stability", stability).withColumn("band", F.when(F.col("stability") > 0.8, "stable").when(F.col("stability") > 0.4, "borderline").otherwise("unstable"))
