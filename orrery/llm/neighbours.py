"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest pivots in order. Each block of an index partition posts its rows in
inverted files, one a pivot, with the pivot's place in the row's order. A query adds up, over the files of its own
pivots, how far the places differ (Spearman's footrule; a pivot that a row lacks counts as place PREFIX). Rows in none
of its files are looked at only where too few others are; of those, at most the share of the block with the smallest footrule, ties
included, is ranked again by the exact cosine. All of this is alike at every size of table and block.

Queries go out in blocks of bounded size and meet every index partition where it lies, so no vector is shuffled and
no key is hot: a vector that a third of the rows repeat makes some files of a block longer, and no task larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.chunks import flat_ranges
from orrery.llm.common import materialise

PIVOTS = 1024
PREFIX = 22
#: Rows, those of the smallest hashes, that pivots are chosen from; pivots closer than ALIKE to another are left out.
PIVOT_SAMPLE = 4096
ALIKE = 0.95
#: Share of a block's rows that the exact measure ranks again at most; never less than a few times the rows wanted.
RERANKED = 0.3
FLOOR = 4
BLOCK = 8192
#: Bytes of queries broadcast at a time, about.
QUERY_BYTES = 32 << 20
NEAREST = 5
#: By how much scores of the quick product and of the exact measure may differ.
ROUNDING = 1e-9


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix of doubles."""
    rows = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, -1 if rows else 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest components near 1, so that squares neither overflow nor vanish."""
    exponents = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
    half = -exponents // 2
    return np.ldexp(np.ldexp(vectors, half), -exponents - half)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, in order, none of them nearly parallel to an earlier one."""
    sample, chosen = unit(sample), []
    for row in sample:
        if len(chosen) < most and (not chosen or (np.stack(chosen) @ row).max() < ALIKE):
            chosen.append(row)
    return np.stack(chosen)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Each row's nearest pivots in order."""
    return np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


class InvertedFiles:
    """The rows of a block, posted under their pivots with the pivots' places."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.rows, self.prefix = orders.shape
        flat = orders.ravel()
        order = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[order], np.arange(pivots + 1))
        self.starts, self.lengths = ends[:-1], np.diff(ends)
        self.row, self.place = order // self.prefix, order % self.prefix

    def footrule(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows in the files of the query's pivots, and by how much their footrule is below that of rows in none."""
        lengths = self.lengths[query]
        posted = flat_ranges(self.starts[query], lengths)
        gains = self.prefix - np.abs(self.place[posted] - np.repeat(np.arange(len(query)), lengths))
        total = np.bincount(self.row[posted], weights=gains, minlength=self.rows)
        rows = np.flatnonzero(total)
        return rows, total[rows]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The exact measure, of scaled vectors."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def search_block(ids, vectors, orders, queries, pivots: int, nearest: int, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (id, scaled vector, order), the ids and cosines of the nearest rows found, its own id left out."""
    files = InvertedFiles(orders, pivots)
    vectors = scaled(vectors)
    units = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    reranked = max(int(share * len(ids)), FLOOR * nearest)
    found = []
    for own, vector, order in zip(*queries):
        rows, gains = files.footrule(order)
        if len(rows) < FLOOR * nearest:
            rows = np.arange(len(ids))  # the rest of the block shares the largest footrule
        elif len(rows) > reranked:
            rows = rows[gains >= np.partition(gains, -reranked)[-reranked]]
        rows = rows[ids[rows] != own]
        quick = units[rows] @ (vector / np.sqrt((vector * vector).sum()))
        if len(rows) > nearest:
            near = quick >= np.partition(quick, -nearest)[-nearest] - ROUNDING
            rows = rows[near]
        scores = cosines(vectors[rows], vector)
        best = np.lexsort((ids[rows], -scores))[:nearest]
        found.append((ids[rows][best], scores[best]))
    return found


def _searched(batches: Iterator[pa.RecordBatch], sent, nearest: int, share: float) -> Iterator[pa.RecordBatch]:
    queries, pivots = sent.value
    best = [(np.empty(0, np.int64), np.empty(0)) for _ in queries[0]]
    waiting: list[tuple[np.ndarray, ...]] = []

    def work() -> None:
        ids, vectors, orders = (np.concatenate(parts) for parts in zip(*waiting))
        waiting.clear()
        for i, (rows, scores) in enumerate(search_block(ids, vectors, orders, queries, pivots, nearest, share)):
            rows, scores = np.r_[best[i][0], rows], np.r_[best[i][1], scores]
            order = np.lexsort((rows, -scores))[:nearest]
            best[i] = rows[order], scores[order]

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            waiting.append((part.column(0).to_numpy(), matrix(part.column(1)), matrix(part.column(2)).astype(np.int16)))
            if sum(len(w[0]) for w in waiting) >= BLOCK:
                work()
    if waiting:
        work()
    counts = [len(rows) for rows, _ in best]
    columns = [np.repeat(queries[0], counts), np.concatenate([b[0] for b in best] or [np.empty(0, np.int64)]), np.concatenate([b[1] for b in best] or [np.empty(0)])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, in doubles, of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))


def build_index(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The index table (vec_id, embedding, nearest pivots) of usable rows of one length, all of them, and the pivots.

    Pivots come from PIVOT_SAMPLE rows at most.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(PIVOT_SAMPLE).select("embedding").collect()
    pivots = choose_pivots(np.array([r[0] for r in sample], dtype=np.float64))
    prefix = min(PREFIX, len(pivots))

    def ordered(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                orders = permutations(matrix(part.column(1)), pivots, prefix)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, orders.size + 1, prefix, dtype=np.int32)), pa.array(orders.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column], names=["vec_id", "embedding", "nearest"])

    return materialise(rows.mapInArrow(ordered, "vec_id long, embedding array<double>, nearest array<smallint>")), pivots


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, share: float = RERANKED) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of each query's nearest rows found, ties to the smaller vec_id.

    Queries are the usable rows where `is_query` (over vec_id) holds, candidates all usable rows of another vec_id.
    Null, zero and non-finite vectors take no part; null vec_ids neither. Vectors of different lengths have no cosine:
    each length has an index of its own. Rows that repeat a vec_id are candidates one by one; of those that repeat a
    query's, the least vector is the query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable_rows(vectors)
    found = spark.createDataFrame([], schema)
    for (size,) in sorted(rows.select(F.size("embedding")).distinct().collect()):
        index, pivots = build_index(rows.where(F.size("embedding") == size))
        queries = index.where(is_query).groupBy("vec_id").agg(F.min(F.struct("embedding", "nearest")).alias("q")).select("vec_id", "q.*")
        blocks = max(1, -(-queries.count() * 8 * (size + PREFIX) // QUERY_BYTES))
        for block in range(blocks):
            # A block of the stated queries: the one thing that is gathered and broadcast.
            own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
            if own:
                arrays = (np.array([r.vec_id for r in own], np.int64), scaled(np.array([r.embedding for r in own], np.float64)), np.array([r.nearest for r in own], np.int64))
                sent = spark.sparkContext.broadcast((arrays, len(pivots)))
                found = found.union(index.mapInArrow(lambda batches, sent=sent: _searched(batches, sent, nearest, share), schema))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    # `nearest` rows a query and index partition.
    ranked = found.groupBy("query_id").agg(F.slice(best, 1, nearest).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of `embeddings` of every row whose vec_id is divisible by 50."""
    from orrery.llm.common import table

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
