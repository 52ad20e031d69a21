"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths goes to a dynamic programme that chooses at most `buckets` upper bounds so that the
padding of all rows up to their bucket's bound is least. Inside a bucket, as many rows share a batch as fit the token
budget at the bucket's bound.

The histogram has a row for each length that occurs: T tokens have less than the square root of 2 T of them, so what the
driver holds grows far slower than the input. Positions inside a bucket come from counts of small cells of rows, never
from a sort of a whole bucket, so a bucket with most of the rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.bpe import VOCABULARY
from orrery.llm.common import materialise, shipped_file, text_parts, tokenizer_path, word_array, worker_state
from orrery.llm.token_files import chunk_table

BUCKETS = 16
BUDGET = 32_768
TEXT_BYTES = 1 << 20
#: Rows of a bucket that are numbered together.
CELL_ROWS = 4096


def least_padding(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds, at most `buckets`, that make the padding of all rows least.

    `cells` are (bound, rows, sum of lengths) in ascending order. best[j], the least padding of the first j cells,
    is a lower envelope of lines in the bound of cell j, which a hull of lines finds in linear time a bucket.
    """
    count = len(cells)
    if not count:
        return []
    bounds = [c[0] for c in cells]
    rows, total = [0], [0]
    for _, n, s in cells:
        rows.append(rows[-1] + n)
        total.append(total[-1] + s)
    best = [bounds[j - 1] * rows[j] - total[j] if j else 0 for j in range(count + 1)]
    choices = [[0] * (count + 1)]
    for _ in range(1, min(buckets, count)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, cell
        at, now, choice = 0, [0] * (count + 1), [0] * (count + 1)
        for j in range(1, count + 1):
            i = j - 1
            slope, intercept = -rows[i], best[i] + total[i]
            if not hull or hull[-1][0] != slope or hull[-1][1] > intercept:
                while len(hull) >= 2:
                    (a, b, _), (c, d, _) = hull[-2], hull[-1]
                    if (intercept - b) * (a - c) <= (d - b) * (a - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, intercept, i))
            at = min(at, len(hull) - 1)
            x = bounds[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - total[j]
            choice[j] = hull[at][2]
        best = now
        choices.append(choice)
    chosen, j = [], count
    for choice in reversed(choices):
        if not j:
            break
        chosen.append(bounds[j - 1])
        j = choice[j]
    return chosen[::-1]


def pack(rows: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch and slot of every row (doc_id, n_tokens).

    Buckets count from 0 by length, batches from 0 in each bucket, slots from 0 in each batch. A row longer than the
    budget has a batch of its own; an empty one is in the first bucket. Null lengths count as 0. Repeated and null doc_ids
    are packed row by row, each in a place of its own, over many tasks; an empty table gives no rows.
    """
    rows = materialise(rows.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((length, n, length * n) for length, n in histogram.collect())  # see the module's docstring for its bound
    bounds = least_padding(cells, buckets) or [0]
    bucket, length = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        inside = F.col("n_tokens") <= bounds[i]
        bucket, length = F.when(inside, i).otherwise(bucket), F.when(inside, bounds[i]).otherwise(length)
    salts = max(1, -(-sum(c[1] for c in cells) // CELL_ROWS))
    placed = rows.select("*", bucket.cast("int").alias("bucket"), length.cast("long").alias("bucket_length"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("cell"))
    counts = placed.groupBy("bucket", "cell").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "cell", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("n_tokens", "doc_id", "row")) - 1
    numbered = placed.withColumn("own", own).join(offsets, ["bucket", "cell"]).withColumn("position", F.col("own") + F.col("offset"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("position") / capacity).cast("long").alias("batch"), (F.col("position") % capacity).cast("long").alias("slot")
    )


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and its number of words as n_tokens; null and empty texts have 0."""
    return docs.select(F.col("doc_id").cast("long"), F.size(word_array(F.col("text"))).cast("long").alias("n_tokens"))


def _token_counts(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    table = worker_state("token_counts", lambda: chunk_table(file.value, 0))
    for part in text_parts(batches, 1, TEXT_BYTES):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(table.sizes(part.column(1)))], names=["doc_id", "n_tokens"])


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens, its number of ids in a public vocabulary; null and empty texts have 0."""
    file = shipped_file(docs.sparkSession, vocabulary or tokenizer_path(VOCABULARY))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda batches: _token_counts(batches, file), "doc_id long, n_tokens long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row of `documents`, by ids of the public byte-level vocabulary."""
    from orrery.llm.common import table

    return pack(token_lengths(table(spark, sf_dir, "documents")))
