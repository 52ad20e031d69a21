"""Near-duplicate detection: SimHash fingerprints, a grid over segment popcounts, exact Hamming distances.

A fingerprint's 64 bits are cut into segments; the vector of the segments' bit counts moves by at most one per
flipped bit, so the Manhattan distance of two vectors is a lower bound of the Hamming distance. Two grid points at
Manhattan distance two or less have a common neighbour at distance one or less of both, within the box they span.
Posting each fingerprint at its own cell and at the cells one step away therefore brings together every pair that
may link, by equality of cells; what meets in a cell is then compared exactly.

Null and empty texts have fingerprint zero and link like any other. Equal texts have one fingerprint and are one row
from the second step on, so a group of copies, however large, costs one posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise, planned_partitions, text_parts, utf8
from orrery.llm.components import components

BITS = 64
SEGMENTS = 16
SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
#: Shingles hashed at a time, which bounds memory on very long texts.
CHUNK = 1 << 16
#: Bytes of distinct fingerprints whose postings one task makes.
DISTINCT_BYTES = 1 << 20
#: Longer runs of a cell are linked through common neighbours, which is linear, and not pair by pair.
LONG_RUN = 64


def simhash64(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text; a bit is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and blanks U+0020, U+0009 to U+000D
    if not words:
        return 0
    total = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, CHUNK):
        part = words[start : start + CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_parts(batches):
        found = np.fromiter((simhash64(text or b"") for text in utf8(part.column(1))), dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def grid_cells(fp: Column, segments: int = SEGMENTS) -> Column:
    """The fingerprint's cell and the cells one step away, packed with equal widths per coordinate."""
    width = BITS // segments
    coordinate = (width + 1).bit_length()
    cell, cells = F.lit(0).cast("long"), []
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long") for i in range(segments)]
    for i, count in enumerate(counts):
        cell = cell + F.shiftleft(count, coordinate * i)
    for i, count in enumerate(counts):
        step = F.lit(1 << coordinate * i).cast("long")
        cells += [F.when(count < width, cell + step), F.when(count > 0, cell - step)]
    return F.array_compact(F.array(cell, *cells))


def _linked(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal cells; rows are sorted by cell. Complete for connectivity."""
    firsts, seconds = [], []
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    lengths = np.diff(np.r_[starts, len(cell)])
    for start, length in zip(starts[lengths > LONG_RUN], lengths[lengths > LONG_RUN]):
        a, b = ball_links(fp[start : start + length], distance)
        firsts.append(a)
        seconds.append(b)
    short = np.repeat((lengths > 1) & (lengths <= LONG_RUN), lengths)
    cell, fp = cell[short], fp[short]
    for shift in range(1, LONG_RUN):
        same = cell[shift:] == cell[:-shift]
        if not same.any():
            break
        a, b = fp[:-shift][same], fp[shift:][same]
        near = np.bitwise_count(a ^ b) <= distance
        firsts.append(a[near])
        seconds.append(b[near])
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return join(firsts), join(seconds)


def ball_links(fp: np.ndarray, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most `distance` bits (0 to 2) that keep components, without pairs: rows meet at one-bit neighbours.

    Two rows at distance two or less have a neighbour in common; at distance one, one of them is the other's neighbour.
    """
    masks = np.r_[np.uint64(0), np.uint64(1) << np.arange(BITS, dtype=np.uint64)]
    if distance == 0:
        masks = masks[:1]
    meeting = (fp[:, None] ^ masks).ravel()
    owner, itself = np.repeat(fp, len(masks)), np.tile(masks == 0, len(fp))
    order = np.lexsort((~itself, meeting))
    meeting, owner, itself = meeting[order], owner[order], itself[order]
    same = meeting[1:] == meeting[:-1]
    if distance == 1:
        first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(meeting)), 0))
        with_itself = itself[first[1:]] & same
        return owner[first[1:]][with_itself], owner[1:][with_itself]
    return owner[:-1][same], owner[1:][same]


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that a spanning forest needs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
    for x, y in pairs.tolist():
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp) sorted by cell, in any batches; the last cell of a batch waits for its rest."""
    cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(until: int) -> pa.RecordBatch:
        kept = np.array(spanning(*_linked(cell[:until], fp[:until], distance)), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["u", "v"])

    for batch in batches:
        cell = np.r_[cell, batch.column(0).to_numpy()]
        fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
        if len(cell) < CHUNK:
            continue
        until = int(np.searchsorted(cell, cell[-1]))
        yield out(until)
        cell, fp = cell[until:], fp[until:]
    if len(cell):
        yield out(len(cell))


def fingerprint_links(distinct: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(u, v): links between distinct fingerprints that keep the components of all links of at most `distance` bits."""
    if distance > 2:
        raise ValueError("the grid's one-step postings cover distances up to 2")
    # Each row becomes some 30 postings of 16 bytes, so rows are dealt out first.
    distinct = distinct.repartition(planned_partitions(distinct, DISTINCT_BYTES), "fp")
    postings = distinct.select(F.explode(grid_cells(F.col("fp"), segments)).alias("cell"), "fp")
    dealt = postings.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, distance), "u long, v long").distinct()


def component_ids(marked: DataFrame, smallest: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of the rows of `marked` (doc_id, fp): the smallest doc_id that links between fps reach."""
    roots = components(links)
    rooted = smallest.join(roots, smallest.fp == roots.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of two or fewer differing bits reach.

    Rows with a null doc_id get a component too, but never name one; repeats of one doc_id are separate rows. An empty table gives no rows. Columns other
    than doc_id and text are ignored.
    """
    marked = materialise(fingerprints(docs))
    smallest = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    return component_ids(marked, smallest, fingerprint_links(smallest.select("fp")))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every row of `documents`."""
    from orrery.llm.common import table

    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each component of similar texts, that of the smallest doc_id; columns unchanged.

    Candidates come from the fingerprints' grid and, for pairs further apart than its two bits, from MinHash bands; an
    exact comparison decides (similar_texts.py).

    Of rows that share this doc_id, the one with the least text stays, and of equal texts the least hash of what columns
    can be hashed, so the result does not differ between runs. Rows without a doc_id all stay.
    """
    from orrery.llm.similar_texts import similar_text_components

    named = docs.where(docs["doc_id"].isNotNull())
    kept = similar_text_components(named).where("doc_id = component_id").select(F.col("component_id").alias("__kept")).distinct()
    hashed = [docs[f.name] for f in docs.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    # Partial aggregation, so rows that share a doc_id, however many, do not meet in one task.
    rows = named.join(kept, named["doc_id"].cast("long") == kept["__kept"], "left_semi").select(named["doc_id"].alias("__id"), F.struct(*(named[c] for c in docs.columns)).alias("__row"), named["text"].alias("__text"), F.xxhash64(*hashed).alias("__hash"))
    one = rows.groupBy("__id").agg(F.min_by("__row", F.struct("__text", "__hash")).alias("__row")).select("__row.*")
    return one.unionByName(docs.where(docs["doc_id"].isNull()))
