"""Near copies of texts: components of links of Jaccard similarity 0.8 or more between sets of five-word shingles.

A text's node is the hash of its shingle set, so texts of equal sets are one node. The first candidates come from SimHash:
each set has a fingerprint, and the grid over segment popcounts of near_duplicates.py brings together fingerprints at an
exact Hamming distance of two or less. As pairs at similarity 0.8 differ by some 10 bits, other candidates are nodes that
share all ROWS MinHash values of one of BANDS bands: a pair at similarity 0.8 shares none with a chance of 5e-8, and more
similar pairs with a smaller one. Candidates of either kind are compared exactly, by the shingle sets themselves.

With the grid's candidates every member of a bucket is compared with the bucket's least node, which is linear and joins
most of a group of near copies. In what is left, only members of different components are compared: a bucket's largest component against the
others, and those among each other, in parts of UNIT members. A large group of near copies therefore never makes pairs
within itself, and buckets of the same members are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import forget_worker_state, materialise, planned_partitions, text_parts, utf8
from orrery.llm.components import components
from orrery.llm.near_duplicates import BITS, CHUNK, DISTINCT_BYTES, component_ids, fingerprint_links

SHINGLE = 5
#: Least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
SEED = 42
#: Shingles at a time under the BANDS x ROWS hash functions.
BLOCK = 256
#: Members of a part of a bucket, where its components are compared.
UNIT = 512


def shingle_set(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; a text of fewer words is one shingle, and one without words none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a shingle set: a bit is set if it is set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[start : start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1)


def band_keys(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One key a band, of the band's number and its ROWS MinHash values."""
    import xxhash

    low, high = hashes.astype(np.uint32)[:, None], (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (low[i : i + BLOCK] * multipliers[0] + high[i : i + BLOCK] * multipliers[1]).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_worker_state()
    multipliers = _multipliers()
    for batch in text_parts(batches):
        nodes, codes, keys = [], [], []
        for text in utf8(batch.column(1)):
            hashes = shingle_set(text or b"")
            nodes.append(_node(hashes))
            codes.append(set_fingerprint(hashes))
            keys.append(band_keys(hashes, multipliers) if len(hashes) else np.empty(0, np.int64))
        nodes, codes = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, codes))
        yield pa.RecordBatch.from_arrays([batch.column(0), nodes, codes, _lists(keys)], names=["doc_id", "fp", "simhash", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_parts(batches, 0):
        for start in range(0, batch.num_rows, BLOCK):
            sets = [shingle_set(text or b"") for text in utf8(batch.column(0).slice(start, BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64)), _lists(sets)], names=["fp", "hashes"])


def similar_pairs(nodes: list[int], parts: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that keep the components of all similar pairs of different roots; of two parts, those across them."""
    lengths = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(codes.max() + 1, dtype=np.int32)
    part, label, links = np.array(parts), np.unique(np.array(roots), return_inverse=True)[1], []
    across = parts[0] != parts[-1]
    for i in range(len(nodes) - 1):
        other = label[i + 1 :] != label[i]
        if across:
            other &= part[i + 1 :] != part[i]
        if not other.any():
            continue
        own = codes[starts[i] : starts[i] + lengths[i]]
        marked[own] = 1
        common = np.add.reduceat(marked[codes[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        marked[own] = 0
        # common / (a + b - common) >= n / d, in whole numbers
        near = other & (sum(LEAST) * common >= LEAST[0] * (lengths[i] + lengths[i + 1 :]))
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((nodes[i], nodes[j]))
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, low, high, part, root, fp, hashes) sorted by unit (band, low, high) and part, in any batches."""
    unit, nodes, parts, roots, sets = None, [], [], [], []

    def out() -> pa.RecordBatch:
        found = np.array(similar_pairs(nodes, parts, roots, sets), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
        part, root, node = (batch.column(k).to_pylist() for k in (3, 4, 5))
        lists = batch.column(6)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, key in enumerate(keys):
            if key != unit:
                if len(nodes) > 1:
                    yield out()
                unit, nodes, parts, roots, sets = key, [], [], [], []
            nodes.append(node[i])
            parts.append(part[i])
            roots.append(root[i])
            sets.append(values[offsets[i] : offsets[i + 1]].copy())
    if len(nodes) > 1:
        yield out()


def grid_pairs(distinct: DataFrame) -> DataFrame:
    """(u, v): nodes (fp, simhash) whose fingerprints are equal or linked by the grid; they keep the components of all such."""
    least = materialise(distinct.groupBy("simhash").agg(F.min("fp").alias("least")))
    links = fingerprint_links(least.select(F.col("simhash").alias("fp")))
    ends = [least.select(F.col("simhash").alias(code), F.col("least").alias(node)) for code, node in (("u", "a"), ("v", "b"))]
    across = links.join(ends[0], "u").join(ends[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    within = distinct.join(least, "simhash").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return across.union(within)


def pivot_pairs(members: DataFrame) -> DataFrame:
    """(u, v): the bucket's least node and each other member, of all buckets (band, fp)."""
    least = members.groupBy("band").agg(F.min("fp").alias("u"))
    return members.join(least, "band").where("u <> fp").select("u", F.col("fp").alias("v"))


def similar_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar by their sets (fp, hashes)."""
    with_u = pairs.distinct().join(sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a")), "u")
    both = with_u.join(sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(sum(LEAST) * common >= LEAST[0] * (F.size("a") + F.size("b"))).select("u", "v")


def remaining_links(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links that keep the components of all similar pairs that share a bucket but no root (node, root)."""
    rooted = materialise(members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("band", "fp", F.coalesce("root", "fp").alias("root")))
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > F.col("top.n"))
    parts = lambda n: F.ceil(n / UNIT).cast("int")
    buckets = buckets.select("band", F.col("top.root").alias("top"), parts(F.col("top.n")).alias("p"), parts(F.col("all") - F.col("top.n")).alias("q"))
    placed = rooted.join(buckets, "band").withColumn("is_top", F.col("root") == F.col("top"))
    dealt = lambda n: F.pmod(F.xxhash64("fp", "band"), n).cast("int")
    placed = placed.withColumn("part", F.when(F.col("is_top"), dealt(F.col("p"))).otherwise(F.col("p") + dealt(F.col("q"))))
    other = F.explode(F.sequence(F.when(F.col("is_top"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)).alias("other")
    units = placed.select("band", "fp", "root", "part", other).select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "root", "fp")
    rows = units.join(sets, "fp").select("band", "low", "high", "part", "root", "fp", "hashes")
    return rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "part").mapInArrow(_links, "u long, v long").distinct()


def similar_links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(u, v): links between nodes (fp, doc_id, simhash, bands) that keep the components of all similar pairs."""
    dealt = distinct.repartition(planned_partitions(distinct, DISTINCT_BYTES), "fp")
    postings = materialise(dealt.select(F.explode("bands").alias("band"), "fp"))
    buckets = postings.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64("fp", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(2)))
    buckets = materialise(buckets.where("n > 1").groupBy("n", "s0", "s1").agg(F.min("band").alias("band")).select("band"))
    members = materialise(postings.join(buckets, "band").select("band", "fp"))
    near = materialise(grid_pairs(distinct.select("fp", "simhash")))
    met = members.select("fp").union(near.select("u")).union(near.select("v")).distinct()
    needed = materialise(distinct.join(met, "fp", "left_semi").select("fp", "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed.select("doc_id"), "doc_id", "left_semi").select("text")
    # Rows that share a doc_id may have other texts, and the smallest doc_id of two nodes may be the same.
    sets = texts.mapInArrow(_sets, "fp long, hashes array<long>").join(needed.select("fp").distinct(), "fp", "left_semi")
    sets = materialise(sets.groupBy("fp").agg(F.first("hashes").alias("hashes")))
    first = materialise(similar_of(near.union(pivot_pairs(members)), sets))
    return first.union(remaining_links(members, components(first), sets))


def similar_text_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of similar texts reach. Texts without words are alike."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures, "doc_id long, fp long, simhash long, bands array<long>")
    marked = materialise(marked)
    smallest = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands")))
    return component_ids(marked.select("doc_id", "fp"), smallest.select("fp", "doc_id"), similar_links(docs, smallest))
