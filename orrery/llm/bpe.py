"""Byte-level BPE with a segment tree over adjacent pair ranks, and decoding.

A piece's symbols are a linked list; leaf i of the tree holds (rank, i) of the pair that starts at symbol i. The root
is the leftmost pair of the lowest rank. A merge changes three leaves, each in a logarithmic number of steps, so a
piece of n bytes costs O(n log n), and very long pieces (runs of one letter, encoded blobs) stay cheap.

Merges never cross pieces, and pieces never cross the cuts between chunks, so each distinct chunk is encoded once by a
worker that remembers it, and texts are gathered from there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.chunks import ChunkTable, binary, byte_characters, flat_ranges
from orrery.llm.common import RecentCache, shipped_file, text_parts, tokenizer_path, utf8, worker_state

#: Unicode White_Space, as the content of a character class.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
VOCABULARY = "byte_bpe_50k.json"
#: Chunks in a worker's memory, entries of each of the two generations of pieces, and bytes of text worked on at a time.
REMEMBERED = 700_000
PIECES = 100_000
TEXT_BYTES = 8 << 20
NONE = 1 << 62
POSITION = (1 << 32) - 1


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, file: bytes):
        import regex

        spec = json.loads(file)
        vocabulary = spec["model"]["vocab"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_ids = [vocabulary[c] for c in characters]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.all_bytes, self.byte_offsets = np.frombuffer(b"".join(bytes_of), np.uint8), np.cumsum([0, *map(len, bytes_of)])
        self.find_pieces = regex.compile(PIECE).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.pieces = RecentCache(self.encode_piece, PIECES)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost among equals."""
        count = len(symbols)
        if count < 2:
            return symbols
        rank_of, merged = self.ranks.get, self.merged
        leaves = 1 << (count - 2).bit_length()
        tree = [NONE] * (2 * leaves)
        node = leaves
        for left, right in zip(symbols, symbols[1:]):
            rank = rank_of(left << 32 | right)
            if rank is not None:
                tree[node] = rank << 32 | node - leaves
            node += 1
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(node: int, left: int, right: int) -> None:
            rank = rank_of(left << 32 | right)
            value = NONE if rank is None else rank << 32 | node - leaves
            if tree[node] != value:
                tree[node] = value
                raise_from(node)

        def raise_from(node: int) -> None:
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                if a > b:
                    a = b
                if tree[node] == a:
                    return
                tree[node] = a

        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        while (best := tree[1]) != NONE:
            i = best & POSITION
            j = after[i]
            symbols[i] = symbol = merged[best >> 32]
            after[i] = k = after[j]
            if k < count:
                before[k] = i
                if tree[leaves + j] != NONE:
                    tree[leaves + j] = NONE
                    raise_from(leaves + j)
                put(leaves + i, symbol, symbols[k])
            else:
                tree[leaves + i] = NONE
                raise_from(leaves + i)
            if (h := before[i]) >= 0:
                put(leaves + h, symbols[h], symbol)
        kept, i = [], 0
        while i < count:
            kept.append(symbols[i])
            i = after[i]
        return kept

    def encode_piece(self, piece: str) -> bytes:
        return np.array(self.merge([self.byte_ids[b] for b in piece.encode()]), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; a special token's string is its id."""
        plain = lambda x: b"".join(map(self.pieces.__getitem__, self.find_pieces(x)))
        if self.split_special and any(token in text for token in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else plain(x) for i, x in enumerate(self.split_special(text)))
        return plain(text)

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids that follow each other; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.byte_offsets[ids + 1] - self.byte_offsets[ids]
        data = self.all_bytes[flat_ranges(self.byte_offsets[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(lengths))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> str:
        return self.decode_all(np.frombuffer(ids, "<u4").astype(np.int64), np.array([len(ids) // 4]))[0]


def _chunk_table(coder: ByteBPE) -> ChunkTable:
    def codes(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [coder.encode(chunk) for chunk in chunks.to_numpy(zero_copy_only=False).tolist()]
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")

    return ChunkTable(codes, "<u4", REMEMBERED)


def _encoded(batches: Iterator[pa.RecordBatch], file, decode: bool) -> Iterator[pa.RecordBatch]:
    coder = worker_state("byte_bpe", lambda: ByteBPE(file.value))
    table = worker_state("byte_bpe_chunks", lambda: _chunk_table(coder))
    for part in text_parts(batches, 1, TEXT_BYTES):
        ids, lengths = table.texts(part.column(1))
        columns = [part.column(0), binary(ids.view(np.uint8), 4 * lengths)]
        if decode:
            columns.append(pa.array(coder.decode_all(ids, lengths), pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: 2 + decode])


def encode(docs: DataFrame, vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each whole text; with `decode`, also the text
    that these ids decode to.

    A null text counts as empty and has no ids. Rows with equal doc_ids are separate; other columns are ignored. An
    empty table gives no rows. There is no shuffle: each text is encoded where it is read.
    """
    file = shipped_file(docs.sparkSession, vocabulary or tokenizer_path(VOCABULARY))
    schema = "doc_id long, ids binary" + ", decoded string" * decode
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _encoded(batches, file, decode), schema)


def _decoded(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    coder = worker_state("byte_bpe", lambda: ByteBPE(file.value))
    for part in text_parts(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array((coder.decode(x or b"") for x in utf8(part.column(1))), pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids) as encode() gives them; null ids give an empty text."""
    file = shipped_file(encoded.sparkSession, vocabulary or tokenizer_path(VOCABULARY))
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, file), "doc_id long, text string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts for every row of `documents`."""
    from orrery.llm.common import table

    done = encode(table(spark, sf_dir, "documents"), decode=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
