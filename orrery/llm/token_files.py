"""Token-id files: adaptive context mixing over order-0 to order-2 predictions drives a range coder in blocks.

A block of BLOCK ids starts from an empty model, has its own length and CRC-32 and can be read alone. For each id the
order-2 context, or else the order-1 context, names a candidate. Three models give the log odds that it comes: order 2
and order 1 by how often their contexts were right of late, order 0 by the candidate's count in the block, as of the last of
the places in HISTORY and with its hits since. Their sum is the mixed prediction, and all three learn from its error at every id. The rest of the range is shared by the ids that
the block held up to that place, by their order-0 counts, and by new ids, which are coded digit by digit. One narrowing of the interval thus codes an id by all three orders. All arithmetic is on integers.

Blocks do not depend on each other, so up to LANES of them are coded in lockstep, a vector operation doing one step
of all of them. The working memory is that of LANES models, whatever the input.

File format. A record holds the documents of a group in order: "OTF3", four little-endian uint32 (documents, blocks,
ids, bytes of an id: 2 or 4), per document an int64 doc_id, a uint8 that is 1 where it is null and a uint32 number of
ids, per block three uint32 (ids, words, CRC-32 of the ids as little-endian integers), then the blocks' words (uint32).
Records are rows of a table, ordered by shard and group.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.bpe import VOCABULARY
from orrery.llm.chunks import ChunkTable, PlainPieces, binary, plain_strings
from orrery.llm.common import materialise, planned_partitions, shipped_file, text_parts, tokenizer_path, worker_state

MAGIC = b"OTF3"
BLOCK = 2048
LANES = 2560
END = 2
#: Ids of a group, after which the next document starts another.
GROUP = 3 * BLOCK * LANES
#: Distinct chunks that a worker remembers, and bytes of text and chunks that are worked on at a time.
REMEMBERED = 1_200_000
TEXT_BYTES = 512 << 10
ENCODED = 8192
#: Chunks of plain pieces that the library gets as one string.
JOINED = 512
#: Bytes of the plan's estimate that a range of documents is to have, and groups whose starts are broadcast at most.
RANGE_BYTES = 6 << 20
BROADCAST_GROUPS = 500_000

#: Places of a block at which the order-0 counts are taken anew; up to the next power of two is left for new ids.
HISTORY = (24, 48, 112, 224, 448, 896)
SLOT_BITS, WAY_BITS = 9, 2
WIDTH_BITS, SQUASH_BITS, RATE = 20, 12, 4
ONE = 1 << WIDTH_BITS
#: Widths of intervals stay between LEAST and 2^63, so that 32 bits and a carry are above the KEPT low ones.
KEPT_BITS = 31
LEAST, KEPT, KEPT_SHIFT, WORD, WIDTH = (np.uint64(x) for x in (1 << KEPT_BITS, (1 << KEPT_BITS) - 1, KEPT_BITS, 32, WIDTH_BITS))
DIGIT, DIGITS, WHOLE, ERROR_SHIFT, UNIT = (np.uint64(x) for x in (16, 0xFFFF, ONE, WIDTH_BITS - SQUASH_BITS, 1))
#: Chance, of ONE, of log odds of 1/256 from -8 to 8. The rest has a part for each slot of the history.
SQUASH = np.array([round(ONE * max(1 / 1024, min(1 - 1 / 256, 1 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], dtype=np.uint64)
#: Log odds that each lane begins with: by order 2's state (4), order 1's state and whether it agrees (8), the candidate's count (16).
START = np.array([-200, -100, 200, 400] + [-200, -200, -100, 0, 0, 200, 100, 300] + [-300 + 20 * n for n in range(16)], dtype=np.int32)
#: An id in the history: the id, its count up to MOST, its first slot and its number of slots. Counts in the tables go up to MOST + 1.
ID_AT, COUNT_AT, START_AT, FIELD, MOST = 32, 26, 16, (1 << 10) - 1, 14
#: Columns added to tables of blocks, whose rows would else be a power of two apart, all in a few sets of the processor's cache.
PAD = 32


class Encoder:
    """Range encoders, one a lane. Words come out with a carry above their 32 bits; `finish` passes the carries on."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.width = np.full(lanes, 1 << 32, np.uint64)
        self.counts = np.zeros(lanes, np.uint16)
        self.lanes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def narrow(self, part: slice, add: np.ndarray, width: np.ndarray) -> None:
        """Go to the interval `add` above the one of each of the first lanes."""
        low = self.low[part]
        low += add
        self.width[part] = width
        few = np.flatnonzero(width < LEAST)
        self.move(few, low.take(few), width.take(few))

    def move(self, lanes: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Put lanes on intervals of less than LEAST, and their upper words out."""
        places = self.counts.take(lanes)
        self.counts[lanes] = places + 1
        self.lanes.append(lanes.astype(np.uint16))
        self.places.append(places)
        self.words.append(low >> KEPT_SHIFT)
        self.low[lanes] = (low & KEPT) << WORD
        self.width[lanes] = width << WORD

    def digits(self, lanes: np.ndarray, token: np.ndarray) -> None:
        """Code the last 16 bits of ids, all alike."""
        share = self.width.take(lanes) >> DIGIT
        low = self.low.take(lanes) + share * (token & 0xFFFF).astype(np.uint64)
        self.low[lanes], self.width[lanes] = low, share
        short = np.flatnonzero(share < LEAST)
        self.move(lanes.take(short), low.take(short), share.take(short))

    def finish(self) -> list[np.ndarray]:
        """The words of each lane."""
        every = np.arange(len(self.low))
        for _ in range(2):
            self.move(every, self.low, self.width)
        most = int(self.counts.max())
        words = np.zeros(len(every) * most, np.uint64)
        words[np.concatenate(self.lanes) * np.int64(most) + np.concatenate(self.places)] = np.concatenate(self.words)
        # What a lane has coded is less than one, so its first word has no carry.
        while len(carried := np.flatnonzero(words >> WORD)):
            words[carried] &= np.uint64((1 << 32) - 1)
            words[carried - 1] += np.uint64(1)
        return [row[:n].astype(np.uint32) for row, n in zip(words.reshape(len(every), -1), self.counts.tolist())]


class Decoder:
    """Range decoders, one a lane; `above` is how far the code lies above the interval's lower end."""

    def __init__(self, words: np.ndarray):
        self.width = np.full(len(words), 1 << 32, np.uint64)
        self.above = words[:, 0].astype(np.uint64) << KEPT_SHIFT | words[:, 1] >> 1
        # The words as they come in: KEPT_BITS of the first two are there, so each is a bit of one and the others of the next.
        self.feed = (words[:, 1:-1] << 31 | words[:, 2:] >> 1).ravel()
        self.at = np.arange(len(words)) * (words.shape[1] - 2)

    def narrow(self, part: slice, add: np.ndarray, width: np.ndarray) -> None:
        self.above[part] -= add
        self.width[part] = width
        few = np.flatnonzero(width < LEAST)
        self.move(few, width.take(few))

    def move(self, lanes: np.ndarray, width: np.ndarray) -> None:
        at = self.at.take(lanes)
        self.above[lanes] = self.above.take(lanes) << WORD | self.feed.take(at, mode="clip")
        self.at[lanes] = at + 1
        self.width[lanes] = width << WORD

    def digits(self, lanes: np.ndarray, token: None) -> np.ndarray:
        share, above = self.width.take(lanes) >> DIGIT, self.above.take(lanes)
        own = np.minimum(above // share, DIGITS)
        self.above[lanes], self.width[lanes] = above - share * own, share
        short = np.flatnonzero(share < LEAST)
        self.move(lanes.take(short), share.take(short))
        return own.view(np.int64)


class Models:
    """The adaptive models of all lanes, and one step of coding."""

    def __init__(self, lanes: int, coder: Encoder | Decoder, digits: int):
        self.coder, self.digits = coder, digits
        self.decoding = isinstance(coder, Decoder)
        self.lane = np.arange(lanes)
        self.entries = np.int32 if digits == 1 else np.int64
        # The slot of the last id has order 1 first and then order 2 by the id before it, all in one line of the processor's cache.
        self.orders = np.zeros(lanes << SLOT_BITS + WAY_BITS, self.entries)
        self.base = self.lane << SLOT_BITS + WAY_BITS
        self.way = np.ones(lanes, np.int64)
        self.slot1, self.slot2 = self.base.copy(), self.base + 1
        self.odds = np.tile(START, lanes)
        self.parts = np.array([[0], [4], [12]]) + self.lane * len(START)

    def history(self, ids: np.ndarray, after: np.ndarray | None = None) -> None:
        """Take the order-0 counts of the ids so far (lanes x places): a row of slots a lane for decoding, and for coding
        what the ids `after` them, up to the next time, have there."""
        lanes, self.known = ids.shape
        self.bits = np.uint64(self.known.bit_length())
        if self.decoding:
            # Each of a lane's slots, and one for new ids.
            self.place = self.lane * (self.known + 1)
            slots = np.full((lanes, self.known + 1), self.known << START_AT)
            for start in range(0, lanes if self.known else 0, PAD):
                slots[start : start + PAD, :-1] = np.repeat(*self.entries_of(ids[start : start + PAD])[1:]).reshape(-1, self.known)
            self.slots = slots.ravel()
            return
        self.coming = np.full(after.shape[::-1], self.known << START_AT, np.int32)
        if not self.known:
            return
        # Some lanes at a time, whose index stays in the processor's cache. Of ids that meet in a cell, the last stays; the others are coded as new ones.
        cells = 2 << self.known.bit_length()
        for start in range(0, lanes, PAD):
            row, entry, _ = self.entries_of(ids[start : start + PAD])
            index = np.full(min(PAD, lanes - start) * cells, -1)
            index[row * cells + cell(entry >> ID_AT, cells)] = entry
            own = after[start : start + PAD].astype(np.int64)
            kept = index.take(cell(own, cells) + np.arange(0, len(index), cells)[:, None])
            there = kept >> ID_AT == own
            self.coming[:, start : start + PAD] = ((kept & (1 << ID_AT) - 1) * there + ~there * (self.known << START_AT)).T

    @staticmethod
    def entries_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, entry and number of slots of each row's distinct ids, in order."""
        known = ids.shape[1]
        ordered = np.sort(ids, axis=1).ravel()
        first = np.empty(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        first[::known] = True
        starts = np.flatnonzero(first)
        widths = np.diff(starts, append=len(ordered))
        row = starts // known
        return row, ordered[starts].astype(np.int64) << ID_AT | np.minimum(widths, MOST) << COUNT_AT | starts - row * known << START_AT | widths, widths

    def step(self, active: int, token: np.ndarray | None, kept: np.ndarray | None = None) -> np.ndarray:
        """Code the next id of the first `active` lanes: `token`, which has `kept` in the history, or decode it.

        Choices are made by arithmetic, as branches on what came would be mispredicted.
        """
        coder, part = self.coder, slice(0, active)
        slot1, slot2, way = self.slot1[part], self.slot2[part], self.way[part]
        # An entry: the id that came last, its count then, and 0 if there is none yet, else how often it was right, from 1 to 3.
        entry1, entry2 = self.orders.take(slot1), self.orders.take(slot2)
        sure1, sure2 = entry1 & 3, entry2 & 3
        entry = entry1 * (entry2 == 0)
        entry += entry2
        last1, last2, guess = entry1 >> 6, entry2 >> 6, entry >> 6
        count = entry >> 2
        count &= 15
        at = np.empty((3, active), np.int64)
        np.add(self.parts[0, part], sure2, out=at[0])
        np.add(self.parts[1, part], (sure1 << 1) + (last1 == guess), out=at[1])
        np.add(self.parts[2, part], count, out=at[2])
        odds = self.odds.take(at)
        chance = SQUASH.take(odds[0] + odds[1] + odds[2] + 2048, mode="clip")

        # The interval is the candidate's part, then a part for each slot of the history, then that of new ids.
        share = coder.width[part] >> WIDTH
        edge = share * chance
        each = WHOLE - chance
        each >>= self.bits
        each *= share
        if token is None:
            above = coder.above[part]
            hit = above < edge
            slot = above - edge
            slot //= each
            kept = self.slots.take(self.place[part] + np.minimum(slot, np.uint64(self.known), out=slot).view(np.int64))
            found, kept = (kept >> ID_AT).astype(self.entries), kept.astype(np.int32)
            own = hit.astype(np.int32)
            found += (guess - found) * own
        else:
            found, hit = token, guess == token
            own = hit.astype(np.int32)
        hits = own.astype(np.uint64)
        size = (kept & FIELD).astype(np.uint64)
        size *= each
        size += (edge - size) * hits
        add = (kept >> START_AT & FIELD).astype(np.uint64)
        add *= each
        add += edge
        add *= hits ^ UNIT
        new = np.flatnonzero(size == 0)
        if len(new):
            # The first digit of new ids, all alike, is coded at once: a part of at least 2^20 has room for 2^16.
            begin = add.take(new)
            each = share.take(new) * WHOLE - begin >> DIGIT
            if token is None:
                top = np.minimum((above.take(new) - begin) // each, DIGITS)
            else:
                top = (token.take(new) >> 16 * (self.digits - 1)).astype(np.uint64) & DIGITS
            add[new], size[new] = begin + each * top, each
        coder.narrow(part, add, size)
        if len(new):
            if self.digits > 1:
                low = coder.digits(new, None if token is None else token.take(new))
            if token is None:
                found[new] = top if self.digits == 1 else top.view(np.int64) << 16 | low

        error = own << SQUASH_BITS
        error -= (chance >> ERROR_SHIFT).astype(np.int32)
        error >>= RATE
        odds += error
        self.odds[at.ravel()] = odds.ravel()
        seen = kept >> COUNT_AT
        seen &= 15
        seen += (np.minimum(count, MOST) - seen) * own
        entry = found << 4
        entry += seen
        entry += 1
        entry <<= 2
        self.orders[slot1] = entry + np.minimum((last1 == found) * sure1 + 1, 3)
        self.orders[slot2] = entry + np.minimum((last2 == found) * sure2 + 1, 3)
        now = cell(found, 1 << SLOT_BITS).astype(np.int64)
        np.add(self.base[part], now << WAY_BITS, out=slot1)
        np.add(slot1, way, out=slot2)
        now *= (1 << WAY_BITS) - 1
        now >>= SLOT_BITS
        np.add(now, 1, out=way)
        return found


def cell(ids: np.ndarray, cells: int) -> np.ndarray:
    return (ids * 40_503 >> 5) & (cells - 1)


def even_parts(count: int, most: int) -> list[slice]:
    """Slices of at most `most` that are about as long as each other."""
    parts = -(-count // most)
    each = -(-count // max(1, parts))
    return [slice(i * each, (i + 1) * each) for i in range(parts)]


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(number of ids, CRC-32, words) of each block of BLOCK ids (uint16 or uint32); the last may be shorter."""
    coded = []
    starts = range(0, len(ids), BLOCK)
    for part in even_parts(len(starts), LANES):
        blocks = [ids[s : s + BLOCK] for s in starts[part]]  # from long to short, as decoding needs
        rows = np.zeros((len(blocks), len(blocks[0]) + PAD), ids.dtype)[:, :-PAD]
        for row, block in zip(rows, blocks):
            row[: len(block)] = block
        coder = Encoder(len(blocks))
        models = Models(len(blocks), coder, ids.dtype.itemsize // 2)
        columns = rows.T
        taken = (0, *HISTORY, BLOCK)
        for t in range(len(columns)):
            if t in taken:
                begin = t
                models.history(rows[:, :t], rows[:, t : taken[taken.index(t) + 1]])
            if t % PAD == 0:
                several = columns[t : t + PAD].astype(models.entries, order="C")
            active = len(blocks) if t < len(blocks[-1]) else len(blocks) - 1
            models.step(active, several[t % PAD, :active], models.coming[t - begin, :active])
        coded += [(len(b), zlib.crc32(b.astype(b.dtype.newbyteorder("<"), copy=False).tobytes()), w) for b, w in zip(blocks, coder.finish())]
    return coded


def decode_blocks(coded: list[tuple[int, int, np.ndarray]], dtype="<u2") -> np.ndarray:
    """The ids of blocks of which only the last is shorter than the others; raises ValueError on a wrong checksum."""
    found = []
    for part in map(coded.__getitem__, even_parts(len(coded), LANES)):
        words = np.zeros((len(part), 3 + max(len(w) for _, _, w in part)), np.uint32)
        for row, (_, _, own) in zip(words, part):
            row[: len(own)] = own
        models = Models(len(part), Decoder(words), np.dtype(dtype).itemsize // 2)
        columns = np.zeros((part[0][0], len(part) + PAD), dtype)[:, :-PAD]
        for t in range(len(columns)):
            if t == 0 or t in HISTORY:
                models.history(np.ascontiguousarray(columns[:t].T))
            active = len(part) if t < part[-1][0] else len(part) - 1
            columns[t, :active] = models.step(active, None)
        rows = np.empty(columns.shape[::-1], dtype)
        for t in range(0, len(columns), PAD):
            rows[:, t : t + PAD] = columns[t : t + PAD].T
        for (n, crc, _), row in zip(part, rows):
            block = row[:n]
            if zlib.crc32(block.tobytes()) != crc:
                raise ValueError("a block's checksum is wrong")
            found.append(block)
    return np.concatenate(found) if found else np.empty(0, dtype)


DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])


def write_record(doc_ids: list[int | None], counts, ids: np.ndarray) -> bytes:
    """The record of documents whose ids (uint16 or uint32) follow each other."""
    coded = encode_blocks(ids)
    docs = np.zeros(len(doc_ids), DOCUMENT)
    docs["doc_id"], docs["null"], docs["n"] = [i or 0 for i in doc_ids], [i is None for i in doc_ids], counts
    heads = np.array([(n, len(words), crc) for n, crc, words in coded], "<u4").reshape(-1, 3)
    sizes = np.array([len(docs), len(coded), len(ids), ids.dtype.itemsize], "<u4")
    return b"".join([MAGIC, sizes.tobytes(), docs.tobytes(), heads.tobytes(), *(w.astype("<u4").tobytes() for _, _, w in coded)])


def read_record(record: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and all ids of a record."""
    if record[:4] != MAGIC:
        raise ValueError("not a token-id record")
    n_docs, n_blocks, n_ids, size = np.frombuffer(record, "<u4", 4, 4).tolist()
    docs = np.frombuffer(record, DOCUMENT, n_docs, 20)
    at = 20 + docs.nbytes
    heads = np.frombuffer(record, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    words = np.frombuffer(record, "<u4", -1, at + heads.nbytes)
    ends = np.cumsum(heads[:, 1]).tolist()
    ids = decode_blocks([(n, crc, words[end - size : end]) for (n, size, crc), end in zip(heads.tolist(), ends)], f"<u{size}")
    if len(ids) != n_ids:
        raise ValueError("a record lacks ids")
    return [None if null else i for i, null in zip(docs["doc_id"].tolist(), docs["null"].tolist())], docs["n"], ids


def chunk_table(file: bytes, end: int) -> ChunkTable:
    """What the tokenizers library gives for chunks of text; row 0 is the id `end`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    def loaded() -> Tokenizer:
        tokenizer = Tokenizer.from_str(file.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def library(coder: Tokenizer, texts: list[str]) -> tuple[list[int], list[np.ndarray]]:
        lengths, codes = [], [np.empty(0, np.uint32)]
        for start in range(0, len(texts), ENCODED):
            ids = [e.ids for e in coder.encode_batch_fast(texts[start : start + ENCODED], add_special_tokens=False)]
            lengths += map(len, ids)
            codes.append(np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids))))
        return lengths, codes

    tokenizer, pieces = loaded(), PlainPieces(file)
    if pieces.fits:
        merger = loaded()
        merger.pre_tokenizer = CharDelimiterSplit("\n")

    def encode(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not pieces.fits:
            lengths, codes = library(tokenizer, chunks.to_pylist())
            return np.array(lengths, np.int64), np.concatenate(codes)
        plain = pieces.plain(*plain_strings(chunks))
        data, offsets = plain_strings(chunks.filter(pa.array(plain)))
        codes = np.concatenate(library(merger, pieces.strings(data, offsets, JOINED))[1])
        lengths = np.empty(len(chunks), np.int64)
        lengths[plain] = pieces.counts(codes, offsets)
        if plain.all():
            return lengths, codes
        others = np.flatnonzero(~plain)
        lengths[others], other_codes = library(tokenizer, chunks.take(pa.array(others)).to_pylist())
        own = np.repeat(plain, lengths)
        joined = np.empty(len(own), np.uint32)
        joined[own], joined[~own] = codes, np.concatenate(other_codes)
        return lengths, joined

    return ChunkTable(encode, "<u2" if max(end + 1, tokenizer.get_vocab_size()) <= 1 << 16 else "<u4", REMEMBERED, (end,))


def _records(batches: Iterator[pa.RecordBatch], file, end: int) -> Iterator[pa.RecordBatch]:
    table = worker_state("chunk_ids", lambda: chunk_table(file.value, end), str(end))
    shard, group, total = TaskContext.get().partitionId(), 0, 0
    doc_ids, counts, parts = [], [], []

    def record() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        payload = write_record(doc_ids, np.concatenate(counts), ids)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([group], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "group", "n_ids", "payload"])

    for part in text_parts(batches, 1, TEXT_BYTES):
        ids, lengths = table.texts(part.column(1), closing=True)
        own, ends, done = part.column(0).to_pylist(), np.cumsum(lengths), 0
        while done < len(own):
            # up to the document that fills the group
            before = int(ends[done - 1]) if done else 0
            upto = min(len(own), int(np.searchsorted(ends, before + GROUP - total)) + 1)
            doc_ids += own[done:upto]
            counts.append(lengths[done:upto])
            parts.append(ids[before : ends[upto - 1]])
            total += int(ends[upto - 1]) - before
            done = upto
            if total >= GROUP:
                pa.default_memory_pool().release_unused()
                yield record()
                group, total, doc_ids, counts, parts = group + 1, 0, [], [], []
    if doc_ids:
        pa.default_memory_pool().release_unused()
        yield record()


def write_token_files(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """The written table (shard, group, n_ids, payload) of all documents, in ascending order of doc_id.

    Every document, also a null or empty text, ends with the id `end`. Documents are dealt out by ranges of doc_id and
    sorted in each; null doc_ids come first, and equal or null ones follow in the order of the input, over several
    ranges if they are many. An empty table gives no rows; other columns are ignored.
    """
    file = shipped_file(docs.sparkSession, vocabulary or tokenizer_path(VOCABULARY))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = planned_partitions(rows, RANGE_BYTES)
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(ranges, "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    schema = "shard int, group int, n_ids long, payload binary"
    return materialise(ranged.mapInArrow(lambda batches: _records(batches, file, end), schema))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids, counts, ids = read_record(batch.column(1)[i].as_py())
            ends = np.cumsum(counts, dtype=np.int64)
            starts = batch.column(0)[i].as_py() + ends - counts
            for a in range(0, len(doc_ids), 256):
                own, upto = slice(a, a + 256), min(a + 256, len(doc_ids))
                wide = ids[ends[a] - counts[a] : ends[upto - 1]].astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[own], pa.int64()), pa.array(starts[own]), binary(wide, 4 * counts[own].astype(np.int64))], names=["doc_id", "start", "ids"])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian uint32) of every document in the files."""
    order = Window.orderBy("shard", "group").rowsBetween(Window.unboundedPreceding, -1)
    # One row a group of some millions of ids.
    starts = materialise(files.select("shard", "group", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first")))
    small = starts.count() <= BROADCAST_GROUPS
    placed = files.select("shard", "group", "payload").join(F.broadcast(starts) if small else starts, ["shard", "group"])
    return placed.select("first", "payload").mapInArrow(_documents, "doc_id long, start long, ids binary")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the ids of every row of `documents`, read back from the written files."""
    from orrery.llm.common import table

    read = read_token_files(write_token_files(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
