"""Texts as sequences of distinct chunks, by Arrow and numpy instead of a loop over words.

A text is cut where no rule of byte-level BPE vocabularies reaches across: before a blank of ASCII that stands behind
a character that is no blank, or before one; and between a letter of ASCII and a mark that closes words. What such a
chunk encodes to does not depend on its neighbours, so each distinct chunk is worked on once and everything else is a
gather.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ASCII blanks, last bytes that a blank beyond ASCII may have in UTF-8, and first bytes of such blanks.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
LAST_BYTES = (*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)
FIRST_BYTES = (0xC2, 0xE1, 0xE2, 0xE3)
# Letters of ASCII, and marks that close words and that no special token holds.
LETTERS = (*range(0x41, 0x5B), *range(0x61, 0x7B))
CLOSING = tuple(b"!\"),.:;?")


# Bits of a byte's class in `chunked`: a blank; after which, or before which, a blank of ASCII may be one of several; and the two above.
IS_BLANK, OPEN_LEFT, OPEN_RIGHT, IS_CLOSING, IS_LETTER = 1, 2, 4, 8, 16


def _classes() -> bytes:
    table = np.zeros(256, np.uint8)
    for bit, members in ((IS_BLANK, BLANKS), (OPEN_LEFT, BLANKS + LAST_BYTES), (OPEN_RIGHT, BLANKS + FIRST_BYTES), (IS_CLOSING, CLOSING), (IS_LETTER, LETTERS)):
        table[list(members)] |= bit
    return table.tobytes()


_CLASSES = _classes()
#: Chunks that are looked up at a time, whose arrays stay in the processor's cache.
PART = 1 << 16

# Classes of bytes in plain chunks: others, blanks that may stand first, letters (of ASCII, or from U+00C0 to U+00FF), digits, marks.
OTHER, BLANK, LETTER, DIGIT, MARK = range(5)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PlainPieces:
    """Pieces of plain chunks by numpy, so that a byte-level BPE library only merges and its regular expression has no work.

    A plain chunk is a blank or none, then letters, digits and marks of few classes without apostrophes and without what a
    special token begins with. The rule of such vocabularies cuts it where the class changes, and after a first line end;
    a first space goes with what follows. `file` is the vocabulary's JSON; `fits` says whether it has that rule.
    """

    def __init__(self, file: bytes):
        spec = json.loads(file)
        pre, model, characters = spec.get("pre_tokenizer") or {}, spec["model"], byte_characters()
        self.fits = (
            not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and all(c in model["vocab"] for c in characters)
        )
        if not self.fits:
            return
        self.points = np.array([ord(c) for c in characters], "<u4")
        self.sizes = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]), np.int64)
        for token, i in model["vocab"].items():
            self.sizes[i] = len(token)
        self.kinds = np.full(256, OTHER, np.uint8)
        for kind, members in ((MARK, b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'), (DIGIT, b"0123456789"), (LETTER, LETTERS), (LETTER, (0xC3, *range(0x80, 0xC0))), (BLANK, b" \n")):
            self.kinds[list(members)] = kind
        # The multiplication and division signs are no letters; bytes that lead other characters than U+00C0 to U+00FF are OTHER.
        self.kinds[[0x97, 0xB7, *(t["content"].encode()[0] for t in spec["added_tokens"])]] = OTHER

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which chunks (none empty) are plain."""
        kinds = self.kinds[data]
        odd = kinds <= BLANK
        odd[offsets[:-1]] = kinds[offsets[:-1]] == OTHER
        return np.diff(np.append(0, np.cumsum(odd))[offsets]) == 0

    def strings(self, data: np.ndarray, offsets: np.ndarray, each: int) -> list[str]:
        """The pieces of plain chunks in the characters that stand for bytes, a line each, `each` chunks a string."""
        kinds = self.kinds[data]
        cut = np.empty(len(data), bool)
        cut[1:] = (kinds[1:] != kinds[:-1]) & (data[:-1] != 0x20)
        cut[offsets[:-1]] = True
        cuts = np.flatnonzero(cut)
        lines = np.full(len(data) + len(cuts), 0x0A, "<u4")
        places = np.arange(len(data)) + np.cumsum(cut)
        lines[places] = self.points[data]
        ends = np.append(places[offsets[:-1]], len(lines))
        return [lines[ends[i] : ends[min(i + each, len(offsets) - 1)]].tobytes().decode("utf-32-le") for i in range(0, len(offsets) - 1, each)]

    def counts(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many of the ids each chunk has; ids of byte-level vocabularies stand for all bytes, and none for bytes of two pieces."""
        return np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), offsets, side="right"))


def plain_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and the offset of every text and of the end."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of bytes that follow each other."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def distinct_slices(data: np.ndarray, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct strings between neighbouring cuts of UTF-8 bytes, and for each slice the number of its string."""
    array = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(data))
    encoded = array.dictionary_encode()
    return encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy()


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The strings of these ranges of UTF-8 bytes."""
    offsets = np.append(0, np.cumsum(lengths))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[flat_ranges(starts, lengths)]))


def cut_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, where its chunks begin and the last ends, and how many chunks each text has.

    A null or empty text has none. A chunk is never longer than its text, and mostly a blank and a word.
    """
    data, offsets = plain_strings(column)
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(column), np.int64)
    kinds = np.frombuffer(data.tobytes().translate(_CLASSES), np.uint8)
    closed = np.empty(len(data), bool)  # whether the neighbour on either side is surely no blank
    closed[:-1] = kinds[1:] & OPEN_RIGHT == 0
    filled = offsets[:-1] < offsets[1:]
    closed[offsets[1:][filled] - 1] = False
    closed[1:] |= kinds[:-1] & OPEN_LEFT == 0
    cut = closed & (kinds & IS_BLANK).view(bool)
    cut[1:] |= (kinds[1:] & IS_CLOSING != 0) & (kinds[:-1] & IS_LETTER != 0)
    cut[offsets[:-1][filled]] = True
    cuts = np.flatnonzero(cut)
    return data, np.append(cuts, len(data)), np.diff(np.searchsorted(cuts, offsets))


def chunked(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of a column of texts, the number of each chunk in order, and how many chunks each text has."""
    data, cuts, counts = cut_places(column)
    if not len(data):
        return [], np.empty(0, np.int32), counts
    return *distinct_slices(data, cuts), counts


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start to start + length, one after the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return places


class ShortKeys:
    """A hash table of byte strings of 1 to SHORT bytes, with a number for each; all steps are on many strings at once.

    A string is two integers, its first 8 bytes, and the others with its length on top. It stands in the first place free
    or its own from its hash on. At most three quarters of the places are taken.
    """

    SHORT = 15
    _FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")

    def __init__(self, most: int):
        self.count, self.bits = 0, max(10, (3 * most // 2).bit_length())
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.zeros(1 << self.bits, np.int32)

    @staticmethod
    def words(data: np.ndarray) -> np.ndarray:
        """The bytes as integers, with some after the end."""
        return np.append(data, np.zeros(32 - len(data) % 8, np.uint8)).view("<u8")

    @classmethod
    def keys(cls, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, shift = starts >> 3, (starts << 3 & 63).astype(np.uint64)
        rest, one = np.uint64(63) - shift, np.uint64(1)
        middle = words.take(at + 1)
        low = (words.take(at) >> shift | middle << one << rest) & cls._FILLED.take(lengths, mode="clip")
        high = (middle >> shift | words.take(at + 2) << one << rest) & cls._FILLED.take(lengths - 8, mode="clip")
        return low, high | lengths.astype(np.uint64) << np.uint64(56)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, or -1, and its place or the free one where it would stand."""
        mixed = (low ^ low >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        places = (mixed >> np.uint64(64 - self.bits)).view(np.int64)
        there = self.high.take(places)
        same = (there == high) & (self.low.take(places) == low)
        numbers = self.numbers.take(places)
        numbers[~same] = -1
        left = np.flatnonzero(~same & (there != 0))
        while len(left):
            places[left] = at = places[left] + 1 & len(self.low) - 1
            there = self.high.take(at)
            same = (there == high.take(left)) & (self.low.take(at) == low.take(left))
            numbers[left[same]] = self.numbers.take(at[same])
            left = left[~same & (there != 0)]
        return numbers, places

    def add(self, low: np.ndarray, high: np.ndarray, places: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys that are not there, with places from `find`, get numbers from `first` on; gives one position of each
        distinct key, in the order of its number, and the number of every key."""
        if 4 * (self.count + len(low)) > 3 * len(self.low):
            held = np.flatnonzero(self.high)
            old = self.low[held], self.high[held], self.numbers[held]
            self.__init__(self.count + len(low))
            _, at = self.find(*old[:2])
            won, _ = self.add(*old[:2], at, 0)
            self.numbers[at[won]] = old[2][won]
            _, places = self.find(low, high)
        left, chosen = np.arange(len(low)), [np.empty(0, np.int64)]
        while len(left):
            # Of keys that meet at a free place, one takes it; the others look whether it is theirs, and else go on.
            own = left[self.high.take(places.take(left)) == 0]
            at = places.take(own)
            self.numbers[at] = own
            own = own[self.numbers.take(at) == own]
            at = places.take(own)
            self.low[at], self.high[at] = low.take(own), high.take(own)
            chosen.append(own)
            at = places.take(left)
            left = left[(self.high.take(at) != high.take(left)) | (self.low.take(at) != low.take(left))]
            places[left] = places.take(left) + 1 & len(self.low) - 1
        chosen = np.sort(np.concatenate(chosen))
        self.numbers[places.take(chosen)] = np.arange(first, first + len(chosen))
        self.count += len(chosen)
        return chosen, self.numbers.take(places).astype(np.int64)


class ChunkTable:
    """What chunks encode to, as ranges of one array; begins anew when it holds more than `most` chunks.

    `encode` gives the lengths and, joined, the codes of an array of chunks. Row 0 holds `first`.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype, most: int, first: tuple[int, ...] = ()):
        self.encode, self.dtype, self.most, self.first = encode, np.dtype(dtype), most, first
        self.clear()

    def clear(self) -> None:
        self.short, self.long = ShortKeys(self.most), {}
        self.count = 1
        self.codes, self.offsets = np.empty(1 << 16, self.dtype), np.zeros(1 << 16, np.int64)
        self.codes[: len(self.first)] = self.first
        self.offsets[1] = len(self.first)

    def append(self, chunks: pa.Array) -> None:
        lengths, codes = self.encode(chunks)
        begin, upto = int(self.offsets[self.count]), self.count + len(lengths)
        if upto >= len(self.offsets):
            self.offsets = np.append(self.offsets, np.empty(upto, np.int64))
        if begin + len(codes) > len(self.codes):
            self.codes = np.append(self.codes, np.empty(begin + len(codes), self.dtype))
        self.offsets[self.count + 1 : upto + 1] = begin + np.cumsum(lengths)
        self.codes[begin : begin + len(codes)] = codes
        self.count = upto

    def rows_of(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Rows of the chunks between neighbouring cuts; row i is codes[offsets[i] : offsets[i + 1]]."""
        if self.count > self.most:
            self.clear()
        rows, words = np.empty(len(cuts) - 1, np.int64), ShortKeys.words(data)
        for start in range(0, len(rows), PART):
            own = slice(start, start + PART)
            self.fill(data, words, cuts[start : start + PART + 1], rows[own])
        return rows

    def fill(self, data: np.ndarray, words: np.ndarray, cuts: np.ndarray, rows: np.ndarray) -> None:
        starts, lengths = cuts[:-1], np.diff(cuts)
        long = np.flatnonzero(lengths > ShortKeys.SHORT)
        # Long ones are looked up by what they begin with, and rightly below.
        low, high = ShortKeys.keys(words, starts, lengths)
        numbers, places = self.short.find(low, high)
        missing = np.flatnonzero((numbers < 0) & (lengths <= ShortKeys.SHORT))
        rows[:] = numbers
        if len(missing):
            first = self.count
            chosen, rows[missing] = self.short.add(low[missing], high[missing], places[missing], first)
            self.append(strings(data, starts[missing[chosen]], lengths[missing[chosen]]))
        if len(long):
            encoded = strings(data, starts[long], lengths[long]).dictionary_encode()
            distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if new := [c for c in distinct if c not in self.long]:
                first = self.count
                self.append(pa.array(new, pa.large_string()))
                self.long.update(zip(new, range(first, first + len(new))))
            rows[long] = np.fromiter(map(self.long.__getitem__, distinct), np.int64, len(distinct))[encoded.indices.to_numpy()]

    def sizes(self, column: pa.Array) -> np.ndarray:
        """How many codes each text has."""
        data, cuts, counts = cut_places(column)
        rows = self.rows_of(data, cuts)
        lengths = self.offsets.take(rows + 1) - self.offsets.take(rows)
        total, ends = np.append(0, np.cumsum(lengths)), np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def texts(self, column: pa.Array, closing: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts, joined, and the length of each; with `closing`, row 0 stands at each text's end."""
        data, cuts, counts = cut_places(column)
        rows = self.rows_of(data, cuts)
        if closing:
            rows, counts = np.insert(rows, np.cumsum(counts), 0), counts + 1
        starts, ends = self.offsets.take(rows), np.cumsum(counts)
        lengths = self.offsets.take(rows + 1) - starts
        total = np.append(0, np.cumsum(lengths))
        return self.codes.take(flat_ranges(starts, lengths)), total[ends] - total[ends - counts]
