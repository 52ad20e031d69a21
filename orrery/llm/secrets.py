"""Secret scans: fixed rules, and a battery of randomness tests with length-aware false-discovery control.

Beside the fixed rules, every token of an encoded look is tested against the alphabet of its inferred encoding:
chi-squared uniformity of its characters, a runs test about the alphabet's middle and the lag-1 serial correlation
of its code values. The three p-values are combined by Fisher's method. Under true randomness the result is uniform,
while words, numbers and paths pile up near zero. Within each class of encoding and length, the share of random
tokens is read off the flat upper part of the whole corpus's histogram of p-values; a token counts as a secret
if its p-value lies above the lowest cut at which the estimated share of ordinary tokens stays within `rate`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise, text_parts

# The base rules.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
BINS = 50
#: P-values above this are taken to come from random tokens alone.
FLAT = 0.5
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
CODES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS}


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token's characters; None if none does, or if it has no digit or no letter."""
    body = token.rstrip("=")
    present = set(body)
    if not any(c.isdigit() for c in present) or not any(c.isalpha() for c in present):
        return None
    return next((name for name, codes in CODES.items() if present <= codes.keys()), None)


def battery(token: str) -> tuple[str, float] | None:
    """Encoding and combined p-value of the hypothesis that the token is uniform over its encoding's alphabet."""
    encoding = encoding_of(token)
    if encoding is None:
        return None
    codes = CODES[encoding]
    values, size = [codes[c] for c in token.rstrip("=")], len(codes)
    n = len(values)
    counts = [0] * size
    for v in values:
        counts[v] += 1
    spread = sum((x - n / size) ** 2 for x in counts) * size / n
    degrees = size - 1
    # Wilson and Hilferty's normal form of chi-squared; one-sided, as ordinary text repeats letters.
    uniform = 0.5 * math.erfc((((spread / degrees) ** (1 / 3) - 1 + 2 / (9 * degrees)) / math.sqrt(2 / (9 * degrees))) / math.sqrt(2))
    high = [2 * v >= size for v in values]
    above = sum(high)
    below = n - above
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    expected = 1 + 2 * above * below / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    of_runs = normal_tail((runs - expected) / math.sqrt(variance)) if variance > 0 else 0.0
    middle = (size - 1) / 2
    moved = [v - middle for v in values]
    energy = (size * size - 1) / 12
    serial = normal_tail(sum(a * b for a, b in zip(moved, moved[1:])) / (energy * math.sqrt(n - 1)))
    x = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, of_runs, serial))
    half = x / 2
    return encoding, math.exp(-half) * (1 + half + half * half / 2)


def length_class(length: int) -> int:
    """Lengths in steps of a quarter of a power of two."""
    return int(4 * math.log2(length))


def scanner():
    """The compiled base rules, as a function from a text to (kind, start, end) in order of start and kind."""
    assign, access, hexes = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        return sorted(found)

    return scan


SPAN = "struct<start:int,kind:int,end:int>"
CANDIDATE = "struct<start:int,end:int,class:string,bin:int>"


def findings(text: str, scan, token: re.Pattern) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans of a text, and its tested tokens outside of them."""
    base, own = scan(text), []
    for m in token.finditer(text):
        start, end = m.span()
        if not any(s < end and start < e for s, _, e in base) and (tested := battery(m[0])):
            own.append({"start": start, "end": end, "class": f"{tested[0]}:{length_class(end - start)}", "bin": min(BINS - 1, int(tested[1] * BINS))})
    return base, own


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, token = scanner(), re.compile(TOKEN)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.string()), ("bin", pa.int32())]))
    for part in text_parts(batches):
        bases, candidates = [], []
        for text in part.column(1).to_pylist():
            base, own = findings(text or "", find, token)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            candidates.append(own)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bases, span), pa.array(candidates, candidate)], names=["doc_id", "base", "candidates"])


def lowest_cuts(histogram: dict[str, list[int]], rate: float) -> dict[str, int]:
    """For each class, the lowest bin from which on the estimated share of ordinary tokens is at most `rate`.

    Classes without a token in the flat part get no cut.
    """
    cuts = {}
    for name, counts in histogram.items():
        flat = int(BINS * FLAT)
        density = sum(counts[flat:]) / (BINS - flat)
        cut, above = None, 0
        for b in range(BINS - 1, -1, -1):
            above += counts[b]
            if above and density:
                if 1 - density * (BINS - b) / above <= rate:
                    cut = b
                elif b < flat:
                    break
        if cut is not None:
            cuts[name] = cut
    return cuts


def corpus_cuts(scanned: DataFrame, rate: float) -> dict[str, int]:
    """lowest_cuts() of the candidates of all documents. The histogram has encodings x length classes x BINS rows at most."""
    histogram: dict[str, list[int]] = {}
    for name, b, count in scanned.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").count().collect():
        histogram.setdefault(name, [0] * BINS)[b] = count
    return lowest_cuts(histogram, rate)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the base rules, and tested tokens with class and bin of their p-value, of each whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scanned, f"doc_id long, base array<{SPAN}>, candidates array<{CANDIDATE}>")


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, base and spans (start, kind, end) of each whole text, in code points, end exclusive; kind indexes KINDS.

    A null text counts as empty and has no spans. Null and repeated doc_ids are rows like any other, an empty table
    gives none, other columns are ignored. One pass reads the texts; spans and candidates are written, and the cuts
    come from a histogram over all documents.
    """
    scanned = materialise(scan(docs))
    cuts = corpus_cuts(scanned, rate)
    if cuts:
        cut = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
        passed = F.filter("candidates", lambda c: F.coalesce(c["bin"] >= F.element_at(cut, c["class"]), F.lit(False)))
        added = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    else:
        added = F.array().cast(f"array<{SPAN}>")
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and list of secrets in every row of `documents`."""
    from orrery.llm.common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """The documents with what find_secrets() finds replaced by `mark`, and n_chars as long as the new text.

    Overlapping spans are replaced by one mark. Rows, columns and null texts stay. A first pass over all texts gives
    the cuts, a second one replaces, so texts are never shuffled or joined.
    """
    cuts = corpus_cuts(materialise(scan(docs).where("size(candidates) > 0")), rate)
    columns, schema = docs.columns, docs.schema
    at, length = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def replaced(batches):
        find, token = scanner(), re.compile(TOKEN)
        for part in text_parts(batches, at):
            texts = []
            for text in part.column(at).to_pylist():
                base, own = findings(text or "", find, token)
                spans = sorted([(s, e) for s, _, e in base] + [(c["start"], c["end"]) for c in own if c["bin"] >= cuts.get(c["class"], BINS)])
                texts.append(with_marks(text, spans, mark) if spans else text)
            arrays = list(part.columns)
            arrays[at] = pa.array(texts, pa.string()).cast(arrays[at].type)
            if length is not None:
                old = arrays[length].to_pylist()
                arrays[length] = pa.array([n if t is None else len(t) for n, t in zip(old, texts)]).cast(arrays[length].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(replaced, schema)


def with_marks(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each of the sorted spans, merged where they overlap, replaced by the mark."""
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
