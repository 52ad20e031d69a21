"""Language identification by segmentation-marginalised unigram models.

The vocabulary is a fixed public list of pieces. A language is a probability for each piece and one for a character
that no piece covers; a word's probability under it is the sum over all ways to cut the word into pieces, from a
forward pass. Expectation maximisation with forward and backward passes learns the probabilities. A text's score for
a language is the sum of its words' logarithms; the languages' posterior, with equal priors, gives the answer.

Words are runs of letters (Unicode category L) with the marks (M) on them, lower-cased, with the mark of a word's
beginning. A worker remembers what recent chunks of text score, so the forward pass runs once for most of them however
often they occur.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orrery.llm.chunks import chunked
from orrery.llm.common import free_name, materialise, text_parts, tokenizer_path, worker_state

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"
#: Documents of each language that the models are fitted on: with the vocabulary it bounds what is broadcast.
FIT_DOCUMENTS = 500
ROUNDS = 2
#: Share of the probability that all pieces have alike in every language, and the chance of an uncovered character.
SMOOTHING = 0.01
OTHER = 1e-8
#: Letters of words that take the forward pass together, places that have their arcs listed together, places between rescalings.
BATCH_LETTERS = 1 << 18
SPAN = 1 << 12
RESCALED = 8
#: Sums below this are taken on logarithms.
LEAST_SUM = 1e-250
#: Numbers that a worker's table of scores holds, and bytes of text worked on at a time.
TABLE_VALUES = 3_500_000
TEXT_BYTES = 8 << 20


def pieces(path: str | None = None) -> dict[str, int]:
    """The vocabulary's pieces of letters, lower-cased, some with the mark of a word's beginning; numbered by rule."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path(VOCABULARY))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return {p: i for i, p in enumerate(sorted(p for p in found if WORD.fullmatch(p.removeprefix(MARK))))}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Models:
    """Piece probabilities of every language: a row for each piece and at last one for a character that no piece covers,
    the same for all languages, so that such characters tell nothing; a column for each language."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray, other: float):
        self.languages, self.pieces, self.other = languages, pieces, other
        self.table = np.vstack([probabilities.reshape(len(pieces), len(languages)), np.full((1, len(languages)), other)])
        self.longest = max(map(len, pieces), default=1)

    @cached_property
    def numbered(self) -> dict[str, int]:
        """Row of each piece in `table`; -1 for what only begins a piece."""
        rows = {piece: i for i, piece in enumerate(self.pieces)}
        return {piece[:n]: -1 for piece in rows for n in range(1, len(piece))} | rows

    def log_scores(self, words: list[str]) -> np.ndarray:
        """Logarithm of each word's probability under each language, all segmentations of the whole word summed."""
        total = np.zeros((len(words), len(self.languages)))
        order, start = sorted(range(len(words)), key=lambda i: len(words[i])), 0
        while start < len(order):
            letters, end = 0, start
            while end < len(order) and (end == start or letters + len(words[order[end]]) < BATCH_LETTERS):
                letters += len(words[order[end]]) + 1
                end += 1
            total[order[start:end]] = self.forward([MARK + words[i] for i in order[start:end]])
            start = end
        return total

    def arcs(self, text: str, owner: int, first: int, into: tuple[list, list, list, list]) -> None:
        """Add the arcs that begin in text (which starts at `first`): owner, start, end, row."""
        get, lone = self.numbered.get, len(self.pieces)
        owners, starts, ends, rows = into
        n = len(text)
        for start in range(n):
            end = start + 1
            row = get(text[start:end])
            owners.append(owner)
            starts.append(first + start)
            ends.append(first + end)
            rows.append(lone if row is None or row < 0 else row)
            while row is not None and end < n:
                end += 1
                row = get(text[start:end])
                if row is not None and row >= 0:
                    owners.append(owner)
                    starts.append(first + start)
                    ends.append(first + end)
                    rows.append(row)

    def forward(self, texts: list[str]) -> np.ndarray:
        """Logarithm of the sum of the probabilities of all segmentations, for each text (from short to long) and language.

        An arc is a piece from one place of a text to a later one; arcs are summed by the place where they end. Only the
        places that the longest piece can reach back to are held, and they are rescaled before they could underflow.
        """
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ring = self.longest + 1
        alpha = np.zeros((ring, len(texts), len(self.languages)))
        alpha[0] = 1.0
        scale, result = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:])
        finals = np.searchsorted(lengths, np.arange(lengths[-1] + 2))
        for begin in range(0, int(lengths[-1]), SPAN):
            into: tuple[list, list, list, list] = ([], [], [], [])
            for i in range(int(np.searchsorted(lengths, begin, side="right")), len(texts)):
                # Arcs that end in this span; they begin up to `longest` places before it.
                self.arcs(texts[i][max(0, begin - self.longest) : begin + SPAN], i, max(0, begin - self.longest), into)
            owner, start, end, row = (np.array(x, dtype=np.int64) for x in into)
            own = np.flatnonzero(end > begin)
            own = own[np.lexsort((owner[own], end[own]))]
            owner, start, end, row = owner[own], start[own], end[own], row[own]
            last = min(begin + SPAN, int(lengths[-1]))
            edges = np.searchsorted(end, np.arange(begin + 1, last + 2))
            for place in range(begin + 1, last + 1):
                arcs = slice(edges[place - begin - 1], edges[place - begin])
                mine = owner[arcs]
                firsts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                live = mine[firsts]
                alpha[place % ring, live] = np.add.reduceat(alpha[start[arcs] % ring, mine] * self.table[row[arcs]], firsts)
                done = slice(finals[place], finals[place + 1])
                result[done] = np.log(alpha[place % ring, done]) + scale[done]
                if place % RESCALED == 0:
                    most = alpha[:, live].max(axis=0)
                    alpha[:, live] /= most
                    scale[live] += np.log(most)
        return result


class TokenScores:
    """A table of what the words of a chunk of text score under each language, and their number, of the chunks met last.

    It holds TABLE_VALUES numbers and starts anew when it is full.
    """

    def __init__(self, models: Models, values: int = 0):
        self.models, self.width = models, 1 + len(models.languages)
        self.most = max(1, (values or TABLE_VALUES) // self.width)
        self.table, self.rows = np.empty((self.most, self.width)), {}

    def rows_of(self, chunks: list[str]) -> np.ndarray:
        """Rows of at most `most` chunks in the table."""
        new = [c for c in chunks if c not in self.rows]
        if len(self.rows) + len(new) > self.most:
            self.rows, new = {}, chunks
        found = [words(chunk) for chunk in new]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for ws in found for w in ws))}
        scores = self.models.log_scores(list(place)) if place else np.zeros((0, self.width - 1))
        counts = np.array([len(ws) for ws in found], dtype=np.int64)
        at = len(self.rows)
        rows = self.table[at : at + len(new)]
        rows[:, :-1] = 0
        np.add.at(rows, (np.repeat(np.arange(len(new)), counts), slice(0, self.width - 1)), scores[np.array([place[w] for ws in found for w in ws], dtype=np.int64)])
        rows[:, -1] = counts
        self.rows.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))

    def totals(self, column: pa.Array) -> np.ndarray:
        """Scores under each language and number of words of each text."""
        distinct, numbers, counts = chunked(column)
        total, ends = np.zeros((len(column), self.width)), np.cumsum(counts)
        for first in range(0, len(distinct), self.most):
            rows = self.rows_of(distinct[first : first + self.most])
            if len(distinct) <= self.most:
                own, until = rows[numbers], ends
            else:
                inside = (numbers >= first) & (numbers < first + self.most)
                own, until = rows[numbers[inside] - first], np.append(0, np.cumsum(inside))[ends]
            begin = 0
            for i, end in enumerate(until.tolist()):
                for at in range(begin, end, self.most):
                    total[i] += self.table[own[at : min(end, at + self.most)]].sum(axis=0)
                begin = end
        return total


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(x - most) for x in values))


def expected_counts(text: str, count: int, probability: Callable[[str], float | None], other: float, longest: int, into: dict[str, float]) -> None:
    """Add the expected uses of each piece in `count` occurrences of text under one language; "" is an uncovered character."""
    n = len(text)
    arcs = []
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    alpha[0] = beta[n] = 1.0
    for start in range(n):
        here = alpha[start]
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = text[start:end]
            p = probability(piece)
            if p is None and end == start + 1:
                piece, p = "", other
            if p:
                arcs.append((start, end, piece, p))
                alpha[end] += here * p
    if alpha[n] > LEAST_SUM:
        for start, end, _, p in reversed(arcs):
            beta[start] += p * beta[end]
        scale = count / alpha[n]
        for start, end, piece, p in arcs:
            into[piece] += alpha[start] * p * beta[end] * scale
        return
    # Long words underflow: the same on logarithms.
    ahead: list[list] = [[] for _ in range(n + 1)]
    behind: list[list] = [[] for _ in range(n + 1)]
    for arc in arcs:
        ahead[arc[0]].append(arc)
        behind[arc[1]].append(arc)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for place in range(1, n + 1):
        alpha[place] = _log_sum([alpha[start] + math.log(p) for start, _, _, p in behind[place]])
    for place in range(n - 1, -1, -1):
        beta[place] = _log_sum([beta[end] + math.log(p) for _, end, _, p in ahead[place]])
    for start, end, piece, p in arcs:
        into[piece] += count * math.exp(alpha[start] + math.log(p) + beta[end] - alpha[n])


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """FIT_DOCUMENTS documents of each language at most, those of the smallest hashes, outside `held_out`."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text").where(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A share of the hashes that holds somewhat more than the documents wanted, so that the rest is small to rank.
    shares = [(r.lang, min(1 << 32, int((2 * FIT_DOCUMENTS + 50) / r["n"] * 2**32))) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    below = spark.createDataFrame(shares, "__of string, __below long")  # a row for each language
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    near = rows.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), hashed.alias("__hash")).join(F.broadcast(below), F.col("__lang") == F.col("__of")).where("__hash < __below")
    chosen = near.withColumn("n", F.row_number().over(Window.partitionBy("__lang").orderBy("__hash", "__id"))).where(F.col("n") <= FIT_DOCUMENTS)
    chosen = materialise(chosen.select("__id", "__lang").distinct())
    return rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("lang", "text")


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_parts(batches):
        counts: dict[tuple[str, str], int] = defaultdict(int)
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            for word in words(text):
                counts[lang, MARK + word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, vocabulary: str | None = None) -> Models:
    """Models of the languages of the documents outside `held_out`, fitted on a bounded sample of them.

    The models have a probability for each piece of the fixed vocabulary and each language, whatever the input's size;
    rows without a doc_id, a text or a language teach nothing.
    """
    spark = docs.sparkSession
    known = sorted(pieces(vocabulary))
    counted = training_rows(docs, held_out).mapInArrow(_word_batches, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.repartition(spark.sparkContext.defaultParallelism, "word"))
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    # What a language has used, with its probability; the rest of the vocabulary shares `base`.
    used: dict[str, dict[str, float]] = {lang: {} for lang in languages}
    base, longest = 1 / max(1, len(known)), max(map(len, known), default=1)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((used, dict.fromkeys(known, base)))

        def expectation(batches, sent=sent):
            used, shared = sent.value
            into: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    own = used[lang]
                    expected_counts(word, n, (lambda piece, own=own: own.get(piece) or shared.get(piece)), OTHER, longest, into[lang])
            rows = [(lang, piece, x) for lang, own in into.items() for piece, x in own.items()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "x"])

        # Sums of whole millionths do not depend on the order of partitions.
        expected = counted.mapInArrow(expectation, "lang string, piece string, x double")
        summed = expected.groupBy("lang", "piece").agg(F.sum(F.round(F.col("x") * 1_000_000).cast("long")).alias("x")).collect()
        used = {lang: {} for lang in languages}
        for lang, piece, x in summed:
            if piece and x:
                used[lang][piece] = x
        base = SMOOTHING / max(1, len(known))
        for lang, own in used.items():
            total = sum(own.values())
            used[lang] = {piece: (1 - SMOOTHING) * x / total + base for piece, x in own.items()}
        sent.unpersist()
    table, place = np.full((len(known), len(languages)), base), {piece: i for i, piece in enumerate(known)}
    for i, lang in enumerate(languages):
        for piece, p in used[lang].items():
            table[place[piece], i] = p
    return Models(languages, known, table, OTHER)


def _answers(column: pa.Array, models: Models, remembered: TokenScores) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for total in remembered.totals(column):
        if not total[-1] or not models.languages:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        total = total[:-1]
        best = int(total.argmax())
        langs.append(models.languages[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return langs, scores


def predict(docs: DataFrame, models: Models, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (the posterior, 0 to 1) of every row, from the text alone; with `keep`, the rows'
    own columns with lang_pred and score put before them as __lang and __score, or longer names where those are taken.

    A null text or one without a letter, or a fit without any language, gives `und` and score 0. Ties go to the
    language that sorts first. Null and repeated doc_ids are rows like any other; an empty table gives no rows.
    """
    sent, version = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex
    rows = docs if keep else docs.select("doc_id", "text")
    at = rows.columns.index("text")
    lang, score = (free_name(n, rows.columns) for n in ("__lang", "__score"))
    schema = T.StructType([T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), *rows.schema.fields])

    def scored(batches):
        remembered = worker_state("language", lambda: TokenScores(sent.value), version)
        for part in text_parts(batches, at, TEXT_BYTES):
            langs, scores = _answers(part.column(at), sent.value, remembered)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *part.columns], names=schema.names)

    found = rows.mapInArrow(scored, schema)
    return found if keep else found.select("doc_id", F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def keep_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is determined with a posterior of `least` or more, columns unchanged."""
    found = predict(docs, fit(docs, held_out_fold()), keep=True)
    lang, score = found.columns[:2]
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).drop(lang, score)


def held_out_fold() -> Column:
    """Whether the remainder is 1; a null doc_id has none, so it is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every row of `documents`, learned from the rows that are not held out."""
    from orrery.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, held_out_fold()))
    return found.select("doc_id", held_out_fold().alias("held_out"), "lang_pred", "score")
