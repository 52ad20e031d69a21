"""Quality rules on DataFrame functions alone: text statistics, and a hashed n-gram log-likelihood ratio.

Word and word-pair n-grams are hashed to a fixed number of buckets. A bucket's weight is the logarithm of its share
among the trusted documents over its share in the whole corpus. A document's score is the mean weight of its n-grams,
so length does not matter, and a document is kept if its score reaches the score that all but a small share of the
trusted documents reach. Half of the trusted documents, by hash, are for the weights, which are fitted on a bounded number
of them, and every one of the other half counts for the threshold, so that documents are not held against scores of texts
which the weights have seen. Those that the base rules reject give none: the means of a few n-grams scatter most, and
such texts are never decided by their score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import BLANK_CLASS, let, materialise, word_array

# The base rules.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Trusted documents that the target multinomial is fitted on, at most; those of the smallest hashes.
FIT_DOCUMENTS = 10_000
#: Share of the held-out trusted documents that pass the base rules whose scores lie below the threshold.
MISSED = 0.002
#: Taken off the threshold, so that documents like the trusted ones are not decided by small differences.
MARGIN = 0.02
#: Digits of the scores that are counted for the threshold, so their number is bounded.
COUNTED_DIGITS = 4
#: Bits for a window's position while hashes are sorted; longer texts, and hash prefixes that collide, take the slow way.
POSITION_BITS = 24


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"[^{BLANK_CLASS[1:]}"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def window_hashes(words: Column) -> Column:
    """XXH64 of each window of WINDOW words, in order."""
    last = F.size(words) - WINDOW
    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW)))))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(positions: Column) -> Column:
    """Words under windows that start at the sorted positions."""
    return let(
        positions,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(WINDOW).cast("long"), F.get(p, i + 1) - x)).otherwise(F.lit(WINDOW).cast("long"))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )


def repeated_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more.

    Hashes are sorted as longs that hold a prefix of the hash above the position. Where neighbours share the prefix
    but not the hash, or the text has too many words for the position, pairs of hash and position are sorted instead.
    """
    low = (1 << POSITION_BITS) - 1

    def quick(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long"))))

        def flagged(s: Column) -> Column:
            prefix = lambda i: F.shiftright(F.get(s, i), POSITION_BITS)
            whole = lambda i: F.get(h, F.get(s, i).bitwiseAND(F.lit(low).cast("long")).cast("int"))
            clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: (prefix(i) == prefix(i - 1)) & (whole(i) != whole(i - 1)))
            same = lambda i, j: F.coalesce(prefix(i) == prefix(j), F.lit(False))
            own = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
            positions = F.sort_array(F.transform(own, lambda x: x.bitwiseAND(F.lit(low).cast("long"))))
            return F.when(clash, slow(h)).otherwise(_covered(positions))

        return let(packed, flagged)

    def slow(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.cast("long").alias("at"))))

        def flagged(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["hash"] == F.get(s, j)["hash"], F.lit(False))
            own = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
            return _covered(F.array_sort(F.transform(own, lambda x: x["at"])))

        return let(pairs, flagged)

    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    return let(hashes, lambda h: F.when(~repeats(h), F.lit(0).cast("long")).when(F.size(h) <= low, quick(h)).otherwise(slow(h)))


def gram_buckets(words: Column) -> Column:
    """Bucket of each word and of each pair of neighbouring words."""
    bucket = lambda *w: F.xxhash64(*w).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
    pairs = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: bucket(w[i - 1], w[i])))
    return F.concat(F.transform(words, lambda w: bucket(w)), F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """__trusted, the doc_id of every document labelled good and not toxic, and __fits: whether it is for weights or the threshold."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
    return good.withColumn("__fits", F.xxhash64("__trusted", F.lit("half")) % 2 == 0)


def gram_weights(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING, most: int = FIT_DOCUMENTS) -> DataFrame:
    """One row with `weights`: an array of BUCKETS log ratios of shares among `most` trusted documents to corpus shares."""
    fitted = materialise(trusted.where("__fits").orderBy(F.xxhash64("__trusted"), "__trusted").limit(most))
    marked = docs.join(F.broadcast(fitted), F.col("doc_id") == F.col("__trusted"), "left")
    grams = marked.select(F.explode(gram_buckets(word_array(F.col("text")))).alias("bucket"), F.col("__trusted").isNotNull().cast("long").alias("good"))
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").fillna(0, ["raw", "target"])
    # BUCKETS rows, whatever the input.
    gathered = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("b"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    share = lambda count, total: (count + F.lit(smoothing)) / (total + F.lit(smoothing * BUCKETS))
    return gathered.select(F.transform("b", lambda x: F.log(share(x["target"], F.col("targets")) / share(x["raw"], F.col("raws")))).alias("weights"))


def gram_score(words: Column, weights: Column) -> Column:
    """Mean weight of the n-grams; null without a word."""
    total = let(weights, lambda w: F.aggregate(gram_buckets(words), F.lit(0.0), lambda sofar, b: sofar + w[b]))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1))


def text_statistics(docs: DataFrame) -> DataFrame:
    """The documents' columns with __words and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("__words", word_array(F.col("text"))).select(
        "*",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(window_hashes(F.col("__words"))).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Whether the base rules reject a row of text_statistics()."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def scored(docs: DataFrame, trusted: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, the statistics, base_failed and score of every row; `carry` names a struct of the row's own columns."""
    own = [F.struct(*(docs[c] for c in docs.columns)).alias(carry)] if carry else []
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *own)
    weights = materialise(gram_weights(docs.select("doc_id", "text"), trusted))
    return text_statistics(docs).withColumn("__weights", weights.scalar()).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.round(gram_score(F.col("__words"), F.col("__weights")), 6).alias("score"),
        *([carry] if carry else []),
    )


def threshold_of(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with `threshold`, from the scored rows of every held-out trusted document that passes the base rules.

    Equal scores of a doc_id are counted before the join, so a doc_id that many rows share is no hot key.
    """
    counts = rows.where("not base_failed and doc_id is not null").groupBy("doc_id", F.round("score", COUNTED_DIGITS).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.join(trusted.where("not __fits"), F.col("doc_id") == F.col("__trusted"), "left_semi").groupBy("score").agg(F.sum("n").alias("n"))
    return held.agg(F.round(F.coalesce(F.percentile("score", F.lit(MISSED), F.col("n")), F.lit(float("-inf"))) - MARGIN, 6).alias("threshold"))


def verdicts(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The written scored rows with `kept`."""
    threshold = materialise(threshold_of(rows, trusted))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold.scalar(), F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every row.

    A null or empty text has no words and fails the base rules. Without trusted documents the ratio is the same for
    all texts and only the base rules reject. Rows with equal or null doc_ids are judged one by one; an empty table gives
    none. The weights (BUCKETS numbers) and the threshold are read as scalar subqueries. The rows are written without
    their texts once they are scored, and the threshold comes from them.
    """
    trusted = materialise(trusted_ids(labels))
    return verdicts(materialise(scored(docs, trusted)), trusted)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of `documents`."""
    from orrery.llm.common import table

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that judge() keeps, columns unchanged, without a join or shuffle of texts; what passes the base rules is written once."""
    trusted = materialise(trusted_ids(labels))
    return verdicts(materialise(scored(docs, trusted, carry="__row").where("not base_failed")), trusted).where("kept").select("__row.*")
