"""Exact quantiles and ranks that do not put all values into one task."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distinct values that a bracket may hold when it is gathered, and relative width of the first bracket.
GATHERED = 20_000
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Linearly interpolated quantiles {name: (column, share)} of the non-null values; None without any.

    A sketch brackets each wanted rank, one pass counts what lies below the bracket, and only the bracket's distinct
    values are gathered. A bracket that is still too wide is cut again, so the driver's part stays bounded.
    """
    if not wanted:
        return {}
    own = {f"q{i}": spec for i, spec in enumerate(wanted.values())}
    names = list(own)
    values = df.select(*(own[n][0].cast("double").alias(n) for n in names))
    counts = values.agg(*(F.count(n).alias(n) for n in names)).first()
    rank = {n: (counts[n] - 1) * own[n][1] for n in names if counts[n]}
    below, size, bracket = dict.fromkeys(rank, 0), {n: counts[n] for n in rank}, dict.fromkeys(rank, (-math.inf, math.inf))
    wide = [n for n in rank if size[n] > GATHERED]
    while wide:
        shares = {n: (rank[n] - below[n]) / (size[n] - 1) for n in wide}
        margin = {n: 2 / ACCURACY + 1 / size[n] for n in wide}
        sketched = values.agg(
            *(F.percentile_approx(F.when(F.col(n).between(*bracket[n]), F.col(n)), [max(0.0, shares[n] - margin[n]), min(1.0, shares[n] + margin[n])], ACCURACY).alias(n) for n in wide)
        ).first()
        # Sums may differ in their last digits from run to run, so brackets are a little wider than the sketch says.
        cut = {n: (sketched[n][0] - 1e-9 * abs(sketched[n][0]), sketched[n][1] + 1e-9 * abs(sketched[n][1])) for n in wide}
        inside = {n: F.when(F.col(n).between(*cut[n]), F.col(n)) for n in wide}
        counted = values.agg(*(c for n in wide for c in (F.count(F.when(F.col(n) < cut[n][0], 1)).alias(f"b_{n}"), F.count(inside[n]).alias(f"s_{n}"), F.approx_count_distinct(inside[n]).alias(f"d_{n}")))).first()
        still = []
        for n in wide:
            b, s = counted[f"b_{n}"], counted[f"s_{n}"]
            if not (b <= math.floor(rank[n]) and math.ceil(rank[n]) <= b + s - 1):
                raise ArithmeticError(f"the sketch of {n} missed rank {rank[n]}")
            smaller = s < size[n]
            bracket[n], below[n], size[n] = cut[n], b, s
            if counted[f"d_{n}"] > GATHERED and smaller:
                still.append(n)
        wide = still
    held = F.array_compact(F.array(*(F.when(F.col(n).between(*bracket[n]), F.struct(F.lit(n).alias("name"), F.col(n).alias("v"))) for n in rank))) if rank else None
    found: dict[str, list[tuple[float, int]]] = {n: [] for n in rank}
    if rank:
        for r in values.select(F.explode(held).alias("x")).groupBy("x.name", "x.v").count().collect():
            found[r[0]].append((r[1], r[2]))
    return {given: _interpolated(sorted(found[n]), rank[n] - below[n]) if n in rank else None for given, n in zip(wanted, names)}


def _interpolated(values: list[tuple[float, int]], rank: float) -> float:
    def at(k: int) -> float:
        for value, count in values:
            if k < count:
                return value
            k -= count
        return values[-1][0]

    lower, upper = at(math.floor(rank)), at(math.ceil(rank))
    return lower + (upper - lower) * (rank - math.floor(rank))


#: Tasks over which the rows of a frequent value are dealt out, in each range.
SALTS = 256


def with_global_rank(df: DataFrame, value: str, rank: str = "rank_below", rows: str | None = None, parts: int = 64) -> DataFrame:
    """`df` with the number of rows whose `value` is smaller, and optionally the number of all rows.

    Values are cut into `parts` ranges of about equal size; a window ranks inside a range, and the sizes of the ranges
    before it, which are `parts` numbers, are added. A value that fills ranges of its own (inactive entities often share
    one) needs no window: what lies below it is counted, and its rows are dealt out. So no task sees much more than a range.
    """
    bounds = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], ACCURACY).alias("b")).first()["b"] or []
    frequent = sorted(v for v, n in Counter(bounds).items() if n > 1)
    below = df.agg(*(F.count(F.when(F.col(value) < v, 1)).alias(f"b{i}") for i, v in enumerate(frequent))).first() if frequent else ()
    bounds = sorted(set(bounds))
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value)))
    placed = df.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    before, offset, n = [], F.lit(0).cast("long"), 0
    for p in sorted(sizes):
        before.append((p, n))
        n += sizes[p]
    for p, b in before:
        offset = F.when(F.col("__part") == p, F.lit(b).cast("long")).otherwise(offset)
    is_frequent, known = F.lit(False), F.lit(None).cast("long")
    for v, count in zip(frequent, below):
        is_frequent, known = is_frequent | (F.col(value) == v), F.when(F.col(value) == v, F.lit(count).cast("long")).otherwise(known)
    dealt = F.when(is_frequent, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).otherwise(0)
    own = F.rank().over(Window.partitionBy("__part", "__dealt").orderBy(value)) - 1
    ranked = placed.withColumn("__dealt", dealt).withColumn(rank, F.coalesce(known, own + offset)).drop("__dealt")
    if rows:
        ranked = ranked.withColumn(rows, F.lit(n).cast("long"))
    return ranked.drop("__part")
