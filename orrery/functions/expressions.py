"""Scalar and vector expressions on columns: shapes, distances, hyperplanes, witnesses, forecasts, probabilities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of durations, in seconds.
DURATIONS = {"d": 86_400.0, "h": 3_600.0, "m": 60.0}
# Shares of the four parts of a link score, and the decay of forecast weights.
LINK_WEIGHTS = {"similarity": 0.40, "witness": 0.30, "trajectory": 0.20, "anomaly": 0.10}
FORECAST_DECAY = 0.3


def seconds(duration: str) -> float:
    """Seconds of a duration such as 7d, 24h or 30m."""
    match = re.fullmatch(r"(\d+)([dhm])", duration.strip())
    if not match:
        raise ValueError(f"not a duration: {duration!r}")
    return int(match[1]) * DURATIONS[match[2]]


def epoch(column: Column) -> Column:
    """Timestamp as seconds since 1970, a double."""
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def norm(columns) -> Column:
    """Euclidean norm of scalar columns."""
    return F.sqrt(total([c * c for c in columns]))


def dot(a, b) -> Column:
    return total([x * y for x, y in zip(a, b)])


def distance(a, b) -> Column:
    return norm([x - y for x, y in zip(a, b)])


def alive(column: Column) -> Column:
    """A foreign key that is neither null nor the empty string."""
    text = column.cast("string")
    return text.isNotNull() & (text != "")


def relation_shape(column: Column) -> Column:
    """1 where the relation's key is alive, else 0."""
    return F.when(alive(column), 1.0).otherwise(0.0)


def continuous_shape(column: Column, edge_max: float) -> Column:
    """A count or amount capped at edge_max, as a share of it."""
    return F.least(F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(float(edge_max))) / F.lit(float(edge_max))


def event_shape(column: Column, edge_max: float) -> Column:
    """A numeric event column over edge_max, between 0 and 3."""
    return F.least(F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)) / F.lit(float(edge_max)), F.lit(0.0)), F.lit(3.0))


def property_shape(column: Column) -> Column:
    return F.when(column.isNotNull(), 1.0).otherwise(0.0)


def composite_key(columns, separator: str = "→") -> Column:
    """Parts joined by the separator; null if any part is null."""
    parts: list[Column] = []
    for i, c in enumerate(columns):
        parts += [F.lit(separator)] * bool(i) + [c.cast("string")]
    return F.concat(*parts)


def signed_distance(delta, normal, bias: float) -> Column:
    """Signed distance of a point from the hyperplane normal · x = bias."""
    length = sum(w * w for w in normal) ** 0.5
    if not length:
        raise ValueError("a hyperplane needs a normal that is not zero")
    return (dot(delta, [F.lit(float(w)) for w in normal]) - F.lit(float(bias))) / F.lit(length)


def health(rate: Column, rows: Column) -> Column:
    """Calibration health from the anomaly rate."""
    return (
        F.when(rows == 0, "good")
        .when((rate > 0.30) | (rate < 0.001), "poor")
        .when((rate > 0.20) | (rate < 0.01), "suspect")
        .otherwise("good")
    )


def driving_dimensions(delta, names, most: int = 3, least: float = 0.05) -> Column:
    """Names of the dimensions with the largest shares of the squared norm, those above `least`."""
    square = total([d * d for d in delta])
    shares = F.array(*(F.struct(F.round(-(d * d) / F.greatest(square, F.lit(1e-300)), 9).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (d, n) in enumerate(zip(delta, names))))
    return F.transform(F.slice(F.array_sort(F.filter(shares, lambda x: x["s"] < -least)), 1, most), lambda x: x["n"])


def _by_square(delta, names) -> Column:
    return F.array_sort(F.array(*(F.struct(F.round(-(d * d), 9).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (d, n) in enumerate(zip(delta, names)))))


def witness_set(delta, names, theta: Column | float) -> Column:
    """The fewest of the largest dimensions whose squares reach the squared threshold; empty below it."""
    limit = F.lit(theta) * F.lit(theta) if not isinstance(theta, Column) else theta * theta
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("names"))
    walked = F.aggregate(
        _by_square(delta, names),
        start,
        lambda a, x: F.when(a["sum"] >= limit, a).otherwise(F.struct((a["sum"] - x["s"]).alias("sum"), F.concat(a["names"], F.array(x["n"])).alias("names"))),
    )
    return F.when(walked["sum"] >= limit, walked["names"]).otherwise(F.array().cast("array<string>"))


def repair_set(delta, names, theta: Column | float) -> Column:
    """The fewest of the largest dimensions to set to zero so that the rest stays below the threshold."""
    limit = F.lit(theta) * F.lit(theta) if not isinstance(theta, Column) else theta * theta
    start = F.struct(total([d * d for d in delta]).alias("left"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(
        _by_square(delta, names),
        start,
        lambda a, x: F.when(a["left"] < limit, a).otherwise(F.struct((a["left"] + x["s"]).alias("left"), F.concat(a["names"], F.array(x["n"])).alias("names"))),
        lambda a: a["names"],
    )


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def link_score(similarity: Column, witness: Column, trajectory: Column | None, anomaly: Column, weights: dict | None = None) -> Column:
    """Weighted sum of the parts; without trajectories their weight goes to the others in proportion."""
    weights = dict(weights or LINK_WEIGHTS)
    parts = {"similarity": similarity, "witness": witness, "anomaly": anomaly}
    if trajectory is not None:
        parts["trajectory"] = trajectory
    whole = sum(weights[k] for k in parts) or 1.0
    scale = sum(weights.values()) / whole
    return total([F.lit(weights[k] * scale) * v for k, v in parts.items()])


def severity(norm_column: Column, theta: Column) -> Column:
    ratio = norm_column / theta
    return F.when(ratio >= 2.5, "extreme").when(ratio >= 1.5, "high").when(ratio >= 1.1, "medium").otherwise("low")


# What distances of entities and of their histories are called.
DISTANCE_BANDS = ((0.1, "very similar"), (0.5, "similar"), (1.0, "moderately different"))
HISTORY_BANDS = ((1.0, "similar history"), (3.0, "divergent history"))


def band(value: Column, zero: str, bands, rest: str) -> Column:
    """`zero` at 0, else the name of the first limit above the value, else `rest`."""
    name = F.when(value == 0, zero)
    for limit, text in bands:
        name = name.when(value < limit, text)
    return name.otherwise(rest)


def distance_band(d: Column) -> Column:
    """Verbal band of a distance between two members of one population."""
    return band(d, "identical shapes", DISTANCE_BANDS, "very different")


def history_band(d: Column) -> Column:
    return band(d, "identical history", HISTORY_BANDS, "very different history")


def fisher_p(p_values: Column) -> Column:
    """Fisher's combined p of an array of p-values; chi-squared with an even number of degrees has a closed form."""
    half = F.aggregate(p_values, F.lit(0.0), lambda s, p: s - F.log(F.greatest(p, F.lit(1e-15))))
    start = lambda h: F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def tail(h: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(p_values))
        return F.aggregate(steps, start(h), lambda a, i: F.struct((a["term"] * h / i).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: F.exp(-h) * a["sum"])

    return F.when(F.size(p_values) > 0, F.transform(F.array(half), tail)[0]).otherwise(F.lit(1.0))


def iso(micros: Column) -> Column:
    """Microseconds since 1970 as ISO 8601 in UTC, with microseconds where there are any."""
    whole = F.timestamp_micros(micros.cast("long"))
    text = F.date_format(F.to_utc_timestamp(whole, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros.cast("long"), F.lit(1_000_000))
    return F.concat(text, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def reliability(slices: Column, r_squared: Column) -> Column:
    return F.when((slices >= 10) & (r_squared >= 0.7), "high").when((slices >= 5) | (r_squared >= 0.4), "medium").otherwise("low")
