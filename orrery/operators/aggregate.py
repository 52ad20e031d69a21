"""The event aggregation engine: one plan of flatten, filter, join, group, order and page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import expressions as X

OPERATORS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "eq": lambda c, v: c == v,
}
SYMBOLS = {">=": "gte", "<=": "lte", "!=": "ne", ">": "gt", "<": "lt", "=": "eq"}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """The name if it is a plain identifier; raises ValueError otherwise."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def comparison(column: Column, spec: dict, dtype: str = "") -> Column:
    """All operators of the spec hold; ISO dates are dates on date columns."""
    unknown = set(spec) - set(OPERATORS)
    if unknown or not spec:
        raise ValueError(f"unknown operators: {sorted(unknown) or spec}")
    held = F.lit(True)
    for op, value in spec.items():
        literal = F.lit(value)
        if isinstance(value, str) and dtype.startswith(("date", "timestamp")):
            literal = literal.cast(dtype)
        held = held & OPERATORS[op](column, literal)
    return held


def event_filter(df: DataFrame, filters: dict) -> DataFrame:
    """Filters per column: a scalar, None (is null), {"not_null": True} or comparisons; all must hold."""
    kinds = dict(df.dtypes)
    for name, spec in filters.items():
        if name not in kinds:
            raise ValueError(f"unknown column {name!r}; there are {', '.join(df.columns)}")
        column = F.col(name)
        if spec is None:
            df = df.where(column.isNull())
        elif isinstance(spec, dict) and "not_null" in spec:
            if len(spec) > 1:
                raise ValueError("not_null stands alone")
            df = df.where(column.isNotNull())
        elif isinstance(spec, dict):
            df = df.where(comparison(column, spec, kinds[name]))
        else:
            df = df.where(column == F.lit(spec))
    return df


def property_filter(df: DataFrame, filters: dict) -> DataFrame:
    """Filters with the operators = < <= > >= !=; a scalar is equality."""
    for name, spec in filters.items():
        for symbol, value in (spec if isinstance(spec, dict) else {"=": spec}).items():
            if symbol not in SYMBOLS:
                raise ValueError(f"unknown operator: {symbol}")
            op = SYMBOLS[symbol]
            df = df.where(F.col(identifier(name)) != F.lit(value)) if op == "ne" else df.where(OPERATORS[op](F.col(identifier(name)), F.lit(value)))
    return df


def simple_filter(expression: str) -> Column:
    """A filter such as "amount >= 10" as a column; only `name operator value` is accepted."""
    match = re.fullmatch(r"\s*(\w+)\s*(>=|<=|>|<|=)\s*(.+?)\s*", expression)
    if not match:
        raise ValueError(f"not a filter: {expression!r}")
    name, symbol, text = match.groups()
    text = text.strip("'\"")
    value = {"true": True, "false": False}.get(text.lower())
    if value is None:
        try:
            value = float(text)
        except ValueError:
            value = text
    return OPERATORS[SYMBOLS[symbol]](F.col(identifier(name)), F.lit(value))


@dataclass(frozen=True)
class EventLine:
    """An event table: its key and, per line, the columns (slots) that refer to the line."""

    frame: DataFrame
    key: str
    slots: dict[str, tuple[str, ...]]
    time: str | None = None
    geometry: DataFrame | None = None
    properties: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


def pairs(events: DataFrame, slots: tuple[str, ...], name: str) -> DataFrame:
    """One row per event and alive slot; an event with two alive slots of a line counts twice."""
    keys = F.array(*(F.when(X.alive(F.col(s)), F.col(s).cast("string")) for s in slots))
    return events.withColumn(name, F.explode(F.array_compact(keys)))


def measure(metric: str) -> Column:
    """The aggregate of `count`, `sum:x`, `avg:x`, `min:x`, `max:x`, `median:x`, `pctN:x` or `count_distinct:x`."""
    name, _, column = metric.partition(":")
    if name == "count":
        return F.count(F.lit(1)).cast("double")
    if not column:
        raise ValueError(f"metric {metric!r} needs a column")
    value = F.col(identifier(column)).cast("double")
    if name == "count_distinct":
        return F.count_distinct(F.col(column)).cast("double")
    if name in ("median",) or re.fullmatch(r"pct\d{1,3}", name):
        share = 0.5 if name == "median" else int(name[3:]) / 100
        if share > 1:
            raise ValueError(f"no percentile: {metric!r}")
        return F.percentile(value, F.lit(share))
    makers = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if name not in makers:
        raise ValueError(f"unknown metric: {metric!r}")
    return makers[name](value)


def needed(metric: str) -> str | None:
    return metric.partition(":")[2] or None


def sample_hash(key: str, seed: int) -> Column:
    """What samples order rows by: MD5 of the key and the seed, so that any engine draws the same sample."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def filtered(line: EventLine, *, event_filters=None, time_from=None, time_to=None, key_filters=None, filter_by_keys=None, geometry_filter: Column | None = None, missing_edge_to=None, sample_size=None, sample_pct=None, seed=0) -> DataFrame:
    """The events after all filters and sampling, before grouping."""
    events = event_filter(line.frame, event_filters or {})
    if time_from is not None or time_to is not None:
        if line.time is None:
            raise ValueError("the events have no time column")
        if time_from is not None:
            events = events.where(F.col(line.time) >= F.lit(time_from).cast("timestamp"))
        if time_to is not None:
            events = events.where(F.col(line.time) < F.lit(time_to).cast("timestamp"))
    for name, keys in (key_filters or {}).items():
        wanted = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
        slots = line.slots[name]
        held = F.lit(False)
        for s in slots:
            held = held | F.coalesce(F.col(s).cast("string").isin(*wanted) if wanted else F.lit(False), F.lit(False))
        events = events.where(held)
    if missing_edge_to is not None:
        for s in line.slots[missing_edge_to]:
            events = events.where(~F.coalesce(X.alive(F.col(s)), F.lit(False)))
    if filter_by_keys is not None:
        events = events.join(filter_by_keys.select(F.col(filter_by_keys.columns[0]).alias(line.key)).distinct(), line.key, "left_semi")
    if geometry_filter is not None:
        if line.geometry is None:
            raise ValueError("the events have no geometry")
        events = events.join(line.geometry.where(geometry_filter).select(line.key), line.key, "left_semi")
    if sample_size is not None and sample_pct is not None:
        raise ValueError("give sample_size or sample_pct")
    if sample_pct is not None:
        events = events.where(F.conv(F.substring(sample_hash(line.key, seed), 1, 8), 16, 10).cast("long") < int(sample_pct * 2**32))
    if sample_size is not None:
        events = events.orderBy(sample_hash(line.key, seed), line.key).limit(sample_size)
    return events


def aggregate(line: EventLine, group_by: str, metric: str = "count", *, group_by_2=None, group_by_property=None, distinct=False, collapse=False, pivot=None, having=None, sort="desc", limit=20, offset=0, **filters) -> DataFrame:
    """Rows (key, [key_2 | property | pivot columns], value, count) of the grouped events.

    Every alive slot of a line counts. Values are rounded to two digits. `having` filters values, `limit` None gives
    all groups; ties are ordered by key.
    """
    if sort not in ("asc", "desc"):
        raise ValueError("sort is asc or desc")
    if pivot and (having or group_by_property or group_by_2):
        raise ValueError("a pivot takes no having, property or second line")
    if group_by_2 == group_by:
        raise ValueError("the second line must differ")
    events = pairs(filtered(line, **filters), line.slots[group_by], "key")
    counted = metric.startswith("count_distinct:")
    if counted and (group_by_property or pivot):
        raise ValueError("count_distinct takes no property or pivot")
    target = needed(metric)
    keys = ["key"]
    if counted:
        events = pairs(events, line.slots[target], "__target")
        value = F.count_distinct("__target").cast("double")
    else:
        value = measure(metric)
        if target:
            events = events.where(F.col(target).isNotNull())
    if group_by_2:
        events = pairs(events, line.slots[group_by_2], "key_2")
        keys.append("key_2")
    if group_by_property:
        owner, name = group_by_property.split(":")
        frame, own_key = line.properties[owner]
        events = events.join(frame.select(F.col(own_key).cast("string").alias("__owner"), F.col(name).alias("property")), F.col("key") == F.col("__owner")).where("property is not null")
        if distinct:
            grouped = events.groupBy("property").agg(F.count_distinct("key").cast("double").alias("value"))
            return _paged(grouped, ["property"], having, sort, limit, offset)
        keys = ["property"] if collapse else ["key", "property"]
    if pivot:
        cells = events.withColumn("__cell", F.col(pivot).cast("string")).where("__cell is not null")
        # Values of the field become columns: as many as a table can have.
        wide = cells.groupBy("key").pivot("__cell").agg(F.round(value, 2))
        totals = events.groupBy("key").agg(F.count(F.lit(1)).alias("count"))
        return wide.join(totals, "key").orderBy(F.desc("count"), "key").limit(limit) if limit is not None else wide.join(totals, "key")
    grouped = events.groupBy(*keys).agg(F.round(value, 2).alias("value"), F.count(F.lit(1)).alias("count"))
    return _paged(grouped, keys, having, sort, limit, offset)


def _paged(grouped: DataFrame, keys: list[str], having, sort: str, limit, offset: int) -> DataFrame:
    if having:
        grouped = grouped.where(comparison(F.col("value"), having))
    if limit is None:
        return grouped
    order = F.desc("value") if sort == "desc" else F.asc("value")
    return grouped.orderBy(order, *keys).offset(offset).limit(limit)


def anomaly_rates(line: EventLine, group_by: str, geometry_filter: Column) -> DataFrame:
    """key, count (events that pass the filter), total_events and anomaly_rate of each group with such events."""
    all_ = pairs(line.frame, line.slots[group_by], "key").groupBy("key").agg(F.count(F.lit(1)).alias("total_events"))
    some = pairs(filtered(line, geometry_filter=geometry_filter), line.slots[group_by], "key").groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    return some.join(all_, "key").withColumn("anomaly_rate", F.col("count") / F.col("total_events"))


def dropped_share(line: EventLine, geometry_filter: Column) -> DataFrame:
    """Events, events that a geometry filter drops, and their share."""
    flagged = line.frame.select(line.key).join(line.geometry.where(geometry_filter).select(line.key, F.lit(1).alias("__kept")), line.key, "left")
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("__kept").isNull(), 1)).alias("dropped")).withColumn("share", F.col("dropped") / F.col("total"))


def anomalies_by_property(geo: DataFrame, group: str, key: str, keys_per_group: int = 5) -> DataFrame:
    """Global anomalies grouped by a property: count, mean norm and the keys with the largest norms; null is "(null)"."""
    from pyspark.sql.window import Window

    held = geo.where("norm >= theta").withColumn("group_key", F.coalesce(F.col(group).cast("string"), F.lit("(null)")))
    order = Window.partitionBy("group_key").orderBy(F.desc("norm"), key)
    ranked = held.withColumn("__n", F.row_number().over(order))
    return ranked.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.avg("norm").alias("mean_norm"), F.sort_array(F.collect_list(F.when(F.col("__n") <= keys_per_group, F.col(key)))).alias("keys")
    )
