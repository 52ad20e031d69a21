"""Declarative build specifications: parsing, validation, and the build they describe."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.expressions import composite_key, epoch, seconds
from orrery.operators import calibrate, derived, graph, temporal
from orrery.plans.spec import Alias, Calibration, Dimension, Pattern, VersionError
from orrery.sources.readers import SourceSpec, as_line, load_source
from orrery.sources.store import Store

VERSION_PREFIX = "0.1"
FEATURE = re.compile(r"(?P<metric>\w+)(?::(?P<column>\w+))?(?P<options>(?::\w+=\w+)*)")
WINDOW_AGGREGATIONS = ("max", "mean", "last")


@dataclass(frozen=True)
class Feature:
    """A derived dimension: metric[:column][:window=7d][:agg=max]."""

    name: str
    metric: str
    column: str | None = None
    window: str | None = None
    aggregation: str = "max"


def parse_feature(name: str, text: str) -> Feature:
    match = FEATURE.fullmatch(text.strip())
    if not match:
        raise ValueError(f"not a feature: {text!r}")
    options = dict(o.split("=") for o in filter(None, match["options"].split(":")))
    unknown = set(options) - {"window", "agg"}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    metric = "mean" if match["metric"] == "avg" else match["metric"]
    if metric not in derived.METRICS and metric not in derived.GAPS:
        raise ValueError(f"unknown metric: {metric}")
    if match["column"] is None and metric not in ("count", *derived.GAPS):
        raise ValueError(f"metric {metric} needs a column")
    if "window" in options:
        seconds(options["window"])
    aggregation = options.get("agg", "max")
    if aggregation not in WINDOW_AGGREGATIONS:
        raise ValueError(f"unknown window aggregation: {aggregation}")
    return Feature(name, metric, match["column"], options.get("window"), aggregation)


@dataclass(frozen=True)
class LineSpec:
    line_id: str
    source: str
    key: str
    role: str = "anchor"
    columns: dict[str, str] = field(default_factory=dict)
    time: str | None = None


@dataclass(frozen=True)
class PatternSpec:
    pattern_id: str
    line: str
    event_line: str | None = None
    foreign_key: str | None = None
    features: tuple[Feature, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class BuildSpec:
    version: str
    sources: dict[str, SourceSpec]
    lines: dict[str, LineSpec]
    patterns: dict[str, PatternSpec]
    aliases: dict[str, dict] = field(default_factory=dict)
    composite_lines: dict[str, dict] = field(default_factory=dict)
    #: Chain lines: event_line, source, target, seeds or none for those of high fan-out, hops, window_hours, features.
    chain_lines: dict[str, dict] = field(default_factory=dict)
    #: Edge tables by event line: source, target, time, amount; `false` where an event line is to have none.
    edges: dict[str, dict | bool] = field(default_factory=dict)
    #: Graph features by anchor line: event_line, source, target.
    graph_features: dict[str, dict] = field(default_factory=dict)
    #: Time slices by pattern: width, such as 90d.
    temporal: dict[str, dict] = field(default_factory=dict)


def load_text(text: str) -> dict:
    """JSON, or YAML where its library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as error:
            raise ValueError("the specification is not JSON, and no YAML library is installed") from error
        return yaml.safe_load(text)


def parse(raw: dict) -> BuildSpec:
    """A specification from its parsed text; raises ValueError on unknown references and fields."""
    version = str(raw.get("version", ""))
    if not version.startswith(VERSION_PREFIX):
        raise VersionError(f"version {version!r} is not supported")
    sources = {n: SourceSpec(**{k: tuple(v) if k == "joins" else v for k, v in x.items()}) for n, x in raw.get("sources", {}).items()}
    lines = {n: LineSpec(n, **x) for n, x in raw.get("lines", {}).items()}
    patterns = {}
    for n, x in raw.get("patterns", {}).items():
        features = tuple(parse_feature(k, v) for k, v in x.get("features", {}).items())
        dimensions = tuple(Dimension(**d) for d in x.get("dimensions", ()))
        patterns[n] = PatternSpec(n, x["line"], x.get("event_line"), x.get("foreign_key"), features, dimensions, x.get("options", {}))
    rest = {n: raw.get(n, {}) for n in ("aliases", "composite_lines", "chain_lines", "edges", "graph_features", "temporal")}
    spec = BuildSpec(version, sources, lines, patterns, **rest)
    problems = validate(spec)
    if problems:
        raise ValueError("; ".join(problems))
    return spec


def validate(spec: BuildSpec) -> list[str]:
    """What is wrong with a specification, without reading any data."""
    problems = [f"line {x.line_id}: no source {x.source}" for x in spec.lines.values() if x.source not in spec.sources]
    problems += [f"line {x.line_id}: role is anchor or event" for x in spec.lines.values() if x.role not in ("anchor", "event")]
    problems += [f"line {x.line_id}: the key must be among the columns" for x in spec.lines.values() if x.columns and x.key not in x.columns]
    known = {*spec.lines, *spec.composite_lines, *spec.chain_lines}
    problems += [f"{kind} {n}: no event line {x.get('event_line')}" for kind, part in (("chain line", spec.chain_lines), ("graph features", spec.graph_features)) for n, x in part.items() if x.get("event_line") not in spec.lines]
    problems += [f"{kind} {n}: needs source and target" for kind, part in (("chain line", spec.chain_lines), ("graph features", spec.graph_features)) for n, x in part.items() if not {"source", "target"} <= x.keys()]
    problems += [f"edges: no event line {n}" for n in spec.edges if n not in spec.lines]
    problems += [f"temporal: no pattern {n} with features over time" for n in spec.temporal if n not in spec.patterns or not spec.patterns[n].features or not spec.lines.get(spec.patterns[n].event_line, LineSpec("", "", "")).time]
    for p in spec.patterns.values():
        if p.line not in known:
            problems.append(f"pattern {p.pattern_id}: no line {p.line}")
        if p.features and p.event_line not in spec.lines:
            problems.append(f"pattern {p.pattern_id}: no event line {p.event_line}")
        if p.event_line in spec.lines and any(f.window or f.metric in derived.GAPS for f in p.features) and not spec.lines[p.event_line].time:
            problems.append(f"pattern {p.pattern_id}: the event line has no time")
        if not p.features and not p.dimensions:
            problems.append(f"pattern {p.pattern_id}: no dimension")
    for n, c in spec.composite_lines.items():
        if c.get("event_line") not in spec.lines or len(c.get("keys", ())) < 2:
            problems.append(f"composite line {n}: needs an event line and two keys")
    problems += [f"alias {n}: no pattern {a.get('pattern')}" for n, a in spec.aliases.items() if a.get("pattern") not in spec.patterns]
    return problems


def foreign_key(pattern: PatternSpec, events: DataFrame, key: str) -> str:
    """The declared key, else a column of the events named like the anchor's key or line."""
    singular = pattern.line.removesuffix("s")
    for name in (pattern.foreign_key, key, f"{singular}_id", f"{singular}_key"):
        if name and name in events.columns:
            return name
    raise ValueError(f"pattern {pattern.pattern_id}: no foreign key to {pattern.line}")


@dataclass
class Population:
    pattern: Pattern
    calibration: Calibration
    geometry: DataFrame
    slices: DataFrame | None = None


def build(spark: SparkSession, spec: BuildSpec, base: str | None = None, store: Store | None = None) -> dict[str, Population]:
    """All populations of a specification; with a store, points, geometries, calibrations and aliases are written."""
    raw = {n: load_source(spark, s, base) for n, s in spec.sources.items()}
    tables = {n: as_line(raw[x.source], x.key, x.columns or None) for n, x in spec.lines.items()}
    for n, c in spec.composite_lines.items():
        tables[n] = derived.composite_line(tables[c["event_line"]], c["keys"], c.get("separator", "→"))
    edges = edge_tables(spec, tables)
    for n, c in spec.chain_lines.items():
        own = graph.extract_edges(tables[c["event_line"]], c["source"], c["target"], "primary_key", _time_of(spec, c["event_line"]), c.get("amount"))
        seeds = c.get("seeds") or [r.key for r in graph.chain_seeds(own).where("is_fan_out").select("key").collect()]  # the top share of entities
        found = graph.discover_chains(own, seeds, c.get("hops", 3), c.get("least", 2), c.get("window_hours", 168))
        tables[n] = graph.chain_line(found, c.get("features"))
    built = {}
    for name, p in spec.patterns.items():
        rows = tables[p.line].withColumnRenamed("primary_key", p.line + "_key")
        key = p.line + "_key"
        if p.line in spec.graph_features:
            g = spec.graph_features[p.line]
            events = tables[g["event_line"]]
            rows = derived.graph_features(rows, key, events.withColumns({g["source"]: F.col(g["source"]).cast("string"), g["target"]: F.col(g["target"]).cast("string")}), g["source"], g["target"])
        if p.features:
            rows = with_features(spec, p, rows, key, tables)
        dimensions = p.dimensions + tuple(Dimension(f.name) for f in p.features)
        pattern = Pattern(name, key, dimensions, **p.options)
        rows = rows.persist()
        calibration = calibrate.calibrate(rows, pattern)
        geometry = calibrate.geometry(rows, pattern, calibration)
        if store is not None:
            store.write("geometry", name, geometry, sort_by=[F.desc("norm")])
            store.write_json(f"calibration-{name}", calibration.as_dict())
            geometry = store.read("geometry", name)
        rows.unpersist()
        built[name] = Population(pattern, calibration, geometry)
        if name in spec.temporal:
            line = spec.lines[p.event_line]
            plain = {f.name: (f.metric, f.column) for f in p.features if not f.window and f.metric in derived.METRICS}
            if set(plain) != set(pattern.names):
                raise ValueError(f"temporal {name}: all dimensions must be plain features")
            events = tables[p.event_line].withColumn("__fk", F.col(foreign_key(p, tables[p.event_line], spec.lines[p.line].key)).cast("string"))
            slices = temporal.snapshots(events, "__fk", key, epoch(F.col(line.time)), float(seconds(spec.temporal[name].get("width", "90d"))), plain, calibration.edge_max, calibration, list(pattern.names))
            if store is not None:
                store.append_temporal(name, slices)
                slices = store.read("temporal", name)
            built[name].slices = slices
    if store is not None:
        for n, t in edges.items():
            store.write("edges", n, t, sort_by=["from_key", "timestamp"])
        store.write_json("description", describe(spec, built))
        for n, t in tables.items():
            store.write("points", n, t, sort_by=["primary_key"])
        for n, a in spec.aliases.items():
            own = built[a["pattern"]]
            alias = Alias.of_dimension(n, own.pattern, a["dimension"], a["threshold"]) if "dimension" in a else Alias(n, a["pattern"], tuple(a["normal"]), a["bias"])
            store.write_json(f"alias-{n}", calibrate.alias_statistics(own.geometry, own.pattern, alias))
    return built


def _time_of(spec: BuildSpec, line: str):
    return epoch(F.col(spec.lines[line].time)) if spec.lines[line].time else None


def edge_tables(spec: BuildSpec, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The edge table of each event line that has one: declared, that of its graph features, or of two keys to one line."""
    found = {}
    for name, line in spec.lines.items():
        if line.role != "event":
            continue
        relations = {d.column: d.line for p in spec.patterns.values() if p.line == name for d in p.dimensions if d.line and d.column}
        declared = spec.edges.get(name)
        features = next((g for g in spec.graph_features.values() if g["event_line"] == name), None)
        columns = graph.edge_columns(tables[name], relations, declared if isinstance(declared, dict) else None, features, declared is False)
        if columns:
            time = epoch(F.col(columns["time"])) if columns["time"] else None
            found[name] = graph.extract_edges(tables[name], columns["source"], columns["target"], "primary_key", time, columns["amount"])
    return found


def describe(spec: BuildSpec, built: dict[str, Population]) -> dict:
    """What a store holds, for readers without the specification."""
    return {
        "version": spec.version,
        "lines": {n: {"role": x.role, "key": x.key, "time": x.time} for n, x in spec.lines.items()} | {n: {"role": "anchor", "chains_of": c["event_line"]} for n, c in spec.chain_lines.items()},
        "patterns": {n: {"key": p.pattern.key, "dimensions": list(p.pattern.names), "theta": p.calibration.theta, "rows": p.calibration.rows, "temporal": p.slices is not None} for n, p in built.items()},
        "aliases": spec.aliases,
    }


def load_mapping(path: str) -> BuildSpec:
    """A mapping file of the older kind: `objects` (name: source, key, columns, role, time) and `patterns` as today."""
    with open(path, encoding="utf-8") as file:
        raw = load_text(file.read())
    objects = raw.pop("objects", {})
    raw.setdefault("version", VERSION_PREFIX)
    raw["sources"] = raw.get("sources", {}) | {n: {"path": x["source"]} for n, x in objects.items()}
    raw["lines"] = raw.get("lines", {}) | {n: {"source": n, "key": x["key"]} | {k: x[k] for k in ("columns", "role", "time") if k in x} for n, x in objects.items()}
    return parse(raw)


def with_features(spec: BuildSpec, p: PatternSpec, rows: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Anchors with their features: plain metrics in one aggregation, windowed ones and gaps after."""
    events, line = tables[p.event_line], spec.lines[p.event_line]
    if p.line in spec.composite_lines:
        c = spec.composite_lines[p.line]
        events = events.withColumn("__fk", composite_key([F.col(k) for k in c["keys"]], c.get("separator", "→")))
        fk = "__fk"
    else:
        fk = foreign_key(p, events, spec.lines[p.line].key)
        events = events.withColumn("__fk", F.col(fk).cast("string"))
        fk = "__fk"
    plain = {f.name: (f.metric, f.column) for f in p.features if not f.window and f.metric in derived.METRICS}
    if plain:
        rows = derived.derived_batch(rows, key, events, fk, plain)
    time = epoch(F.col(line.time)) if line.time else None
    for f in p.features:
        if f.metric in derived.GAPS:
            rows = derived.inter_event_times(rows, key, events, fk, time, [f.metric]).withColumnRenamed(f.metric, f.name)
        elif f.window:
            rows = derived.windowed(rows, key, events, fk, time, f.window, f.name, (f.metric, f.column), f.aggregation)
    return rows
