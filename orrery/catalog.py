"""The navigator: built populations by name, a position, and the engine's operators as methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import observe, scan, similar
from orrery.plans.config import Population
from orrery.plans.spec import Alias, EntityNotFound, NavigationError, NoAliveEdge, PositionError
from orrery.sources.readers import alive_edges


class Navigator:
    """Queries over built populations; methods give DataFrames, and steps move the position."""

    def __init__(self, populations: dict[str, Population], aliases: dict[str, Alias] | None = None):
        self.populations, self.aliases = populations, aliases or {}
        self.position: tuple[str, str, object] | None = None

    def _of(self, pattern_id: str) -> Population:
        if pattern_id not in self.populations:
            raise NavigationError(f"no pattern {pattern_id!r}; there are {', '.join(sorted(self.populations))}")
        return self.populations[pattern_id]

    def entity(self, pattern_id: str, key) -> dict:
        own = self._of(pattern_id)
        row = own.geometry.where(F.col(own.pattern.key) == F.lit(key)).first()
        if row is None:
            raise EntityNotFound(f"{key} in {pattern_id}")
        return row.asDict()

    def goto(self, pattern_id: str, key) -> dict:
        """The position becomes the entity."""
        found = self.entity(pattern_id, key)
        self.position = ("point", pattern_id, key)
        return found

    def walk(self, direction: str = "+"):
        """Go on to the next key in order, or with "-" to the previous one; None at the end."""
        if self.position is None or self.position[0] != "point":
            raise PositionError("a walk starts from a point")
        _, pattern_id, key = self.position
        own = self._of(pattern_id)
        column = F.col(own.pattern.key)
        rows = own.geometry.where(column > F.lit(key) if direction == "+" else column < F.lit(key))
        found = rows.agg((F.min if direction == "+" else F.max)(own.pattern.key)).first()[0]
        if found is not None:
            self.position = ("point", pattern_id, found)
        return found

    def dive(self, slices: DataFrame, key_column: str, moment: float | None = None) -> DataFrame:
        """The position becomes the entity's history up to the moment, which is returned in order."""
        if self.position is None or self.position[0] != "point":
            raise PositionError("a dive starts from a point")
        _, pattern_id, key = self.position
        rows = slices.where(F.col(key_column) == F.lit(key))
        self.position = ("solid", pattern_id, key)
        return (rows if moment is None else rows.where(F.col("window_start") <= moment)).orderBy("slice")

    def emerge(self):
        """Back from a history to its point."""
        if self.position is None or self.position[0] != "solid":
            raise PositionError("only a history is left by emerging")
        self.position = ("point", *self.position[1:])
        return self.position[2]

    def jump(self, rows: DataFrame, line: str, index: int = 0) -> str:
        """Key of the position's n-th alive edge to a line, from rows with `edges`."""
        if self.position is None:
            raise PositionError("a jump needs a position")
        own = self._of(self.position[1])
        row = rows.where(F.col(own.pattern.key) == F.lit(self.position[2])).select(alive_edges(F.col("edges")).alias("e")).first()
        keys = [e["point_key"] for e in (row["e"] if row else ()) if e["line_id"] == line]
        if not keys:
            raise NoAliveEdge(f"no alive edge to {line}")
        if index >= len(keys):
            raise NavigationError(f"{len(keys)} alive edges to {line}")
        return keys[index]

    def anomalies(self, pattern_id: str, radius: float = 1.0, top: int = 10, offset: int = 0) -> DataFrame:
        own = self._of(pattern_id)
        return similar.anomalies(own.geometry, own.pattern.key, radius, top, offset)

    def boundary(self, alias_id: str, direction: str = "both", top: int = 10) -> DataFrame:
        if alias_id not in self.aliases:
            raise NavigationError(f"no alias {alias_id!r}")
        alias = self.aliases[alias_id]
        own = self._of(alias.pattern_id)
        return similar.boundary(own.geometry, own.pattern.key, own.pattern.deltas, alias.normal, alias.bias, direction, top)

    def hubs(self, pattern_id: str, top: int = 10) -> DataFrame:
        own = self._of(pattern_id)
        return observe.hubs(own.geometry, own.pattern.key, own.pattern.shapes, [own.calibration.edge_max.get(n, 1.0) for n in own.pattern.names], top)

    def clusters(self, pattern_id: str, k: int = 5) -> DataFrame:
        own = self._of(pattern_id)
        return similar.clusters(own.geometry, own.pattern.key, own.pattern.deltas, k or similar.best_k(own.geometry, own.pattern.deltas))[1]

    def similar(self, pattern_id: str, key, top: int = 5, condition: Column | None = None) -> DataFrame:
        own = self._of(pattern_id)
        return similar.nearest(own.geometry, own.pattern.key, own.pattern.deltas, key, top, condition)

    def contrast(self, pattern_id: str, in_a: Column, in_b: Column | None = None) -> DataFrame:
        own = self._of(pattern_id)
        return similar.contrast(own.geometry, own.pattern.names, own.pattern.deltas, in_a, in_b)

    def explain(self, pattern_id: str, key) -> dict:
        self.entity(pattern_id, key)
        own = self._of(pattern_id)
        row = similar.explain(own.geometry.where(F.col(own.pattern.key) == F.lit(key)), own.pattern.key, own.pattern.names, own.pattern.deltas).first()
        return row.asDict() if row else {own.pattern.key: key, "severity": "none"}

    def overview(self) -> DataFrame:
        return observe.sphere_overview({n: p.geometry for n, p in self.populations.items()})

    def data_quality(self, pattern_id: str) -> DataFrame:
        own = self._of(pattern_id)
        return observe.data_quality(own.geometry, own.pattern.names, own.pattern.shapes, own.pattern.deltas)

    def discover(self, pattern_id: str, borderline: bool = False, contagion: DataFrame | None = None, rank: float = 80.0) -> list[DataFrame]:
        """Sources that say something about the entities of a population: itself and others with its key, populations of
        composite keys and of chains, and the contagion statistics of a graph (key, neighbor_count, ...) if given."""
        home, sources = self._of(pattern_id), []
        for n, p in sorted(self.populations.items()):
            kind = "direct" if p.pattern.key == home.pattern.key else scan.key_type(p.geometry, p.pattern.key)
            if kind == "chain":
                sources.append(scan.chains(p.geometry.withColumn("__chain", F.split("chain_keys", ",")), n, "__chain"))
            elif kind == "composite":
                sources.append(scan.composite(p.geometry, n, p.pattern.key))
            elif p.pattern.key == home.pattern.key:
                sources.append(scan.direct(p.geometry, n, p.pattern.key))
                if borderline:
                    sources.append(scan.borderline(p.geometry, f"{n}-borderline", p.pattern.key, rank))
        if contagion is not None:
            sources.append(scan.contagious(contagion, "graph", "key"))
        return sources

    def edge_pattern_of(self, pattern_id: str) -> str | None:
        """The event population whose relations name the anchor population's line most often; None if none does."""
        own = self._of(pattern_id)
        counts = {n: sum(d.line == own.pattern.pattern_id or d.line == own.pattern.key for d in p.pattern.dimensions) for n, p in sorted(self.populations.items()) if p.pattern.pattern_type == "event"}
        best = max(counts, key=counts.get, default=None)
        return best if best and counts[best] else None

    def anchor_pattern_of(self, event_pattern: str) -> str | None:
        """The anchor population that an event population's relations name most often; None if they name none."""
        lines = [d.line for d in self._of(event_pattern).pattern.dimensions if d.line]
        found = [n for n, p in sorted(self.populations.items()) if p.pattern.pattern_type != "event" and (n in lines or p.pattern.key in lines)]
        return max(found, key=lambda n: lines.count(n) + lines.count(self.populations[n].pattern.key), default=None)

    def passive_scan(self, key: str, threshold: int = 2, top: int = 100, borderline: bool = False) -> DataFrame:
        """Entities that several populations with the key flag."""
        own = [(n, p) for n, p in sorted(self.populations.items()) if p.pattern.key == key]
        if not own:
            raise NavigationError(f"no pattern has the key {key!r}")
        sources = [scan.direct(p.geometry, n, key) for n, p in own]
        if borderline:
            sources += [scan.borderline(p.geometry, f"{n}-borderline", key) for n, p in own]
        return scan.screen(sources, threshold, top)
