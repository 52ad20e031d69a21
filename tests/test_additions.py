"""Operators without SQL, and the parts of the engine that queries do not reach, against brute force and small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.catalog import Navigator
from orrery.functions import expressions as X
from orrery.operators import calibrate, graph, observe, scan, similar, temporal
from orrery.operators.quantiles import with_global_rank
from orrery.plans import config, registry
from orrery.plans import lines as L
from orrery.plans import time_queries as T
from orrery.plans.spec import CorruptedTable, MissingTable, Pattern
from orrery.sources import readers
from orrery.sources.store import Store


@pytest.fixture(scope="module")
def geo(spark, data):
    return L.customer_geometry(spark, data)[0].toPandas()


@pytest.fixture(scope="module")
def slices(spark, data):
    return T.slices(spark, data)[0].toPandas().sort_values(["c_custkey", "slice"])


def run(spark, data, name):
    return registry.queries()[name](spark, data).collect()


# queries without SQL


def test_mahalanobis_norms(spark, data, geo):
    shapes = geo[L.CUSTOMERS.shapes].to_numpy()
    moved = shapes - shapes.mean(axis=0)
    inverse = np.linalg.inv(np.cov(shapes.T) + calibrate.RIDGE * np.eye(shapes.shape[1]))
    norms = dict(zip(geo.c_custkey, np.sqrt(np.einsum("ij,jk,ik->i", moved, inverse, moved))))
    theta = np.quantile(list(norms.values()), 0.95)
    for r in run(spark, data, "calibration_mahalanobis"):
        assert math.isclose(r.norm, norms[r.c_custkey], rel_tol=1e-4, abs_tol=1e-5)
        assert r.is_anomaly == (norms[r.c_custkey] >= theta - 1e-9) or abs(norms[r.c_custkey] - theta) < 1e-4


def test_time_warping(spark, data, slices):
    a, b = (slices[slices.c_custkey == k][L.CUSTOMERS.deltas].to_numpy() for k in (3, 8))
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    if len(a) and len(b):
        assert [r.distance for r in run(spark, data, "compare_temporal")] == [pytest.approx(cost[-1, -1], abs=1e-4)]


def test_detours_of_trajectories(spark, data, slices):
    expected = {}
    for key, own in slices.groupby("c_custkey"):
        norms = own.norm.to_numpy()
        if len(norms) >= 2:
            expected[key] = np.abs(np.diff(norms)).sum() - abs(norms[-1] - norms[0])
    found = run(spark, data, "trajectory_anomaly")
    assert {r.c_custkey: pytest.approx(r.detour, abs=1e-5) for r in found} == expected
    short = slices.groupby("c_custkey").size()
    assert all((r["shape"] == "insufficient_data") == (short[r.c_custkey] < 3) for r in found)


def test_clusters_are_those_of_the_nearest_centre(spark, data, geo):
    members, summary = similar.clusters(L.customer_geometry(spark, data)[0], "c_custkey", L.CUSTOMERS.deltas, 5)
    of = {r.c_custkey: r.cluster for r in members.collect()}
    vectors, labels = geo[L.CUSTOMERS.deltas].to_numpy(), geo.c_custkey.map(of).to_numpy()
    centres = np.stack([vectors[labels == c].mean(axis=0) for c in range(max(of.values()) + 1)])
    distances = np.linalg.norm(vectors[:, None] - centres, axis=2)
    assert (distances[np.arange(len(labels)), labels] <= distances.min(axis=1) + 0.05).mean() > 0.98
    sizes = {r.cluster: r["size"] for r in summary.collect()}
    assert sizes == {c: int((labels == c).sum()) for c in sizes} and sizes == {r.cluster: r["size"] for r in run(spark, data, "pi8_attract_cluster")}
    assert list(sizes[c] for c in sorted(sizes)) == sorted(sizes.values(), reverse=True)


def test_number_of_clusters_and_drift_clusters(spark, data, slices):
    assert 2 <= run(spark, data, "find_optimal_k")[0].k <= 6
    moved = sum(np.linalg.norm(own[L.CUSTOMERS.deltas].iloc[-1] - own[L.CUSTOMERS.deltas].iloc[0]) > 0 for _, own in slices.groupby("c_custkey") if len(own) >= 2)
    found = run(spark, data, "collective_drift")
    assert sum(r["size"] for r in found) == moved and all(-1 <= r.mean_cosine <= 1 + 1e-9 for r in found)


def test_cohort_and_similar_trajectories(spark, data):
    rows, c = L.supplier_geometry(spark, data)
    edges = L.hand_overs(spark, data).where("amount > 90000").toPandas()
    connected = {*edges[edges.from_key == 7].to_key, *edges[edges.to_key == 7].from_key} - {7}
    found = run(spark, data, "find_witness_cohort")
    near = rows.toPandas().set_index("s_suppkey")[L.SUPPLIERS.deltas]
    assert {r.s_suppkey for r in found} == set(near.index) - connected - {7} if len(near) <= 10 else found
    for r in found:
        assert math.isclose(r.distance, np.linalg.norm(near.loc[r.s_suppkey] - near.loc[7]), rel_tol=1e-6, abs_tol=1e-9)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert len(run(spark, data, "pi10_attract_trajectory")) > 0


# graph


def test_influence_takes_the_stronger_longer_path(spark):
    edges = [("A", "B", "1"), ("A", "C", "2"), *[("C", "B", f"x{i}") for i in range(40)], ("B", "D", "3"), ("D", "A", "4"), ("E", "E", "5")]
    table = spark.createDataFrame([(f, t, e, 0.0, 1.0) for f, t, e in edges], "from_key string, to_key string, event_key string, timestamp double, amount double")
    points = {"A": (1.0, 0.0), "B": (0.0, 1.0), "C": (2.0, 2.0), "D": (0.1, 2.0), "E": (1.0, 1.0)}
    geo = spark.createDataFrame([(k, *v) for k, v in points.items()], "k string, x double, y double")
    theta = 0.5
    counts = {}
    for f, t, _ in edges:
        if f != t:
            counts[f, t] = counts[t, f] = counts.get((f, t), 0) + 1

    def hop(a, b):
        a, b = np.array(points[a]), np.array(points[b])
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        high_a, high_b = np.abs(a) > theta / 2**0.5, np.abs(b) > theta / 2**0.5
        either = (high_a | high_b).sum()
        return 0.4 * a @ b / (na * nb) + 0.3 * ((high_a & high_b).sum() / either if either else 0) + 0.3 * min(na, nb) / max(na, nb)

    best = {}

    def go(key, score, depth):
        if depth < 3:
            for (a, b), n in counts.items():
                if a == key and b != "A":
                    s = score * 0.7 * max(hop(a, b), 0.01) * (1 + math.log(n))
                    if s >= 0.001:
                        if s > best.get(b, (0, 0))[0]:
                            best[b] = (s, depth + 1)
                        go(b, s, depth + 1)

    go("A", 1.0, 0)
    found = {r.key: r for r in graph.propagate_influence(table, geo, "k", ["x", "y"], theta, ["A"]).collect()}
    assert {k: (pytest.approx(r.score), r.depth) for k, r in found.items()} == best
    assert found["B"].depth == 2 and found["B"].tx_count == 40 and found["D"].depth == 3


def test_influence_returns_every_entity_it_reaches(spark):
    n = 10_050
    table = spark.range(1, n + 1).selectExpr("0L AS from_key", "id AS to_key", "id AS event_key", "0.0D AS timestamp", "1.0D AS amount")
    geo = spark.range(n + 1).selectExpr("id AS k", "1.0D AS x", "1.0D AS y")
    found = graph.propagate_influence(table, geo, "k", ["x", "y"], 1.0, [0])
    assert found.count() == n and found.where("depth = 1 and round(score, 9) = 0.7").count() == n
    assert graph.propagate_influence(table, geo, "k", ["x", "y"], 1.0, [0], most=3).count() == 3


def test_edge_columns(spark):
    events = spark.createDataFrame([], "a string, b string, c string, day date, price double")
    inferred = {"time": "day", "amount": "price"}
    assert graph.edge_columns(events, {"a": "x", "b": "y"}) is None and graph.edge_columns(events, {"a": "x", "b": "x"}, disabled=True) is None
    assert graph.edge_columns(events, {"c": "y", "a": "x", "b": "x"}) == inferred | {"source": "a", "target": "b"}
    assert graph.edge_columns(events, {}, {"source": "b", "target": "c", "amount": None}) == {"source": "b", "target": "c", "time": "day", "amount": None}
    assert graph.edge_columns(events, {}, None, {"source": "c", "target": "a"})["source"] == "c"


# ranks


@pytest.mark.parametrize("parts", [4, 64])
def test_ranks_of_frequent_values(spark, parts):
    values = [0.0] * 500 + [5.0] * 300 + [float(i % 97) for i in range(400)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(5)
    found = {r.i: (r.rank_below, r.n) for r in with_global_rank(rows, "v", rows="n", parts=parts).collect()}
    assert found == {i: (sum(w < v for w in values), len(values)) for i, v in enumerate(values)}


# sources and store


def test_transforms_skip_what_is_missing_and_scripts_are_cached(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a long, b string")
    got = readers.transform(rows, {"nothing": {"cast": "int32"}, "b": {"fill_null": "7", "cast": "int64"}})
    assert got.columns == ["a", "b"] and got.first()["b"] == 7
    script = tmp_path / "source.py"
    script.write_text("def prepare(spark):\n    return spark.range(3)\n")
    assert readers.run_script(spark, str(script)).count() == readers.run_script(spark, str(script)).count() == 3
    script.write_text("def prepare(spark):\n    return spark.range(44)\n")
    assert readers.run_script(spark, str(script)).count() == 44 and readers.run_script(spark, str(script), cache=False).count() == 44


def test_store_appends_without_rewriting_and_detects_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("points", "p", spark.range(3))
    first = store.manifest()["tables"]["points/p"][0]
    session = store.session()
    assert store.append("points", "p", spark.range(3, 5)) == 2 and store.manifest()["tables"]["points/p"][1][:1] == first
    assert session.read("points", "p").count() == 3 and store.read("points", "p").count() == 5 and store.read("points", "p", 1).count() == 3
    with pytest.raises(CorruptedTable):
        store.write("points", "p", spark.range(1), expected=1)
    # Another writer commits between this one's look at the state and its own commit: both versions stay.
    looked = store._state
    store._state = lambda: (Store(spark, store.root).append("points", "p", spark.range(9, 10)), setattr(store, "_state", looked), looked() - 1)[2]
    store.append("points", "q", spark.range(2))
    assert store.read("points", "p").count() == 6 and store.read("points", "q").count() == 2
    assert store.upsert("points", "p", spark.range(0, 1), "id") == 4 and store.read("points", "p").count() == 6
    assert sum(b.num_rows for b in store.batches("points", "p", ["id"], 4)) == 6 and max(b.num_rows for b in store.batches("points", "p", rows=4)) == 4
    with pytest.raises(MissingTable):
        store.read("points", "p", 9)


def test_temporal_slices_of_agents(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path / "t")), spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k long, slice long")
    for agent in (None, "a", "b"):
        store.append_temporal("p", rows, agent)
    store.purge_temporal("p", "a")
    assert {r.agent_id for r in store.read("temporal", "p").collect()} == {None, "b"}
    store.purge_temporal("p")
    store.compact_temporal("p", "k")
    assert sorted((r.k, r.slice) for r in store.read("temporal", "p").collect()) == [(1, 0), (1, 1), (2, 0)]


# monitoring, screening, forecasts


def test_alerts_of_regimes_and_staleness(spark):
    changes = spark.createDataFrame([(1, 100.0), (2, 100 * 86_400.0)], "slice long, window_start double")
    assert observe.regime_alert(changes, 101 * 86_400).first().asDict() == {"alert": "regime_changepoint", "value": 1.0, "raised": True}
    assert not observe.regime_alert(changes, 900 * 86_400).first()["raised"]
    raised = {d: [n for n, _, r in observe.staleness_alerts(d) if r] for d in (0.01, 0.1, 0.3)}
    assert raised == {0.01: [], 0.1: ["calibration_stale"], 0.3: ["calibration_blocked"]}
    assert observe.effective_sample_size(1000, 0.1234) == 123 and observe.effective_sample_size(3, 0.01) == 1
    times = spark.createDataFrame([(0,), (1_500_000,), (None,)], "us long").select(X.iso(F.col("us")).alias("t")).collect()
    assert [r.t for r in times] == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00", None]


def test_composite_keys(spark):
    rows = [("a→b", 3.0, True), ("b→c", 1.0, False), ("c→b", 4.0, True), ("x→y", 9.0, True)]
    geo = spark.createDataFrame(rows, "k string, norm double, is_anomaly boolean").withColumn("theta", F.lit(2.0))
    assert scan.composite_profile(geo, "k", "b").first().asDict() == {"related": 3, "anomalous": 2, "max_norm": 4.0, "anomalous_keys": ["a→b", "c→b"]}
    assert scan.composite_profile(geo, "k", "nobody").collect() == []
    assert scan.key_type(geo, "k") == "composite" and scan.key_type(geo.withColumn("k", F.lit("a")), "k") == "direct" and scan.key_type(geo.withColumn("chain_keys", F.lit("a")), "k") == "chain"
    ranks = spark.createDataFrame([("a", 50.0), ("c", 70.0)], "e string, delta_rank_pct double")
    assert scan.connected_risk(geo, "k", "b", ranks, "e", most=None).first().asDict() == {"counterparties": 2, "mean_rank": 60.0}


def test_forecast_providers(spark, data):
    rows, c = T.slices(spark, data)
    own = {r.c_custkey: r.predicted_norm for r in temporal.forecast(rows, "c_custkey", L.CUSTOMERS.deltas, c.theta).collect()}
    found = {r.c_custkey: r.predicted_norm for r in temporal.forecast_with(rows, "c_custkey", L.CUSTOMERS.deltas, temporal.Extrapolation()).collect()}
    assert found.keys() == own.keys() and all(math.isclose(found[k], own[k], rel_tol=1e-6, abs_tol=1e-6) for k in own)
    assert temporal.forecast_population(rows, temporal.Extrapolation()).first()["windows"] == rows.select("slice").distinct().count()


def test_components_have_statistics_of_their_own(spark):
    rng = np.random.default_rng(1)
    values = [*rng.uniform(1, 3, 200), *rng.uniform(80, 90, 100)]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, a double")
    pattern = Pattern("p", "k", (L.Dimension("a"),))
    placed, found = calibrate.component_calibration(rows, pattern, 2)
    assert sorted(g["rows"] for g in found.groups.values()) == [100, 200]
    scored = calibrate.score(placed, calibrate.replace(pattern, group_by="component"), found)
    assert 0.02 < scored.agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0] < 0.08


# builds


SPEC = {
    "version": "0.1",
    "sources": {"supplier": {"path": "supplier.parquet"}, "lineitem": {"path": "moves.parquet"}},
    "lines": {"suppliers": {"source": "supplier", "key": "s_suppkey"}, "moves": {"source": "lineitem", "key": "event_key", "role": "event", "time": "day"}},
    "chain_lines": {"chains": {"event_line": "moves", "source": "from_key", "target": "to_key", "seeds": ["1"], "hops": 2, "amount": "amount"}},
    "graph_features": {"suppliers": {"event_line": "moves", "source": "from_key", "target": "to_key"}},
    "patterns": {
        "traders": {"line": "suppliers", "event_line": "moves", "foreign_key": "from_key", "features": {"n": "count", "sum": "sum:amount"}, "dimensions": []},
        "graph": {"line": "suppliers", "dimensions": [{"name": "in_degree"}, {"name": "out_degree"}]},
        "paths": {"line": "chains", "dimensions": [{"name": "hop_count"}, {"name": "n_keys"}, {"name": "amount_decay"}]},
    },
    "temporal": {"traders": {"width": "360d"}},
}


def test_build_with_chains_edges_features_and_time(spark, data, tmp_path):
    moves = L.hand_overs(spark, data).withColumn("day", F.timestamp_seconds("timestamp")).drop("timestamp").dropDuplicates(["event_key"])
    moves.write.parquet(str(tmp_path / "moves.parquet"))
    spark.read.parquet(f"{data}/supplier.parquet").write.parquet(str(tmp_path / "supplier.parquet"))
    store = Store(spark, str(tmp_path / "store"))
    built = config.build(spark, config.parse(SPEC), str(tmp_path), store)
    assert store.read("edges", "moves").count() == moves.count()
    chains = built["paths"].geometry
    assert chains.count() == graph.discover_chains(store.read("edges", "moves"), ["1"], 2).count() > 0
    assert built["traders"].slices.groupBy("suppliers_key").agg(F.count("slice")).count() == moves.select("from_key").distinct().count()
    degrees = {r.from_key: r.n for r in moves.groupBy(F.col("from_key").cast("string").alias("from_key")).agg(F.count_distinct("to_key").alias("n")).collect()}
    assert {r.suppliers_key: int(r.out_degree) for r in built["graph"].geometry.where("out_degree > 0").collect()} == degrees
    about = store.read_json("description")
    assert about["patterns"]["traders"]["temporal"] and about["lines"]["chains"]["chains_of"] == "moves"
    nav = Navigator(built)
    assert len(nav.discover("traders")) == 3 and scan.key_type(chains.withColumn("chain_keys", F.lit("")), "chains_key") == "chain"
    for change in ({"chain_lines": {"c": {"event_line": "none"}}}, {"edges": {"none": {}}}, {"temporal": {"paths": {}}}, {"graph_features": {"suppliers": {"event_line": "moves"}}}):
        with pytest.raises(ValueError):
            config.parse(SPEC | change)


def test_older_mapping_files(tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"objects": {"suppliers": {"source": "supplier.parquet", "key": "s_suppkey"}}, "patterns": {"p": {"line": "suppliers", "dimensions": [{"name": "s_acctbal"}]}}}))
    spec = config.load_mapping(str(path))
    assert spec.lines["suppliers"].key == "s_suppkey" and spec.sources["suppliers"].path == "supplier.parquet"
