import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators import aggregate as A
from orrery.operators import calibrate, derived, graph, scan, similar, temporal
from orrery.operators.quantiles import exact_quantiles, with_global_rank
from orrery.plans.spec import Alias, Dimension, EntityNotFound, MissingTable, Pattern
from orrery.sources import readers
from orrery.sources.store import Store
from orrery.streaming import tracker


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), "xy"[i % 2]) for i, (a, b) in enumerate(zip(rng.poisson(5, 400), rng.gamma(2, 50, 400)))]
    return spark.createDataFrame(rows, "k long, n double, v double, g string").cache()


PATTERN = Pattern("p", "k", (Dimension("n"), Dimension("v")))


def test_quantiles_match_numpy(spark, population, monkeypatch):
    values = np.array([r.v for r in population.collect()])
    wanted = {str(q): (F.col("v"), q) for q in (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)}
    for gathered in (20_000, 10):
        monkeypatch.setattr("orrery.operators.quantiles.GATHERED", gathered)
        for q, found in exact_quantiles(population, wanted).items():
            assert math.isclose(found, np.quantile(values, float(q)), rel_tol=1e-12)
    assert exact_quantiles(population.limit(0), wanted)["0.5"] is None


def test_global_rank(spark, population):
    ranked = with_global_rank(population.select("k", "n"), "n", "below", "rows", parts=5).collect()
    values = [r.n for r in ranked]
    assert all(r.below == sum(v < r.n for v in values) and r.rows == 400 for r in ranked)


def test_geometry_matches_numpy(spark, population):
    rows = population.orderBy("k").collect()
    raw = np.array([[r.n, r.v] for r in rows])
    cap = np.array([max(1, int(np.quantile(c[c > 0], 0.99))) for c in raw.T])
    shape = np.clip(raw, 0, cap) / cap
    delta = (shape - shape.mean(0)) / np.maximum(shape.std(0), 0.01)
    norm = np.sqrt((delta**2).sum(1))
    found = calibrate.geometry(population, PATTERN).orderBy("k").collect()
    assert np.allclose([r.norm for r in found], norm)
    assert [r.is_anomaly for r in found] == (norm.round(9) >= np.quantile(norm, 0.95).round(9)).tolist()
    assert all(abs(r.delta_rank_pct + 100 * r.conformal_p - 100) < 1e-9 for r in found)


def test_mahalanobis_whitens(spark, population):
    pattern = Pattern("m", "k", PATTERN.dimensions, mahalanobis=True)
    deltas = np.array([[r.delta_n, r.delta_v] for r in calibrate.geometry(population, pattern, ranks=False).collect()])
    assert np.allclose(np.cov(deltas.T), np.eye(2), atol=0.02)


def test_group_of_one_is_never_anomalous(spark):
    rows = spark.createDataFrame([(1, 5.0, 1.0, "a"), (2, 1.0, 2.0, "b"), (3, 2.0, 9.0, "b")], "k long, n double, v double, g string")
    found = calibrate.geometry(rows, Pattern("g", "k", PATTERN.dimensions, group_by="g"), ranks=False)
    assert not found.where("k = 1").first().is_anomaly


def test_weights_and_recalibration(spark, population):
    frozen = calibrate.calibrate(population, PATTERN)
    fresh = calibrate.recalibrate(calibrate.geometry(population, PATTERN, frozen, ranks=False), PATTERN, frozen)
    assert math.isclose(fresh.theta, frozen.theta, rel_tol=1e-9)
    assert all(w >= 1 for w in calibrate.calibrate(population, Pattern("w", "k", PATTERN.dimensions, weights="kurtosis")).weights)


def test_alias_and_errors(spark, population):
    geo = calibrate.geometry(population, PATTERN, ranks=False)
    assert calibrate.alias_statistics(geo, PATTERN, Alias.of_dimension("a", PATTERN, "n", 0.0))["population"] > 0
    with pytest.raises(ValueError):
        calibrate.alias_statistics(geo, PATTERN, Alias.of_dimension("a", PATTERN, "n", 99.0))
    with pytest.raises(ValueError):
        Pattern("x", "k", ())
    with pytest.raises(ValueError):
        Pattern("x", "k", (Dimension("a", "binary"), Dimension("b")))
    with pytest.raises(EntityNotFound):
        similar.nearest(geo, "k", PATTERN.deltas, -1)


def test_two_slots_count_twice(spark):
    rows = spark.createDataFrame([(1, "A", "B", 10.0), (2, "B", "C", 20.0), (3, "A", "C", 30.0), (4, "A", "A", 40.0), (5, "", None, 50.0)], "e long, f string, t string, amount double")
    line = A.EventLine(rows, "e", {"account": ("f", "t")})
    counts = {r.key: r.value for r in A.aggregate(line, "account").collect()}
    assert counts == {"A": 4.0, "B": 2.0, "C": 2.0}
    sums = {r.key: r.value for r in A.aggregate(line, "account", "sum:amount").collect()}
    assert sums == {"A": 120.0, "B": 30.0, "C": 50.0}
    low, high = ({r.key: r.value for r in A.aggregate(line, "account", m).collect()} for m in ("pct0:amount", "min:amount"))
    assert low == high


@pytest.mark.parametrize("options", [{"sort": "up"}, {"metric": "mode:amount"}, {"metric": "sum"}, {"group_by_2": "account"}, {"pivot": "f", "having": {"gt": 1}}, {"sample_size": 1, "sample_pct": 0.5}, {"time_from": "2020-01-01"}, {"event_filters": {"nope": 1}}, {"event_filters": {"f": {"not_null": True, "gt": 1}}}])
def test_aggregate_rejects(spark, options):
    line = A.EventLine(spark.createDataFrame([(1, "A", 1.0)], "e long, f string, amount double"), "e", {"account": ("f",)})
    with pytest.raises(ValueError):
        A.aggregate(line, "account", **options)


def test_empty_tables(spark):
    line = A.EventLine(spark.createDataFrame([], "e long, f string, amount double"), "e", {"account": ("f",)})
    assert A.aggregate(line, "account", "sum:amount").collect() == []
    empty = spark.createDataFrame([], "k long, n double, v double")
    assert calibrate.geometry(empty, PATTERN).collect() == []


def test_fisher(spark):
    got = spark.range(1).select(X.fisher_p(F.array(F.lit(0.03))).alias("one"), X.fisher_p(F.array(F.lit(0.2), F.lit(0.1))).alias("two"), X.fisher_p(F.array().cast("array<double>")).alias("none")).first()
    product = 0.02
    assert math.isclose(got.one, 0.03) and math.isclose(got.two, product * (1 - math.log(product))) and got.none == 1.0


@pytest.mark.parametrize(("norms", "shape"), [([1.0, 2.0], "insufficient_data"), ([1.0, 1.0, 1.0], "flat"), ([0.0, 1.0, 5.0, 1.0, 0.0], "arch"), ([5.0, 1.0, 0.0, 1.0, 5.0], "v_shape"), ([0.0, 1.0, 2.0, 3.0, 4.0], "linear_drift")])
def test_trajectory_shapes(spark, norms, shape):
    assert spark.range(1).select(temporal.classify_norms(F.array(*map(F.lit, norms)))).first()[0] == shape


def test_forecast_follows_a_line(spark):
    rows = spark.createDataFrame([(1, i, 3.0 * i, 4.0 * i) for i in range(6)], "k long, slice long, a double, b double")
    got = temporal.forecast(rows, "k", ["a", "b"], 25.0).first()
    assert math.isclose(got.predicted_norm, 30.0, rel_tol=1e-9) and math.isclose(got.r_squared, 1.0) and got.crosses


def test_dtw_of_equal_sequences_is_zero(spark):
    rows = spark.createDataFrame([(k, i, float(i)) for k in (1, 2) for i in range(4)] + [(3, 0, 9.0)], "k long, slice long, a double")
    assert temporal.dtw(rows, "k", ["a"], 1, 2).first().distance == 0.0
    assert temporal.dtw(rows, "k", ["a"], 1, 3).first().distance == 9 + 8 + 7 + 6


def edges(spark, rows):
    return spark.createDataFrame([(f, t, i, float(ts), a) for i, (f, t, ts, a) in enumerate(rows)], "from_key string, to_key string, event_key long, timestamp double, amount double")


def test_neighbours_in_blocks(spark, monkeypatch):
    geo = spark.createDataFrame([(i, float(i * i)) for i in range(12)], "k long, x double")
    whole = sorted(map(tuple, similar.neighbours_of(geo, geo, "k", ["x"], 2).collect()))
    monkeypatch.setattr(similar, "QUERY_ROWS", 5)
    assert sorted(map(tuple, similar.neighbours_of(geo, geo, "k", ["x"], 2).collect())) == whole and len(whole) == 24


def test_neighbours_by_trees_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEAF", 8)
    random = np.random.default_rng(3)
    points = np.concatenate([random.normal(size=(1500, 3)), random.integers(0, 4, (900, 3)).astype(float), np.zeros((400, 3))])
    geo = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(9_999, None, 0.0, 0.0)], "k long, x double, y double, z double")
    found = similar.neighbours_of(geo, geo.where("k % 5 = 0"), "k", ["x", "y", "z"], 4)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    expected = set()
    for q in range(0, len(points), 5):
        distance = np.sqrt(((points - points[q]) ** 2)[:, 0] + ((points - points[q]) ** 2)[:, 1] + ((points - points[q]) ** 2)[:, 2])
        best = [i for i in np.lexsort((np.arange(len(points)), distance)).tolist() if i != q][:4]
        expected |= {(q, i, float(distance[i]), rank) for rank, i in enumerate(best, 1)}
    assert {tuple(r) for r in found.collect()} == expected


def test_chains(spark):
    table = edges(spark, [("A", "B", 0, 1.0), ("B", "C", 3600, 2.0), ("C", "A", 7200, 4.0), ("B", "D", 10**9, 1.0)])
    found = {tuple(r["keys"]): r for r in graph.discover_chains(table, ["A"], hops=3).collect()}
    assert set(found) == {("A", "B", "C"), ("A", "B", "C", "A")}
    assert found["A", "B", "C", "A"].is_cyclic and found["A", "B", "C", "A"].amount_decay == 4.0


def test_chains_of_late_starts(spark):
    """Every start extends, however many are earlier; in both directions."""
    hour = 3600
    rows = [x for i in range(300) for x in (("A", f"B{i}", i * 200 * hour, 1.0), (f"B{i}", "C", (i * 200 + 1) * hour, 2.0))]
    chains = graph.discover_chains(edges(spark, rows), ["A"], hops=2)
    assert {tuple(r["keys"]) for r in chains.collect()} == {("A", f"B{i}", "C") for i in range(300)}
    assert graph.discover_chains(edges(spark, rows), ["C"], hops=2, direction="backward").count() == 300


def test_paths_and_influence(spark):
    table = edges(spark, [("A", "B", 0, 1.0), ("B", "C", 1, 1.0), ("A", "D", 1, 1.0)])
    geo = spark.createDataFrame([(k, 1.0, float(i)) for i, k in enumerate("ABCD")], "k string, x double, y double")
    assert [r.path for r in graph.geometric_path(table, geo, "k", ["x", "y"], 1.0, "A", "C").collect()] == [["A", "B", "C"]]
    depth = {r.key: r.depth for r in graph.propagate_influence(table, geo, "k", ["x", "y"], 1.0, ["A"]).collect()}
    assert depth == {"B": 1, "D": 1, "C": 2}


def test_ring_graph(spark):
    table = edges(spark, [(f"A{i % 20}", f"A{(i + 3) % 20}", i * 3600, 100.0 + i) for i in range(200)])
    anchors = spark.createDataFrame([(f"A{i}",) for i in range(20)], "k string")
    for r in derived.graph_features(anchors, "k", table, "from_key", "to_key").collect():
        assert (r.out_degree, r.in_degree, r.reciprocity, r.counterpart_overlap) == (1.0, 1.0, 1.0, 0.0)


def test_scanner_rules(spark):
    frame = spark.createDataFrame([(1, 5.0, None), (2, 9.0, 1.0)], "k long, a double, b double")
    assert [r.key for r in scan.points(frame, "s", "k", ["a > 4", "b > 0"]).collect()] == ["2"]
    assert len(scan.points(frame, "s", "k", ["a > 4", "b > 0"], "OR").collect()) == 2
    with pytest.raises(ValueError):
        scan.points(frame, "s", "k", ["a; drop"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x\n1;2.7\n2;\n")
    (tmp_path / "s.py").write_text("def prepare(spark):\n    return spark.range(3)\n")
    spec = readers.SourceSpec("a.csv", delimiter=";", transforms={"x": {"fill_null": 0.0, "cast": "int64"}})
    assert [tuple(r) for r in readers.load_source(spark, spec, str(tmp_path)).orderBy("id").collect()] == [(1, 2), (2, 0)]
    assert readers.load_source(spark, readers.SourceSpec(script="s.py"), str(tmp_path)).count() == 3
    import pyarrow as pa

    table = pa.table({"k": [1, 2], "t": ["a", None]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), table.schema) as sink:
        sink.write_table(table)
    assert readers.read_file(spark, str(tmp_path / "t.arrow")).count() == 2


def test_store_pins_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("points", "c", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    session = store.session()
    store.upsert("points", "c", spark.createDataFrame([(2, "z"), (3, "c")], "k long, v string"), "k")
    assert session.read("points", "c").count() == 2 and store.read("points", "c").count() == 3
    store.delete("points", "c", spark.createDataFrame([(1,)], "k long"), "k")
    assert {r.v for r in store.read("points", "c").collect()} == {"z", "c"}
    with pytest.raises(MissingTable):
        store.read("points", "nothing")


def test_tracker_merges(spark, population):
    frozen = calibrate.calibrate(population, PATTERN)
    scored = calibrate.score(population, PATTERN, frozen)
    one, two = tracker.Tracker.of(frozen), tracker.Tracker.of(frozen)
    one.update(scored, PATTERN)
    for g in "xy":
        two.update(scored.where(F.col("g") == g), PATTERN)
    assert np.allclose(one.mean, two.mean) and np.allclose(one.m2, two.m2) and one.drift < 1e-9 and not one.is_stale
    assert tracker.Tracker.from_dict(one.as_dict()).mean == one.mean


def test_streaming_scores_each_batch(spark, population, tmp_path):
    frozen = calibrate.calibrate(population, PATTERN)
    population.write.parquet(str(tmp_path / "in"))
    seen = []
    state = tracker.Tracker.of(frozen)
    stream = spark.readStream.schema(population.schema).parquet(str(tmp_path / "in"))
    running = tracker.score_stream(stream, PATTERN, frozen, lambda df, epoch: seen.append(df.count()), str(tmp_path / "cp"), state)
    running.processAllAvailable()
    running.stop()
    assert sum(seen) == 400 and state.count == 400


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
