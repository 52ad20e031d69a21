import json

import pytest
from pyspark.sql import functions as F

from orrery.__main__ import main
from orrery.catalog import Navigator
from orrery.plans import config
from orrery.plans.spec import Alias, EntityNotFound, NavigationError, PositionError, VersionError
from orrery.sources.store import Store

SPEC = {
    "version": "0.1",
    "sources": {"customer": {"path": "customer.parquet"}, "orders": {"path": "orders.parquet"}},
    "lines": {"customers": {"source": "customer", "key": "c_custkey"}, "orders": {"source": "orders", "key": "o_orderkey", "role": "event", "time": "o_orderdate"}},
    "patterns": {"buyers": {"line": "customers", "event_line": "orders", "foreign_key": "o_custkey", "features": {"n": "count", "spend": "sum:o_totalprice", "burst": "count:window=30d:agg=max", "gap": "iet_mean"}}},
    "aliases": {"busy": {"pattern": "buyers", "dimension": "n", "threshold": 0.0}},
}


@pytest.fixture(scope="module")
def built(spark, data, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("sphere")))
    return config.build(spark, config.parse(SPEC), data, store), store


def test_build_writes_and_navigates(spark, data, built):
    populations, store = built
    own = populations["buyers"]
    assert own.geometry.count() == spark.read.parquet(f"{data}/customer.parquet").count()
    assert store.read_json("alias-busy")["population"] > 0 and store.read_json("calibration-buyers")["theta"] == own.calibration.theta
    nav = Navigator(populations, {"busy": Alias.of_dimension("busy", own.pattern, "n", 0.0)})
    worst = nav.anomalies("buyers", top=1).first()
    assert nav.goto("buyers", worst["customers_key"])["is_anomaly"] and nav.walk("+") != worst["customers_key"]
    assert nav.boundary("busy", "in", 3).count() == 3 and nav.hubs("buyers", 2).count() == 2 and nav.similar("buyers", "1", 4).count() == 4
    assert nav.explain("buyers", worst["customers_key"])["severity"] != "none" and nav.overview().first()["pattern"] == "buyers"
    assert nav.contrast("buyers", F.col("is_anomaly")).count() == 4 and nav.passive_scan("customers_key", 1).count() >= 1
    for call, error in ((lambda: nav.anomalies("x"), NavigationError), (lambda: nav.goto("buyers", "nobody"), EntityNotFound), (nav.emerge, PositionError), (lambda: nav.boundary("x"), NavigationError)):
        with pytest.raises(error):
            call()


@pytest.mark.parametrize("text", ["mode:x", "sum", "count:window=7y", "count:window=7d:agg=min", "count:size=3", "a b"])
def test_features_are_checked(text):
    with pytest.raises(ValueError):
        config.parse_feature("f", text)


def test_specifications_are_checked(tmp_path):
    assert config.parse_feature("f", "avg:x:window=24h:agg=last") == config.Feature("f", "mean", "x", "24h", "last")
    with pytest.raises(VersionError):
        config.parse(SPEC | {"version": "9"})
    with pytest.raises(ValueError):
        config.parse(SPEC | {"sources": {}})
    with pytest.raises(ValueError):
        config.parse(SPEC | {"aliases": {"a": {"pattern": "none"}}})
    (tmp_path / "good.json").write_text(json.dumps(SPEC))
    (tmp_path / "bad.json").write_text(json.dumps(SPEC | {"lines": {}}))
    assert main(["validate", str(tmp_path / "good.json")]) == 0 and main(["validate", str(tmp_path / "bad.json")]) == 1
