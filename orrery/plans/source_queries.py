"""Queries on sources, edges of points, writes and incremental updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.operators import calibrate, similar
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans.registry import query
from orrery.sources import readers, store
from orrery.streaming import tracker


@query("source_join", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def source_join(spark, sf_dir):
    nations = L.table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return readers.join_source(L.table(spark, sf_dir, "customer"), nations, "c_nationkey", "left", ["n_name"]).select("c_custkey", "c_name", "n_name")


@query("source_transforms", "SELECT c_custkey, trunc(coalesce(c_acctbal, 0))::BIGINT AS c_acctbal, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def source_transforms(spark, sf_dir):
    rows = L.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return readers.transform(rows, {"c_acctbal": {"fill_null": 0.0, "cast": "int64"}, "c_nationkey": {"cast": "string"}})


@query("source_load", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def source_load(spark, sf_dir):
    rows = readers.load_source(spark, readers.SourceSpec("nation.parquet"), sf_dir)
    regions = readers.load_source(spark, readers.SourceSpec("region.parquet"), sf_dir).withColumnRenamed("r_regionkey", "n_regionkey")
    return readers.join_source(rows, regions, "n_regionkey", "inner").select("n_nationkey", "n_name", "r_name")


@query("add_line", "SELECT s_suppkey::VARCHAR AS primary_key, s_name AS name, 1 AS version, 'active' AS status FROM supplier")
def add_line(spark, sf_dir):
    return readers.as_line(L.table(spark, sf_dir, "supplier"), "key", {"key": "s_suppkey", "name": "s_name"}).select("primary_key", "name", "version", "status")


@query("entity_keys", "SELECT o_orderkey, o_custkey::VARCHAR AS customer_key, 2 AS n_alive, o_orderstatus AS status_key FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus <> ''")
def entity_keys(spark, sf_dir):
    rows = readers.with_edges(L.table(spark, sf_dir, "orders"), {"customers": "o_custkey", "statuses": "o_orderstatus"})
    return rows.select("o_orderkey", readers.jump(F.col("edges"), "customers").alias("customer_key"), F.size(readers.alive_edges(F.col("edges"))).alias("n_alive"), F.get("entity_keys", 1).alias("status_key")).where("n_alive = 2")


@query("event_polygons_for", "SELECT o_orderkey FROM orders WHERE o_custkey = 17")
def event_polygons_for(spark, sf_dir):
    return readers.referring(readers.with_edges(L.table(spark, sf_dir, "orders"), {"customers": "o_custkey"}), "17", 0).select("o_orderkey")


@query("missing_edges", "SELECT o_orderkey FROM orders WHERE o_custkey IS NULL")
def missing_edges(spark, sf_dir):
    rows = readers.with_edges(L.table(spark, sf_dir, "orders"), {"customers": "o_custkey"})
    return rows.where(F.size(readers.alive_edges(F.col("edges"))) == 0).select("o_orderkey")


@query("common_relations", "SELECT l_suppkey::VARCHAR AS point_key FROM lineitem WHERE l_partkey = 5 INTERSECT SELECT l_suppkey::VARCHAR FROM lineitem WHERE l_partkey = 6")
def common_relations(spark, sf_dir):
    items = readers.with_edges(L.table(spark, sf_dir, "lineitem"), {"supplier": "l_suppkey"}).where("l_partkey in (5, 6)")
    # The edges of two polygons, the parts 5 and 6: as many as their suppliers.
    edges = items.groupBy("l_partkey").agg(F.array_distinct(F.flatten(F.collect_list(readers.alive_edges(F.col("edges"))))).alias("edges"))
    five, six = (edges.where(F.col("l_partkey") == part).select(F.col("edges").alias(f"e{part}")) for part in (5, 6))
    return five.join(F.broadcast(six)).select(F.explode(similar.common_relations(F.col("e5"), F.col("e6"))["point_key"]).alias("point_key"))


@query("update_points", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer")
def update_points(spark, sf_dir):
    rows = L.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return store.upserted(rows, rows.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("changed")), "c_custkey")


@query("delete_points", "SELECT c_custkey FROM customer WHERE c_nationkey <> 3")
def delete_points(spark, sf_dir):
    own, rows = scratch(spark), L.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    own.write("points", "customers", rows)
    own.delete("points", "customers", rows.where("c_nationkey = 3").select("c_custkey"), "c_custkey")
    return own.read("points", "customers").select("c_custkey")


@query("append_edges", f"WITH {S.EDGES} SELECT from_key, count(*) AS n FROM edges GROUP BY 1")
def append_edges(spark, sf_dir):
    own, edges = scratch(spark), L.hand_overs(spark, sf_dir)
    own.write("edges", "lines", edges.where("amount < 30000"))
    own.append("edges", "lines", edges.where("amount >= 30000"))
    return own.read("edges", "lines").groupBy("from_key").agg(F.count(F.lit(1)).alias("n"))


@query("append_geometry", f"WITH {S.CUSTOMER_GEO} SELECT c_custkey, round(delta_rank_pct, 6) AS delta_rank_pct FROM geo")
def append_geometry(spark, sf_dir):
    """A population of which a part is written, the rest is appended, and a part is written again."""
    own, rows = scratch(spark), store.materialise(L.customer_geometry(spark, sf_dir)[0])
    own.write("geometry", "customers", rows.where("c_custkey % 3 > 0"))
    own.append_geometry("customers", rows.where("c_custkey % 3 = 0 or c_custkey % 2 = 0"), "c_custkey")
    return own.read("geometry", "customers").select("c_custkey", F.round("delta_rank_pct", 6).alias("delta_rank_pct"))


@query("purge_temporal", "SELECT agent, count(*) AS n FROM (SELECT NULL AS agent, user_id FROM events WHERE user_id % 3 = 0 UNION ALL SELECT 'b', user_id FROM events WHERE user_id % 3 = 2) GROUP BY 1")
def purge_temporal(spark, sf_dir):
    """Slices of all and of two agents, of whom one is purged; then few files."""
    own, rows = scratch(spark), L.table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("slice"))
    for agent, rest in ((None, 0), ("a", 1), ("b", 2)):
        own.append_temporal("events", rows.where(F.col("user_id") % 3 == rest), agent)
    own.purge_temporal("events", "a")
    own.compact_temporal("events", "user_id")
    return own.read("temporal", "events").groupBy(F.col("agent_id").alias("agent")).agg(F.count(F.lit(1)).alias("n"))


def scratch(spark) -> store.Store:
    """A new store in the shared folder."""
    return store.Store(spark, f"{store.shared_folder(spark)}/orrery-store-{uuid.uuid4().hex}")


@query("count_geometry_rows", f"WITH {S.CUSTOMER_GEO} SELECT count(*) AS n FROM geo WHERE is_anomaly AND norm >= 2")
def count_geometry_rows(spark, sf_dir):
    return L.customer_geometry(spark, sf_dir)[0].where("is_anomaly and norm >= 2").agg(F.count(F.lit(1)).alias("n"))


@query("check_anomaly_batch", f"WITH {S.CUSTOMER_GEO} SELECT c_custkey, is_anomaly, round(norm, 6) AS norm FROM geo WHERE c_custkey IN (1, 2, 3, 4, 5)")
def check_anomaly_batch(spark, sf_dir):
    return L.customer_geometry(spark, sf_dir)[0].where(F.col("c_custkey").isin(1, 2, 3, 4, 5)).select("c_custkey", "is_anomaly", F.round("norm", 6).alias("norm"))



@query("incremental_update", f"WITH {S.CUSTOMER_GEO}, x AS (SELECT c_custkey, norm FROM geo WHERE c_custkey % 7 <> 0 OR c_custkey % 10 = 0), y AS (SELECT *, round((rank() OVER (ORDER BY round(norm, 9)) - 1) / count(*) OVER ()::DOUBLE * 100, 6) AS delta_rank_pct FROM x) SELECT c_custkey, round(norm, 6) AS norm, delta_rank_pct FROM y")
def incremental_update(spark, sf_dir):
    rows = L.customers(spark, sf_dir)
    frozen = calibrate.calibrate(rows, L.CUSTOMERS)
    old = calibrate.geometry(rows.where("c_custkey % 10 <> 0"), L.CUSTOMERS, frozen)
    got = tracker.incremental_update(old, rows.where("c_custkey % 10 = 0"), L.CUSTOMERS, frozen, rows.where("c_custkey % 7 = 0").select("c_custkey"))
    return got.select("c_custkey", F.round("norm", 6).alias("norm"), F.round("delta_rank_pct", 6).alias("delta_rank_pct"))


@query("calibration_drift", f"WITH {S.CUSTOMER_GEO}, h AS (SELECT {', '.join(f'avg(shape_{d}) AS m_{d}' for d in S.CUSTOMER_DIMS)} FROM geo WHERE c_acctbal > 0) SELECT round(sqrt({' + '.join(f'pow(m_{d} - mu_{d}, 2)' for d in S.CUSTOMER_DIMS)}) / sqrt({' + '.join(f'sd_{d} * sd_{d}' for d in S.CUSTOMER_DIMS)}), 6) AS drift FROM h, geo_stats")
def calibration_drift(spark, sf_dir):
    geo, frozen = L.customer_geometry(spark, sf_dir)
    state = tracker.Tracker.of(frozen)
    for part in (0, 1):  # two batches merge into one state
        state.update(geo.where((F.col("c_acctbal") > 0) & (F.col("c_custkey") % 2 == part)), L.CUSTOMERS)
    return spark.createDataFrame([(round(state.drift, 6),)], "drift double")


@query("event_json_property", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def event_json_property(spark, sf_dir):
    return L.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
