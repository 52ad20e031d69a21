"""Queries of the aggregation engine and of predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.operators import aggregate as A
from orrery.operators import observe
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans.registry import query


def items(spark, sf_dir, **more) -> A.EventLine:
    frame = L.table(spark, sf_dir, "lineitem").withColumn("event_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    parts, suppliers = L.table(spark, sf_dir, "part"), L.table(spark, sf_dir, "supplier")
    slots = {"part": ("l_partkey",), "supplier": ("l_suppkey",), "order": ("l_orderkey",)}
    return A.EventLine(frame, "event_key", slots, "l_shipdate", properties={"part": (parts, "p_partkey"), "supplier": (suppliers, "s_suppkey")}, **more)


def orders(spark, sf_dir, with_geometry: bool = False) -> A.EventLine:
    geometry = L.sales_geometry(spark, sf_dir)[0] if with_geometry else None
    return A.EventLine(L.table(spark, sf_dir, "orders"), "o_orderkey", {"customer": ("o_custkey",)}, "o_orderdate", geometry, {"customer": (L.table(spark, sf_dir, "customer"), "c_custkey")})


def transfers(spark, sf_dir) -> A.EventLine:
    """Hand-overs: sender and receiver are two slots of one line."""
    return A.EventLine(L.hand_overs(spark, sf_dir), "event_key", {"supplier": ("from_key", "to_key"), "sender": ("from_key",)})


def simple(name: str, sql: str, maker, *args, **options):
    """Register an aggregate over all groups."""

    def run(spark, sf_dir):
        return A.aggregate(maker(spark, sf_dir), *args, **({"limit": None} | options))

    query(name, sql)(run)


def grouped(value: str, where: str = "true", key: str = "l_suppkey", source: str = "lineitem", having: str = "") -> str:
    return f"SELECT {key}::VARCHAR AS key, round({value}, 2)::DOUBLE AS value, count(*) AS count FROM {source} WHERE {key} IS NOT NULL AND {where} GROUP BY 1 {having}"


simple("agg_count", grouped("count(*)"), items, "supplier")
simple("agg_sum", grouped("sum(l_extendedprice)"), items, "supplier", "sum:l_extendedprice")
simple("agg_avg", grouped("avg(l_quantity)"), items, "supplier", "avg:l_quantity")
simple("agg_min", grouped("min(l_quantity)"), items, "supplier", "min:l_quantity")
simple("agg_max", grouped("max(l_extendedprice)"), items, "supplier", "max:l_extendedprice")
simple("agg_median", grouped("quantile_cont(l_quantity, 0.5e0)"), items, "supplier", "median:l_quantity")
simple("agg_count_distinct", grouped("count(DISTINCT l_partkey)"), items, "supplier", "count_distinct:part")
simple("agg_top_groups", grouped("sum(l_quantity)") + " ORDER BY value DESC, key LIMIT 20", items, "supplier", "sum:l_quantity", limit=20)
simple("agg_page_ascending", grouped("count(*)") + " ORDER BY value, key LIMIT 10 OFFSET 5", items, "supplier", sort="asc", limit=10, offset=5)
simple("agg_having", grouped("count(*)", having="HAVING count(*) > 600"), items, "supplier", having={"gt": 600})
simple("agg_event_filter", grouped("count(*)", "l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_tax IS NOT NULL"), items, "supplier", event_filters={"l_quantity": {"gte": 10, "lt": 20}, "l_returnflag": "R", "l_tax": {"not_null": True}})
simple("agg_time_range", grouped("count(*)", "l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"), items, "supplier", time_from="1997-01-01", time_to="1998-01-01")
simple("agg_key_filters", grouped("count(*)", "l_suppkey IN (1, 2, 3) AND l_partkey IN (5, 6, 7, 8, 9, 10)"), items, "supplier", key_filters={"supplier": [1, 2, 3], "part": [5, 6, 7, 8, 9, 10]})
simple("agg_missing_edge", grouped("count(*)", "l_partkey IS NULL"), items, "supplier", missing_edge_to="part")
simple(
    "agg_two_lines",
    "SELECT l_suppkey::VARCHAR AS key, l_partkey::VARCHAR AS key_2, round(sum(l_quantity), 2) AS value, count(*) AS count FROM lineitem GROUP BY ALL",
    items, "supplier", "sum:l_quantity", group_by_2="part",
)
simple(
    "agg_two_slots",
    f"WITH {S.EDGES} SELECT k::VARCHAR AS key, round(sum(amount), 2) AS value, count(*) AS count FROM (SELECT from_key AS k, amount FROM edges UNION ALL SELECT to_key, amount FROM edges) GROUP BY 1",
    transfers, "supplier", "sum:amount",
)
simple(
    "agg_by_property",
    "SELECT o_custkey::VARCHAR AS key, c_mktsegment AS property, round(sum(o_totalprice), 2) AS value, count(*) AS count FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS NOT NULL GROUP BY ALL",
    orders, "customer", "sum:o_totalprice", group_by_property="customer:c_mktsegment",
)
simple("agg_property_distinct", "SELECT c_mktsegment AS property, count(DISTINCT o_custkey)::DOUBLE AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", orders, "customer", group_by_property="customer:c_mktsegment", distinct=True)
simple("agg_property_collapsed", "SELECT p_brand AS property, round(avg(l_quantity), 2) AS value, count(*) AS count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", items, "part", "avg:l_quantity", group_by_property="part:p_brand", collapse=True)


@query("agg_percentile", "SELECT l_suppkey::VARCHAR AS key, round(quantile_cont(l_quantity, 0.9e0), 2) AS value, count(*) AS count FROM lineitem GROUP BY 1")
def agg_percentile(spark, sf_dir):
    return A.aggregate(items(spark, sf_dir), "supplier", "pct90:l_quantity", limit=None)


@query("agg_pivot", "SELECT o_custkey::VARCHAR AS key, " + ", ".join(f"CASE WHEN count(*) FILTER (o_orderstatus = '{s}') > 0 THEN round(count(*) FILTER (o_orderstatus = '{s}'), 2)::DOUBLE END AS {s}" for s in "FOP") + ", count(*) AS count FROM orders GROUP BY 1")
def agg_pivot(spark, sf_dir):
    return A.aggregate(orders(spark, sf_dir), "customer", pivot="o_orderstatus", limit=None)


@query("agg_filter_by_keys", "SELECT o_custkey::VARCHAR AS key, count(*)::DOUBLE AS value, count(*) AS count FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def agg_filter_by_keys(spark, sf_dir):
    returned = L.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return A.aggregate(orders(spark, sf_dir), "customer", filter_by_keys=returned, limit=None)


@query("agg_geometry_filter", f"WITH {S.SALES_GEO} SELECT o_custkey::VARCHAR AS key, count(*)::DOUBLE AS value, count(*) AS count FROM egeo WHERE is_anomaly AND delta_price > 1 GROUP BY 1")
def agg_geometry_filter(spark, sf_dir):
    return A.aggregate(orders(spark, sf_dir, True), "customer", geometry_filter=F.col("is_anomaly") & (F.col("delta_price") > 1), limit=None)


@query("agg_anomaly_rate", f"WITH {S.SALES_GEO} SELECT o_custkey::VARCHAR AS key, count(*) FILTER (is_anomaly) AS count, count(*) AS total_events, round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE, 6) AS anomaly_rate FROM egeo GROUP BY 1 HAVING count(*) FILTER (is_anomaly) > 0")
def agg_anomaly_rate(spark, sf_dir):
    got = A.anomaly_rates(orders(spark, sf_dir, True), "customer", F.col("is_anomaly"))
    return got.withColumn("anomaly_rate", F.round("anomaly_rate", 6))


@query("agg_dropped_share", f"WITH {S.SALES_GEO} SELECT count(*) AS total, count(*) FILTER (NOT is_anomaly) AS dropped, round(count(*) FILTER (NOT is_anomaly) / count(*)::DOUBLE, 6) AS share FROM egeo")
def agg_dropped_share(spark, sf_dir):
    return A.dropped_share(orders(spark, sf_dir, True), F.col("is_anomaly")).withColumn("share", F.round("share", 6))


@query("agg_alias_inside", f"WITH {S.SALES_GEO} SELECT o_custkey::VARCHAR AS key, count(*)::DOUBLE AS value, count(*) AS count FROM egeo WHERE (delta_price + delta_day - 1.0e0) / sqrt(2.0e0) > 0 GROUP BY 1")
def agg_alias_inside(spark, sf_dir):
    inside = X.signed_distance([F.col(d) for d in L.SALES.deltas], (0.0, 1.0, 1.0), 1.0) > 0
    return A.aggregate(orders(spark, sf_dir, True), "customer", geometry_filter=inside, limit=None)


_KEYED = "k AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_key FROM lineitem), m AS (SELECT *, md5(event_key || ':7') AS h FROM k)"
_COUNTED = "SELECT l_suppkey::VARCHAR AS key, count(*)::DOUBLE AS value, count(*) AS count FROM {} WHERE l_suppkey IS NOT NULL GROUP BY 1"


@query("agg_sampled", f"WITH {_KEYED}, x AS (SELECT * FROM m ORDER BY h, event_key LIMIT 5000) {_COUNTED.format('x')}")
def agg_sampled(spark, sf_dir):
    return A.aggregate(items(spark, sf_dir), "supplier", sample_size=5000, seed=7, limit=None)


@query("agg_sampled_share", f"WITH {_KEYED}, x AS (SELECT * FROM m WHERE ('0x' || substr(h, 1, 8))::BIGINT < 429496729) {_COUNTED.format('x')}")
def agg_sampled_share(spark, sf_dir):
    return A.aggregate(items(spark, sf_dir), "supplier", sample_pct=0.1, seed=7, limit=None)


@query("aggregate_anomalies", f"""WITH {S.CUSTOMER_GEO} SELECT group_key, count(*) AS anomaly_count, round(avg(norm), 6) AS mean_norm, array_to_string(list_sort(list(c_custkey) FILTER (n <= 5)), ',') AS keys
FROM (SELECT *, coalesce(c_mktsegment, '(null)') AS group_key, row_number() OVER (PARTITION BY coalesce(c_mktsegment, '(null)') ORDER BY norm DESC, c_custkey) AS n FROM geo WHERE norm >= theta) GROUP BY 1""")
def aggregate_anomalies(spark, sf_dir):
    geo, _ = L.customer_geometry(spark, sf_dir)
    return A.anomalies_by_property(geo, "c_mktsegment", "c_custkey").select("group_key", "anomaly_count", F.round("mean_norm", 6).alias("mean_norm"), F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("filter_property", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 5000 AND c_mktsegment <> 'BUILDING'")
def filter_property(spark, sf_dir):
    return A.property_filter(L.table(spark, sf_dir, "customer"), {"c_acctbal": {">": 0, "<=": 5000}, "c_mktsegment": {"!=": "BUILDING"}}).select("c_custkey")


@query("filter_simple", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000")
def filter_simple(spark, sf_dir):
    return L.table(spark, sf_dir, "orders").where(A.simple_filter("o_totalprice >= 200000")).select("o_orderkey")


@query("filter_delta_dimension", f"WITH {S.CUSTOMER_GEO} SELECT c_custkey FROM geo WHERE delta_order_sum > 0.5 AND delta_order_count <= 1")
def filter_delta_dimension(spark, sf_dir):
    geo, _ = L.customer_geometry(spark, sf_dir)
    return geo.where(A.comparison(F.col("delta_order_sum"), {"gt": 0.5}) & A.comparison(F.col("delta_order_count"), {"lte": 1})).select("c_custkey")


@query("filter_inside_alias", f"WITH {S.CUSTOMER_GEO} SELECT c_custkey, round((delta_order_count + delta_order_sum - 1.0e0) / sqrt(2.0e0), 6) AS signed_distance FROM geo WHERE (delta_order_count + delta_order_sum - 1.0e0) / sqrt(2.0e0) > 0")
def filter_inside_alias(spark, sf_dir):
    geo, _ = L.customer_geometry(spark, sf_dir)
    signed = X.signed_distance([F.col(d) for d in L.CUSTOMERS.deltas], (1.0, 1.0, 0.0, 0.0), 1.0)
    return geo.withColumn("signed_distance", signed).where("signed_distance > 0").select("c_custkey", F.round("signed_distance", 6).alias("signed_distance"))


@query("search_entities", "SELECT c_custkey, count(*) OVER () AS total FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 20")
def search_entities(spark, sf_dir):
    return observe.search_entities(L.table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", 7, 20)


PROFILE_SQL = {
    "categorical": "SELECT coalesce(c_mktsegment, '(null)') AS value, count(*) AS count, (SELECT count(*) FROM customer) AS total, (SELECT count(DISTINCT coalesce(c_mktsegment, '(null)')) FROM customer) AS distinct_values FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "numeric": "SELECT count(*) AS total, count(*) - count(c_acctbal) AS nulls, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std, round(quantile_cont(c_acctbal, 0.25e0), 4) AS p25, round(quantile_cont(c_acctbal, 0.5e0), 4) AS median, round(quantile_cont(c_acctbal, 0.75e0), 4) AS p75 FROM customer",
    "temporal": "SELECT count(*) AS total, count(*) - count(o_orderdate) AS nulls, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS min, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS max FROM orders",
    "grouped": "SELECT c_mktsegment AS group_key, count(*) AS total, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5e0), 4) AS median FROM customer GROUP BY 1",
}


@query("profile_categorical", PROFILE_SQL["categorical"])
def profile_categorical(spark, sf_dir):
    return observe.profile_categorical(L.table(spark, sf_dir, "customer"), "c_mktsegment", 20)


@query("profile_numeric", PROFILE_SQL["numeric"])
def profile_numeric(spark, sf_dir):
    return observe.profile_numeric(L.table(spark, sf_dir, "customer"), "c_acctbal")


@query("profile_temporal", PROFILE_SQL["temporal"])
def profile_temporal(spark, sf_dir):
    return observe.profile_temporal(L.table(spark, sf_dir, "orders"), "o_orderdate")


@query("profile_grouped", PROFILE_SQL["grouped"])
def profile_grouped(spark, sf_dir):
    return observe.profile_numeric_grouped(L.table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")
