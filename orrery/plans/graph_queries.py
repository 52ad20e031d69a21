"""Queries on the supplier hand-over graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.plans import lines as L
from orrery.plans import sql as S
from orrery.plans.registry import query

#: The suppliers that single-entity queries start from.
SEED, OTHER = 7, 12
BOTH = "nb AS (SELECT DISTINCT * FROM (SELECT from_key AS key, to_key AS other FROM edges WHERE from_key <> to_key UNION ALL SELECT to_key, from_key FROM edges WHERE from_key <> to_key))"


def edges(spark, sf_dir):
    return L.hand_overs(spark, sf_dir)


def geo(spark, sf_dir):
    return L.supplier_geometry(spark, sf_dir)


@query("graph_edges", f"WITH {S.EDGES} SELECT from_key, to_key, event_key, timestamp, amount FROM edges")
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("graph_extract_edges", "SELECT o_custkey AS from_key, o_orderstatus AS to_key, o_orderkey AS event_key, epoch_us(o_orderdate) / 1e6 AS timestamp, coalesce(o_totalprice, 0) AS amount FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderstatus <> ''")
def graph_extract_edges(spark, sf_dir):
    from orrery.functions.expressions import epoch

    return G.extract_edges(L.table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", epoch(F.col("o_orderdate")), "o_totalprice")


@query("graph_read_edges", f"WITH {S.EDGES} SELECT from_key, to_key, event_key FROM edges WHERE from_key IN (1, 2, 3) AND timestamp >= 8.6e8 AND timestamp <= 9.2e8")
def graph_read_edges(spark, sf_dir):
    return G.read_edges(edges(spark, sf_dir), [1, 2, 3], None, 8.6e8, 9.2e8).select("from_key", "to_key", "event_key")


@query("graph_edge_statistics", f"WITH {S.EDGES} SELECT count(*) AS n_edges, count(DISTINCT from_key) AS n_from, count(DISTINCT to_key) AS n_to, min(timestamp) AS min_time, max(timestamp) AS max_time, min(amount) AS min_amount, max(amount) AS max_amount, round(count(*) / count(DISTINCT from_key)::DOUBLE, 6) AS mean_out_degree FROM edges")
def graph_edge_statistics(spark, sf_dir):
    return G.edge_statistics(edges(spark, sf_dir)).withColumn("mean_out_degree", F.round("mean_out_degree", 6))


@query("graph_contagion", f"WITH {S.SUPPLIER_GEO}, {S.EDGES}, {BOTH} SELECT key, count(*) AS neighbor_count, count(*) FILTER (is_anomaly) AS anomalous_neighbor_count, round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE, 6) AS contagion_ratio FROM nb LEFT JOIN sgeo ON s_suppkey = other GROUP BY 1")
def graph_contagion(spark, sf_dir):
    return G.contagion(edges(spark, sf_dir), geo(spark, sf_dir)[0], "s_suppkey").withColumn("contagion_ratio", F.round("contagion_ratio", 6))


@query("graph_counterparties", f"""WITH {S.SUPPLIER_GEO}, {S.EDGES}, c AS (SELECT 'out' AS direction, to_key AS other, amount FROM edges WHERE from_key = {SEED} UNION ALL SELECT 'in', from_key, amount FROM edges WHERE to_key = {SEED}),
g AS (SELECT direction, other, count(*) AS tx_count, round(sum(amount), 2) AS amount_sum, max(amount) AS amount_max FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY tx_count DESC, other) AS rank FROM g)
SELECT r.*, is_anomaly FROM r LEFT JOIN sgeo ON s_suppkey = other WHERE rank <= 20""")
def graph_counterparties(spark, sf_dir):
    got = G.counterparties(edges(spark, sf_dir), SEED, geo(spark, sf_dir)[0], "s_suppkey")
    return got.select("direction", "other", "tx_count", F.round("amount_sum", 2).alias("amount_sum"), "amount_max", F.col("rank").cast("long").alias("rank"), "is_anomaly")


@query("graph_entity_flow", f"""WITH {S.EDGES}, o AS (SELECT from_key AS key, sum(amount) AS out_total FROM edges GROUP BY 1), i AS (SELECT to_key AS key, sum(amount) AS in_total FROM edges GROUP BY 1), f AS (SELECT key, coalesce(out_total, 0) AS o, coalesce(in_total, 0) AS i FROM o FULL JOIN i USING (key))
SELECT key, round(o, 2) AS out_total, round(i, 2) AS in_total, round(i - o, 2) AS net, CASE WHEN round(i - o, 2) > 0 THEN 'in' WHEN round(i - o, 2) < 0 THEN 'out' ELSE 'even' END AS direction FROM f""")
def graph_entity_flow(spark, sf_dir):
    return G.entity_flow(edges(spark, sf_dir)).select("key", F.round("out_total", 2).alias("out_total"), F.round("in_total", 2).alias("in_total"), "net", "direction")


@query("graph_counterparty_flow", f"""WITH {S.EDGES}, f AS (SELECT CASE WHEN from_key = {SEED} THEN to_key ELSE from_key END AS other, sum(CASE WHEN to_key = {SEED} THEN amount ELSE 0 END) AS i, sum(CASE WHEN from_key = {SEED} THEN amount ELSE 0 END) AS o FROM edges WHERE from_key = {SEED} OR to_key = {SEED} GROUP BY 1)
SELECT other, round(i - o, 2) AS net FROM f ORDER BY abs(round(i - o, 2)) DESC, other LIMIT 20""")
def graph_counterparty_flow(spark, sf_dir):
    return G.counterparty_flow(edges(spark, sf_dir), SEED).select("other", "net")


@query("graph_degree_velocity", f"""WITH {S.EDGES}, s AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM edges), p AS (SELECT from_key, to_key, least(floor((timestamp - lo) / greatest((hi - lo) / 4, 1e-9)), 3) AS b FROM edges, s),
n AS (SELECT from_key AS key, to_key AS other, b FROM p UNION ALL SELECT to_key, from_key, b FROM p)
SELECT key, count(DISTINCT CASE WHEN b = 0 THEN other END) AS first_degree, count(DISTINCT CASE WHEN b = 3 THEN other END) AS last_degree, round(count(DISTINCT CASE WHEN b = 3 THEN other END) / greatest(count(DISTINCT CASE WHEN b = 0 THEN other END), 1)::DOUBLE, 6) AS velocity FROM n GROUP BY 1""")
def graph_degree_velocity(spark, sf_dir):
    return G.degree_velocity(edges(spark, sf_dir)).withColumn("velocity", F.round("velocity", 6))


@query("graph_coverage", f"""WITH {S.SUPPLIER_GEO}, {S.EDGES}, {BOTH} SELECT count(*) AS neighbors, count(*) FILTER (other <= 50) AS explored, count(*) FILTER (other > 50 AND is_anomaly) AS unexplored_anomalies, round(count(*) FILTER (other <= 50) / greatest(count(*), 1)::DOUBLE, 6) AS coverage FROM nb LEFT JOIN sgeo ON s_suppkey = other WHERE key = {SEED}""")
def graph_coverage(spark, sf_dir):
    explored = L.table(spark, sf_dir, "supplier").where("s_suppkey <= 50").select("s_suppkey")
    return G.investigation_coverage(edges(spark, sf_dir), SEED, explored, geo(spark, sf_dir)[0], "s_suppkey").withColumn("coverage", F.round("coverage", 6))


_ORDERS = "hand AS (SELECT o_custkey AS from_key, o_orderstatus AS to_key, o_orderkey AS event_key FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderstatus <> '')"


@query("graph_anomalous_edges", f"WITH {S.SALES_GEO}, {_ORDERS} SELECT event_key, round(norm, 6) AS norm, is_anomaly FROM hand JOIN egeo ON o_orderkey = event_key WHERE from_key = {SEED} AND to_key = 'O' ORDER BY egeo.norm DESC, event_key LIMIT 10")
def graph_anomalous_edges(spark, sf_dir):
    """Orders of a customer in one state, by the norms of the population of orders."""
    table = G.extract_edges(L.table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string")), "o_custkey", "o_orderstatus", "o_orderkey")
    return G.anomalous_edges(table, str(SEED), "O", L.sales_geometry(spark, sf_dir)[0], "o_orderkey").select("event_key", F.round("norm", 6).alias("norm"), "is_anomaly")


@query("graph_neighborhood", f"""WITH {S.EDGES}, {BOTH}, one AS (SELECT DISTINCT other AS key FROM nb WHERE key = {SEED}), two AS (SELECT DISTINCT nb.other AS key FROM one JOIN nb ON nb.key = one.key WHERE nb.other <> {SEED} AND nb.other NOT IN (SELECT key FROM one))
SELECT key, 1 AS hops FROM one UNION ALL SELECT key, 2 FROM two ORDER BY hops, key LIMIT 100""")
def graph_neighborhood(spark, sf_dir):
    return G.neighborhood(edges(spark, sf_dir), SEED)


def _hop_sql() -> str:
    dot = " + ".join("x.delta_{0} * y.delta_{0}".format(d) for d in S.SUPPLIER_DIMS)
    either = " + ".join(f"(abs(x.delta_{d}) > x.theta / 2 OR abs(y.delta_{d}) > x.theta / 2)::INT" for d in S.SUPPLIER_DIMS)
    both = " + ".join(f"(abs(x.delta_{d}) > x.theta / 2 AND abs(y.delta_{d}) > x.theta / 2)::INT" for d in S.SUPPLIER_DIMS)
    return f"""(0.4 * CASE WHEN x.norm > 0 AND y.norm > 0 THEN ({dot}) / (x.norm * y.norm) ELSE 0 END
 + 0.3 * CASE WHEN {either} > 0 THEN ({both})::DOUBLE / ({either}) ELSE 0 END
 + 0.3 * CASE WHEN greatest(x.norm, y.norm) > 0 THEN least(x.norm, y.norm) / greatest(x.norm, y.norm) ELSE 0 END)"""


HOP = _hop_sql()


def _step_sql(step: int) -> str:
    """The best score of each entity over paths of `step` steps, of which the last has tx_count events."""
    return f"w{step} AS (SELECT key, max(s) AS score, arg_max(n, s) AS tx_count FROM (SELECT f.b AS key, w{step - 1}.score * f.f AS s, n FROM w{step - 1} JOIN f ON f.a = w{step - 1}.key) WHERE s >= 0.001 GROUP BY 1)"


@query("graph_influence", f"""WITH {S.SUPPLIER_GEO}, {S.EDGES}, pairs AS (SELECT a, b, count(DISTINCT event_key) AS n FROM (SELECT from_key AS a, to_key AS b, event_key FROM edges WHERE from_key <> to_key UNION ALL SELECT to_key, from_key, event_key FROM edges WHERE from_key <> to_key) GROUP BY 1, 2),
f AS (SELECT a, b, n, greatest({HOP}, 0.01) * (1 + ln(n)) * 0.7e0 AS f FROM pairs JOIN sgeo x ON x.s_suppkey = a JOIN sgeo y ON y.s_suppkey = b WHERE b <> {SEED}), w0 AS (SELECT {SEED} AS key, 1.0e0 AS score), {', '.join(map(_step_sql, (1, 2, 3)))},
w AS (SELECT *, 1 AS depth FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, depth) AS r FROM w) SELECT key, round(score, 5) AS score, depth, tx_count FROM k WHERE r = 1""")
def graph_influence(spark, sf_dir):
    rows, calibration = geo(spark, sf_dir)
    found = G.propagate_influence(edges(spark, sf_dir), rows, "s_suppkey", L.SUPPLIERS.deltas, calibration.theta, [SEED])
    return found.select("key", F.round("score", 5).alias("score"), F.col("depth").cast("int").alias("depth"), "tx_count")


def _chains_sql(seeds: str, hops: int, backward: bool = False) -> str:
    """CTEs up to `chains`: all simple paths in time order, one for each set of events."""
    ways = "to_key AS f, from_key AS t, event_key AS e, -timestamp AS ts, amount AS am" if backward else "from_key AS f, to_key AS t, event_key AS e, timestamp AS ts, amount AS am"
    return f"""WITH RECURSIVE {S.EDGES}, st AS (SELECT {ways} FROM edges WHERE from_key <> to_key),
p AS (SELECT f AS seed, [f, t] AS keys, [e] AS ev, [am] AS ams, ts AS first, ts AS last, t AS tip FROM st WHERE f IN ({seeds})
UNION ALL SELECT p.seed, list_append(p.keys, st.t), list_append(p.ev, st.e), list_append(p.ams, st.am), p.first, st.ts, st.t FROM p JOIN st ON st.f = p.tip AND st.ts >= p.last AND st.ts - p.last <= 604800
WHERE p.tip <> p.seed AND (st.t = p.seed OR NOT list_contains(p.keys, st.t)) AND NOT list_contains(p.ev, st.e) AND len(p.ev) < {hops}),
chains AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_sort(ev) ORDER BY seed, ev) AS r FROM p WHERE len(ev) >= 2) WHERE r = 1)"""


_CHAIN = "array_to_string(keys, ',') AS keys, array_to_string(ev, ',') AS event_keys, len(ev)::INT AS hop_count, round((last - first) / 3600, 4) AS span_hours, tip = seed AS is_cyclic, round(CASE WHEN ams[1] <> 0 THEN ams[-1] / ams[1] END, 6) AS amount_decay"


def _chain_columns() -> list:
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("keys", "event_keys")]
    return ["seed", *joined, "hop_count", F.round("span_hours", 4).alias("span_hours"), "is_cyclic", F.round("amount_decay", 6).alias("amount_decay")]


@query("graph_discover_chains", f"{_chains_sql(str(SEED), 3)} SELECT seed, {_CHAIN} FROM chains")
def graph_discover_chains(spark, sf_dir):
    return G.discover_chains(edges(spark, sf_dir), [SEED], hops=3).select(*_chain_columns())


@query("graph_chain_statistics", f"""{_chains_sql(f'{SEED}, {OTHER}', 2, True)} SELECT seed, {_CHAIN}, round(list_avg(ams), 4) AS amount_mean, round(list_stddev_pop(ams), 4) AS amount_std, round(CASE WHEN list_avg(ams) <> 0 THEN list_stddev_pop(ams) / list_avg(ams) ELSE 0 END, 6) AS amount_cv,
list_min(ams) AS amount_min, list_max(ams) AS amount_max, len(list_distinct(keys))::INT AS n_keys FROM chains""")
def graph_chain_statistics(spark, sf_dir):
    found = G.chain_statistics(G.discover_chains(edges(spark, sf_dir), [SEED, OTHER], hops=2, direction="backward"))
    return found.select(*_chain_columns(), *(F.round(c, n).alias(c) for c, n in (("amount_mean", 4), ("amount_std", 4), ("amount_cv", 6))), "amount_min", "amount_max", "n_keys")


_CAPPED = ", ".join(f"least(greatest({c}, 0), 1) AS {n}" for n, c in (("hop_count", "len(ev) / 10.0e0"), ("is_cyclic", "(tip = seed)::INT::DOUBLE"), ("n_keys", "len(list_distinct(keys)) / 10.0e0"), ("amount_decay", "coalesce(round(CASE WHEN ams[1] <> 0 THEN ams[-1] / ams[1] / 2 END, 6), 0)")))


@query("graph_chain_line", f"{_chains_sql(str(SEED), 2)} SELECT sha256(array_to_string(ev, ',')) AS primary_key, array_to_string(keys, ',') AS chain_keys, array_to_string(ev, ',') AS chain_events, {_CAPPED} FROM chains")
def graph_chain_line(spark, sf_dir):
    return G.chain_line(G.discover_chains(edges(spark, sf_dir), [SEED], hops=2)).withColumn("amount_decay", F.round("amount_decay", 6))


@query("graph_chain_seeds", f"""WITH {S.EDGES}, o AS (SELECT from_key AS key, count(DISTINCT to_key) AS od, count(*) AS oe FROM edges GROUP BY 1), i AS (SELECT to_key AS key, count(DISTINCT from_key) AS idg, count(*) AS ie FROM edges GROUP BY 1),
j AS (SELECT key, coalesce(od, 0) AS out_degree, coalesce(idg, 0) AS in_degree, coalesce(oe, 0) + coalesce(ie, 0) AS n FROM o FULL JOIN i USING (key)), p AS (SELECT quantile_cont(out_degree, 0.95e0) AS lim FROM j)
SELECT key, out_degree, in_degree, out_degree >= lim AS is_fan_out, in_degree >= 2 AND out_degree >= 2 AND n >= 5 AS is_pass_through FROM j, p WHERE out_degree >= lim OR (in_degree >= 2 AND out_degree >= 2 AND n >= 5)""")
def graph_chain_seeds(spark, sf_dir):
    return G.chain_seeds(edges(spark, sf_dir))


@query("graph_geometric_path", f"""WITH {S.SUPPLIER_GEO}, {S.EDGES}, {BOTH}, h AS (SELECT key, other, {HOP} AS hop FROM nb JOIN sgeo x ON x.s_suppkey = key JOIN sgeo y ON y.s_suppkey = other),
one AS (SELECT [key, other] AS path, hop AS score FROM h WHERE key = {SEED} AND other = {OTHER}),
two AS (SELECT [a.key, a.other, b.other] AS path, (a.hop + b.hop) / 2 AS score FROM h a JOIN h b ON a.other = b.key WHERE a.key = {SEED} AND b.other = {OTHER} AND a.other <> {OTHER} AND NOT EXISTS (SELECT 1 FROM one))
SELECT array_to_string(path, ',') AS path, len(path)::INT - 1 AS n_hops, round(score, 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""")
def graph_geometric_path(spark, sf_dir):
    rows, calibration = geo(spark, sf_dir)
    found = G.geometric_path(edges(spark, sf_dir), rows, "s_suppkey", L.SUPPLIERS.deltas, calibration.theta, SEED, OTHER, beam=None, depth=2)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "n_hops", F.round("score", 6).alias("score"))


_P = " + ".join("x.delta_{0} * y.delta_{0}".format(d) for d in S.SUPPLIER_DIMS)


@query("graph_hop_scores", f"""WITH {S.SUPPLIER_GEO}, {S.EDGES}, {BOTH}
SELECT key, other, round(0.4 * CASE WHEN x.norm > 0 AND y.norm > 0 THEN ({_P}) / (x.norm * y.norm) ELSE 0 END
 + 0.3 * CASE WHEN {' + '.join(f"(abs(x.delta_{d}) > x.theta / 2 OR abs(y.delta_{d}) > x.theta / 2)::INT" for d in S.SUPPLIER_DIMS)} > 0 THEN ({' + '.join(f"(abs(x.delta_{d}) > x.theta / 2 AND abs(y.delta_{d}) > x.theta / 2)::INT" for d in S.SUPPLIER_DIMS)})::DOUBLE / ({' + '.join(f"(abs(x.delta_{d}) > x.theta / 2 OR abs(y.delta_{d}) > x.theta / 2)::INT" for d in S.SUPPLIER_DIMS)}) ELSE 0 END
 + 0.3 * CASE WHEN greatest(x.norm, y.norm) > 0 THEN least(x.norm, y.norm) / greatest(x.norm, y.norm) ELSE 0 END, 6) AS score
FROM nb JOIN sgeo x ON x.s_suppkey = key JOIN sgeo y ON y.s_suppkey = other WHERE key = {SEED}""")
def graph_hop_scores(spark, sf_dir):
    rows, calibration = geo(spark, sf_dir)
    n = len(L.SUPPLIERS.deltas)
    left = rows.select(F.col("s_suppkey").alias("key"), *(F.col(d).alias(f"x{i}") for i, d in enumerate(L.SUPPLIERS.deltas)))
    right = rows.select(F.col("s_suppkey").alias("other"), *(F.col(d).alias(f"y{i}") for i, d in enumerate(L.SUPPLIERS.deltas)))
    score = G.hop_score("geometric", [F.col(f"x{i}") for i in range(n)], [F.col(f"y{i}") for i in range(n)], calibration.theta / n**0.5)
    return G.both_ways(edges(spark, sf_dir)).where(F.col("key") == SEED).join(left, "key").join(right, "other").select("key", "other", F.round(score, 6).alias("score"))


@query("graph_cluster_bridges", f"""WITH {S.EDGES}, a AS (SELECT least(from_key % 5, to_key % 5) AS low, greatest(from_key % 5, to_key % 5) AS high, from_key, to_key FROM edges WHERE from_key % 5 <> to_key % 5)
SELECT low, high, (SELECT count(*) FROM a z WHERE z.low = e.low AND z.high = e.high) AS n_edges, count(DISTINCT k) AS n_entities FROM (SELECT low, high, from_key AS k FROM a UNION ALL SELECT low, high, to_key FROM a) e GROUP BY low, high ORDER BY n_edges DESC, low, high LIMIT 10""")
def graph_cluster_bridges(spark, sf_dir):
    clusters = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 5).alias("cluster"))
    return G.cluster_bridges(edges(spark, sf_dir), clusters)
