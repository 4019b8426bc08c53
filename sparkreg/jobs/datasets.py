"""Queries on datasets: projection, indexing, joins, keyed tables, sets, grouping, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreg.jobs.common import EV, KEYED, LI, Registry, events, gap6, lines, order_prices, order_totals, r6, table
from sparkreg.operators import dataset as D
from sparkreg.operators import grouping as G
from sparkreg.operators import keyed as K

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

# ---- projections, filters, indexing


@add("create_dataset", "SELECT o_orderkey AS row_id, round(o_totalprice / 1000, 6) AS feature, CAST(o_custkey AS DOUBLE) AS target, coalesce(CASE WHEN o_orderstatus = 'F' THEN 0.5 END, 0) AS target_variance FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return D.create_dataset(o, F.col("o_orderkey"), r6(F.col("o_totalprice") / 1000), F.col("o_custkey"), F.when(F.col("o_orderstatus") == "F", 0.5))


@add("filter_rows", f"WITH {EV} SELECT row_id, round(feature, 6) AS feature, target FROM ev WHERE feature > 24 AND key <> 'click'")
def _(spark, d):
    return events(spark, d).where((F.col("feature") > 24) & (F.col("key") != "click")).select("row_id", r6("feature").alias("feature"), "target")


@add("apply_rows", f"WITH {EV} SELECT row_id, round(sqrt(abs(target)) + feature, 6) AS applied FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", r6(F.sqrt(F.abs("target")) + F.col("feature")).alias("applied"))


def _positions(spark, d):
    """Every seventh row, last first, each of those below 70 twice."""
    e = table(spark, d, "events").where("event_id % 7 = 0")
    return e.select((-F.col("event_id") * 2).alias("pos"), F.col("event_id").alias("row_id")).union(e.where("event_id < 70").select(-F.col("event_id") * 2 + 1, "event_id"))


@add("subset_rows", f"WITH {EV}, p AS (SELECT -row_id * 2 AS pos, row_id FROM ev WHERE row_id % 7 = 0 UNION ALL SELECT -row_id * 2 + 1, row_id FROM ev WHERE row_id % 7 = 0 AND row_id < 70) SELECT p.pos AS row_id, target, key FROM p JOIN ev USING (row_id)")
def _(spark, d):
    return D.subset_rows(events(spark, d), _positions(spark, d)).select("row_id", "target", "key")


@add("set_subset", f"WITH {EV} SELECT row_id, CASE WHEN row_id % 7 = 0 THEN -1.0 ELSE target END AS target FROM ev")
def _(spark, d):
    changes = events(spark, d).where("row_id % 7 = 0").select("row_id", F.lit(-1.0).alias("target"))
    return D.set_subset(events(spark, d), changes, "target").select("row_id", "target")


@add("indices_complement", f"WITH {EV} SELECT row_id FROM ev WHERE row_id % 7 <> 0")
def _(spark, d):
    return D.indices_complement(events(spark, d), _positions(spark, d))


@add("indices_from_groups", f"WITH {EV}, k AS (SELECT * FROM (VALUES (0, 'error'), (1, 'view'), (2, 'error')) t(pos, key)) SELECT pos, row_id FROM k JOIN ev USING (key)")
def _(spark, d):
    keys = spark.createDataFrame([(0, "error"), (1, "view"), (2, "error")], "pos int, key string")
    return D.indices_from_groups(events(spark, d), F.broadcast(keys), "key")


@add("unique_values", "SELECT DISTINCT l_quantity AS value FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("value")).distinct()


@add("unique_value", "SELECT max(o_orderstatus) AS value FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return D.unique_value(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_orderstatus"))


def _mixed(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("feature"), F.col("s_acctbal").alias("target"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("feature"), F.col("c_acctbal").alias("target"))
    return D.concatenate_mixed([("name", s), ("nation", c)])


_MIXED = "m AS (SELECT 'name' AS kind, 0 AS part, s_suppkey AS row_id, s_name AS feature_name, CAST(NULL AS INTEGER) AS feature_nation, s_acctbal AS target FROM supplier UNION ALL SELECT 'nation', 1, c_custkey, NULL, c_nationkey, c_acctbal FROM customer)"


@add("concatenate_mixed", f"WITH {_MIXED} SELECT * FROM m")
def _(spark, d):
    return _mixed(spark, d).select("kind", "part", "row_id", "feature_name", "feature_nation", "target")


@add("extract_from_variants", f"WITH {_MIXED} SELECT row_id, feature_nation AS feature, target FROM m WHERE kind = 'nation'")
def _(spark, d):
    return D.extract_kind(_mixed(spark, d), "nation").select("row_id", "feature", "target")


@add("to_tagged_union", "SELECT c_custkey AS row_id, 'nation' AS kind, c_nationkey AS feature_nation, CAST(NULL AS VARCHAR) AS feature_name FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("feature"))
    return D.concatenate_mixed([("nation", c)]).select("row_id", "kind", "feature_nation", F.lit(None).cast("string").alias("feature_name"))


# ---- matrices in long form: (i, j, v)


def _matrix(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "v"))


_M = "m AS (SELECT i, j - 1 AS j, CAST(embedding[j] AS DOUBLE) AS v FROM (SELECT CAST(vec_id AS INTEGER) AS i, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings))"


@add("subset_matrix", f"WITH {_M} SELECT i // 3 AS i, j // 2 AS j, round(v, 6) AS v FROM m WHERE i % 3 = 0 AND j % 2 = 0")
def _(spark, d):
    m = _matrix(spark, d)
    rows = m.select("i").distinct().where("i % 3 = 0").select("i", F.expr("int(i div 3)").alias("ni"))
    columns = m.select("j").distinct().where("j % 2 = 0").select("j", F.expr("int(j div 2)").alias("nj"))
    return m.join(rows, "i").join(columns, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), r6(F.col("v").cast("double")).alias("v"))


# ---- joins


@add("align_datasets", "SELECT l.l_orderkey AS okey, l.l_linenumber AS line, o_custkey AS cust FROM lineitem l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0")
def _(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("feature"), F.col("l_linenumber").alias("line"))
    b = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("feature"), F.col("o_custkey").alias("cust"))
    return D.align(a, b, ["feature"]).select(F.col("feature").alias("okey"), "line", F.col("r_cust").alias("cust"))


@add("align_datasets_theta", "SELECT s_suppkey AS row_id, c_custkey AS r_row_id, round(abs(s_acctbal - c_acctbal), 6) AS gap FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 7.5")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("feature"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("feature"))
    return D.align_within(a, b, "feature", 7.5).select("row_id", "r_row_id", gap6(F.abs(F.col("feature") - F.col("r_feature"))).alias("gap"))


@add("align_datasets_points", "WITH s AS (SELECT s_suppkey AS row_id, s_acctbal / 1000 AS x, s_suppkey % 7 AS y, s_nationkey % 5 AS z FROM supplier), c AS (SELECT c_custkey AS r_row_id, c_acctbal / 1000 AS u, c_custkey % 7 AS v, c_nationkey % 5 AS w FROM customer) SELECT row_id, r_row_id, round(sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2), 6) AS gap FROM s JOIN c ON sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2) <= 1.2345")
def _(spark, d):
    """Pairs of suppliers and customers that are near each other in three dimensions."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 7).alias("y"), (F.col("s_nationkey") % 5).alias("z"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 7).alias("y"), (F.col("c_nationkey") % 5).alias("z"))
    apart = [(F.col(c) - F.col(f"r_{c}")).cast("double") for c in "xyz"]
    gap = F.sqrt(sum((d * d for d in apart), F.lit(0.0)))
    return D.align_points(a, b, ["x", "y", "z"], 1.2345).select("row_id", "r_row_id", gap6(gap).alias("gap"))


@add("group_with_rows", f"WITH {EV} SELECT ev.key, count(*) AS n, round(sum(ev.target * o_totalprice / 1000) / 1000, 6) AS s FROM ev JOIN orders ON o_orderkey = row_id GROUP BY 1")
def _(spark, d):
    other = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("other"))
    return events(spark, d).join(other, "row_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("target") * F.col("other") / 1000) / 1000).alias("s"))


@add("group_with_groups", f"WITH {EV}, g AS (SELECT key, avg(target) AS a FROM ev GROUP BY 1), h AS (SELECT key, max(feature) AS b FROM ev GROUP BY 1) SELECT key, round(a, 6) AS a, round(b, 6) AS b FROM g JOIN h USING (key)")
def _(spark, d):
    a = events(spark, d).groupBy("key").agg(F.avg("target").alias("value"))
    b = events(spark, d).groupBy("key").agg(F.max("feature").alias("value"))
    both = K._sides(a, b, "full_outer")
    equal = F.when(F.col("__in_a").isNull() | F.col("__in_b").isNull(), F.raise_error(F.lit("key sets differ")).cast("double")).otherwise(F.col("__a"))
    return both.select("key", r6(equal).alias("a"), r6("__b").alias("b"))


def _two(spark, d):
    return order_totals(spark, d), order_prices(spark, d)


@add("map_intersect", f"WITH {KEYED} SELECT key, round(a.value - b.value, 6) AS value FROM a JOIN b USING (key)")
def _(spark, d):
    return K.intersect(*_two(spark, d), lambda x, y: r6(x - y))


@add("map_union", f"WITH {KEYED} SELECT key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (key)")
def _(spark, d):
    return K.union(*_two(spark, d))


@add("map_join", f"WITH {KEYED} SELECT key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (key)")
def _(spark, d):
    return K.join_over(*_two(spark, d))


@add("map_join_strict", f"WITH {KEYED} SELECT * FROM a WHERE key % 3 = 0 UNION ALL SELECT * FROM b")
def _(spark, d):
    a, b = _two(spark, d)
    return K.join_strict(a.where("key % 3 = 0"), b)


@add("map_at_or", f"WITH {KEYED} SELECT key, coalesce(b.value, -1.0) AS value FROM a LEFT JOIN b USING (key)")
def _(spark, d):
    a, b = _two(spark, d)
    return K.at_or(b, a.select("key"), -1.0)


@add("map_subset", f"WITH {KEYED} SELECT * FROM a WHERE key IN (SELECT key FROM b)")
def _(spark, d):
    return K.subset(*_two(spark, d))


# ---- sets


@add("concatenate_datasets", "SELECT s_suppkey AS row_id, s_acctbal AS target FROM supplier UNION ALL SELECT c_custkey + (SELECT max(s_suppkey) + 1 FROM supplier), c_acctbal FROM customer")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("target"))
    return D.concatenate(s, table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("target")))


@add("set_difference", "SELECT DISTINCT l_suppkey AS value FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("value")).subtract(table(spark, d, "supplier").where("s_suppkey % 4 = 0").select("s_suppkey"))


@add("map_difference", f"WITH {KEYED} SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)")
def _(spark, d):
    return K.difference(*_two(spark, d))


@add("map_difference_keys", f"WITH {KEYED} SELECT key FROM a WHERE key NOT IN (SELECT key FROM b)")
def _(spark, d):
    return K.difference(*_two(spark, d)).select("key")


@add("map_symmetric_difference", f"WITH {KEYED} SELECT * FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)")
def _(spark, d):
    return K.symmetric_difference(*_two(spark, d))


@add("map_intersect_keys", f"WITH {KEYED} SELECT key FROM a WHERE key IN (SELECT key FROM b)")
def _(spark, d):
    return K.intersect_keys(*_two(spark, d))


# ---- groups


@add("group_by_groups", f"WITH {EV} SELECT CAST(floor(feature / 24) AS BIGINT) AS key, row_id, target FROM ev")
def _(spark, d):
    return G.with_key(events(spark, d), F.floor(F.col("feature") / 24)).select("key", "row_id", "target")


@add("group_indexers", f"WITH {EV} SELECT user_id AS key, count(*) AS n, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS indices FROM ev GROUP BY 1")
def _(spark, d):
    some = G.indexers(events(spark, d), "user_id")
    return some.select(F.col("user_id").alias("key"), F.size("indices").cast("long").alias("n"), F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


@add("group_keys", f"WITH {EV} SELECT DISTINCT user_id AS key FROM ev")
def _(spark, d):
    return events(spark, d).select(F.col("user_id").alias("key")).distinct()


@add("group_size", f"WITH {EV} SELECT count(DISTINCT user_id) AS n FROM ev")
def _(spark, d):
    return events(spark, d).agg(F.count_distinct("user_id").alias("n"))


@add("group_counts", f"WITH {LI} SELECT supp AS key, count(*) AS n FROM li GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy(F.col("supp").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@add("get_group", f"WITH {EV} SELECT row_id, target FROM ev WHERE key = 'error'")
def _(spark, d):
    return events(spark, d).where("key = 'error'").select("row_id", "target")


@add("first_group", f"WITH {EV} SELECT key, row_id, target FROM ev WHERE key = (SELECT min(key) FROM ev)")
def _(spark, d):
    return G.extreme_group(events(spark, d)).select("key", "row_id", "target")


@add("first_value", f"WITH {EV}, g AS (SELECT key, avg(target) AS v FROM ev GROUP BY 1) SELECT round(arg_min(v, key), 6) AS value FROM g")
def _(spark, d):
    return events(spark, d).groupBy("key").agg(F.avg("target").alias("v")).agg(r6(F.min_by("v", "key")).alias("value"))


@add("last_value", f"WITH {EV}, g AS (SELECT key, avg(target) AS v FROM ev GROUP BY 1) SELECT round(arg_max(v, key), 6) AS value FROM g")
def _(spark, d):
    return events(spark, d).groupBy("key").agg(F.avg("target").alias("v")).agg(r6(F.max_by("v", "key")).alias("value"))


@add("erase_group", f"WITH {EV} SELECT row_id, key FROM ev WHERE key <> 'error'")
def _(spark, d):
    return events(spark, d).where("key <> 'error'").select("row_id", "key")


@add("group_apply_scalar", f"WITH {LI} SELECT supp AS key, round(sum(y) / 1000, 6) AS total, round(avg(y), 6) AS mean FROM li GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy(F.col("supp").alias("key")).agg(r6(F.sum("y") / 1000).alias("total"), r6(F.avg("y")).alias("mean"))


@add("group_apply_rows", f"WITH {EV}, m AS (SELECT key, avg(target) AS mean FROM ev GROUP BY 1) SELECT key, row_id, target FROM ev JOIN m USING (key) WHERE target > mean + 0.001")
def _(spark, d):
    return G.with_group_value(events(spark, d), F.avg("target"), "mean").where("target > mean + 0.001").select("key", "row_id", "target")


@add("index_apply", f"WITH {EV} SELECT key, min(row_id) AS first_index, max(row_id) AS last_index, round(avg(row_id), 6) AS mean_index FROM ev GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("key").agg(F.min("row_id").alias("first_index"), F.max("row_id").alias("last_index"), r6(F.avg("row_id")).alias("mean_index"))


@add("group_filter", f"WITH {EV} SELECT user_id, row_id FROM ev WHERE user_id IN (SELECT user_id FROM ev GROUP BY 1 HAVING count(*) >= 60)")
def _(spark, d):
    return G.filter_groups(events(spark, d), F.count(F.lit(1)) >= 60, "user_id").select("user_id", "row_id")


@add("combine_groups", f"WITH {EV} SELECT row_number() OVER (ORDER BY key, row_id) - 1 AS position, key, row_id FROM ev")
def _(spark, d):
    return G.combine(events(spark, d).select("key", "row_id")).select("position", "key", "row_id")


@add("grouped_sum_mean", f"WITH {EV}, g AS (SELECT user_id, avg(target) AS v FROM ev GROUP BY 1) SELECT round(sum(v), 6) AS total, round(avg(v), 6) AS mean FROM g")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.avg("target").alias("v")).agg(r6(F.sum("v")).alias("total"), r6(F.avg("v")).alias("mean"))


@add("grouped_min_max", f"WITH {EV}, g AS (SELECT user_id AS key, count(*) AS value FROM ev GROUP BY 1) SELECT 'min' AS which, key, value FROM (SELECT * FROM g ORDER BY value, key LIMIT 1) UNION ALL SELECT 'max', key, value FROM (SELECT * FROM g ORDER BY value DESC, key LIMIT 1)")
def _(spark, d):
    g = events(spark, d).groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    low, high = G.extreme_value(g, "value"), G.extreme_value(g, "value", largest=True)
    return low.select(F.lit("min").alias("which"), "key", "value").union(high.select(F.lit("max"), "key", "value"))


@add("grouped_all_any", f"WITH {EV}, g AS (SELECT user_id, count(*) > 50 AS b FROM ev GROUP BY 1) SELECT bool_and(b) AS all_true, bool_or(b) AS any_true FROM g")
def _(spark, d):
    return G.all_any(events(spark, d).groupBy("user_id").agg((F.count(F.lit(1)) > 50).alias("b")), F.col("b"))


@add("leave_one_out_grouper", f"WITH {EV} SELECT row_id AS key, target FROM ev")
def _(spark, d):
    return G.leave_one_out(events(spark, d).drop("key")).select("key", "target")


@add("kfold_grouper", "SELECT o_orderkey AS row_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS key FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return G.kfold(o, 5).select("row_id", "key")


@add("all_same_value", f"WITH {EV} SELECT min(target_variance) = max(target_variance) AS all_same FROM ev")
def _(spark, d):
    return G.all_same(events(spark, d), F.col("target_variance"))


@add("mean_aggregator", f"WITH {EV}, m AS (SELECT key, sqrt(avg(target * target)) AS metric FROM ev GROUP BY 1) SELECT round(avg(metric), 6) AS mean FROM m")
def _(spark, d):
    return events(spark, d).groupBy("key").agg(F.sqrt(F.avg(F.col("target") * F.col("target"))).alias("m")).agg(r6(F.avg("m")).alias("mean"))


# ---- order


@add("deduplicate", "SELECT l_partkey AS feature, max(l_orderkey * 10 + l_linenumber) AS row_id FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_partkey").alias("feature"))
    return D.deduplicate(rows, ["feature"]).select("feature", "row_id")


@add("uniform_ks", f"WITH {EV}, u AS (SELECT (feature - min(feature) OVER ()) / (max(feature) OVER () - min(feature) OVER ()) AS x FROM ev), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM u) SELECT round(max(greatest((i + 1) / n - x, x - i / n, 0.0)), 6) AS ks FROM r")
def _(spark, d):
    e = events(spark, d)
    span = F.broadcast(e.agg(F.min("feature").alias("lo"), F.max("feature").alias("hi")))
    return G.uniform_ks(e.crossJoin(span).select(((F.col("feature") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x")), "x").select(r6("ks").alias("ks"))


@add("original_order", f"WITH {EV} SELECT row_id, round(target - avg(target) OVER (PARTITION BY key), 6) AS residual FROM ev")
def _(spark, d):
    e = events(spark, d)
    return G.in_original_order(G.with_group_value(e, F.avg("target"), "mean"), e).select("row_id", r6(F.col("target") - F.col("mean")).alias("residual"))


@add("best_iteration", f"WITH {EV} SELECT min(row_id) AS iteration, min(target) AS metric FROM ev WHERE target = (SELECT min(target) FROM ev)")
def _(spark, d):
    best = events(spark, d).where(~F.isnan("target")).agg(F.min(F.struct("target", "row_id")).alias("s"))
    return best.select(F.col("s.row_id").alias("iteration"), F.col("s.target").alias("metric"))


@add("running_max_loglik", f"WITH {EV}, w AS (SELECT row_id // 100 AS iteration, row_id % 100 AS ensemble_index, target, max(target) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev) SELECT iteration, ensemble_index, target FROM w WHERE before IS NULL OR target > before")
def _(spark, d):
    w = events(spark, d).select(F.expr("row_id div 100").alias("iteration"), (F.col("row_id") % 100).alias("ensemble_index"), "target")
    return D.running_max_before(w, "target", "iteration", "ensemble_index").where("before is null or target > before").select("iteration", "ensemble_index", "target")


@add("sample_without_replacement", f"WITH {EV} SELECT row_id, target FROM ev QUALIFY row_number() OVER (ORDER BY md5('7:' || row_id), row_id) <= (SELECT count(*) FROM ev) // 2")
def _(spark, d):
    """Half of all events."""
    e = events(spark, d)
    return D.sample_without_replacement(e, e.count() // 2, 7).select("row_id", "target")


