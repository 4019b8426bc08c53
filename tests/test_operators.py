"""Datasets, groups, keyed tables, graphs and order: literal cases, edges, and partitions that must not matter."""

import random

import pytest
from pyspark.sql import functions as F

from sparkreg.functions.components import connected_components
from sparkreg.functions.order import global_row_number
from sparkreg.operators import dataset as D
from sparkreg.operators import graph as GR
from sparkreg.operators import grouping as G
from sparkreg.operators import keyed as K


def _ds(spark, values, schema="row_id long, feature int"):
    return spark.createDataFrame(list(enumerate(values)), schema)


def test_deduplicate_keeps_the_last(spark):
    assert sorted(r.row_id for r in D.deduplicate(_ds(spark, [0, 1, 1, 2]), ["feature"]).collect()) == [0, 2, 3]
    assert D.deduplicate(_ds(spark, []), ["feature"]).count() == 0


@pytest.mark.parametrize("a,b,n", [([0, 1, 2], [2, 3, 0, 1], 3), ([0, 1, 2, 3], [2, 4, 0], 2), ([0, 1, 2], [3, 4, 5], 0), ([1, 1], [1, 1, 1], 6)])
def test_align(spark, a, b, n):
    assert D.align(_ds(spark, a), _ds(spark, b), ["feature"]).count() == n
    assert D.align_within(_ds(spark, a), _ds(spark, b), "feature", 0.5).count() == n


def test_align_within_finds_every_pair(spark):
    random.seed(3)
    a, b = ([round(random.uniform(-20, 20), 3) for _ in range(80)] for _ in "ab")
    got = D.align_within(_ds(spark, a, "row_id long, feature double"), _ds(spark, b, "row_id long, feature double"), "feature", 0.75)
    assert sorted((r.row_id, r.r_row_id) for r in got.collect()) == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 0.75)


def test_subset_order_multiplicity_and_range(spark):
    df = _ds(spark, [10, 11, 12])
    taken = D.subset_rows(df, spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "pos long, row_id long")).orderBy("row_id")
    assert [r.feature for r in taken.collect()] == [12, 10, 12]
    with pytest.raises(Exception, match="out of range"):
        D.subset_rows(df, spark.createDataFrame([(0, 9)], "pos long, row_id long")).collect()


def test_guards(spark):
    df = _ds(spark, [1, 2, 3])
    with pytest.raises(Exception, match="exactly one"):
        D.unique_value(df, F.col("feature")).collect()
    with pytest.raises(Exception, match="not those"):
        G.in_original_order(df.where("row_id < 2"), df).collect()
    with pytest.raises(Exception, match="both sides"):
        kv = spark.createDataFrame([(1, 2)], "key int, value int")
        K.join_strict(kv, kv).collect()
    with pytest.raises(Exception, match="more rows"):
        D.sample_without_replacement(df, 5, 1).collect()
    with pytest.raises(Exception, match="null or NaN"):
        D.require_complete(spark.createDataFrame([(1, None)], "a int, b double"), "a", "b").collect()


def test_map_operators_keep_null_values_apart_from_missing_keys(spark):
    a = spark.createDataFrame([(1, None), (2, 20)], "key int, value int")
    b = spark.createDataFrame([(1, 5), (3, 30)], "key int, value int")
    rows = lambda df: sorted((r.key, r.value) for r in df.collect())
    assert rows(K.union(a, b)) == [(1, None), (2, 20), (3, 30)]
    assert rows(K.join_over(a, b)) == [(1, 5), (2, 20), (3, 30)]
    assert rows(K.at_or(a, b, -1)) == [(1, None), (3, -1)]
    assert rows(K.symmetric_difference(a, b)) == [(2, 20), (3, 30)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_row_numbers_are_dense_in_any_partitioning(spark, parts):
    values = list(range(200))
    random.Random(parts).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(parts)
    assert all(r.v == r.row_number for r in global_row_number(df, "v").collect())


def test_row_numbers_of_an_empty_table(spark):
    assert global_row_number(spark.createDataFrame([], "v int"), "v").count() == 0


def test_extremes_all_any(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0), ("d", 3.0)], "key string, v double")
    assert G.extreme_value(df, "v").first().key == "a" and G.extreme_value(df, "v", largest=True).first().key == "c"
    row = G.all_any(df.where("false"), F.col("v") > 0).first()
    assert row.all_true and not row.any_true
    assert G.all_same(df.where("false"), F.col("v")).first().all_same


def test_kfold_of_positions(spark):
    df = spark.createDataFrame([(v,) for v in (5, 9, 12, 40)], "row_id long")
    assert {r.row_id: r.key for r in G.kfold(df, 2).collect()} == {5: 0, 9: 1, 12: 0, 40: 1}


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 130)} == {100}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def _kruskal(edges):
    par, total, n = {}, 0.0, 0

    def find(v):
        while par.setdefault(v, v) != v:
            v = par[v]
        return v

    for a, b, c, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = find(a), find(b)
        if x != y:
            par[x], total, n = y, total + c, n + 1
    return total, n


def test_spanning_forest_has_least_cost(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(6)), k) for k in range(90)] + [(50, 51, 1.0, 90), (51, 51, 0.0, 91)]
    df = spark.createDataFrame(edges, "a int, b int, cost double, id int")
    rows = GR.spanning_forest(df).collect()
    want, n = _kruskal([e for e in edges if e[0] != e[1]])
    assert (sum(r.cost for r in rows), len(rows)) == (want, n)
    most = sum(r.cost for r in GR.spanning_forest(df, maximum=True).collect())
    assert most == -_kruskal([(a, b, -c, k) for a, b, c, k in edges if a != b])[0]
    tree = GR.spanning_tree(spark.createDataFrame([(0, 1, 5.0, 0), (1, 2, 4.0, 1), (7, 8, 1.0, 2)], "a int, b int, cost double, id int"))
    assert [(r.a, r.b) for r in tree.collect()] == [(7, 8)]


def test_materialise_keeps_the_session_as_it_was(spark):
    from sparkreg.functions.storage import bounded_broadcast, materialise

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.range(50)
    sizes = df.mapInPandas(lambda it: (p.assign(id=len(p)) for p in it), "id long")
    assert max(r.id for r in materialise(sizes, "sizes", batch_rows=5).collect()) <= 5
    assert spark.conf.get(key) == before
    assert "broadcast" in bounded_broadcast(df, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in bounded_broadcast(df, 49)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("hot_rows", [3, 20_000])
def test_components_with_hubs(spark, hot_rows):
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(17)] + [(200, 200), (None, 5), (300, 301), (39, 90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hot_rows=hot_rows).collect()}
    want = {**dict.fromkeys([*range(40), 90], 0), **dict.fromkeys(range(100, 118), 100), 300: 300, 301: 300}
    assert got == want
