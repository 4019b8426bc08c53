"""Graphs as edge tables (a, b, cost, id): spanning forests by Boruvka rounds of joins and aggregates, over the edges that a
round of forests of parts of the graph leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.components import connected_components
from sparkreg.functions.storage import materialise


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("vertex")).union(edges.select("b")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, target, cost, id): every edge in both directions. The long form; collect lists only for bounded degrees."""
    there = edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "cost", "id")
    return there.union(edges.select("b", "a", "cost", "id"))


def spanning_forest(edges: DataFrame, maximum: bool = False, max_rounds: int = 40) -> DataFrame:
    """Edges (a, b, cost, id) of a minimum (or maximum) spanning forest; self-loops are dropped.

    An edge that is the last of a cycle among some of the edges is in no forest of all, so first each part of the graph keeps the
    edges of its own forest, over fewer and fewer parts (``_thinned``). If more is left than a task may hold, then every round
    each component takes its least edge in the total order (cost, a, b, id), which rules out cycles, and the components these
    edges join become one; rounds are written to the shared folder.
    """
    sign = -1 if maximum else 1
    left, ready = _thinned(edges.where("a <> b").withColumn("w", sign * F.col("cost")).select("a", "b", "cost", "id", "w"))
    if ready:
        return left.select("a", "b", "cost", "id")
    left = left.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    forest = None
    for _ in range(max_rounds):
        if left.limit(1).count() == 0:
            break
        edge = F.struct("w", "a", "b", "id", "cost", "ca", "cb")
        least = left.select(F.col("ca").alias("c"), edge.alias("e")).union(left.select("cb", edge)).groupBy("c").agg(F.min("e").alias("e"))
        taken = materialise(least.select("e.*").distinct(), "taken")
        forest = taken if forest is None else forest.union(taken)
        names = connected_components(taken, "ca", "cb")
        ends = [names.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"m{c}")) for c in ("ca", "cb")]
        left = left.join(ends[0], F.col("ca") == F.col("nca"), "left").join(ends[1], F.col("cb") == F.col("ncb"), "left")
        left = left.select("a", "b", "cost", "id", "w", F.coalesce("mca", "ca").alias("ca"), F.coalesce("mcb", "cb").alias("cb")).where("ca <> cb")
        left = materialise(left, "edges")
    if forest is None:
        return edges.where("false").select("a", "b", "cost", "id")
    return forest.select("a", "b", "cost", "id")


_HELD_EDGES = 1_000_000  # of a forest that a task holds


def _thinned(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges (a, b, cost, id, w) without those that are last in the order (w, a, b, id) of a cycle of their part, and whether that
    is the forest: the parts become fewer as long as one has about _HELD_EDGES edges at most. Edges without a cost or id, whose
    order is Spark's, all stay."""
    odd = F.col("w").isNull() | F.isnan("w") | F.col("id").isNull()
    edges, side = materialise(edges, "edges"), max(1, math.isqrt(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    while True:
        edges = materialise(_parts(edges.where(~odd), side).union(edges.where(odd)), "edges")
        if side == 1 and edges.count() <= _HELD_EDGES:
            return edges, edges.where(odd).limit(1).count() == 0
        fewer = math.isqrt(max(edges.count() - 1, 0) // _HELD_EDGES) + 1
        if fewer >= side:
            return edges, False
        side = fewer


def _parts(edges: DataFrame, side: int) -> DataFrame:
    """The edges of the forests of side * side parts: a part has the edges between two groups of nodes, so about 1 / side^2 of the
    edges and 2 / side of the nodes. Its edges stream by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, rows = None, [], 0
        for pdf in batches:
            waiting.append(pdf)
            rows += len(pdf)
            if rows >= max(50_000, 0 if held is None else len(held)):
                held, waiting, rows = kept_edges(pd.concat(waiting if held is None else [held, *waiting])), [], 0
                if len(held) > _HELD_EDGES:
                    yield held
                    held = None
        if waiting or held is not None:
            yield kept_edges(pd.concat(waiting if held is None else [held, *waiting]))

    group = [F.pmod(F.xxhash64(F.col(c)), F.lit(side)) for c in ("a", "b")]
    return edges.repartition(*group).mapInPandas(run, edges.schema)


def kept_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of the least forest of pdf in the order (w, a, b, id), by the same rounds in arrays."""
    pdf = pdf.sort_values(["w", "a", "b", "id"], ignore_index=True)
    codes = pd.factorize(pd.concat([pdf["a"], pdf["b"]]))[0]
    ends, n = codes.reshape(2, -1), int(codes.max(initial=-1)) + 1
    label, at, keep = np.arange(n), np.arange(len(pdf)), np.zeros(len(pdf), bool)
    while len(at):
        a, b = label[ends[0, at]], label[ends[1, at]]
        at, a, b = (v[a != b] for v in (at, a, b))
        if not len(at):
            break
        least = np.full(n, len(pdf))
        np.minimum.at(least, a, at)
        np.minimum.at(least, b, at)
        own = np.flatnonzero(least < len(pdf))
        keep[least[own]] = True
        # a component points to the other end of its least edge; of two that point to each other the lesser is the root
        other = np.arange(n)
        x, y = label[ends[0, least[own]]], label[ends[1, least[own]]]
        other[own] = np.where(x == own, y, x)
        root = np.where((other[other] == np.arange(n)) & (np.arange(n) < other), np.arange(n), other)
        while not np.array_equal(root, root[root]):
            root = root[root]
        label = root[label]
    return pdf[keep]


def spanning_tree(edges: DataFrame, maximum: bool = False) -> DataFrame:
    """The spanning tree of the component that holds the extreme edge: that part of the spanning forest, which has the same
    components as all edges, and the extreme edge too. A forest of one edge less than nodes is one tree."""
    forest = materialise(spanning_forest(edges, maximum), "forest")
    if vertices(forest).count() == forest.count() + 1:
        return forest
    least = F.struct(((-1 if maximum else 1) * F.col("cost")).alias("w"), "a", "b", "id")
    start = forest.agg(F.min(least).alias("e")).select(F.col("e.a").alias("s"))
    names = materialise(connected_components(forest), "components")
    mine = names.join(F.broadcast(start), F.col("node") == F.col("s")).select("component")
    inside = names.join(F.broadcast(mine), "component").select(F.col("node").alias("__n"))
    return forest.join(inside, F.col("a") == F.col("__n"), "left_semi")
