"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, hot_rows: int = 20_000) -> DataFrame:
    """(node, component): component is the least node of its connected component.

    Every round takes the least label among neighbours and then jumps to the label's own label, which halves the remaining
    paths; labels are written every round. Nodes with more than hot_rows edges, and labels that more than hot_rows nodes have,
    are joined by a broadcast of their own (there is at most one for every hot_rows rows), so neither a hub nor a large component
    meets in one task. Null ends and self-loops are ignored; an empty edge table gives an empty result.
    """
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialise(one.union(one.select("v", "u")).distinct(), "edges")
    start = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l"), F.count(F.lit(1)).alias("n")), "labels")
    hubs = _hot(start.select(F.col("u").alias("v"), "n"), "v", hot_rows)
    labels = start.select("u", "l")
    for _ in range(max_rounds):
        near = _join(both, labels.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v", hubs, "inner").groupBy("u").agg(F.min("nl").alias("nl"))
        step = labels.join(near, "u", "left").select("u", F.col("l").alias("old"), F.least("l", F.coalesce("nl", "l")).alias("l"))
        large = _hot(labels.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "l", hot_rows)  # as of the round before
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after = _join(step, jump, "l", large, "left").select("u", "old", F.least("l", F.coalesce("ll", "l")).alias("l"))
        after = materialise(after, "labels")
        labels = after.select("u", "l")
        if after.where("old <> l").limit(1).count() == 0:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _hot(sizes: DataFrame, key: str, hot_rows: int) -> DataFrame | None:
    """The keys of more than hot_rows rows, or None if there are none."""
    found = materialise(sizes.where(F.col("n") > hot_rows).select(key), "hot-keys")
    return found if found.limit(1).count() else None


def _join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str) -> DataFrame:
    """left joined with right, which has one row a key; the hot keys apart from the others."""
    if hot is None:
        return left.join(right, key, how)
    side = bounded_broadcast(hot)
    some = left.join(side, key, "left_semi").join(bounded_broadcast(materialise(right.join(side, key, "left_semi"), "hot-rows")), key, how)
    return some.unionByName(left.join(side, key, "left_anti").join(right, key, how))
