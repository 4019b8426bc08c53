"""Operators on regression datasets: one row a measurement.

A dataset has row_id (its explicit order), feature column(s), target and target_variance. Positions are values of row_id;
no operator relies on the physical order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.storage import MAX_ROWS, bounded_broadcast, materialise


def create_dataset(df: DataFrame, row_id: Column, feature: Column, target: Column, variance: Column | None = None, *more: Column) -> DataFrame:
    """row_id, feature, target, target_variance (0 where absent) and more columns."""
    spread = F.lit(0.0) if variance is None else F.coalesce(variance.cast("double"), F.lit(0.0))
    return df.select(row_id.cast("long").alias("row_id"), feature.alias("feature"), target.cast("double").alias("target"), spread.alias("target_variance"), *more)


def require_complete(df: DataFrame, *columns: str) -> DataFrame:
    """df, with an error at the first row in which one of columns is null or NaN."""
    types = dict(df.dtypes)
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False)) for c in columns])
    checked = {c: F.when(bad, F.raise_error(F.lit(f"null or NaN in {', '.join(columns)}")).cast(types[c])).otherwise(F.col(c)) for c in columns[:1]}
    return df.withColumns(checked)


def subset_rows(df: DataFrame, positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows at positions (pos, row_id), in the order and multiplicity of pos, which becomes the row_id."""
    taken = positions.select(F.col("pos"), F.col(row_id).alias("__at"))
    rows = taken.join(df, F.col("__at") == F.col(row_id), "left")
    present = F.when(F.col(row_id).isNull(), F.raise_error(F.lit("position out of range")).cast("long")).otherwise(F.col("pos"))
    return rows.withColumn(row_id, present).drop("__at", "pos")


def set_subset(df: DataFrame, changes: DataFrame, value: str, row_id: str = "row_id") -> DataFrame:
    """df with value overwritten at the row_ids of changes (row_id, value)."""
    new = changes.select(F.col(row_id).alias("__at"), F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return df.join(new, F.col(row_id) == F.col("__at"), "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__at", "__new", "__hit")


def indices_complement(df: DataFrame, positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.select(row_id).join(positions.select(row_id), row_id, "left_anti")


def indices_from_groups(df: DataFrame, keys: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """(pos, row_id): row_ids of the listed keys (pos, key); a key listed twice repeats."""
    return keys.join(df.select(F.col(key), F.col(row_id)), key).select("pos", row_id)


def unique_value(df: DataFrame, value: Column) -> DataFrame:
    """The one distinct value; an error unless there is exactly one."""
    least, most = F.min(value), F.max(value)
    one = F.count(value).cast("boolean") & (least == most)
    return df.agg(F.when(one, least).otherwise(F.raise_error(F.lit("not exactly one distinct value"))).alias("value"))


def deduplicate(df: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """One row of each feature: the last. A partial aggregate, so a feature that most rows share is no hot group."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(row_id)).alias("__row"))
    return last.select(*keys, "__row.*").select(*df.columns)


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of rows with equal keys: left columns as they are, right columns with the prefix r_. Order: row_id, r_row_id."""
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    return left.join(other, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"r_{k}") for k in keys]))


def align_within(left: DataFrame, right: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Every pair of rows whose values differ by at most tolerance."""
    return align_points(left, right, [value], tolerance)


_RUN, _GROUP = 64, 4_096  # rows of a run, and of a group that is sorted into runs
_PARTS, _CARRIED = 250, 500_000  # parts of all cells together, about, or the shuffle partitions if more; rows that the runs of a part hold


def align_points(left: DataFrame, right: DataFrame, columns: list[str], tolerance: float, hot_rows: int = 20_000) -> DataFrame:
    """Every pair of rows whose points are at most tolerance apart (Euclidean): an equality join on cells of that width.

    The side with fewer rows is carried: in runs of _RUN rows that lie close together, it goes to each cell that a run's box may
    reach (about 3^d for d columns). Rows of the other side stay in their cells, meet the boxes there, and unpack only the runs that
    may hold a partner. Cells with more than 1,000 hot_rows pairs, or more than one in _PARTS of all pairs where those are more, are
    dealt out in parts of both sides. So the number of copies of a row does not grow with the tables, until the runs that reach
    a cell hold more than _CARRIED rows, which no task holds at once. Left columns as they are, right columns with the prefix r_;
    rows with a null or infinite coordinate have no partner.
    """
    def value(c: str) -> Column:
        return F.col(c).cast("double")

    def sound(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf"))

    def cell(v: Column) -> Column:
        return F.floor(v / tolerance).cast("long")

    def placed(df: DataFrame, names: list[str]) -> DataFrame:
        for c in names:
            df = df.where(sound(c))
        return df.withColumns({k: cell(value(c)) for k, c in zip(cells, names, strict=True)})

    def spread(df: DataFrame, ends: list[tuple[Column, Column]]) -> DataFrame:
        for k, (low, high) in zip(cells, ends, strict=True):
            df = df.withColumn(k, F.explode(F.sequence(low, high)))
        return df

    cells, theirs = [f"__c{k}" for k in range(len(columns))], [f"r_{c}" for c in columns]
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    names, kinds = [*left.columns, *other.columns], dict(left.dtypes) | dict(other.dtypes)
    stay, carried, mine, to = placed(left, columns), placed(other, theirs), columns, theirs
    zero, one = F.lit(0), F.lit(1)
    counts = stay.select(*cells, one.alias("__n"), zero.alias("__m")).union(carried.select(*cells, zero, one))
    counts = materialise(counts.groupBy(*cells).agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m")), "cells")
    found = counts.agg(F.sum("__n").alias("n"), F.sum("__m").alias("m"), F.count(one).alias("cells")).first()
    if (found.n or 0) < (found.m or 0):
        stay, carried, mine, to = carried, stay, to, mine
        counts = counts.select(*cells, F.col("__m").alias("__n"), F.col("__n").alias("__m"))

    # parts of a cell: __a of the rows that stay, __b of the runs, so that about the same number of rows of both is copied
    reach = spread(counts.where("__m > 0").select(*cells, "__m"), [(F.col(k) - 1, F.col(k) + 1) for k in cells])
    sizes = counts.where("__n > 0").select(*cells, "__n").join(reach.groupBy(*cells).agg(F.sum("__m").alias("__m")), cells, "left").fillna(1, ["__m"])
    sizes = materialise(sizes.withColumn("__pairs", F.col("__n").cast("double") * F.col("__m")), "pairs")
    total = sizes.agg(F.sum("__pairs").alias("pairs"), F.count(one).alias("cells")).first()
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1000.0 * hot_rows, (total.pairs or 0) / max(_PARTS, partitions))
    parts, m = F.ceil(F.col("__pairs") / most), F.col("__m")
    even = F.ceil(parts / F.ceil(F.sqrt(parts * F.col("__n") / m)))
    b = F.greatest(F.least(even, F.ceil(m / _RUN)), F.ceil(m / _CARRIED))
    dealing = sizes.select(*cells, F.ceil(parts / b).cast("int").alias("__a"), b.cast("int").alias("__b"))
    few = total.cells <= MAX_ROWS
    dealing = F.broadcast(dealing) if few else bounded_broadcast(materialise(dealing.where("__a > 1 or __b > 1"), "hot-cells"))

    def dealt(df: DataFrame, own: str, others: str, parts: str, copies: str, key: Column) -> DataFrame:
        """df in ``parts`` parts of its cell, each ``copies`` times; only cells where rows stay, if all of these are known."""
        df = df.join(dealing, cells, "inner" if few else "left").withColumn(own, F.pmod(key, F.coalesce(parts, one)).cast("int"))
        df = df.withColumn(others, F.explode(F.sequence(zero, F.coalesce(copies, one) - 1))).withColumn("__at", F.concat_ws(",", *cells, "__p", "__q"))
        return df.drop(*cells, "__p", "__q", "__a", "__b").repartition(tasks, "__at")  # one key: a constant coordinate stays part of it

    # runs: rows of a group in strips of all coordinates but the first, and along the first within a strip
    fields, kept = [c for c in carried.columns if c not in cells], [c for c in stay.columns if c not in cells]
    strip = tolerance / max(2, round((_GROUP / _RUN) ** (1 / len(to))))
    order = F.struct(*(F.floor(value(c) / strip).alias(f"s{k}") for k, c in enumerate(to[1:])), value(to[0]).alias("x"))
    crowded = counts.where(m > _GROUP).select(*cells, F.ceil(m / _GROUP).alias("__groups"))
    crowded = F.broadcast(crowded) if found.cells <= MAX_ROWS else bounded_broadcast(crowded)
    groups = carried.join(crowded, cells, "left").withColumn("__g", F.pmod(F.xxhash64(*fields), F.coalesce("__groups", one)))
    groups = groups.groupBy(*cells, "__g").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("row")))).alias("__rows"))
    groups = groups.withColumn("__k", F.explode(F.sequence(one, F.size("__rows"), F.lit(_RUN))))
    runs = groups.select(F.xxhash64(*cells, "__g", "__k").alias("__key"), F.slice("__rows", F.col("__k"), F.lit(_RUN))["row"].alias("__run"))
    box, ends, wide = {}, [], tolerance * (1 + 1e-9)
    for k, c in enumerate(to):
        v = F.transform(F.col("__run")[c], lambda x: x.cast("double"))
        lost = 0.0 if kinds[c] in ("double", "float", "int", "smallint", "tinyint") else 2.0**-52  # by the cast
        box |= {f"__l{k}": F.array_min(v) - F.abs(F.array_min(v)) * lost, f"__u{k}": F.array_max(v) + F.abs(F.array_max(v)) * lost}
        ends.append((cell(F.col(f"__l{k}") - wide), cell(F.col(f"__u{k}") + wide)))
    tasks = max(partitions, math.ceil((total.pairs or 0) / most))
    stay = dealt(stay, "__p", "__q", "__a", "__b", F.xxhash64(*kept))
    runs = dealt(spread(runs.withColumns(box), ends), "__q", "__p", "__b", "__a", F.col("__key")).drop("__key")

    def length(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [g * g for g in parts])

    apart = [F.greatest(F.col(f"__l{k}") - value(c), value(c) - F.col(f"__u{k}"), F.lit(0.0)) for k, c in enumerate(mine)]
    pairs = stay.join(runs.hint("merge"), "__at").where(length(apart) <= wide * wide).select(*kept, F.inline("__run"))
    gap = F.abs(F.col(columns[0]) - F.col(theirs[0])) if len(columns) == 1 else F.sqrt(length([value(c) - value(r) for c, r in zip(columns, theirs, strict=True)]))
    return pairs.where(gap <= tolerance).select(*names)


def align_on_sphere(left: DataFrame, right: DataFrame, lat: str, lon: str, metres: float, radius: float = 6_371_000.0, hot_rows: int = 20_000) -> DataFrame:
    """Every pair of rows whose places, in degrees, are at most that far apart on the sphere: by the chord, so that poles and
    the date line are places like others."""
    names = ["__x", "__y", "__z"]

    def on_sphere(df: DataFrame) -> DataFrame:
        a, b = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
        return df.withColumns({"__x": F.cos(a) * F.cos(b), "__y": F.cos(a) * F.sin(b), "__z": F.sin(a)})

    chord = 2 * math.sin(min(metres / radius, math.pi) / 2)
    return align_points(on_sphere(left), on_sphere(right), names, chord, hot_rows).drop(*names, *(f"r_{n}" for n in names))


def concatenate(first: DataFrame, *others: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of all, in order: row_ids of each follow those before. Metadata columns that differ are an error."""
    out, offset = first, None
    for other in others:
        top = out.agg(F.coalesce(F.max(row_id) + 1, F.lit(0)).alias("__top"))
        offset = F.broadcast(top)  # one row
        out = out.unionByName(other.crossJoin(offset).withColumn(row_id, F.col(row_id) + F.col("__top")).drop("__top"))
    return out


def concatenate_mixed(parts: list[tuple[str, DataFrame]], feature: str = "feature") -> DataFrame:
    """Datasets with features of different types as one tagged union: kind, and a nullable column a type."""
    tagged = [df.withColumn("kind", F.lit(kind)).withColumnRenamed(feature, f"{feature}_{kind}").withColumn("part", F.lit(k)) for k, (kind, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def extract_kind(df: DataFrame, kind: str, feature: str = "feature") -> DataFrame:
    """The rows of one kind of a tagged union."""
    drop = [c for c in df.columns if c.startswith(f"{feature}_") and c != f"{feature}_{kind}"]
    return df.where(F.col("kind") == kind).drop("kind", *drop).withColumnRenamed(f"{feature}_{kind}", feature)


def sample_without_replacement(df: DataFrame, n: int, seed: int, row_id: str = "row_id", bits: int = 16, few: int = 10_000) -> DataFrame:
    """n distinct rows, uniformly: the n least MD5 sums of seed and row_id, so that partitioning has no say.

    Counts of 2^bits ranges of sums tell in which range the n-th lies, counts within it in which part, until ``few`` sums are
    left; the n-th of all is then the limit of a filter, and no task gathers the sample. row_ids are distinct; more rows than
    there are is an error.
    """
    rows = df.withColumn("__u", F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))))
    digits, prefix, missing = bits // 4, "", n
    if n <= 0:
        return df.limit(0)
    while True:
        at = F.substring("__u", len(prefix) + 1, digits)
        inside = rows.where(F.col("__u").startswith(prefix)) if prefix else rows
        counts = sorted((r.c, r.n) for r in inside.groupBy(at.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())  # 2^bits numbers
        for c, own in counts:
            if missing <= own:
                break
            missing -= own
        else:
            raise ValueError("more rows asked for than there are")
        prefix += c
        if own <= few or len(prefix) >= 32:
            break
    last = rows.where(F.col("__u").startswith(prefix)).select("__u", F.col(row_id).alias("__r")).orderBy("__u", "__r").limit(missing)
    cut = F.broadcast(last.agg(F.max(F.struct("__u", "__r")).alias("__cut")))  # one row
    return rows.join(cut, F.struct(F.col("__u"), F.col(row_id)) <= F.col("__cut")).drop("__u", "__cut")


def first_by(df: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """One row of each key: the first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def running_max_before(df: DataFrame, value: str, outer: str, inner: str) -> DataFrame:
    """df with before: the largest value of all earlier rows in the order (outer, inner); null for the first.

    Three levels: the maxima of runs of outer steps (one row a partition of a range shuffle of the steps), of whole outer
    steps within a run, and a window inside each step.
    """
    steps = df.groupBy(F.col(outer).alias("__o")).agg(F.max(value).alias("__m"))
    steps = materialise(steps.repartitionByRange("__o").withColumn("__run", F.spark_partition_id()), "steps")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = steps.groupBy("__run").agg(F.max("__m").alias("__r")).select("__run", F.max("__r").over(earlier().orderBy("__run")).alias("__rest"))
    steps = steps.join(F.broadcast(runs), "__run")  # one row a partition
    steps = steps.select("__o", F.greatest("__rest", F.max("__m").over(earlier("__run").orderBy("__o"))).alias("__before"))
    inside = Window.partitionBy(outer).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.join(steps, F.col(outer) == F.col("__o"))
    return rows.withColumn("before", F.greatest("__before", F.max(value).over(inside))).drop("__o", "__before")
