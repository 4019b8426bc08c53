"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. Sources share a budget of words by weight; a target stops at max_copies times its source and the excess goes to the
   others by weight (solved at once from running sums over the sources sorted by where they would stop).
2. Within a source a document of size class c (binary digits of its size) is meant to be taken e = min(max_copies,
   level * 2^(size_power * c)) times, the level chosen so that the expected words equal the target.
3. floor(e) whole copies are certain. The fraction left, p, is the inclusion probability of one further copy: documents
   are ranked by their random odds over their inclusion odds, (u/(1-u)) / (p/(1-p)), and the lowest ranks are taken
   until the words still missing are filled: the sample's size is fixed in words. One last document of the next
   ``reach`` ranks is added where that brings the source nearer to its target.

The ranks are never sorted as a whole: a histogram of 256 rank cells a source tells in which cell the sample ends, a second
one of 256 parts of that cell in which part, a third one likewise, and only the last part's documents are ordered: about one
in 17 million of a source. u comes from a hash of the document's id and text, so reruns agree.

Defined cases: null text has size 0; texts of any length are counted whole; a document of size 0 is never taken; a null source
is a source of its own, last in order; ids of any type will do; rows that share an id and text share their rank and are taken together;
other columns are kept whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise

WORDS = "[^\\x20\\x09-\\x0D]+"
SEED = 20240607
_BITS = 50  # of a rank
_CELL_BITS, _LEVELS = 8, 3  # of a rank's place in a histogram; histograms


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _mark(doc_id: Column, text: Column) -> Column:
    """What a document's rank is drawn from: its id and text, so that rows of one id (null above all) have ranks of their own."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def _rank(mark: Column, p: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), mark)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.floor(odds / (1 + odds) * float(1 << _BITS)).cast("long")


def _classes(slim: DataFrame, share: float, weights: tuple, max_copies: float, size_power: float) -> DataFrame:
    """(source, class) with source_size, target, whole copies and the probability of one more."""
    cells = slim.groupBy("source", "class").agg(F.sum("size").alias("words"))
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int"))
    sources = sources.withColumn("w", weight).withColumn("cap", max_copies * F.col("source_size"))
    sources = sources.withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    capped = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    open_weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.col("budget") - F.coalesce(capped, F.lit(0.0))) / open_weight)
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    sources = sources.select("source", "source_size", F.round(target, 6).alias("target"))

    cells = cells.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.withColumn("m", F.pow(F.lit(2.0), size_power * F.col("class")))
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    full = F.coalesce(F.sum(max_copies * F.col("words")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("m") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    cells = cells.withColumn("l", F.when(rest > 0, (F.col("target") - full) / rest))
    valid = F.when((F.col("l") * F.col("m") <= max_copies), F.struct("class", "l"))
    level = F.max(valid).over(Window.partitionBy("source"))["l"]
    copies = F.least(F.lit(max_copies), F.coalesce(level * F.col("m"), F.lit(max_copies)))
    cells = cells.withColumn("e", F.greatest(F.lit(0.0), copies))
    return cells.select("source", "class", "words", "source_size", "target", F.floor("e").alias("whole"), (F.col("e") - F.floor("e")).alias("p"))


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    side = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), "source_size", "target", "whole", "p")
    return rows.join(bounded_broadcast(side), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left").drop("s", "c")


def _end_parts(ranked: DataFrame, start: DataFrame, low_bits: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ranked (source, size, k) in the cell where each source's sample ends and in those with the next ranks.

    start has (source, before, missing): the words of ranks below ranked's, and those that the sample needs. Cells are
    k >> low_bits. Returns the rows, and start for them.
    """
    cell = F.shiftright("k", low_bits)
    up = Window.partitionBy("source").orderBy("cell")
    cells = ranked.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    side = start.select(F.col("source").alias("r"), F.col("before").alias("below"), "missing")
    cells = cells.join(bounded_broadcast(side), F.col("source").eqNullSafe(F.col("r"))).drop("r")
    cells = cells.withColumn("before", F.col("below") + F.sum("words").over(up) - F.col("words")).withColumn("upto", F.sum("n").over(up))
    ends = F.when(F.col("before") + F.col("words") > F.col("missing"), F.struct("cell", "before", "upto"))
    cells = cells.withColumn("first", F.min(ends).over(Window.partitionBy("source")))
    cells = materialise(cells.where(F.expr(f"cell >= first.cell and upto - n < first.upto + {reach}")), "mix-cells")
    places = cells.select(F.col("source").alias("e"), F.col("cell").alias("at"))
    rows = ranked.join(bounded_broadcast(places), F.col("source").eqNullSafe(F.col("e")) & (cell == F.col("at"))).drop("e", "at")
    return rows, cells.groupBy("source").agg(F.min("first.before").alias("before"), F.max("missing").alias("missing"))


def _ends(ranked: DataFrame, missing: DataFrame, reach: int) -> DataFrame:
    """(source, cut, pick): ranks up to cut are taken, and the rank pick. A source without a row has every rank taken."""
    start = missing.withColumn("before", F.lit(0).cast("long"))
    for level in range(1, _LEVELS + 1):
        ranked, start = _end_parts(ranked, start, _BITS - level * _CELL_BITS, reach)
    side = start.withColumnRenamed("source", "r")
    last = ranked.join(bounded_broadcast(side), F.col("source").eqNullSafe(F.col("r")))
    last = last.groupBy("source", "k", "before", "missing").agg(F.sum("size").alias("x"))
    by_rank = Window.partitionBy("source").orderBy("k")
    last = last.withColumn("upto", F.col("before") + F.sum("x").over(by_rank)).withColumn("in", F.col("upto") <= F.col("missing"))
    out = F.sum(F.when(~F.col("in"), 1)).over(by_rank)
    gap = F.col("missing") - F.coalesce(F.max(F.when(F.col("in"), F.col("upto"))).over(Window.partitionBy("source")), F.col("before"))
    last = last.withColumn("out", out).withColumn("gap", gap).withColumn("miss", F.abs(F.col("gap") - F.col("x")))
    pick = F.min(F.when((~F.col("in")) & (F.col("out") <= reach) & (F.col("miss") < F.col("gap")), F.struct("miss", "k")))["k"]
    cut = F.max(F.when(F.col("in"), F.col("k")))
    # with no rank of the end part taken, the sample stops before it
    return last.groupBy("source").agg(F.coalesce(cut, F.min("k") - 1).alias("cut"), pick.alias("pick"))


def _mixed(docs: DataFrame, share: float, weights: tuple, max_copies: float, size_power: float, reach: int, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(row, size, source_size, target, copies) of every row of docs, as a struct."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(whole.alias("row"), _mark(F.col(id_col), F.col(text_col)).alias("mark"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"))
    sized = sized.withColumn("class", F.length(F.bin("size")))
    slim = materialise(sized.select("mark", "source", "size", "class"), "mix-sizes")
    classes = materialise(_classes(slim, share, weights, max_copies, size_power), "mix-classes")
    rank = F.when((F.col("size") > 0) & (F.col("p") > 1e-12), _rank(F.col("mark"), F.least("p", F.lit(1 - 1e-12)), seed))
    ranked = materialise(_with_class(slim, classes).select("source", "size", rank.alias("k")).where("k is not null"), "mix-ranks")
    missing = classes.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("missing"))
    ends = materialise(_ends(ranked, missing, reach).withColumnRenamed("source", "e"), "mix-ends")

    rows = _with_class(sized, classes).join(bounded_broadcast(ends), F.col("source").eqNullSafe(F.col("e")), "left").withColumn("k", rank)
    more = F.when((F.col("k") <= F.col("cut")) | F.col("cut").isNull() | (F.col("k") == F.col("pick")), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("k").isNull(), 0).otherwise(more)).otherwise(0).cast("long")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_sources(
    docs: DataFrame, *, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), max_copies: float = 2.0, size_power: float = 0.25,
    reach: int = 64, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies and mix_taken; columns of docs of these names give way."""
    rows = _mixed(docs, share, weights, max_copies, size_power, reach, seed, id_col, source_col, text_col)
    new = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_copies": F.col("copies"), "mix_taken": F.col("copies") * F.col("size")}
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *(c.alias(name) for name, c in new.items()))


def mixed_rows(
    docs: DataFrame, *, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), max_copies: float = 2.0, size_power: float = 0.25,
    reach: int = 64, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    rows = _mixed(docs, share, weights, max_copies, size_power, reach, seed, id_col, source_col, text_col).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
