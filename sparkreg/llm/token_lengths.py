"""Exact token-length histogram: totals, quantiles and truncated totals for every context limit.

Every whole text is encoded once; what leaves a task is one count for each length it has met. Suffix sums over the
histogram then answer, for a limit L: the documents of at least L tokens, their tokens, and the tokens left when every
document is cut at L. The sums run over blocks of lengths, so no task gathers the histogram.

Defined cases: null and empty texts have length 0; texts of any length are encoded whole; equal lengths share a row, and rows
that repeat count as often as they stand; other columns, ids among them, are ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.storage import materialise
from sparkreg.llm.tokens import encoder

BLOCK = 128  # lengths whose sums are taken together


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs) of the encoded texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, lengths = encoder(vocabulary), Counter()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                lengths.update(tool.lengths(batch.column(0).slice(low, 256).to_pylist()))
        tool.settle()
        yield pa.RecordBatch.from_pydict({"length": list(lengths), "n": list(lengths.values())}, schema=pa.schema([("length", pa.int64()), ("n", pa.int64())]))

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "length long, n long")
    return parts.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least, tokens_at_least, truncated_total (limit = length), and quantile.

    quantile is the share of documents of at most that length. For a limit between two lengths of the histogram, the
    row of the next larger length gives docs_at_least and tokens_at_least (see ``answer``).
    """
    cells = materialise(histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}")), "lengths")
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("tokens").alias("bt"))
    total = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bn").over(after), F.lit(0)).alias("an"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bn").over(total).alias("all_n"), F.sum("bt").over(total).alias("all_t"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc())
    cells = cells.join(blocks, "block").withColumn("dn", F.col("an") + F.sum("n_docs").over(inside)).withColumn("dt", F.col("at") + F.sum("tokens").over(inside))
    return cells.select(
        "length", "n_docs", F.col("tokens").alias("n_tokens"), F.col("dn").alias("docs_at_least"), F.col("dt").alias("tokens_at_least"),
        (F.col("all_t") - F.col("dt") + F.col("length") * F.col("dn")).alias("truncated_total"),
        ((F.col("all_n") - F.col("dn") + F.col("n_docs")) / F.col("all_n")).alias("quantile"), F.col("all_t").alias("total_tokens"),
    )


def answer(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, docs_over, truncated_total) for a table of any limits.

    A limit needs the row of the next larger length: the first in its own block of lengths or, failing that, the first of
    the next block that has one. Blocks are ordered by themselves, so no window runs over all lengths or limits.
    """
    most = sums.agg(F.max("length").alias("most"), F.max("total_tokens").alias("t"))  # one row
    asked = limits.select(F.col("limit").cast("long")).crossJoin(F.broadcast(most))
    past = F.least(F.col("limit") + 1, F.coalesce("most", F.lit(0)) + 1)  # all beyond the longest text are alike
    asked = asked.select(past.alias("length"), "limit", F.coalesce("t", F.lit(0)).alias("t"), F.lit(None).cast("struct<docs_at_least:bigint,tokens_at_least:bigint>").alias("own"))
    both = sums.select("length", F.lit(None).cast("long").alias("limit"), F.lit(None).cast("long").alias("t"), F.struct("docs_at_least", "tokens_at_least").alias("own")).union(asked)
    both = both.withColumn("block", F.expr(f"length div {BLOCK}"))
    heads = both.groupBy("block").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("length"))).alias("head"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    heads = heads.select("block", F.last("head", True).over(later).alias("next"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc(), F.col("limit").isNotNull())
    rows = both.withColumn("own", F.last("own", True).over(inside)).where("limit is not null").join(heads, "block")
    found = F.coalesce("own", "next")
    over, tokens = F.coalesce(found["docs_at_least"], F.lit(0)), F.coalesce(found["tokens_at_least"], F.lit(0))
    return rows.select("limit", over.alias("docs_over"), (F.col("t") - tokens + F.col("limit") * over).alias("truncated_total"))
