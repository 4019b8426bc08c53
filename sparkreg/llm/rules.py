"""Quality rules with risk-controlled cutoffs.

Two base rules are fixed: fewer than 50 words, or more than half of the words inside repeated three-word windows. Six further
rules each reject a document whose metric lies above a cutoff. The cutoffs of a stratum move together along one fixed sequence
of ``STEPS`` vectors, each from its lax to its strict value in equal ratios, and labelled holdout rows of the stratum say how
far: a step stands while the exact (Clopper-Pearson) upper bound on the share of good documents that the rules reject
together is at most alpha. As the walk along a fixed sequence stops at its first failure, neither steps nor rules need a
correction; the strata share the error probability delta evenly (Bonferroni). So with probability 1 - delta, no stratum loses
more than the share alpha of its good documents to these rules (the base rules are fixed beforehand and take what they take).
A stratum with too few labelled good documents for the first step gets no cutoffs: about log(delta / strata) / log(1 - alpha)
are needed, 151 for five strata. Its documents are judged by the base rules alone.

Defined cases: null text has no words; texts of any length are measured whole; a metric equal to a cutoff passes; a null
stratum is a stratum of its own; labels that are null are not used, and of several labels of one id the largest holds; ids of
any type are kept; rows that repeat an id are judged alike and each counts as a holdout row; other columns are kept by
``keep_good`` whatever their names and ignored elsewhere; without labels only the base rules hold; an empty table gives an
empty result.
"""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise
from sparkreg.llm.shingles import TEXTS
from sparkreg.llm.textstats import SCHEMA, measure_series


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


STEPS = 16
#: rule: lax and strict cutoff
RULES: dict[str, tuple[float, float]] = {
    "symbols": (0.5, 0.01),
    "marks": (0.6, 0.06),
    "upper": (0.9, 0.1),
    "repeats": (0.48, 0.1),
    "dup_lines": (0.9, 0.2),
    "top_word": (0.6, 0.1),
}


def cutoff(rule: str, step: int) -> float:
    lax, strict = RULES[rule]
    return lax * (strict / lax) ** (step / (STEPS - 1))


def metrics() -> list[Column]:
    """The metrics of RULES over the columns of textstats, in the same order."""
    return [_share("n_symbols", "word_chars"), _share("n_marks", "word_chars"), _share("n_upper", "word_chars"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines"), _share("n_top", "n_words")]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    at = lgamma(n + 1)
    return min(1.0, sum(exp(at - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1)))


def bound_holds(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, on a rate seen k times in n is at most alpha."""
    return n > 0 and k < alpha * n and binomial_cdf(k, n, alpha) <= delta


def first_rejected() -> Column:
    """The first step at which any rule rejects the document; STEPS if none does."""
    passed = [sum((m <= cutoff(rule, k)).cast("int") for k in range(STEPS)) for rule, m in zip(RULES, metrics(), strict=True)]
    return F.least(*passed)


def last_safe_step(rejected: list[int], n: int, alpha: float, delta: float) -> int | None:
    """The last step of the walk; rejected: of n good documents, how many each step rejects."""
    safe = None
    for step, k in enumerate(rejected):
        if not bound_holds(k, n, alpha, delta):
            break
        safe = step
    return safe


def choose_cutoffs(measured: DataFrame, labels: DataFrame, *, alpha: float = 0.03, delta: float = 0.05, id_col: str = "doc_id", stratum: str = "stratum", label_id: str = "doc_id") -> DataFrame:
    """(stratum, n_good, step, and a cutoff for each rule) of every stratum; step and cutoffs are null where no step stands.

    measured has the id, the stratum and the columns of textstats; labels has label_id and quality (1: good).
    """
    good = labels.where("quality is not null").groupBy(F.col(label_id).cast("string").alias("__id")).agg(F.max("quality").alias("q")).where("q = 1").select("__id")
    rows = measured.where(~base_failed()).join(good, F.col(id_col).cast("string") == F.col("__id"), "left_semi")
    cells = rows.groupBy(F.col(stratum).alias("stratum"), first_rejected().alias("first")).agg(F.count(F.lit(1)).alias("n"))
    strata = materialise(measured.select(F.col(stratum).alias("stratum")).distinct(), "strata")
    share = delta / max(1, strata.count())

    def walk(table: pd.DataFrame) -> pd.DataFrame:
        """STEPS + 1 rows of a stratum at most."""
        rejected = [int(table.loc[table["first"] <= step, "n"].sum()) for step in range(STEPS)]
        step = last_safe_step(rejected, int(table["n"].sum()), alpha, share)
        cutoffs = {f"c_{rule}": None if step is None else cutoff(rule, step) for rule in RULES}
        return pd.DataFrame([{"stratum": table["stratum"].iloc[0], "n_good": int(table["n"].sum()), "step": step} | cutoffs])

    kind = dict(strata.dtypes)["stratum"]
    found = cells.groupBy("stratum").applyInPandas(walk, f"stratum {kind}, n_good long, step int, " + ", ".join(f"c_{rule} double" for rule in RULES))
    found = found.withColumnRenamed("stratum", "s")
    return materialise(strata.join(found, F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s"), "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """measured with base_failed and kept."""
    side = cutoffs.where("step is not null").select(F.col("stratum").alias("__stratum"), F.col("step").alias("__step"))
    rows = measured.join(bounded_broadcast(side), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    rejected = F.coalesce(first_rejected() <= F.col("__step"), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum", "__step")


def measured_docs(docs: DataFrame, keep: list, text_col: str = "text") -> DataFrame:
    """The columns keep and the textstats of every whole text."""
    measure = F.pandas_udf(measure_series, SCHEMA)
    return docs.select(*keep, measure(F.col(text_col).cast("string")).alias("__m")).select("*", "__m.*").drop("__m")


def quality_rules(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.03, delta: float = 0.05, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stratum, textstats, base_failed, kept) of every row."""
    measured = materialise(measured_docs(docs, [F.col(id_col), F.col(stratum_col).alias("stratum")], text_col), "measured", TEXTS)
    return judge(measured, choose_cutoffs(measured, labels, alpha=alpha, delta=delta, id_col=id_col))


def keep_good(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.03, delta: float = 0.05, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep. Rows are written once with their measures, so texts are measured once."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = measured_docs(docs, [whole, F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum")], text_col)
    measured = materialise(rows, "measured", TEXTS, "zstd")
    cutoffs = choose_cutoffs(measured, labels, alpha=alpha, delta=delta)
    return judge(measured, cutoffs).where("kept").select("__row.*")
