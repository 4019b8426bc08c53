"""The pipeline and the registered queries, stage by stage, on a small table."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sparkreg.functions.storage import new_folder
from sparkreg.llm import queries, tokens
from tests.llm.fixtures import sentence
from tests.llm.test_operators import normal, plain_repeats, shingles
from tests.oracle import agree


@pytest.fixture(scope="module")
def folder(spark):
    rng, data = random.Random(21), []
    items = [(k, sentence(rng, 25)) for k in range(4)]
    for k in range(120):
        text = sentence(rng, rng.choice([20, 60, 90, 150]))
        if k % 10 == 0:
            text = f"{text} {items[k // 10 % 4][1]} {sentence(rng, 60)}"
        data.append((k, text, "en", "abc"[k % 3], len(text)))
    for k in range(20):
        w = data[k][1].split()
        w[0] = "other"
        data.append((200 + k, " ".join(w), "en", "a", 0))
    data += [(300, None, None, None, 0), (301, "", "en", "a", 0), (3, data[3][1], "en", "a", 0)]
    path = new_folder(spark, "tables")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, data, items


def test_stages_equal_brute_force(spark, folder):
    path, data, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    def kept(rows):
        return sorted((r[0], r[1] or "") for r in rows)

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    want = [r for r in data if len((r[1] or "").split()) >= 50 and plain_repeats((r[1] or "").split()) * 100 <= 50 * len((r[1] or "").split())]
    docs = stages["quality rules"](spark, docs, path)
    assert docs.columns == columns and kept(docs.collect()) == kept(want)  # 60 labels allow no further cutoff

    groups: list[list] = []
    for r in sorted(want, key=lambda r: (r[0], r[1])):
        near = [g for g in groups if any(len(shingles(r[1]) & shingles(o[1])) >= 0.8 * len(shingles(r[1]) | shingles(o[1])) for o in g)]
        groups = [g for g in groups if g not in near] + [[r, *(o for g in near for o in g)]]
    want = [min(g, key=lambda r: r[0]) for g in groups]
    docs = stages["n-gram Jaccard join"](spark, docs, path)
    assert docs.columns == columns and kept(docs.collect()) == kept(want)

    want = [r for r in want if not any(len(normal(t) & normal(r[1])) >= 0.8 * len(normal(t)) for _, t in items)]
    docs = stages["benchmark decontamination"](spark, docs, path)
    assert docs.columns == columns and kept(docs.collect()) == kept(want) and want

    mixed = stages["mixing sources to target weights"](spark, docs, path)
    rows = mixed.collect()
    assert mixed.columns == columns and set(kept(rows)) <= set(kept(want))
    words = sum(len(r[1].split()) for r in want)
    assert abs(sum(len(r.text.split()) for r in rows) - 1.5 * words) < 0.05 * words

    out = stages["token-ID / binary output"](spark, mixed, path).toPandas().sort_values("start")
    tool = tokens.encoder(queries.vocabulary())
    assert out.n_tokens.tolist() == [len(tool.ids(t)) + 1 for _, t in kept(rows)]
    assert out.start.tolist() == [0, *np.cumsum(out.n_tokens)[:-1].tolist()]
    assert corpus_pipeline.run(spark, path).count() == len(out)


def test_pipeline_of_nothing(spark):
    path = new_folder(spark, "tables")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, small, name):
    agree(queries.queries()[name](spark, small), queries.oracle_sql()[name], small)
