"""Ids of other types, clashing column names, and the ways beyond small tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkreg.functions import joins, storage
from sparkreg.functions.storage import new_folder
from sparkreg.llm import decontaminate, gam, mixing, ngram_join, rules, token_records, tokens, warc
from sparkreg.llm.queries import vocabulary
from tests.llm.fixtures import docs, rows, sentence
from tests.llm.test_operators import near_data, plain_links

CLASHES = ("row", "k", "key", "slot", "at", "part", "bits", "maybe", "__i", "__k", "__row", "__source", "__size", "size", "copies", "class", "mix_copies", "mix_size", "stratum", "step", "spans", "terms", "marks", "n", "component", "x y")


def clashing(spark, data=None):
    df = docs(spark, data).drop("__shard", "size", "key")
    return df.select("*", *(F.concat(F.lit(f"own {c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))


def own_kept(out, df):
    assert out.columns == df.columns
    assert all(r[c] == f"own {c} {r.doc_id}" for r in out.where("doc_id is not null").select("doc_id", *(F.col(f"`{c}`") for c in CLASHES)).collect() for c in CLASHES)


@pytest.fixture
def large(monkeypatch):
    """No table counts as small."""
    monkeypatch.setattr(joins, "is_small", lambda *a, **k: False)
    monkeypatch.setattr(storage, "is_small", lambda *a, **k: False)


def test_stages_keep_clashing_columns(spark):
    data = near_data(31)
    items = [(1, sentence(random.Random(5), 30))]
    data.append((5000, f"{sentence(random.Random(6), 60)} {items[0][1]} {sentence(random.Random(8), 60)}", "en", "a", 0, 0, "", ""))
    path = new_folder(spark, "tables")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    df = clashing(spark, data)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own_kept(stage(spark, df, path), df)
    assert corpus_pipeline.STAGES[-1][1](spark, df, path).count() == len(data)


def test_mix_columns_give_way_to_new_ones(spark):
    out = mixing.mix_sources(clashing(spark))
    assert dict(out.dtypes)["mix_copies"] == "bigint" and out.columns.count("mix_copies") == 1


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 4, "block_rows": 3, "block_shingles": 200}])
def test_near_duplicates_beyond_small_tables(spark, large, sizes):
    data = near_data(11)
    got = ngram_join.near_duplicates(docs(spark, data), **sizes).collect()
    assert sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in got) == plain_links(data)
    small = ngram_join.keep_one(clashing(spark, data))
    assert sorted(map(repr, (r.doc_id for r in small.collect()))) == sorted({repr(c) if c != "None" else c for c in {eval(c) for _, c, _ in plain_links(data)}})


def test_hot_keys_are_joined_apart(spark, large):
    left = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    for hot in (1, 10**6):
        got = joins.join_hot(left, right, "k", "size", hot).collect()
        assert len(got) == 1000 and all(r.size == 1000 // 7 + (r.k < 1000 % 7) for r in got)


def test_bitmap_passes_every_key(spark, large):
    df = spark.range(5000).select(F.col("id"), F.lit("x").alias("k"))
    gone = spark.range(0, 5000, 3).select(F.col("id").cast("string").alias("k"))
    key = F.col("id").cast("string")
    assert sorted(r.id for r in joins.without_keys(df, key, gone).collect()) == [k for k in range(5000) if k % 3]
    found = joins.with_keys(df, key, gone.withColumn("extra", F.lit(1))).select("row.id", "extra").collect()
    assert sorted(r.id for r in found) == list(range(0, 5000, 3))


def test_a_table_of_many_bytes_is_not_small(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("a"), 10_000).alias("t"))
    assert storage.is_small(wide) and not storage.is_small(wide, max_bytes=100_000) and not storage.is_small(wide, max_rows=99)


def _named(spark, data):
    return docs(spark, data).withColumn("doc_id", F.concat(F.lit("d/é "), F.col("doc_id").cast("string")))


def test_string_ids(spark):
    data = [r for r in near_data(11)]
    named = _named(spark, data)
    items = spark.createDataFrame([("i1", data[0][1]), (None, data[1][1])], "item_id string, text string")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(named, items).collect()}
    assert hits >= {(f"d/é {data[0][0]}", "i1")} or len(data[0][1].split()) < 5
    assert decontaminate.drop_contaminated(named, items).count() < len(data)
    got = {r.doc_id: r.n_tokens for r in token_records.round_trip(named, vocabulary(), docs_per_shard=20).collect()}
    tool = tokens.encoder(vocabulary())
    assert all(got[None if r[0] is None else f"d/é {r[0]}"] == len(tool.ids(r[1] or "")) + 1 for r in data)
    pages = named.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("ab"), 600).alias("html"))
    found = warc.round_trip(pages, records_per_shard=7).collect()
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {max(r.page_id for r in found if r.page_id)} and None in {r.page_id for r in found}


def test_string_ids_meet_labels_of_their_own_or_of_none(spark):
    named = _named(spark, list(rows()))
    for labels in (spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(f"d/é {k}", k % 2, 0) for k in range(30)], "doc_id string, quality int, toxic int")):
        assert rules.keep_good(named, labels).count() == rules.quality_rules(named, labels).where("kept").count()
        assert gam.quality_scores(named, labels).where("doc_id = 'd/é 7'").count() == 1


def test_extreme_ids(spark):
    data = [(k, f"text {k}", "en", "a", 0, 0, "", "") for k in (-(1 << 63), (1 << 63) - 1, 0)] + [(None, "none", "en", "a", 0, 0, "", "")]
    got = token_records.round_trip(docs(spark, data), vocabulary(), docs_per_shard=1).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(1 << 63), 0, (1 << 63) - 1]
    assert decontaminate.find_contamination(docs(spark, data), spark.createDataFrame([(-(1 << 63), "text 0")], "item_id long, text string")).count() == 1


def test_short_items_are_found_as_they_stand(spark):
    data = [(k, t, "en", "a", 0, 0, "", "") for k, t in enumerate(["the Grand Total is forty", "grand, total!", "total grand", "a grand old total", None, "", "forty"])]
    items = spark.createDataFrame([(1, "Grand total"), (2, "forty"), (3, ""), (4, "is forty two ways")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles, r.containment) for r in decontaminate.find_contamination(docs(spark, data), items).collect()}
    assert got == {(0, 1, 1, 1, 1.0), (1, 1, 1, 1, 1.0), (0, 2, 1, 1, 1.0), (6, 2, 1, 1, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs(spark, data), items, block_bytes=8).collect()) == [2, 3, 4, 5]


def test_shuffled_reads_give_every_record(spark):
    folder = new_folder(spark, "tokens")
    manifest = token_records.write_records(docs(spark), folder, vocabulary(), docs_per_shard=20, roll_bytes=3000)
    plain = {(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records.read_records(folder, manifest).collect()}
    runs = [token_records.read_shuffled(folder, manifest, seed).collect() for seed in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2] and len(runs[0]) == len(rows())
    assert {(r.start, r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in runs[2]} == plain


def test_exact_links_count_shared_shingles():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(core, 270, replace=False), rng.choice(core[:50], 5), rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(60)]
    linked = ngram_join.exact_links(sets, 0.8)
    for i in range(60):
        for j in range(60):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert i == j or linked[i, j] == (10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both))


def test_items_of_every_length_are_found(spark):
    """Items of one to ninety words, each planted in a text of some three hundred others; nothing else is found."""
    items = [(n, sentence(random.Random(1000 + n), n)) for n in range(1, 91)]
    items += [(100 + n, sentence(random.Random(3000 + n), 5 + n % 3)) for n in range(200)]
    data = [(k, f"{sentence(random.Random(k), 150)} {text.upper()}, {sentence(random.Random(-k), 150)}", "en", "a", 0, 0, "", "") for k, text in items]
    found = decontaminate.find_contamination(docs(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()
    own = {(r.doc_id, r.item_id) for r in found}
    assert own >= {(k, k) for k, _ in items}
    words = {k: text.split() for k, text in items}
    for d, i in own - {(k, k) for k, _ in items}:  # one-word items may stand in other texts
        assert len(words[i]) < 5


def test_mix_comes_near_its_target_where_ids_repeat(spark):
    """Rows of one id, or of none, are drawn one by one."""
    data = [(None if k % 2 else 7, sentence(random.Random(k), 12), "en", s, 0, 0, "", "") for s in ("a", "b", "c") for k in range(40)]
    out = mixing.mix_sources(docs(spark, data)).toPandas()
    for _, own in out.groupby("source"):
        assert abs(own.mix_taken.sum() - own.mix_target.iloc[0]) <= 6  # half of a document
