"""Fill-in-middle against a plain form, and boundary sets against sorted lists."""

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreg.llm import middle
from tests.llm.fixtures import docs, empty, rows

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
EXTRA = [(500, "a text with <S> in it", "en", "a", 0, 0, "", ""), (501, "x" * 2_000_000, "en", "a", 0, 0, "", ""), (502, "a b\n" * 200_000, "en", "a", 0, 0, "", ""), (503, "<<P <S ends< <M", "en", "a", 0, 0, "", "")]


def plain(doc_id, text, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    hexed = sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate", [50, 100])
def test_cuts_agree_and_texts_come_back(spark, rate):
    data = rows() + EXTRA
    out = middle.fill_in_middle(docs(spark, data), rate=rate)
    out = out.withColumn("back", middle.restored(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(out) == len(data)
    for r in out:
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == plain(r.doc_id, r.text, rate)
        assert r.back == (r.text or "")
    assert {r.fim_form for r in out} == {"plain", "psm", "spm"}


def test_columns_that_clash_give_way_and_others_stay(spark):
    df = docs(spark).withColumn("fim_n", F.lit("old")).withColumn("n", F.lit("own"))
    out = middle.fill_in_middle(df)
    assert dict(out.dtypes)["fim_n"] == "bigint" and out.where("n <> 'own'").count() == 0 and out.where("size <> 'size'").count() == 0


def test_empty_table(spark):
    assert middle.fill_in_middle(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 400_000), min_size=1, max_size=300), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(1, 30_000)), max_size=3))
def test_select_of_a_boundary_set(points, runs):
    for high, step, length in runs:  # dense stretches: bitmaps, and runs where the step is one
        points |= set(range(high << 16, min((high << 16) + length * (step + 1), 400_000), step + 1))
    offsets = np.array(sorted(points), np.int64)
    own = middle.BoundarySet(offsets)
    assert len(own) == len(offsets)
    for rank in {0, len(offsets) - 1, *np.random.default_rng(len(offsets)).integers(0, len(offsets), 50).tolist()}:
        assert own.select(rank) == offsets[rank]


def test_each_container_is_used():
    kinds = {type(c).__name__ for c in middle.BoundarySet(np.concatenate([[5, 9, 12], np.arange(65_536, 131_072, 3), np.arange(131_072, 190_000)])).containers}
    assert kinds == {"_Array", "_Bitmap", "_Runs"}
