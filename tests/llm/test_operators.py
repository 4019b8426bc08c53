"""Each operator against brute force on awkward documents, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreg.functions.storage import new_folder
from sparkreg.llm import decontaminate, gam, mixing, ngram_join, rules, sanitise, sharding, textstats, token_lengths, token_records, tokens, warc
from sparkreg.llm.queries import vocabulary
from tests.llm.fixtures import WORD, docs, empty, rows, sentence

LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    return WORD.findall(text or "")


# ---- op1


def test_mix_targets_and_samples(spark):
    got = mixing.mix_sources(docs(spark)).toPandas()
    assert len(got) == len(rows())
    assert (got.mix_size == [len(words_of(t)) for t in got.text]).all()
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words_of(r[1]))
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = dict(zip(order, (3, 1, 2, 3, 1, 2), strict=False))
    target, open_ = {}, set(order)
    while True:  # the plain way: share, stop at the caps, share the excess again
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * sizes[s] - 1e-9}
        if not over:
            target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
        if not open_:
            break
    by = got.assign(source=got.source.where(got.source.notna(), None)).groupby("source", dropna=False)
    for s, part in by:
        s = s if isinstance(s, str) else None
        assert part.mix_target.iloc[0] == pytest.approx(target[s], abs=1e-3)
        assert part.mix_source_size.iloc[0] == sizes[s]
        assert abs(part.mix_taken.sum() - target[s]) <= max(3, 0.05 * target[s], part.mix_size.max() / 2)
    assert (got.mix_taken <= 2 * got.mix_size).all() and (got.mix_taken == got.mix_copies * got.mix_size).all()


def test_mix_agrees_between_runs_and_partitions(spark):
    runs = [sorted(map(repr, mixing.mix_sources(docs(spark, parts=p)).select("doc_id", "mix_copies").collect())) for p in (1, 7)]
    assert runs[0] == runs[1]
    out = mixing.mixed_rows(docs(spark))
    assert out.columns == docs(spark).columns
    assert out.count() == sum(int(r.split("mix_copies=")[1][:-1]) for r in runs[0])


def test_mix_prefers_larger_classes_and_draws_by_rank(spark):
    data = [(k, " ".join(["w"] * (2 ** (k % 6 + 1))), "en", "a", 0, 0, "", "") for k in range(1200)]
    got = mixing.mix_sources(docs(spark, data), share=0.8).toPandas()
    mean = got.groupby("mix_size").mix_copies.mean()
    assert mean.iloc[-1] > mean.iloc[0]
    assert abs(got.mix_taken.sum() - 0.8 * got.mix_size.sum()) <= 4


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    blank = [(1, None, "en", None, 0, 0, "", ""), (2, " ", "en", "a", 0, 0, "", "")]
    assert {r.mix_taken for r in mixing.mix_sources(docs(spark, blank)).collect()} == {0}


# ---- op2


def test_quality_scores(spark):
    rng = random.Random(4)
    data, labels = [], []
    for k in range(600):
        good = k % 4 != 0
        text = sentence(rng, rng.randint(30, 120)) if good else " ".join([sentence(rng, 1) + "***"] * rng.randint(30, 120))
        data.append((k, text, "en", "a", 0, 0, "", ""))
        labels.append((k, int(good), 0))
    labels += [(3, None, 0), (99999, 1, 0)]
    got = gam.quality_scores(docs(spark, [*data, *rows()[60:]]), spark.createDataFrame(labels, LABELS)).toPandas()
    assert len(got) == 600 + len(rows()[60:])
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    for r in got.dropna().itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)
    truth = {i: q for i, q, _ in labels if q is not None and i < 600}
    out = got[got.held_out & got.doc_id.isin(truth)].drop_duplicates("doc_id")
    assert (out.predicted == out.doc_id.map(truth)).mean() > 0.97


def plain_features(text):
    """The classifier's features of a text, counted plainly."""
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    n, chars, n_lines = max(len(w), 1), max(sum(map(len, w)), 1), max(len(lines), 1)
    share = lambda kinds: sum(c in kinds for c in text) / chars
    return [
        np.log1p(len(w)), sum(map(len, w)) / n, share("#*$%&|<>"), share("!\"'(),-./:;?@[\\]^_`{}~+="), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"),
        len(set(w)) / n, max(Counter(w).values(), default=0) / n, plain_repeats(w) / n, (len(lines) - len(set(lines))) / n_lines, len(w) / n_lines, (len(text) - sum(map(len, w))) / max(len(text), 1),
    ]


def test_quality_scores_equal_plain_lookups(spark):
    from bisect import bisect_right

    rng = random.Random(14)
    data, labels = list(rows()), []
    for k in range(300):
        bad = rng.random() < 0.4
        words = sentence(rng, rng.randint(20, 90)).split()
        text = " ".join(w.upper() + "!" * (rng.random() < 0.5) if bad and rng.random() < 0.5 else w for w in words)
        data.append((1000 + k, text.replace(" ", "\n", k % 4), "en", "a", 0, 0, "", ""))
        labels.append((1000 + k, int(bad == (rng.random() < 0.1)), 0))
    got = {r.doc_id: r.score for r in gam.quality_scores(docs(spark, data), spark.createDataFrame(labels, LABELS)).collect()}
    x = {r[0]: plain_features(r[1]) for r in data}
    known = sorted((i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5)
    model = gam.fit(np.array([x[i] for i, _ in known]), np.array([q for _, q in known], float))
    assert len(model.pairs) == 6
    for i, own in x.items():
        z = model.base + sum(float(table[bisect_right(list(edges), v)]) for edges, table, v in zip(model.edges, model.main, own, strict=True))
        z += sum(float(t[bisect_right(list(model.coarse[f]), own[f]), bisect_right(list(model.coarse[g]), own[g])]) for (f, g), t in zip(model.pairs, model.tables, strict=True))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6), i


def test_quality_scores_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert set(gam.quality_scores(docs(spark), none).toPandas().score.round(6)) == {0.5}
    assert gam.quality_scores(empty(spark), none).count() == 0


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.fit(x, y, n_pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.8
    assert ((gam.fit(x, y, n_pairs=0).score(x) >= 0.5) == y).mean() < 0.7


# ---- op3

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15)
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1290.@-+ ()é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert sanitise.written(sanitise.base_spans(text)) == plain_spans(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + ".1.1", "1 " * 150_000, "+1" + "-" * 300_000):
        sanitise.base_spans(text)


def entity_data():
    """Entities beside a word that reveals them, beside common words, in copies, and such words alone."""
    rng = random.Random(7)
    data = list(rows())
    new = lambda k, text: (k, text, "en", "a", 0, 0, "", "")
    for k in range(12):
        data.append(new(200 + k, f"{sentence(rng, 30)} the zorblax wrote {chr(97 + k)}gent@hq.example.com for the {sentence(rng, 30)} far away comes Vexil"))
        data.append(new(300 + k, f"the for wrote {sentence(rng, 40)}"))
        data.append(new(600 + k, f"{sentence(rng, 20)} with passkey {hashlib.sha1(str(k).encode()).hexdigest()} in it"))
    data.append(new(400, "zorblax alone in a clean text"))
    data += [new(420 + k, f"vexil {sentence(rng, 9)}") for k in range(3)]
    data += [new(500 + k, "quine pays 4539 1488 0343 6467 quine") for k in range(9)]  # copies are no evidence
    data.append(new(None, "null ids may hold zorblax, İstanbul and x@hq.example.com too"))
    return data


SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}")


def plain_protected(text):
    found = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in plain_spans(text).split(",") if s)]
    for m in SECRET.finditer(text):
        run = m.group()
        share = np.array(list(Counter(run).values())) / len(run)
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        if mixed and -(share * np.log2(share)).sum() * len(run) >= 60 and not any(m.start() < b and a < m.end() for a, b, _ in found):
            found.append((*m.span(), "secret"))
    return found


def plain_terms(text):
    taken = plain_protected(text)
    return [(*m.span(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(a < m.end() and m.start() < b for a, b, _ in taken)]


def plain_classes(text):
    out = set()
    for a, b, kind in plain_protected(text):
        value = text[a:b].lower()
        digits = re.sub(r"\D", "", value)
        coarse = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}
        out |= {kind, f"{kind} {value}"} | ({f"{kind} of {coarse[kind]}"} if kind in coarse else set())
    return out


def plain_pairs(texts, generalise_at=0.9, remove_at=0.98, support=5):
    """(class, term): (n_ct, n_c, n_t, action), by counting every class against every term."""
    holds = [(t, plain_classes(t), {x for _, _, x in plain_terms(t)}) for t in texts]
    out, n = {}, len(texts)
    n_c, n_t = Counter(c for _, cs, _ in holds for c in cs), Counter(t for _, _, ts in holds for t in ts)
    n_ct, where = Counter(), defaultdict(set)
    for text, cs, ts in holds:
        for c in cs:
            for t in ts:
                n_ct[c, t] += 1
                where[c, t].add(text)
    for (c, t), k in n_ct.items():
        if len(where[c, t]) >= support and n_c[c] < n:
            d = np.log(n * k / (n_c[c] * n_t[t])) / np.log(n / n_c[c])
            if d >= generalise_at:
                out[c, t] = (k, n_c[c], n_t[t], "remove" if d >= remove_at else "generalise")
    return out


def test_disclosing_pairs_equal_brute_force(spark):
    texts = [r[1] or "" for r in entity_data()]
    for settings in ({}, {"generalise_at": 0.6, "remove_at": 0.9, "support": 2}):
        got = sanitise.disclosing_pairs(docs(spark, entity_data()), **settings).collect()
        want = plain_pairs(texts, **settings)
        assert {(r["class"], r.term): (r.n_ct, r.n_c, r.n_t, r.action) for r in got} == want and len(got) == len(want)
        assert settings or {t for _, t in want} >= {"zorblax", "passkey"} and not {t for _, t in want} & {"the", "quine"}


@pytest.mark.parametrize("max_terms", [300_000, 0])
def test_sanitise(spark, max_terms):
    data = entity_data()
    got = sanitise.sanitise(docs(spark, data), max_terms=max_terms).collect()
    flagged = {t for _, t in plain_pairs([r[1] or "" for r in data])}
    want, rank = [], ("email", "ip", "card", "phone", "secret", "term")
    for r in data:
        text = r[1] or ""
        terms = [(a, b, "term") for a, b, t in plain_terms(text) if t in flagged]
        spans = sorted([*plain_protected(text), *terms], key=lambda s: (s[0], rank.index(s[2])))
        base = plain_spans(text)
        want.append((r[0], *(base.count(f"{k}:") for k in PATTERNS), len(terms), len(spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_terms, r.n_spans, r.base_sha256, r.spans)) for r in got)
    assert next(w for w in want if w[0] == 400)[5] == 1  # a term is masked where its entity is absent, too


def test_sanitised_docs(spark):
    data = entity_data()
    clean = sanitise.sanitised_docs(docs(spark, data))
    assert clean.columns == docs(spark, data).columns and clean.count() == len(data)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert "[EMAIL]" in text[200] and "zorblax" not in text[200] and "gent@" not in text[200]
    assert text[400] == "zo* alone in a clean text" and text[130] is None and "[SECRET]" in text[600] and "passkey" not in text[600]
    assert sanitise.masked("a vexil b", "term:2:7", {(2, 7): "generalise"}) == "a v* b"
    assert sanitise.sanitise(empty(spark)).count() == 0 and sanitise.sanitised_docs(empty(spark)).count() == 0
    odd = docs(spark, data).withColumnsRenamed({"n_chars": "spans", "size": "terms", "__shard": "row"}).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sanitise.sanitise(odd).where("doc_id = '200'").first().n_email == 1 and sanitise.sanitised_docs(odd).count() == len(data)


# ---- op4


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_links(data):
    links, par = Counter(), list(range(len(data)))

    def find(k):
        while par[k] != k:
            k = par[k]
        return k

    sets = [shingles(r[1]) for r in data]
    for i, j in combinations(range(len(data)), 2):
        a, b = sets[i], sets[j]
        if (data[i][1] or "") == (data[j][1] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
            links[i] += 1
            links[j] += 1
            par[find(j)] = find(i)
    group = defaultdict(list)
    for k in range(len(data)):
        group[find(k)].append(k)
    least = {k: min((data[m][0] for m in members if data[m][0] is not None), default=None) for members in group.values() for k in members}
    return sorted((repr(data[k][0]), repr(least[k]), links[k]) for k in range(len(data)))


def near_data(seed, n_groups=6, size=14, length=120):
    rng, out = random.Random(seed), list(rows(seed))
    for g in range(n_groups):
        base = sentence(rng, length).split()
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            out.append((1000 + 100 * g + k, " ".join(w), "en", "a", 0, 0, "", ""))
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 4, "block_rows": 3}])
def test_near_duplicates_equal_brute_force(spark, sizes):
    data = near_data(11)
    got = ngram_join.near_duplicates(docs(spark, data), **sizes).collect()
    assert sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in got) == plain_links(data)


def test_keep_one(spark):
    data = near_data(12)
    kept = ngram_join.keep_one(docs(spark, data))
    assert kept.columns == docs(spark, data).columns
    ids = [r.doc_id for r in kept.collect()]
    want = {a for a, b, _ in plain_links(data) if a == b}
    assert sorted(map(repr, ids)) == sorted(want)
    assert ngram_join.near_duplicates(empty(spark)).count() == 0 and ngram_join.keep_one(empty(spark)).count() == 0


def test_pruning_keeps_similar_pairs_and_drops_others():
    least = ngram_join.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(3)
    one = rng.integers(0, 256, ngram_join.HASHES, dtype=np.uint8)
    near, far = (np.where(rng.random((4000, ngram_join.HASHES)) < s, one, rng.integers(0, 256, (4000, ngram_join.HASHES))).astype(np.uint8) for s in (0.85, 0.3))
    assert len(ngram_join.survivors(one, near, least)) >= 3998
    assert len(ngram_join.survivors(one, far, least)) < 400


# ---- op5


def plain_repeats(w):
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)})


def plain_stats(text):
    text = text or ""
    w, seen, dup = words_of(text), set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, plain_repeats(w)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\té\xa0", max_size=80))
def test_textstats_equal_the_rules(text):
    m = dict(zip(textstats.COUNTS, textstats.measure(text), strict=True))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == plain_stats(text)


def test_many_distinct_words():
    ids = np.array([*range(2_100_000), 0, 1, 2])
    assert textstats.repeated_words(ids) == 6


def plain_verdicts(rows, good, alpha, delta):
    """kept by index: the walk of every stratum, recounted for each step from the measures of its rows."""
    from math import comb

    def rejected(r, k):
        share = lambda a, b: a / b if b else 0.0
        values = (share(r.n_symbols, r.word_chars), share(r.n_marks, r.word_chars), share(r.n_upper, r.word_chars), share(r.n_repeat_words, r.n_words), share(r.n_dup_lines, r.n_lines), share(r.n_top, r.n_words))
        return any(v > lax * (strict / lax) ** (k / 15) for v, (lax, strict) in zip(values, ((0.5, 0.01), (0.6, 0.06), (0.9, 0.1), (0.48, 0.1), (0.9, 0.2), (0.6, 0.1)), strict=True))

    strata = list(rows.stratum.fillna("none").unique())
    safe = dict.fromkeys(strata, -1)
    for stratum in strata:
        part = list(good[good.stratum.fillna("none") == stratum].itertuples())
        for k in range(16):
            n, bad = len(part), sum(rejected(r, k) for r in part)
            if not n or sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(bad + 1)) > delta / len(strata):
                break
            safe[stratum] = k
    assert any(k >= 0 for k in safe.values()) or delta < 1e-9
    return {r.Index: not r.base_failed and not (safe["none" if r.stratum != r.stratum or r.stratum is None else r.stratum] >= 0 and rejected(r, safe["none" if r.stratum is None else r.stratum])) for r in rows.itertuples()}


def test_rules_hold_the_bound(spark):
    rng = random.Random(8)
    data, labels = list(rows()), []
    for k in range(3000):
        good = k % 5 != 0
        junk = not good and rng.random() < 0.9
        text = sentence(rng, 60) if not junk else " ".join(w + "%%%" for w in sentence(rng, 60).split())
        data.append((1000 + k, text, "en" if k % 3 else "fr" if k % 2 else "de", "a", 0, 0, "", ""))
        labels.append((1000 + k, int(good), 0))
    labels.append((1001, None, 0))
    table = spark.createDataFrame(labels, LABELS)
    got = rules.quality_rules(docs(spark, data), table).toPandas()
    assert len(got) == len(data)
    texts = {r[0]: r[1] for r in data}
    for r in got.sample(300, random_state=1).itertuples():
        base = plain_stats(texts[None if np.isnan(r.doc_id) else r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
    quality = {i: q for i, q, _ in labels if q is not None}
    seen = got[got.doc_id.isin(quality) & ~got.base_failed]
    good = seen.doc_id.map(quality) == 1
    for alpha, delta in ((0.03, 0.05), (0.03, 1e-12)):
        judged = rules.quality_rules(docs(spark, data), table, alpha=alpha, delta=delta).toPandas()
        want = plain_verdicts(got, seen[good], alpha, delta)
        assert dict(zip(judged.index, judged.kept, strict=True)).keys() == want.keys()
        assert sorted(map(repr, zip(judged.doc_id, judged.n_words, judged.kept, strict=True))) == sorted(map(repr, zip(got.doc_id, got.n_words, want.values(), strict=True)))
    for stratum in ("en", "fr", "de"):
        assert 1 - seen[good & (seen.stratum == stratum)].kept.mean() <= 0.03
        assert seen[~good & (seen.stratum == stratum)].kept.mean() < 0.3
    odd = docs(spark, data).withColumnsRenamed({"n_chars": "__row", "key": "stratum", "size": "kept"}).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert rules.keep_good(odd, table).columns == odd.columns
    kept = rules.keep_good(docs(spark, data), table)
    assert kept.columns == docs(spark, data).columns and kept.count() == got.kept.sum()


def test_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = rules.quality_rules(docs(spark), none).toPandas()
    assert (got.kept == ~got.base_failed).all()
    assert rules.quality_rules(empty(spark), none).count() == 0


def test_binomial_bound():
    from math import comb

    for k, n, p in [(0, 10, 0.1), (3, 50, 0.1), (40, 2000, 0.03)]:
        assert rules.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert not rules.bound_holds(0, 10, 0.03, 0.05) and rules.bound_holds(0, 200, 0.03, 0.05)


# ---- op6

PAGES = "page_id long, url string, html string, digest string"


def _pages(spark):
    big, hot = "x<é>" * 400, "<p>same</p>" * 200
    data = [(k, f"http://h/{k} a", f"<html>{k}</html>" * (k + 1), "d") for k in range(30)] + [(100 + k, None if k == 3 else "http://hot", hot, "d") for k in range(25)]
    data += [(200, "u", big, "d"), (199, "u", big, "d"), (300, "u", None, "d"), (301, "u", "", "d"), (302, "u", "small", "d"), (303, "u", "small", "d"), (None, "u", "null id", "d"), (124, "again", hot, "d")]
    return data, spark.createDataFrame(data, PAGES).repartition(5)


def test_warc_round_trip(spark):
    data, df = _pages(spark)
    got = warc.round_trip(df, records_per_shard=7, roll_bytes=2000).toPandas()
    assert len(got) == len(data)
    largest = defaultdict(int)
    for i, _, h, _ in data:
        largest[h or ""] = max(largest[h or ""], i or 0)
    want = []
    for i, _, h, _ in data:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and largest[h] != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", largest[h] if revisit else None))
    plain = [(None if np.isnan(r.page_id) else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if np.isnan(r.refers_to) else int(r.refers_to)) for r in got.itertuples()]
    assert sorted(map(repr, plain)) == sorted(map(repr, want))


def test_warc_files_are_deterministic(spark):
    _, df = _pages(spark)
    sums = []
    for parts in (1, 6):
        folder = new_folder(spark, "warc")
        files = warc.write_warc(df.where("page_id is null or page_id <> 124").repartition(parts), folder, records_per_shard=7, roll_bytes=2000)
        sums.append(sorted((r.name, r.sha256, r.records) for r in files.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 5


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# ---- op7 and op10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé1 \n\t.,!\xa0<|>ßĞ日", max_size=40), max_size=6))
def test_encoder_equals_the_library(texts):
    tool = tokens.encoder(vocabulary())
    want = [tool.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tool.encode(texts)] == want
    assert tool.lengths([*texts, None]) == [*map(len, want), 0]


def test_encoder_forgets_in_time(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 50)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    tool, rng = tokens.Encoder(vocabulary()), random.Random(2)
    for _ in range(20):
        texts = [sentence(rng, 20) for _ in range(3)]
        assert [x.tolist() for x in tool.encode(texts)] == [tool.ids(t) for t in texts]
    assert tokens.Encoder(vocabulary("word_bpe_49k.json")).by_word is False


def test_length_histogram(spark):
    tool = tokens.encoder(vocabulary())
    lengths = np.array([len(tool.ids(r[1] or "")) for r in rows()])
    sums = token_lengths.suffix_sums(token_lengths.length_histogram(docs(spark), vocabulary()))
    for r in sums.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((lengths == r.length).sum(), (lengths >= r.length).sum(), lengths[lengths >= r.length].sum())
        assert r.truncated_total == np.minimum(lengths, r.length).sum() and r.quantile == pytest.approx((lengths <= r.length).mean())
    limits = [0, 1, 7, 100, 101, 10**6]
    got = {r.limit: (r.docs_over, r.truncated_total) for r in token_lengths.answer(sums, spark.createDataFrame([(k,) for k in limits], "limit long")).collect()}
    assert got == {k: ((lengths > k).sum(), np.minimum(lengths, k).sum()) for k in limits}
    assert token_lengths.suffix_sums(token_lengths.length_histogram(empty(spark), vocabulary())).count() == 0


def test_token_records_round_trip(spark):
    tool = tokens.encoder(vocabulary())
    got = token_records.round_trip(docs(spark), vocabulary(), docs_per_shard=20, roll_bytes=3000).toPandas().sort_values("start")
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r in data:
        ids = np.array([*tool.ids(r[1] or ""), 0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()] == want
    assert token_records.round_trip(empty(spark), vocabulary()).count() == 0


def test_frames():
    assert int(token_records.crc32c([b"123456789"])[0]) == 0xE3069283
    parts = [random.Random(n).randbytes(n) for n in (4, 5, 255, 256, 257, 1000, 70_000)]
    framed = token_records.frame(parts)
    offsets = [0, *np.cumsum(list(map(len, framed)))[:-1].tolist()]
    assert token_records.unframe(b"".join(framed), offsets) == parts
    assert token_records.unframe(b"".join(framed), offsets[::-2]) == parts[::-2]
    broken = bytearray(b"".join(framed))
    broken[offsets[3] + 40] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(broken), offsets)


# ---- op8


def normal(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("block", [20_000, 5])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.choice([6, 12, 20, 40, 90]))) for k in range(25)] + [(90, "too short now"), (91, None), (None, sentence(rng, 20))]
    data = list(rows())
    for k, (_, text) in enumerate(items[:25]):
        w = (text or "").split()
        if k % 3 == 0:
            w[-1] = "altered"
        shouted = " ".join(x.upper() + "!!" for x in w) if k % 2 else " ".join(w)
        data.append((2000 + k, f"{sentence(rng, rng.choice([0, 50, 4000]))} {shouted} {sentence(rng, 50)}", "en", "a", 0, 0, "", ""))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, data), table, block=block).collect()
    want = set()
    for i, t in items:
        q = normal(t)
        for r in data:
            n = len(q & normal(r[1]))
            if q and n >= 0.8 * len(q) - 1e-9:
                want.add((r[0], i, n, len(q)))
            elif not q and t and f" {' '.join(re.findall('[^\\W_]+', t.lower()))} " in f" {' '.join(re.findall('[^\\W_]+', (r[1] or '').lower()))} ":
                want.add((r[0], i, 1, 1))
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == want and len(want) > 15
    clean = decontaminate.drop_contaminated(docs(spark, data), table)
    assert clean.columns == docs(spark, data).columns
    bad = {d for d, *_ in want}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(r[0]) for r in data if r[0] not in bad)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs(spark), none).count() == 0
    assert decontaminate.drop_contaminated(empty(spark), none).count() == 0


# ---- op9


def test_shards(spark):
    got = sharding.assign_shards(docs(spark)).toPandas()
    n = len(rows())
    assert len(got) == n and got.grown_shard.isna().all() and set(got.law) == {"rows"}
    counts = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["count"] == counts["nunique"]).all() and (counts["max"] == counts["count"] - 1).all()
    texts = {r[0]: (r[1] or "").encode() for r in rows()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert sharding.place(r.row_number, n, 16, 11) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, n, 16, 11) == r.row_number
    again = sharding.assign_shards(docs(spark, parts=9)).toPandas()
    key = ["doc_id", "text_crc32", "shard", "slot"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert sharding.assign_shards(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(range(n), n, 3)
    assert sorted(p) == list(range(n)) and sharding.permute(p, n, 3, backwards=True).tolist() == list(range(n))


def test_permutation_of_large_ranges():
    n = 10**15 + 7
    x = [0, 1, n // 2, n - 1]
    p = sharding.permute(x, n, 1)
    assert len(set(p)) == 4 and (p < n).all() and sharding.permute(p, n, 1, True).tolist() == x


