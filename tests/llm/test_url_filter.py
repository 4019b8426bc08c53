"""The url filter against a plain form, with digests that collide and lists of several files."""

import random
import re

import pytest

from sparkreg.functions.storage import new_folder
from sparkreg.llm import url_filter
from sparkreg.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, rule string"
URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "https://example.net/EN/1", "http://net/", "http://net", "http://x.net?q=/en/", "http://x.net#/", "http://badexample.net/en/1",
    "https://www.example.com/de/9?x=1", "https://www.example.com/de", "http://o.org/fr/a#b", "http://o.org/fra", "://net/", "a://b://c.net/x", "no scheme", "", None, "http://", "http:///fr/", "http://.net/",
    "http://user@Host.NET:80/x", "http://x.net:80/", "http://ü.net/ä", "http://\U0001f600.org/fr/\U0001f600", "http://a\nb.net/x\ny", "http://" + "l." * 500 + "net/" + "p" * 100_000,
]


def plain(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        h, p = "".join(c.lower() if "A" <= c <= "Z" else c for c in h), slash + p
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), len(h), h + p, verdict))
    return host, path, best and best[2], best[3] if best else otherwise


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "own host", "own rule") for k, u in enumerate(urls)], SCHEMA).repartition(3)


def check(spark, urls, rules, **settings):
    listed = url_filter.write_list(spark.createDataFrame(rules, "rule string, verdict string"), **settings)
    got = {r.page_id: r for r in url_filter.judge_urls(pages(spark, urls), listed).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        assert (got[k].url_host, got[k].url_path, got[k].url_rule, got[k].url_verdict) == plain(u, [r for r in rules if r[0] is not None]), u
        assert (got[k].host, got[k].rule) == ("own host", "own rule")
    return listed


def test_rules_of_the_query(spark):
    check(spark, URLS, URL_RULES)


def test_many_rules_in_several_files(spark):
    rng = random.Random(5)
    hosts = [f"{a}.{b}" for a in "abcdefgh" for b in ("com", "x.com", "org")]
    paths = ["", "/", "/a", "/a/", "/a/b", "/b/"]
    rules = [(rng.choice(hosts) + rng.choice(paths), v) for v in ("allow", "block") for _ in range(60)]
    block = {r for r, v in rules if v == "block"}
    rules = [(r, "block" if r in block else v) for r, v in rules] + [(None, "block"), ("UPPER.com/P", "block")]
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'a/b/c', '?q', '#f'])}" for _ in range(500)] + ["http://w.upper.com/Px", "http://upper.com/p"]
    assert len(check(spark, urls, rules, rules_per_file=20).files) > 2


def test_block_wins_between_equal_rules(spark):
    listed = url_filter.write_list(spark.createDataFrame([("a.com/", "allow"), ("A.com/", "block"), ("a.com/", "allow")], "rule string, verdict string"))
    assert url_filter.judge_urls(pages(spark, ["http://a.com/x"]), listed).first().url_verdict == "block"


def test_collisions_decide_nothing(spark, monkeypatch):
    """With digests of two values only, stored texts tell rules apart."""
    import xxhash

    monkeypatch.setattr(url_filter, "digest", lambda t: xxhash.xxh64_intdigest(t.encode()) % 2)
    listed = url_filter.write_list(spark.createDataFrame([(f"h{k}.com/", "block" if k % 2 else "allow") for k in range(40)], "rule string, verdict string"))
    found = url_filter.lookup(listed, [f"w.h{k}.com" for k in range(60)], ["/x"] * 60)
    if {len(a.keys) for a in url_filter._arrays(listed)} and max(int(a.keys.max()) for a in url_filter._arrays(listed)) < 2:
        assert found == [(f"h{k}.com/", k % 2) if k < 40 else None for k in range(60)]


def test_array_with_equal_digests(tmp_path):
    texts = [b"x.com/", b"y.com/", b"z.com/"]
    data = (3).to_bytes(8, "little") + b"".join(k.to_bytes(8, "little") for k in (7, 7, 9)) + b"".join(k.to_bytes(8, "little") for k in (0, 6, 12, 18)) + bytes([0, 1, 1]) + b"".join(texts)
    (tmp_path / "f.bin").write_bytes(data)
    import numpy as np

    own = url_filter.DigestArray(f"file://{tmp_path}", "f.bin")
    assert list(own.find(np.array([7, 7, 7, 9, 9, 8], np.uint64), ["y.com/", "x.com/", "q.com/", "z.com/", "x.com/", "x.com/"])) == [(0, 1), (1, 0), (3, 1)]


def test_unknown_verdict_is_an_error(spark):
    with pytest.raises(Exception, match="allow or block"):
        url_filter.write_list(spark.createDataFrame([("a/", "maybe")], "rule string, verdict string"))


def test_empty_list_and_empty_table(spark):
    listed = url_filter.write_list(spark.createDataFrame([], "rule string, verdict string"), new_folder(spark, "list"))
    out = url_filter.judge_urls(pages(spark, URLS), listed, otherwise="block").collect()
    assert {(r.url_rule, r.url_verdict) for r in out} == {(None, "block")}
    assert url_filter.judge_urls(spark.createDataFrame([], SCHEMA), listed).count() == 0
