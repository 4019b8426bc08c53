"""URL filter: a sorted array of 64-bit digests on disk, memory-mapped by the tasks.

A rule is a text host/path with a verdict. It fits a url whose host is its host or a subdomain of it and whose path begins with
its path; of the rules that fit, the longest text wins, and of those the one with the longer host. Rules are written sorted by
the xxhash of their text: digests, offsets, verdicts and texts. A url's candidates are the suffixes of its host with the
prefixes of its path that have the length of some rule's path; each is looked up by one vectorised binary search, and a digest
that is found counts only if the stored text is equal, so a collision decides nothing. What no rule fits gets ``otherwise``.

The files are read where the shared folder is, mapped and not copied if that is a file system; work grows with urls times
labels times path lengths times the logarithm of the rules, and nothing is broadcast or shuffled.

Defined cases: a null url, or one without "://", has an empty host and path and no rule fits it; hosts are compared with A-Z
lowered, ports and user names are part of them; repeated rules count once, and block wins where their verdicts differ; null
rules are ignored; an empty list leaves every url to ``otherwise``; rows that repeat come out alike; other columns are kept, but
those with the names of new columns give way; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import materialise, new_folder
from sparkreg.llm.layout import NewFile, commit

MANIFEST = "name string, temp string, records long, first decimal(20, 0)"
VERDICTS = ("allow", "block")
_HEAD = 8  # bytes: the number of rules of a file


def lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://": the host up to / ? # or the end, with A-Z lowered, and the path up to ? # or the end."""
    form = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return lowered(F.coalesce(F.regexp_extract(url, form, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class DigestList:
    """Where a list is: files in the order of their digests, and the lengths that paths of rules have."""

    folder: str
    files: tuple[str, ...]
    lengths: tuple[int, ...]


def write_list(rules: DataFrame, folder: str | None = None, *, rules_per_file: int = 5_000_000, rule_col: str = "rule", verdict_col: str = "verdict") -> DigestList:
    """Write rules (text, verdict) as sorted digest arrays below folder (a new one in the shared folder if None)."""
    spark = rules.sparkSession
    folder = folder or new_folder(spark, "url-list")
    text = F.col(rule_col).cast("string")
    own_host, own_path = F.regexp_extract(text, "^[^/]*", 0), F.regexp_extract(text, "(?s)^[^/]*(.*)$", 1)
    listed = rules.where(text.isNotNull()).select(F.concat(lowered(own_host), own_path).alias("rule"), F.length(own_path).alias("length"), F.col(verdict_col).alias("verdict"))
    known = F.when(F.col("verdict").isin(*VERDICTS), (F.col("verdict") == "block").cast("int")).otherwise(F.raise_error(F.lit("a rule's verdict is allow or block")).cast("int"))

    @F.pandas_udf("decimal(20, 0)")
    def digests(texts: pd.Series) -> pd.Series:
        from decimal import Decimal

        return texts.map(lambda t: Decimal(digest(t)))

    listed = materialise(listed.groupBy("rule", "length").agg(F.max(known).alias("code")).withColumn("digest", digests("rule")), "url-rules")
    lengths = tuple(sorted(r.length for r in listed.select("length").distinct().collect()))  # at most the longest path
    parts = max(1, -(-listed.count() // rules_per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, texts = [], [], []
        for batch in batches:  # one file's share of the rules
            keys += [int(k) for k in batch.column(0).to_pylist()]
            codes += batch.column(1).to_pylist()
            texts += [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        if keys:
            out = NewFile(folder, f"digests-{keys[0]:016x}.bin")
            offsets = np.cumsum([0, *map(len, texts)])
            out.write(len(keys).to_bytes(_HEAD, "little") + np.array(keys, "<u8").tobytes() + offsets.astype("<u8").tobytes() + bytes(codes))
            out.write(b"".join(texts))
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": out.name, "temp": out.temp, "records": len(keys), "first": keys[0]}], schema=pa.schema([("name", pa.string()), ("temp", pa.string()), ("records", pa.int64()), ("first", pa.decimal128(20, 0))]))

    placed = listed.repartitionByRange(parts, "digest").sortWithinPartitions("digest", "rule").select("digest", "code", "rule")
    manifest = commit(folder, materialise(placed.mapInArrow(write, MANIFEST), "url-files"))
    return DigestList(folder, tuple(r.name for r in manifest.orderBy("first").collect()), lengths)


class DigestArray:
    """One file, mapped: digests in ascending order, offsets of the texts, verdict codes, texts."""

    def __init__(self, folder: str, name: str) -> None:
        system, root = fs.FileSystem.from_uri(folder)
        if isinstance(system, fs.LocalFileSystem):
            self.data = pa.memory_map(f"{root}/{name}").read_buffer()
        else:
            with system.open_input_file(f"{root}/{name}") as f:
                self.data = pa.py_buffer(f.read())
        n = int(np.frombuffer(self.data, "<u8", 1)[0])
        self.keys = np.frombuffer(self.data, "<u8", n, _HEAD)
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, _HEAD + 8 * n)
        self.codes = np.frombuffer(self.data, np.uint8, n, _HEAD + 16 * n + 8)
        self.heap = _HEAD + 17 * n + 8

    def text(self, k: int) -> bytes:
        return self.data.slice(self.heap + int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])).to_pybytes()

    def find(self, digests: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(probe, verdict code) of the probes whose text is in the file; all rules of an equal digest are compared."""
        lo, hi = (np.searchsorted(self.keys, digests, side=s) for s in ("left", "right"))
        for probe in np.flatnonzero(hi > lo).tolist():
            own = texts[probe].encode("utf-8", "surrogatepass")
            for k in range(int(lo[probe]), int(hi[probe])):
                if self.text(k) == own:
                    yield probe, int(self.codes[k])


_open: dict[tuple[str, str], DigestArray] = {}


def _arrays(found: DigestList) -> list[DigestArray]:
    """The files of a list, opened once a worker."""
    for name in found.files:
        if (found.folder, name) not in _open:
            _open[found.folder, name] = DigestArray(found.folder, name)
    return [_open[found.folder, name] for name in found.files]


def candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """The texts of all rules that would fit, the winner first."""
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))] if host else []
    texts = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [h + p for h, p in sorted(texts, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def lookup(found: DigestList, hosts: list[str], paths: list[str]) -> list[tuple[str, int] | None]:
    """(winning rule, verdict code) of each url, or None."""
    owner, texts = [], []
    for at, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        own = candidates(h, p, found.lengths)
        texts += own
        owner += [at] * len(own)
    best: dict[int, tuple[int, int]] = {}  # url: (probe, code); the first probe of a url is the longest text
    keys = np.fromiter(map(digest, texts), np.uint64, len(texts))
    for array in _arrays(found):
        for probe, code in array.find(keys, texts):
            at = owner[probe]
            if at not in best or probe < best[at][0]:
                best[at] = (probe, code)
    return [(texts[best[at][0]], best[at][1]) if at in best else None for at in range(len(hosts))]


def judge_urls(pages: DataFrame, found: DigestList, *, otherwise: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with url_host, url_path, url_rule (the rule that decides, else null) and url_verdict. No shuffle.

    Only hosts and as much of a path as the longest rule has go to Python, each different pair of a batch once.
    """
    longest = max(found.lengths, default=0)
    names = np.array(VERDICTS)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        code, seen = pd.factorize(pd.Series(list(zip(hosts, paths, strict=True)), dtype=object))
        hits = lookup(found, [h for h, _ in seen], [p for _, p in seen])
        rules = np.array([None if x is None else x[0] for x in hits], object)
        verdicts = np.array([otherwise if x is None else names[x[1]] for x in hits], object)
        return pd.DataFrame({"rule": rules[code], "verdict": verdicts[code]})

    host, path = host_and_path(F.col(url_col).cast("string"))
    out = pages.withColumns({"url_host": host, "url_path": path})
    out = out.withColumn("__judged", judge("url_host", F.substring("url_path", 1, longest)))
    return out.withColumns({"url_rule": F.col("__judged.rule"), "url_verdict": F.col("__judged.verdict")}).drop("__judged")
