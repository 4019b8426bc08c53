"""Benchmark decontamination: size-partitioned MinHash search for short test items inside long documents.

Containment of an item in a document is the share of the item's five-word shingles that the document has. MinHash sees
similarity, which vanishes when a document is much longer than an item; so items are partitioned by size into classes of
16, 32, 64 ... shingles, and for each class the document is cut into windows of two blocks of that many shingles,
each block shared by two windows: an item that occurs lies within one window, of which it is at least a quarter or so.
A window is a candidate for an item where any of ``hashes`` minimum hashes agree (at an item share of a quarter, the
chance to miss one is 0.75^48 = 1e-6). Items of fewer than eight shingles, which are less than a quarter of the smallest window,
are looked up by each of their shingles instead. Candidates are verified by the exact containment in the whole document.

Words are runs of letters and digits, lower-cased, so punctuation, symbols and case hide nothing. An item of one to four
words is one shingle, all its words, and is found wherever they stand in that order. Items are the query set: tasks get the
index of one block of items, at most ``block`` of them and about ``block_bytes`` of text, and documents are passed once for
each block.

Defined cases: null text is empty; items without words match nothing; texts of any length are read whole; ids of any type are
kept, nulls too; repeated rows, of documents or items, give repeated results; other columns are ignored, and kept by
``drop_contaminated`` whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.joins import without_keys
from sparkreg.functions.storage import materialise
from sparkreg.llm.ngram_join import row_key, text_key
from sparkreg.llm.shingles import N, TEXTS, forget, windows

WORD = re.compile(r"[^\W_]+")
LEAST = 16  # shingles in a block of the smallest class
FEW = 8  # shingles of an item from which minimum hashes are used
_BITS = 20  # at most, of the tables that sort out most windows; 256 places an item suffice
_NONE = np.uint32(0xFFFFFFFF)


def normal_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingled(text: str | None) -> np.ndarray:
    return windows(normal_words(text), short=False)


def _multipliers(hashes: int) -> np.ndarray:
    return np.random.default_rng(97).integers(1 << 31, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)


class Index:
    """Minimum hashes of a block of items by size class."""

    def __init__(self, texts: list[str | None], hashes: int) -> None:
        self.a = _multipliers(hashes)
        words = [normal_words(text) for text in texts]
        self.sets = [np.unique(windows(w)) for w in words]
        self.short: dict[int, list[int]] = defaultdict(list)  # items of fewer words than a shingle, by their number
        by: dict[int, list[int]] = defaultdict(list)
        few = []
        for k, s in enumerate(self.sets):
            if 0 < len(words[k]) < N:
                self.short[len(words[k])].append(k)
            elif 0 < len(s) < FEW:
                few.append(k)
            elif len(s):
                by[max(0, (len(s) - 1) // LEAST).bit_length()].append(k)
        keys = np.concatenate([np.empty(0, np.uint64), *(self.sets[k] for k in few)])
        order = np.argsort(keys, kind="stable")
        self.few_keys, self.few = keys[order], np.repeat(few, [len(self.sets[k]) for k in few]).astype(np.int64)[order]
        self.few_shift = np.uint64(64 - min(_BITS, 8 + len(keys).bit_length()))
        self.few_table = np.zeros(1 << (64 - int(self.few_shift)), bool)
        self.few_table[keys >> self.few_shift] = True
        self.classes = {}
        for level, members in by.items():
            m = np.array([[((self.sets[k] >> np.uint64(32)).astype(np.uint32) * a).min() for k in members] for a in self.a])
            shift = np.uint32(32 - min(_BITS, 8 + len(members).bit_length()))
            table = np.zeros((hashes, 1 << (32 - int(shift))), bool)
            table[np.arange(hashes)[:, None], m >> shift] = True
            order = np.argsort(m, axis=1, kind="stable")
            self.classes[level] = (shift, table, np.take_along_axis(m, order, 1), np.array(members)[order])

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs of which a window and the item share a minimum hash."""
        found = self._few_candidates(docs)
        for level, (shift, table, values, members) in self.classes.items():
            size = LEAST << level
            blocks = [-(-len(d) // size) for d in docs]
            total = sum(blocks)
            if not total:
                continue
            grid = np.full((total, size), 0, np.uint32)
            empty = np.zeros((total, size), bool)
            owner = np.repeat(np.arange(len(docs)), blocks)
            flat, at = grid.reshape(-1), 0
            void = empty.reshape(-1)
            for d, b in zip(docs, blocks, strict=True):
                flat[at : at + len(d)] = (d >> np.uint64(32)).astype(np.uint32)
                void[at + len(d) : at + b * size] = True
                at += b * size
            grid, empty = np.ascontiguousarray(grid.T), np.ascontiguousarray(empty.T)
            joined = np.append(owner[1:] == owner[:-1], False)  # blocks that the next block of the document follows
            for k, a in enumerate(self.a):
                v = grid * a
                v[empty] = _NONE
                low = v.min(axis=0)
                w = np.where(joined, np.minimum(low, np.append(low[1:], _NONE)), low)
                maybe = np.flatnonzero(table[k][w >> shift])
                if len(maybe):
                    lo, hi = (np.searchsorted(values[k], w[maybe], side=s) for s in ("left", "right"))
                    for window, x, y in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                        found.update((int(owner[window]), int(m)) for m in members[k, x:y])
        return found

    def _few_candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs that share a shingle, of the items with few."""
        if not len(self.few_keys) or not len(docs):
            return set()
        flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), list(map(len, docs)))
        at = np.flatnonzero(self.few_table[flat >> self.few_shift])
        flat, owner = flat[at], owner[at]
        lo, hi = (np.searchsorted(self.few_keys, flat, side=s) for s in ("left", "right"))
        found: set[tuple[int, int]] = set()
        for d, x, y in zip(owner[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            found.update((d, int(k)) for k in self.few[x:y])
        return found

    def short_hits(self, words: list[str]) -> list[int]:
        """The short items that the words hold."""
        found: list[int] = []
        for length, members in self.short.items():
            if len(words) >= length:
                own = windows(words, size=length)
                found += [k for k in members if (own == self.sets[k][0]).any()]
        return found


_last: tuple[str, Index] | None = None


def _index(name: str, texts: list[str | None], hashes: int) -> Index:
    """The index of a block, kept by the worker until another block comes."""
    global _last
    if _last is None or _last[0] != name:
        _last = (name, Index(texts, hashes))
    return _last[1]


def find_contamination(
    docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, hashes: int = 48, block: int = 20_000, block_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", with_key: bool = False,
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every document and item at or above the threshold.

    With with_key, also key (of the text).
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t"))
    listed = listed.withColumn("b", F.xxhash64(F.col("i").cast("string"), "t"))
    held = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("bytes")).first()
    blocks = max(1, -(-held.n // block), -(-(held.bytes or 0) // block_bytes))
    rows = docs.select(F.col(id_col).alias("doc_id"), (text_key(F.col(text_col)) if with_key else F.lit(None).cast("binary")).alias("key"), F.col(text_col).cast("string").alias("text"))
    kinds = dict(rows.dtypes) | {"item": dict(listed.dtypes)["i"]}
    out = None
    for b in range(blocks):
        # one block of items at a time is the query set that tasks get
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, listed.where(F.pmod("b", F.lit(blocks)) == b).select("i", "t").toArrow()))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            name, table = sent.value
            index, item_ids = _index(name, table.column("t").to_pylist(), hashes), table.column("i").combine_chunks()
            for batch in batches:
                lo = 0
                while lo < batch.num_rows:
                    docs, words, start, held = [], [], lo, 0
                    while lo < batch.num_rows and held < 400_000:  # shingles at work together
                        words.append(normal_words(batch.column(2)[lo].as_py()))
                        docs.append(windows(words[-1], short=False))
                        held += len(docs[-1])
                        lo += 1
                    pairs = sorted(index.candidates(docs))
                    sets = {d: np.unique(docs[d]) for d, _ in pairs}
                    hits = [(d, k, 1, 1) for d, w in enumerate(words) for k in index.short_hits(w)] if index.short else []
                    for d, k in pairs:
                        item, own = index.sets[k], sets[d]
                        at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                        n = int((own[at] == item).sum())
                        if n >= threshold * len(item) - 1e-9:
                            hits.append((d, k, n, len(item)))
                    d, k, n, size = (np.array([h[c] for h in hits], np.int64) for c in range(4))
                    columns = [batch.column(0).take(pa.array(d + start)), batch.column(1).take(pa.array(d + start)), item_ids.take(pa.array(k)), pa.array(n), pa.array(size), pa.array(n / np.maximum(size, 1))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "item_id", "shared", "item_shingles", "containment"])
            forget()

        found = rows.mapInArrow(scan, f"doc_id {kinds['doc_id']}, key binary, item_id {kinds['item']}, shared long, item_shingles long, containment double")
        out = found if out is None else out.union(found)
    return out if with_key else out.drop("key")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that hold no item. Rows are told apart by id and text."""
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, with_key=True, **settings)
    found = materialise(found.select(row_key(F.col("doc_id"), F.col("key")).alias("k")).distinct(), "contaminated", TEXTS)
    return without_keys(docs, row_key(F.col(id_col), text_key(F.col(text_col))), found)
