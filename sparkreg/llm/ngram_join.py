"""N-gram Jaccard join with Bayesian candidate pruning.

1. Texts that are equal form one class; a class takes part once, under the MD5 of its text.
2. A class has 80 minimum hashes of its five-word shingles. Twenty bands of four make buckets; two texts of similarity 0.8
   share a bucket with probability 1 - (1 - 0.8^4)^20 = 0.99997.
3. Within a bucket, minimum hashes are compared 16 at a time. After each step a pair is dropped when the posterior
   probability that its similarity reaches the threshold, given the matches so far and a uniform prior, is below
   ``tolerance``. A search from text to text, which compares each text it reaches with the texts not yet reached, yields
   the groups that the surviving pairs connect: a bucket of near copies costs about its size, not its square, and no
   pair is written. A bucket of more than ``bucket_rows`` texts is one group without a search.
4. The texts of a group meet again with their minimum hashes and whole sets of shingles, once each or in pairs of blocks of
   ``block_rows`` texts and ``block_shingles`` shingles at most. Pairs are pruned in the same way, hash by hash, and those that
   survive are verified exactly; links are counted and the links that hold a group together are passed on.
5. Connected components of these links are the near-duplicate classes.

Tables of one row a text or group are joined by broadcast while small; beyond that, keys with many rows are joined apart
from the others (``join_hot``), and whole texts are shuffled only where a bitmap of keys says that they may be in a group.

Words are runs of characters other than white space, as they stand. Defined cases: null text counts as empty; a text of one
to four words has one shingle, all its words; texts without words equal only themselves; texts of any length are read whole;
of ties for the least id, the text with the least key stands for the class; rows that repeat an id and text are copies; ids
of any type are kept; a null id has no number to give, so a class of null ids alone has a null class_id; other columns are
ignored, and kept by ``keep_one`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.components import connected_components
from sparkreg.functions.joins import join_hot, with_keys, without_keys
from sparkreg.functions.order import spread
from sparkreg.functions.storage import materialise
from sparkreg.llm.shingles import TEXTS, forget, windows
from sparkreg.llm.textstats import WORD

BANDS, WIDTH, STEP = 20, 4, 16
HASHES = BANDS * WIDTH


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def row_key(doc_id: Column, key: Column) -> Column:
    """One key of an id, null or not, and a text's key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null")), F.lit(" "), F.hex(key))))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(windows(WORD.findall(text or "")))


def minimum_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES x len(sets); every set must have a shingle."""
    a = np.random.default_rng(5).integers(1 << 31, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.array([np.minimum.reduceat(x * m, starts) for m in a])


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 16, 32 ... hashes compared: the fewest matches that leave a pair in the race.

    Stored hashes are the low byte of minimum hashes, so unequal ones match with probability 1/256: a pair of similarity s
    matches with probability s + (1 - s) / 256.
    """
    s = np.linspace(0, 1, 4001)[1:-1]
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        m = 0
        while m < n:
            weight = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(weight - weight.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Rows of others (hash bytes) that are not dropped when compared with one, step by step."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (others[left, part] == one[part]).sum(1)
        keep = matches >= need
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


def search(sig: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """For each row the first row of its group; groups are the components of the surviving pairs."""
    root = np.full(len(sig), -1)
    fresh = np.arange(len(sig))
    while len(fresh):
        first, fresh = fresh[0], fresh[1:]
        root[first], queue = first, [first]
        while queue and len(fresh):
            hit = survivors(sig[queue.pop()], sig[fresh], least)
            if len(hit):
                root[fresh[hit]] = first
                queue.extend(fresh[hit].tolist())
                fresh = np.delete(fresh, hit)
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first columns of sorted batches; a run that batches share comes whole."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        change = np.zeros(max(len(table) - 1, 0), bool)
        for c in range(keys):
            values = table.column(c)
            change |= pa.compute.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy().astype(bool)
        starts = np.flatnonzero(change) + 1
        low = 0
        for high in starts.tolist():
            yield table.slice(low, high - low)
            low = high
        rest = table.slice(low)
    if rest is not None and len(rest):
        yield rest


def _in_block_pairs(rows: DataFrame, blocks: Column, key: Column) -> DataFrame:
    """rows once for every pair of blocks they belong to: __i and __j; one block gives (0, 0)."""
    rows = rows.withColumn("__n", blocks).withColumn("__own", F.pmod(F.xxhash64(key, F.lit(3)), F.col("__n")))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    return rows.withColumn("__i", F.least("__own", "__o")).withColumn("__j", F.greatest("__own", "__o")).drop("__n", "__o")


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, sig, bands, n) of every row; sig is null for a text without words; n: shingles."""
    kind = dict(docs.dtypes)[id_col]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, bands, sizes, lo = [], [], [], 0
            while lo < batch.num_rows:
                sets, held = [], 0
                while lo + len(sets) < batch.num_rows and held < 200_000:  # shingles at work together
                    sets.append(shingle_set(batch.column(2)[lo + len(sets)].as_py()))
                    held += len(sets[-1])
                full = [k for k, s in enumerate(sets) if len(s)]
                own_sig: list = [None] * len(sets)
                own_bands: list = [[]] * len(sets)
                if full:
                    m = minimum_hashes([sets[k] for k in full])
                    low = np.ascontiguousarray((m & np.uint32(255)).astype(np.uint8).T)
                    wide = m.T.reshape(len(full), BANDS, WIDTH).astype(np.uint64)
                    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
                    for w in range(WIDTH):
                        key = (key ^ wide[:, :, w]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    for k, s, b in zip(full, low, key.view(np.int64), strict=True):
                        own_sig[k], own_bands[k] = s.tobytes(), b.tolist()
                sig += own_sig
                bands += own_bands
                sizes += map(len, sets)
                lo += len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=["doc_id", "key", "sig", "bands", "n"])
        forget()

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(sign, f"doc_id {kind}, key binary, sig binary, bands array<bigint>, n int")


def _candidate_groups(classes: DataFrame, least: tuple[int, ...], bucket_rows: int) -> DataFrame:
    """(node, component) of the classes that surviving pairs connect."""
    rows = classes.select("key", F.explode("bands").alias("bucket"))
    sizes = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-buckets")
    met = materialise(join_hot(rows, sizes, "bucket", "size"), "bucket-members")
    large = met.where(F.col("size") > bucket_rows).select("bucket", "key")
    heads = materialise(large.groupBy("bucket").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("size")), "large-buckets")
    whole = join_hot(large, heads, "bucket", "size").select(F.col("first").alias("a"), F.col("key").alias("b"))
    rows = met.where(F.col("size") <= bucket_rows).join(classes.select("key", "sig"), "key").select("bucket", "key", "sig")
    rows = spread(rows, "bucket").sortWithinPartitions("bucket")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            group = group.combine_chunks()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            root = search(sig, least)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                keys = group.column("key").combine_chunks()
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(root[at])), keys.take(pa.array(at))], names=["a", "b"])

    return connected_components(rows.mapInArrow(link, "a binary, b binary").union(whole).distinct())


def surviving_pairs(sig: np.ndarray, least: tuple[int, ...], one: np.ndarray | None = None) -> np.ndarray:
    """Whether each two rows of hash bytes survive the comparison step by step; one: rows whose pairs are wanted with the
    other rows only."""
    out = np.zeros((len(sig), len(sig)), bool)
    first, second = (None, None) if one is None else (np.flatnonzero(one), np.flatnonzero(~one))
    for k in range(len(sig)) if one is None else first.tolist():
        others = np.arange(k + 1, len(sig)) if one is None else second
        if len(others):
            out[k, others[survivors(sig[k], sig[others], least)]] = True
    return out | out.T


def exact_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each two sets reach the threshold. Shingles of few sets are counted pair by pair, those of many by products
    of 0/1 matrices, a slice of shingles at a time."""
    n, sizes = len(sets), np.array(list(map(len, sets)), np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    count = np.diff(np.append(starts, len(values)))
    both = np.zeros((n, n), np.float32)
    for c in range(2, _RARE + 1):
        members = owner[starts[count == c][:, None] + np.arange(c)]
        if len(members):
            pairs = np.concatenate([members[:, a] * n + members[:, b] for a in range(c) for b in range(a + 1, c)])
            cell, times = np.unique(pairs, return_counts=True)
            both.reshape(-1)[cell] += times
            both.reshape(-1)[cell % n * n + cell // n] += times
    often, width = np.flatnonzero(count > _RARE), max(1, 2_000_000 // n)
    for low in range(0, len(often), width):
        part = often[low : low + width]
        m = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), count[part])
        m[owner[_runs(starts[part], count[part])], column] = 1
        both += m @ m.T
    linked = np.empty((n, n), bool)
    for low in range(0, n, 256):
        rows = both[low : low + 256].astype(np.float64)
        linked[low : low + 256] = rows >= threshold * (sizes[low : low + 256, None] + sizes[None, :] - rows) - 1e-6
    return linked


_RARE = 8  # sets


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of every run, one after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] < 0:
            root[first], queue = first, [first]
            while queue:
                hit = np.flatnonzero(linked[queue.pop()] & (root < 0))
                root[hit] = first
                queue.extend(hit.tolist())
    return root


def near_duplicates(
    docs: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-5, bucket_rows: int = 4096, block_rows: int = 2048, block_shingles: int = 2_000_000,
    id_col: str = "doc_id", text_col: str = "text", with_key: bool = False,
) -> DataFrame:
    """(doc_id, class_id, n_links) of every row.

    class_id is the least id of the near-duplicate class; n_links counts the other rows at or above the threshold, copies
    included. With with_key, also key (of the text) and class_key (the text of the class's least id, and key).
    """
    least = least_matches(threshold, tolerance)
    signed = materialise(signatures(docs, id_col, text_col), "signatures", TEXTS)
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    classes = materialise(classes, "text-classes")
    groups = materialise(_candidate_groups(classes.where("sig is not null"), least, bucket_rows), "groups")
    named = materialise(groups.join(classes.select("key", "rep", "copies", "sig", "n"), F.col("node") == F.col("key")).drop("node"), "group-members")
    sizes = materialise(named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n").cast("long")).alias("shingles")), "group-sizes")
    blocks = F.ceil(F.greatest(F.col("size") / block_rows, F.col("shingles") / block_shingles))
    named = join_hot(named, sizes, "component", "size").withColumn("blocks", blocks)
    named = materialise(named.select(row_key(F.col("rep"), F.col("key")).alias("k"), "component", "blocks", "key", "copies", "sig"), "group-blocks")

    # one row of each text in a group, with its shingles
    key = text_key(F.col(text_col))
    texts = with_keys(docs.select(F.col(id_col), F.col(text_col)), row_key(F.col(id_col), key), named)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t).tobytes() for t in batch.column(5).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sets], names=["component", "blocks", "key", "copies", "sig", "shingles"])
        forget()

    rows = texts.select("component", "blocks", "key", "copies", "sig", F.col(f"row.`{text_col}`").cast("string").alias("text"))
    rows = rows.mapInArrow(cut, "component binary, blocks long, key binary, copies long, sig binary, shingles binary")
    rows = _in_block_pairs(rows, F.col("blocks"), F.col("key")).select("component", "__i", "__j", "key", "__own", "copies", "sig", "shingles")
    rows = spread(rows, "component", "__i", "__j").sortWithinPartitions("component", "__i", "__j", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            key = group.column("key").to_pylist()
            new = [k for k in range(len(key)) if not k or key[k] != key[k - 1]]  # rows may repeat an id and text
            if len(new) < 2:
                continue
            i, j = group.column("__i")[0].as_py(), group.column("__j")[0].as_py()
            own, copies = group.column("__own").to_numpy()[new], group.column("copies").to_numpy()[new]
            sig = np.frombuffer(b"".join(group.column("sig")[k].as_py() for k in new), np.uint8).reshape(-1, HASHES)
            linked = surviving_pairs(sig, least, None if i == j else own == i)
            left = np.flatnonzero(linked.any(1))
            if not len(left):
                continue
            exact = exact_links([np.frombuffer(group.column("shingles")[new[k]].as_py(), np.uint64) for k in left.tolist()], threshold)
            linked[np.ix_(left, left)] &= exact
            links, root = linked @ copies, _forest(linked)
            at = np.flatnonzero(links > 0)
            if len(at):
                keys = pa.array([key[k] for k in new], pa.binary())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(links[at]), keys.take(pa.array(root[at]))], names=["key", "links", "root"])

    found = materialise(rows.mapInArrow(verify, "key binary, links long, root binary"), "links", TEXTS)
    components = connected_components(found, "key", "root").withColumnRenamed("node", "n")
    links = found.groupBy(F.col("key").alias("lk")).agg(F.sum("links").alias("links"))
    members = classes.select("key", "rep", "copies").join(components, F.col("key") == F.col("n"), "left").join(links, F.col("key") == F.col("lk"), "left")
    members = materialise(members.select("key", "rep", "copies", "component", "links"), "members")
    heads = members.where("component is not null").groupBy("component").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "key"))).alias("head"), F.min("key").alias("any_key"), F.count(F.lit(1)).alias("size"))
    heads = materialise(heads, "heads")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    alone = members.where("component is null").select("key", F.col("rep").alias("class_id"), F.col("key").alias("class_key"), n_links, "copies")
    grouped = join_hot(members.where("component is not null"), heads, "component", "size")
    grouped = grouped.select("key", F.col("head.rep").alias("class_id"), F.coalesce("head.key", "any_key").alias("class_key"), n_links, "copies")
    out = join_hot(signed.select("doc_id", "key"), materialise(alone.union(grouped), "classes-of-texts"), "key", "copies")
    return out.select("doc_id", "class_id", "n_links", *(["key", "class_key"] if with_key else []))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the least id."""
    rows = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, with_key=True, **settings), "classes")
    rows = rows.withColumn("k", row_key(F.col("doc_id"), F.col("key")))
    stays = F.col("key").eqNullSafe(F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = materialise(rows.where(~stays).select("k").distinct(), "gone")
    key = row_key(F.col(id_col), text_key(F.col(text_col)))
    kept = without_keys(docs, key, gone)
    if rows.where(stays).groupBy("k").count().where("count > 1").limit(1).count():  # rows that repeat an id and text
        packed = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
        kept = packed.dropDuplicates(["k"]).select("row.*")
    return kept
