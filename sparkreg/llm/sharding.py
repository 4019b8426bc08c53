"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0 .. n-1 in the order of their ids. A balanced Feistel network permutes the integers below the next
power of four; numbers that land at n or above walk on through the network until they fall below n (cycle walking),
which makes a permutation of 0 .. n-1. Position p belongs to shard p mod shards, slot p div shards: shard counts
differ by one at most, slots have no gaps, and both can be computed from a row number alone (``place``) and back
(``row_at``). The law that holds is ``rows``.

Defined cases: null text has the size 1 and the checksum 0; texts of any length are measured whole; null ids are numbered
first; rows that repeat an id are numbered by text checksum and size, then in any order; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.order import global_row_number

ROUNDS = 6
_MUL = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233)  # odd 32-bit multipliers


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _scramble(x: np.ndarray, r: int, seed: int, mask: int) -> np.ndarray:
    """32-bit mix of a half (halves above 32 bits are folded), cut to the half's width."""
    m32 = np.uint64(0xFFFFFFFF)
    y = ((x ^ (x >> np.uint64(32))) & m32) + np.uint64((seed * 7919 + r * 104729) & 0xFFFFFFFF)
    y = ((y & m32) * np.uint64(_MUL[r])) & m32
    y ^= y >> np.uint64(15)
    y = (y * np.uint64(_MUL[(r + 3) % ROUNDS])) & m32
    y ^= y >> np.uint64(13)
    return y & np.uint64(mask)


def _network(x: np.ndarray, half: int, seed: int, backwards: bool) -> np.ndarray:
    mask, shift = (1 << half) - 1, np.uint64(half)
    left, right = x >> shift, x & np.uint64(mask)
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        if backwards:
            left, right = right ^ _scramble(left, r, seed, mask), left
        else:
            left, right = right, left ^ _scramble(right, r, seed, mask)
    return (left << shift) | right


def permute(rows, n: int, seed: int = 0, backwards: bool = False) -> np.ndarray:
    """The permutation of 0 .. n-1 (or its inverse) at each of rows."""
    x = np.array(rows, dtype=np.uint64)
    half = _half_bits(n)
    x = _network(x, half, seed, backwards)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], half, seed, backwards)
    return x.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute([row], n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies in a slot of a shard."""
    return int(permute([slot * shards + shard], n, seed, backwards=True)[0])


def assign_shards(docs: DataFrame, shards: int = 16, *, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard) of every row of docs."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = global_row_number(slim, "doc_id", "text_crc32", "size")
    n = rows.count()

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    rows = rows.withColumn("__p", position("row_number"))
    return rows.select(
        "doc_id", "size", "text_crc32", "row_number", F.lit("rows").alias("law"), (F.col("__p") % shards).cast("int").alias("shard"),
        F.expr(f"__p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
