"""Fill-in-middle: a text is cut at two token boundaries and its parts are put in another order around sentinels.

A token is a word with the white space before it, or the white space at the end. The boundaries of a text are kept as a set of
code-point offsets in containers of 2^16 offsets each: an array, a bitmap or runs, whichever is smallest, with cumulative
cardinalities. A cut is a rank in that set: a binary search over the containers' cardinalities, then a select within one.

Ranks and forms come from the SHA-256 of the seed and the id, so they do not depend on how rows are partitioned.

Defined cases: null text is empty; an empty text, or one that holds a sentinel, stays plain; a text of white space is one token;
texts of any length are cut whole; a null id is hashed as the word null; rows that repeat an id and text come out alike; other
columns are kept, but those with the names of new columns give way; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
_SPAN = 1 << 16  # offsets of a container


class _Array:
    def __init__(self, low: np.ndarray) -> None:
        self.low = low

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class _Bitmap:
    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(_SPAN, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.upto, rank, side="right"))
        before = int(self.upto[word - 1]) if word else 0
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[rank - before])


class _Runs:
    def __init__(self, low: np.ndarray) -> None:
        first = np.append(0, np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1)
        self.starts, self.upto = low[first], np.append(first[1:], len(low))

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.upto, rank, side="right"))
        return int(self.starts[run]) + rank - (int(self.upto[run - 1]) if run else 0)


def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest form: 2 bytes an offset, 8,192 bytes of bits, or 4 bytes a run."""
    runs = 1 + int((np.diff(low.astype(np.int64)) != 1).sum())
    sizes = {_Array: 2 * len(low), _Bitmap: _SPAN // 8, _Runs: 4 * runs}
    return min(sizes, key=sizes.get)(low)


class BoundarySet:
    """A set of offsets, given in ascending order, with select by rank."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1)) if len(offsets) else np.empty(0, np.int64)
        self.high = high[first]
        self.containers = [_container(part.astype(np.uint16)) for part in np.split(offsets & (_SPAN - 1), first[1:])] if len(first) else []
        self.upto = np.append(first[1:], len(offsets))

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, rank: int) -> int:
        """The offset that has ``rank`` smaller ones in the set."""
        at = int(np.searchsorted(self.upto, rank, side="right"))
        return (int(self.high[at]) << 16) + self.containers[at].select(rank - (int(self.upto[at - 1]) if at else 0))


def boundaries(text: str) -> BoundarySet:
    """0 and the end of every token."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    word = ~((points == 32) | ((points >= 9) & (points <= 13)))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    last = [len(points)] if len(points) and not word[-1] else []
    return BoundarySet(np.concatenate([[0], ends, last]).astype(np.int64))


def draws(seed: int, doc_id: str | None) -> tuple[int, ...]:
    """Four numbers of 32 bits."""
    digest = sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode("utf-8", "surrogatepass")).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearrange(text: str, h: tuple[int, ...], rate: int, spm: int, marks: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of prefix and middle, output) of a text."""
    cuts = boundaries(text)
    n = len(cuts) - 1
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = (cuts.select(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", lo, hi - lo, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", lo, hi - lo, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with fim_n (tokens), fim_form (plain, psm or spm), fim_prefix_chars, fim_middle_chars and fim_output.

    rate: per cent of texts that are rearranged; spm: per cent of those with the suffix in front. No shuffle.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [rearrange(t or "", draws(seed, i), rate, spm, sentinels) for i, t in zip(ids, texts, strict=True)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    found = docs.withColumn("__fim", cut(F.col(id_col).cast("string"), F.col(text_col).cast("string")))
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    return found.withColumns({f"fim_{c}": F.col(f"__fim.{c}") for c in names}).drop("__fim")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made of. A rearranged output holds each sentinel once."""
    part = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", s) for s in sentinels))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
