"""Whole-text measurements shared by the quality rules and the quality classifier.

A word is a run of characters other than space and \\t \\n \\v \\f \\r. All counts cover the whole text; a null text
counts as empty.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa

WORD = re.compile("[^\x20\x09-\x0d]+")
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct", "n_top", "n_chars")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
ARROW = pa.struct([(c, pa.int64()) for c in COUNTS])
_SYM = np.frombuffer(SYMBOLS.encode(), np.uint8)
_MARKS = np.frombuffer(b"!\"'(),-./:;?@[\\]^_`{}~+=", np.uint8)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window which occurs at least twice."""
    n = len(ids)
    if n < 3:
        return 0
    span = int(ids.max()) + 1
    if span < 2_000_000:
        windows = (ids[:-2] * span + ids[1:-1]) * span + ids[2:]
    else:  # three ids no longer fit one integer: number the pairs first
        pairs = np.unique(ids[:-1] * span + ids[1:], return_inverse=True)[1].astype(np.int64)
        windows = pairs[:-1] * (n + 1) + pairs[1:]
    uniq, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    if len(uniq) == len(windows):
        return 0
    twice = count[inverse] > 1
    inside = np.zeros(n, bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or ""
    words = WORD.findall(text)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    of = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    top = int(np.bincount(ids).max()) if len(ids) else 0
    return (
        len(words), sum(map(len, words)), int(of[_SYM].sum()), len(lines), len(lines) - len(set(lines)), repeated_words(ids),
        int(of[65:91].sum()), int(of[48:58].sum()), int(of[_MARKS].sum()), len(known), top, len(text),
    )


def measure_series(texts: pd.Series) -> pd.DataFrame:
    """Pandas form for a struct-valued UDF."""
    return pd.DataFrame([measure(t) for t in texts], columns=list(COUNTS), dtype="int64")
