"""Exact byte-level BPE encoding with a cache of words, for use inside tasks.

Byte-level BPE splits a text before it merges, and a single space or line feed between two other characters always
starts a new piece. So a text whose white space is all of that kind is encoded word by word ("\\nword" at a line's start,
" word" elsewhere), each distinct word once by the library, and put together from the cache by array operations; any
other text goes to the library whole. Both give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

MAX_WORDS = 600_000  # of the cache; about 120 MB a worker while a task runs
KEPT_WORDS = 300_000  # those met most often, when the cache is full or a task ends


def _single(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between two other characters."""
    return " ".join(text.split()) == text.replace("\n", " ")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes the bytes 33-126, 161-172 and 174-255 as they are, the others as 256, 257 ... in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


_POINTS = np.array([_byte_letters().get(b, chr(b)) for b in range(256)]).view("<u4").astype("<u2")  # of the bytes as BPE writes them
_LETTER = np.zeros(256, bool)  # bytes of the letters of ASCII and U+00C0 - U+023F in UTF-8
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LF = 10


def _slots(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size - 1 of every run, one after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


class _Codes(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.feed = self.ids("\n")
        # the word-wise way holds for byte-level pre-tokenisers; others are left to the library
        self.by_word = '"ByteLevel"' in self.library.to_str().split('"decoder"')[0] and len(self.feed) == 1 and self.ids("a b\nc") == self.ids("a") + self.ids(" b") + self.feed + self.ids("c")
        self.model = self.library.model
        self.short: dict[str, list[int]] = {}  # ids of pieces of one or two letters: marks, above all
        self.direct = False
        self.forget()
        if self.by_word:
            self.direct = all(p.tolist() == self.ids(w) for w, p in ((w, self._plain([w])[1]) for w in (" the", " \u00e9l\u00e9ment,", "Stra\u00dfe.")))
        self.forget()

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, ids, sizes): the words of letters, with a space in front or without and marks behind or without, whose
        split is known beforehand, and their ids from the BPE model itself, one word after the other."""
        data = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.flatnonzero(data == _LF)
        starts = np.append(0, ends[:-1] + 1)
        odd = ~_LETTER[data]
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs for times and divided by
        spaced = data[starts] == 32
        odd[ends] = False
        odd[starts[spaced]] = False
        odds, marks = (np.add.reduceat(x, starts, dtype=np.int64) for x in (odd, odd & _MARK[data]))
        first = np.minimum(np.minimum.reduceat(np.where(odd, np.arange(len(data)), len(data)), starts), ends)
        which = np.flatnonzero((odds == marks) & (ends - first == odds) & (first - starts - spaced >= 1))
        if not len(which):
            return which, np.empty(0, self.dtype), np.empty(0, np.int64)
        starts, ends, marked = starts[which], ends[which], odds[which] > 0
        own = data[_slots(starts, ends - starts + 1)]
        base = np.cumsum(ends - starts + 1) - (ends - starts + 1)
        written = np.insert(own, (base + first[which] - starts)[marked], _LF)[:-1]  # marks are a piece of their own
        tokenize, ids, sizes = self.model.tokenize, [], []
        for piece in _POINTS[written].tobytes().decode("utf-16-le").split(chr(_POINTS[_LF])):
            own_ids = self.short.get(piece)
            if own_ids is None:
                own_ids = [t.id for t in tokenize(piece)]
                if len(piece) < 3:
                    self.short[piece] = own_ids
            ids += own_ids
            sizes.append(len(own_ids))
        word = np.repeat(np.arange(len(which)), 1 + marked)
        return which, np.array(ids, self.dtype), np.bincount(word, sizes, len(which)).astype(np.int64)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def settle(self) -> None:
        """Give freed memory back at the end of a task; the words met most often stay for the worker's next one."""
        if len(self.codes) > KEPT_WORDS:
            self._thin()
        pa.default_memory_pool().release_unused()

    def forget(self) -> None:
        """Empty the cache."""
        self.codes = _Codes()
        self.buffer, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.sizes, self.met = (np.empty(0, np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Keep the words met most often, numbered anew in the order they had."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[:KEPT_WORDS])
        words = list(self.codes)
        self.codes = _Codes(zip(map(words.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        sizes = self.sizes[keep]
        ids = self.buffer[_slots(self.starts[keep], sizes)]
        self.buffer, self.used, self.sizes, self.met = ids, len(ids), sizes, self.met[keep]
        self.starts = np.cumsum(sizes) - sizes

    def _store(self, sizes: np.ndarray) -> np.ndarray:
        """Room for newly numbered words; returns where each begins."""
        need = self.used + int(sizes.sum())
        if need > len(self.buffer):
            self.buffer = np.concatenate([self.buffer[: self.used], np.empty(max(need, len(self.buffer)), self.dtype)])
        starts = self.used + np.cumsum(sizes) - sizes
        self.starts, self.sizes, self.used = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes]), need
        return starts

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by one call with line feeds between; one by one should a text bring its own."""
        if not texts:
            return []
        ids = np.array(self.library.encode_batch_fast(["\n".join(texts)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == self.feed[0])
        if len(ends) != len(texts) - 1:
            return [np.array(self.ids(t), self.dtype) for t in texts]
        return [part[1:] if k else part for k, part in enumerate(np.split(ids, ends))]

    def _learn(self) -> None:
        new = list(self.codes)[len(self.starts) :]
        at_line = np.fromiter((w[:1] == "\n" for w in new), bool, len(new))  # these have the line feed in front
        raw = [w[1:] if first else " " + w for w, first in zip(new, at_line.tolist(), strict=True)]
        which, ids, sizes = self._plain(raw) if self.direct else (np.empty(0, np.int64), np.empty(0, self.dtype), np.empty(0, np.int64))
        other = np.ones(len(new), bool)
        other[which] = False
        rest = np.flatnonzero(other)
        found = self._joined([raw[k] for k in rest.tolist()])
        all_sizes = at_line.astype(np.int64)
        all_sizes[which] += sizes
        all_sizes[rest] += np.fromiter(map(len, found), np.int64, len(found))
        starts = self._store(all_sizes)
        self.buffer[starts[at_line]] = self.feed[0]
        self.buffer[_slots(starts[which] + at_line[which], sizes)] = ids
        if len(rest):
            self.buffer[_slots(starts[rest] + at_line[rest], all_sizes[rest] - at_line[rest])] = np.concatenate(found)

    def _coded(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Word numbers of the texts that go word by word; a line feed stands before each text. None: the library's."""
        if len(self.codes) > MAX_WORDS:
            self._thin()
        out: list[np.ndarray | None] = []
        for text in texts:
            if not text or not self.by_word or not _single(text):
                out.append(None)
            else:
                words = f"\n{text}".replace("\n", " \n")[1:].split(" ")
                out.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
        if len(self.codes) > len(self.starts):
            self._learn()
        if some := [c for c in out if c is not None]:
            met = np.bincount(np.concatenate(some), minlength=len(self.sizes))
            met[: len(self.met)] += self.met
            self.met = met
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, in self.dtype; null is empty."""
        coded = self._coded(texts)
        some = [c for c in coded if c is not None]
        flat, ends = np.empty(0, self.dtype), iter(())
        if some:
            codes = np.concatenate(some)
            sizes = self.sizes[codes]
            upto = np.cumsum(sizes)
            flat = self.buffer[_slots(self.starts[codes], sizes)]
            ends = iter(upto[np.cumsum(list(map(len, some))) - 1].tolist())
        out, low = [], 0
        for text, c in zip(texts, coded, strict=True):
            if c is None:
                out.append(np.array(self.ids(text) if text else [], self.dtype))
            else:
                high = next(ends)
                out.append(flat[low + 1 : high])  # without the line feed in front
                low = high
        return out

    def lengths(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [(len(self.ids(t)) if t else 0) if c is None else int(self.sizes[c].sum()) - 1 for t, c in zip(texts, self._coded(texts), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
