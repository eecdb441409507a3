"""Words and word shingles of texts as 64-bit values, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_K = np.uint64(0x9E3779B97F4A7C15)
#: Words kept in a task's cache before it is emptied.
CACHE = 400_000


class WordHashes(dict):
    """Word bytes to their 64-bit hash; a bounded cache that any task may rebuild."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k hashes. Order counts."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= _K
        out += h[i : i + n]
    return mix(out)


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct k-word shingles of a text lower-cased A-Z.

    Words end at ASCII white space. A text of fewer than k words has its whole
    sequence as its one shingle; without words it has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(k, len(words))) + np.uint64(min(k, len(words))))


#: Runs of digits, letters (a-z folded) and non-ASCII bytes are words; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SEGMENT = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _K)
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and those of its inverse."""
    if not _POWERS:
        for base in (int(_K), pow(int(_K), -1, 2**64)):
            p = np.ones(1, np.uint64)
            while len(p) <= _SEGMENT:
                p = np.concatenate((p, p * np.uint64(pow(base, len(p), 2**64))))
            _POWERS.append(p[: _SEGMENT + 1])
    return _POWERS[0], _POWERS[1]


def word_numbers(text: bytes | None) -> np.ndarray:
    """A hash for each folded word of a text, by sums over its bytes; for statistics, where a collision is harmless.

    A word over a segment border (of a million bytes without a separator) counts as two.
    """
    up, down = _powers()
    folded, out, at = (text or b"").translate(FOLD), [], 0
    while at < len(folded):
        end = len(folded)
        if end - at > _SEGMENT:
            end = folded.rfind(b" ", at, at + _SEGMENT) + 1 or at + _SEGMENT
        part = np.frombuffer(folded, np.uint8, end - at, at)
        word = part != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)))
        start, stop = edge[::2], edge[1::2]
        out.append(mix((total[stop] - total[start]) * down[start]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def column_word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_numbers() of a text column's rows, one after the other, and the n + 1 places where rows begin and end.

    Rows are taken together up to a segment's length, longer ones alone.
    """
    if not len(column):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    column = column.cast(pa.binary())
    column = column.fill_null(b"") if column.null_count else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    up, down = _powers()
    out, sizes, a = [], [], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + _SEGMENT, "right")) - 1)
        if ends[b] - ends[a] > _SEGMENT:
            out.append(word_numbers(column[a].as_py()))
            sizes.append(np.array([len(out[-1])]))
            a = b
            continue
        n = int(ends[b] - ends[a])
        folded = column.buffers()[2].slice(int(ends[a]), n).to_pybytes().translate(FOLD) if n else b""
        part, begin = np.frombuffer(folded, np.uint8), ends[a : b + 1] - ends[a]
        word, border = np.zeros(n + 2, bool), np.zeros(n + 1, bool)
        word[1:-1] = part != 32
        border[begin] = True
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | border[:-1]))
        stop = np.flatnonzero(word[1:-1] & (~word[2:] | border[1:])) + 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[:n], dtype=np.uint64)))
        out.append(mix((total[stop] - total[start]) * down[start]))
        sizes.append(np.diff(np.searchsorted(start, begin)))
        a = b
    return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
