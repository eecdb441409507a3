"""Toxicity scores on deobfuscated text.

Writers hide words by leetspeak (``1d10t``), by spacing (``i d i o t``, ``i.d.i.o.t``)
and by repetition (``idiooot``). Such a stretch becomes a lattice: every character
offers the letters it may stand for, separators between single characters may
vanish, runs may shrink, each at the price of the noisy channel. Viterbi finds the
cheapest reading under a character trigram model, which is counted over all texts;
the unchanged reading is one of the paths. The restored words are then scored by a
logistic regression on words and word beginnings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_counts, cut, map_rows, named, numbered, small

#: Letters that digits and signs stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "",
}

#: Classes of the character model: 0 for a blank, 1 to 26 for a-z, the others for the rest of the letters.
CLASSES, MODEL_BITS = 64, 18
#: Price, in nats, of reading a sign as a letter, of reading it as a blank, of dropping a separator, of ending a word at one, and of shrinking a run.
SWAP, BLANK, JOIN, PART, SHRINK = 1.0, 9.0, 0.5, 2.0, 0.7
#: The longest stretch, in characters, whose decoding is remembered; longer ones are decoded each time.
REMEMBERED = 64

FEATURE_BITS, PREFIXES = 20, (3, 4, 5, 6)
#: Features kept, labelled rows that the regression is fitted on (a bounded sample, the least hashes first), and least support.
FEATURES, SAMPLE, SUPPORT = 4096, 20_000, 3
CACHE = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def letter_class(point: int) -> int:
    if 97 <= point <= 122:
        return point - 96
    return 27 + point % 37 if chr(point).isalpha() else 0


_PLANE: list[np.ndarray] = []


def class_trigrams(text: str | None) -> np.ndarray:
    """Numbers of the class trigrams of a lower-cased text that end in a letter or end a word."""
    if not _PLANE:
        _PLANE.append(np.array([letter_class(i) for i in range(1 << 16)], np.int64))
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.zeros(len(points) + 3, np.int64)
    c[2:-1] = _PLANE[0][np.minimum(points, 0xFFFF)]
    live = (c[2:] > 0) | (c[1:-1] > 0)
    return (c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:])[live]


#: Separators of spaced-out words.
SEPARATORS = " ._-*"
_ITEM = r"[^\W_]|[@$!|]"
_CHAIN = re.compile(rf"(?<!\w)(?:{_ITEM})(?:[{re.escape(SEPARATORS)}](?:{_ITEM})){{2,}}(?!\w)")
_KINDS: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    """By character: 1 a letter, 2 a sign of leetspeak, 3 white space, 4 an exclamation mark, 0 the rest."""
    if not _KINDS:
        kind = np.array([1 if chr(i).isalpha() else 3 if chr(i).isspace() else 0 for i in range(1 << 16)], np.int8)
        kind[[ord(x) for x in LEET if x not in "!(*"]] = 2
        kind[ord("!")] = 4
        _KINDS.append(kind)
    return _KINDS[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]


def _letters(back: tuple | None) -> list[str]:
    """What a chain of back pointers reads, from its beginning."""
    out = []
    while back:
        back, letters = back
        out.append(letters)
    return out[::-1]


class Channel:
    """The noisy channel with its character model; decodings are remembered."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        pair = n.sum(axis=0)
        back = (pair + 0.5) / (pair.sum(axis=1, keepdims=True) + 0.5 * CLASSES)
        p = (n + 5 * back[None]) / (n.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p)).tolist()
        self.seen: dict[str, str] = {}

    def lattice(self, text: str, joints: set[int] = frozenset()) -> Iterator[list[tuple[str, float]]]:
        """By place, what may be read there and at what price; "" reads nothing, " " ends a word.

        At ``joints``, the separators of spaced-out words, a word may go on or end.
        """
        at = 0
        while at < len(text):
            ch = text[at]
            run = 1
            if at in joints:
                yield [("", JOIN), (" ", PART)]
                at += 1
                continue
            while at + run < len(text) and text[at + run] == ch:
                run += 1
            if ch.isalpha():
                if run >= 3:
                    yield [(ch, SHRINK), (ch * 2, SHRINK), (ch * run, 0.0)]
                else:
                    yield from [[(ch, 0.0)]] * run
            else:
                reads = [(x, SWAP) for x in LEET.get(ch, "")]
                yield from [[*reads, (" ", BLANK if reads else 0.0)]] * min(run, 2)
            at += run

    def decode(self, text: str) -> str:
        """The cheapest reading of a stretch of any length."""
        if text in self.seen:
            return self.seen[text]
        if len(self.seen) >= CACHE:
            self.seen.clear()
        readings = [self.cheapest(self.lattice(text))]
        joints = {i for m in _CHAIN.finditer(text) for i in range(m.start() + 1, m.end(), 2)}
        if joints:  # single characters: as they stand, or each separator inside a word or between two
            readings.append(self.cheapest(self.lattice(text, joints)))
        out = min(readings)[1].strip()
        if len(text) <= REMEMBERED:
            self.seen[text] = out
        return out

    def cheapest(self, lattice: Iterable[list[tuple[str, float]]]) -> tuple[float, str]:
        """Viterbi: of each pair of last letters, only the cheapest reading goes on, as a chain of back pointers.

        What all readings have in common is written out as soon as one is left.
        """
        done: list[str] = []
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in chain(lattice, [[(" ", 0.0)]]):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, back) in paths.items():
                for letters, price in options:
                    x, y, total = a, b, cost + price
                    for ch in letters:
                        k = letter_class(ord(ch)) if ch != " " else 0
                        if y or k:
                            total += self.cost[x][y][k]
                            x, y = y, k
                    best = new.get((x, y))
                    if best is None or total < best[0]:
                        new[x, y] = (total, (back, letters))
            paths = new
            if len(paths) == 1:
                ((pair, (cost, back)),) = paths.items()
                done += _letters(back)
                paths = {pair: (cost, None)}
        cost, back = min(paths.values(), key=lambda x: x[0])
        return cost, "".join([*done, *_letters(back)])

    def restore(self, text: str | None) -> str:
        """The lower-cased text with every suspicious stretch decoded."""
        text = (text or "").lower()
        out, last = [], 0
        for a, b in stretches(text):
            out += [text[last:a], self.decode(text[a:b])]
            last = b
        out.append(text[last:])
        return "".join(out)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a lower-cased text may hide words: tokens in which letters meet leetspeak or run on, and chains of single characters."""
    c = _classes(text)
    if len(c) < 3:
        return []
    letter, leet, gap, bang = c == 1, c == 2, c == 3, c == 4
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    odd = np.zeros(len(c) + 1, bool)
    odd[1:-1] |= (letter[:-1] & leet[1:]) | ((leet | bang)[:-1] & letter[1:])
    odd[1:-2] |= letter[1:-1] & (points[1:-1] == points[:-2]) & (points[1:-1] == points[2:])
    ends = np.flatnonzero(gap)
    out: list[tuple[int, int]] = []
    hot = np.flatnonzero(odd[:-1])
    if len(hot):
        right = np.searchsorted(ends, hot)
        for k in np.unique(right).tolist():
            a = int(ends[k - 1]) + 1 if k else 0
            b = int(ends[k]) if k < len(ends) else len(text)
            out.append((a, b))
    lone = (letter | leet)
    lone[1:] &= ~(letter | leet)[:-1]
    lone[:-1] &= ~(letter | leet)[1:]
    if np.count_nonzero(lone[:-2] & lone[2:]) > 1:
        out += [m.span() for m in _CHAIN.finditer(text)]
    out.sort()
    clean: list[tuple[int, int]] = []
    for a, b in out:
        if not clean or a >= clean[-1][1]:
            clean.append((a, b))
        elif b > clean[-1][1]:
            clean[-1] = (clean[-1][0], b)
    return clean


class WordFeatures(dict):
    """Buckets of a word: the word itself and its beginnings. With ``keep``, only the chosen buckets, renumbered."""

    def __init__(self, keep: np.ndarray | None = None):
        super().__init__()
        self.keep = None if keep is None else {int(b): i for i, b in enumerate(keep)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        parts = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
        buckets = [xxhash.xxh3_64_intdigest(x) >> (64 - FEATURE_BITS) for x in parts]
        out = tuple(buckets) if self.keep is None else tuple(self.keep[b] for b in buckets if b in self.keep)
        self[word] = out
        return out

    def of(self, text: str) -> list[int]:
        """The distinct buckets of a text."""
        return sorted({b for w in set(_WORD.findall(text)) for b in self[w]})


def fit(rows: list[list[int]], labels: list[int], n: int, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on present features, by accelerated gradient descent."""
    y = np.array(labels, float)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64)
    size = np.maximum(1.0, np.bincount(at, minlength=len(rows)))
    scale = 1 / np.sqrt(np.bincount(col, minlength=n) + 1.0)  # rare features may move as far as frequent ones
    w, b = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    v, step = w.copy(), 4.0 / max(1.0, (size * 1.0).mean())
    for k in range(rounds):
        z = np.bincount(at, v[col], minlength=len(rows)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(col, error[at], minlength=n) * scale + ridge * v
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
        b -= 0.5 * error.mean()
    return w, b


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1).

    ``labelled`` (id, text, toxic) is what the scorer learns from; feature counts
    use all of it, the regression at most SAMPLE rows. Null texts are empty, and
    empty texts get the score of no evidence; without labels of both kinds every
    score is 0. Every row is scored by itself, also where ids are missing or
    repeat.
    """
    spark = docs.sparkSession
    rows, names = numbered(docs, id_col, text_col)

    def trigrams(b: pa.RecordBatch):
        yield "", np.concatenate([class_trigrams(t) for t in b.column(0).to_pylist()] or [np.empty(0, np.int64)])

    model = spark.sparkContext.broadcast(bucket_counts(rows.select("v0"), trigrams, MODEL_BITS).get("", np.zeros(1 << MODEL_BITS, np.int64)))  # 2 MB
    labelled = labelled.filter("toxic is not null").select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    labelled = cut(labelled)

    def features(b: pa.RecordBatch):
        channel, words = Channel(model.value), WordFeatures()
        by: dict[str, list[int]] = {"0": [], "1": [], "rows": []}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by[str(toxic)] += words.of(channel.restore(text))
            by["rows"].append(toxic)
        for key, buckets in by.items():
            yield key, np.array(buckets, np.int64)

    counts = bucket_counts(labelled.select("text", "toxic"), features, FEATURE_BITS)
    none = np.zeros(1 << FEATURE_BITS, np.int64)
    n0, n1 = (int(x) for x in counts.get("rows", none)[:2])
    c0, c1 = counts.get("0", none), counts.get("1", none)
    if not n0 or not n1:
        return named(rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score")), names, id_col)
    ratio = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    weight = np.where(c0 + c1 >= SUPPORT, np.abs(ratio) / np.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5)), 0)
    keep = np.sort(np.argsort(-weight, kind="stable")[:FEATURES])
    keep = keep[weight[keep] > 0]
    held = spark.sparkContext.broadcast(keep)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, words = Channel(model.value), WordFeatures(held.value)
        for b in batches:
            found = [words.of(channel.restore(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], names=["f", "toxic"])

    picked = labelled.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = labelled.join(F.broadcast(picked), "id", "left_semi").select("text", "toxic")  # at most SAMPLE ids
    got = map_rows(sample, chosen, "f array<int>, toxic int").collect()  # at most SAMPLE short lists
    w, bias = fit([r.f for r in got], [r.toxic for r in got], len(keep))
    weights = spark.sparkContext.broadcast(w)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, words = Channel(model.value), WordFeatures(held.value)
        for b in batches:
            z = [bias + float(weights.value[words.of(channel.restore(t))].sum()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), pa.float64())], names=[id_col, "score"])

    return named(map_rows(rows, score, f"{id_col} long, score double"), names, id_col)


#: Labels (16 bytes each) that may be broadcast to the documents, checked by a count.
LABELS = 1_000_000

#: The held-out fold of the query.
FOLDS, HELD = 5, 0


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxicity(), learning from the labels outside the held-out fold (of repeated labels, the greatest)."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    few = F.broadcast(known) if small(known, LABELS) else known  # else a shuffle join
    learn = docs.select("doc_id", "text").join(few, "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic")
    return toxicity(docs, learn)
