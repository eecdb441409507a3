"""Packing by lexical retrieval.

Documents are dealt to shards of bounded size by their rarest shared terms (see
``Deal``). A shard holds a BM25 inverted index of its documents, with document
frequencies and the mean length counted over the whole corpus. A seed fills its
window; where room is left, the seed's nearest unused documents in the shard follow,
scored by all its terms, as many as fill the window; documents that share no term
with it come last, in id order. Neighbours in other shards are not seen. What does
not fit seeds the next window, so every window but a shard's last is full, and the
last is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_counts, cut, map_rows, named, numbered, small, texts
from .shingles import column_word_numbers

WINDOW, END_ID = 2048, 1
#: Text bytes of a shard; terms are hashed to 2**TERM_BITS, which bounds the corpus counts.
SHARD_BYTES, TERM_BITS = 3_000_000, 18
K1, B = 1.2, 0.75
#: Neighbours that are sorted at once; the others are when these are used up.
FIRST = 16
#: Distinct chunks whose ids a worker remembers, besides those of one shard.
CACHE = 600_000
#: Pairs of terms that are broadcast at most (16 bytes each).
PAIRS = 200_000

#: ASCII signs that the tokenizer parts from letters before them; an apostrophe may begin a token with letters.
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)

#: What kind of byte each is; those of longer characters count as OTHER.
OTHER, BLANK, LETTER, SIGN = range(4)
_KINDS = np.array([BLANK if b == 32 or 9 <= b <= 13 else LETTER if chr(b).isalpha() and b < 128 else SIGN if b in SIGNS else OTHER for b in range(256)], np.uint8)

_HELD: dict[str, "Chunks"] = {}


class Parts:
    """The chunks between ASCII blanks of texts, A-Z folded, and which of them are the same.

    The tokenizer folds case, drops white space and looks at nothing across it, so
    the ids of a text are those of its chunks in order. Nor does a token reach from an
    ASCII letter to one of SIGNS, so chunks end there as well. Texts that may hold
    special tokens, which are told by case and have signs, are neither folded nor cut at signs.

    ``words`` are the distinct chunks, ``at`` numbers the chunks of all texts by
    them, and ``ends`` is where each text's chunks end.
    """

    def __init__(self, column: pa.Array):
        folded = [x if b"<|" in x else x.lower() for x in (x or b"" for x in texts(column))]
        joined = np.frombuffer(b" ".join([*folded, b""]), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in folded])
        kind = _KINDS[joined]
        parted = (kind[:-1] == LETTER) & (kind[1:] == SIGN)  # between a byte and the next one
        for i in [i for i, x in enumerate(folded) if b"<|" in x]:
            parted[ends[i] - len(folded[i]) - 1 : ends[i]] = False
        ink = kind != BLANK
        start = ink.copy()
        start[1:] &= parted | ~ink[:-1]
        self.ends = np.searchsorted(np.flatnonzero(start), ends)
        offsets = np.append(np.flatnonzero(start[ink]), ink.sum())  # the chunks, blanks left out
        chunks = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined[ink])]).dictionary_encode()
        bounds, flat = (x.to_pybytes() for x in chunks.dictionary.buffers()[1:])
        bounds = np.frombuffer(bounds, np.int64)[: len(chunks.dictionary) + 1].tolist()
        self.at, self.words = chunks.indices.to_numpy(), [flat[i:j] for i, j in itertools.pairwise(bounds)]


def _shown_bytes() -> np.ndarray:
    """How the tokenizer's model spells bytes: printable ones as themselves, the others from 256 on. Blanks, which part words here, stay."""
    shown = np.arange(256, dtype="<u4")
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    shown[hidden] = 256 + np.arange(len(hidden))
    shown[32] = 32
    return shown


_SPELT = _shown_bytes()
#: How a word is encoded: by the merges alone, among other words, or by itself.
PLAIN, ALIKE, APART = range(3)


def _way(word: bytes) -> int:
    """PLAIN for lower-case letters below U+0250, which no normal form changes; ALIKE for other letters.

    A capital may become a letter and a mark, which goes with the signs behind: such words are APART.
    """
    if word.isascii():
        return APART if not word.isalpha() else PLAIN if word.islower() else ALIKE
    text = word.decode()
    if not text.isalpha():
        return APART
    low = text.lower()
    if low == text and max(text) < "\u0250":
        return PLAIN
    return ALIKE if unicodedata.normalize("NFC", low).isalpha() else APART


class Chunks:
    """Token ids of chunks; what a worker has not seen is encoded in bulk.

    Chunks met lately are in ``young``, others in ``old``. When the young ones are
    CACHE / 2, they become the old ones, and chunks that nobody asked for since are forgotten.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> "Chunks":
        if path not in _HELD:
            _HELD[path] = cls(path)
        return _HELD[path]

    def _put(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember the ids of each word, which end at these places."""
        flat, at = ids.astype("<u4").tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            self.young[w] = flat[at:end]
            at = end

    def _plain(self, words: list[bytes]) -> None:
        """Encode lower-case words of Latin letters: normaliser and splitter leave them whole, so the merges alone decide."""
        merge, flat, ends = self.tokenizer.model.tokenize, [], []
        for w in _SPELT[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le").split(" ") if words else ():
            flat += [t.id for t in merge(w)]
            ends.append(len(flat))
        self._put(words, np.array(flat, np.int64), np.array(ends, np.int64))

    def _alike(self, words: list[bytes]) -> None:
        """Encode words of letters, a hundred as one text: each has one last piece, which the vocabulary marks."""
        groups = [words[i : i + 100] for i in range(0, len(words), 100)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                self._put(group, ids, ends)
            else:
                self._apart(group)

    def _apart(self, chunks: list[bytes]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False), strict=True):
            self.young[c] = np.array(e.ids, "<u4").tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        got = [*map(self.young.get, words)]
        missing = [k for k, x in enumerate(got) if x is None]
        new = []
        for k in missing:
            x = self.old.get(words[k])
            if x is None:
                new.append(k)
            else:
                got[k] = self.young[words[k]] = x
        if len(self.young) + len(new) > CACHE // 2:
            self.young, self.old = {}, self.young
        self.learn([words[k] for k in new])
        for k in new:
            got[k] = self.young[words[k]]
        return got

    def learn(self, new: list[bytes]) -> None:
        """Add the ids of chunks. A word and the signs behind it are never one token, so such chunks are put together from both."""
        ways, both = (set(), set(), set()), []
        for c in new:
            way = _way(c)
            if way == APART:
                word = c.rstrip(SIGNS)
                if word != c and word and (ahead := _way(word)) != APART:
                    signs = c[len(word) :]
                    both.append((c, word, signs))
                    if word not in self.young:
                        ways[ahead].add(word)
                    if signs not in self.young:
                        ways[APART].add(signs)
                    continue
            ways[way].add(c)
        plain, alike, apart = map(list, ways)
        self._plain(plain)
        for i in range(0, len(alike), 2000):
            self._alike(alike[i : i + 2000])
        for i in range(0, len(apart), 2000):
            self._apart(apart[i : i + 2000])
        for c, word, signs in both:
            self.young[c] = self.young[word] + self.young[signs]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column, with the end id."""
        parts = Parts(column)
        ids = [*self.ids(parts.words), np.array([END_ID], "<u4").tobytes()]
        at = np.insert(parts.at, parts.ends, len(parts.words))  # an end behind the chunks of each text
        taken = pa.array(ids, pa.large_binary()).take(pa.array(at))
        offsets = np.frombuffer(taken.buffers()[1], np.int64) >> 2
        flat = np.frombuffer(taken.buffers()[2], "<u4")[: offsets[len(at)]]
        return np.split(flat, offsets[1 + np.flatnonzero(at == len(parts.words))[:-1]])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Bm25:
    """An inverted index over hashed terms; ``idf`` and ``mean`` come from the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs])
        both, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) * len(idf) + np.concatenate(docs), return_counts=True)
        row, term = both // len(idf), both % len(idf)
        self.queries = np.split(term, np.searchsorted(row, np.arange(1, len(docs))))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / mean))
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def nearest(self, k: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with document k, best first; ties go to the earlier one."""
        t = self.queries[k]
        n = self.starts[t + 1] - self.starts[t]
        at = np.arange(n.sum()) + np.repeat(self.starts[t] - np.cumsum(n) + n, n)  # the postings of all its terms
        score = np.bincount(self.rows[at], self.weights[at], len(unused))
        score[~unused] = 0
        least = np.partition(score, -FIRST)[-FIRST] if len(score) > FIRST else 0  # few windows need more than the first ones
        for found in (np.flatnonzero((score > 0) & (score >= least)), np.flatnonzero((score > 0) & (score < least))):
            yield from found[np.argsort(-score[found], kind="stable")].tolist()


#: The rank of terms that do not count.
NEVER = np.iinfo(np.int64).max


class Deal:
    """Which shard a document goes to: that of its rarest shared term.

    ``df`` counts the documents of a term; a term is shared if two have it. Terms with
    few bytes share a shard, none is split. A term with more than ``room`` bytes is
    split by the second rarest term, and a pair that has more still goes to as many of
    the term's shards as it fills, by id.
    """

    def __init__(self, df: np.ndarray, room: int):
        self.df, self.room = df, room

    def keys(self, terms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rarest and the second rarest shared term of each text; -1 for none. Of equally rare ones the least term comes first."""
        df = self.df[terms]
        rank = np.where(df > 1, df * len(self.df) + terms, NEVER)
        some, sizes = np.diff(ends) > 0, np.diff(ends)
        out = []
        for again in (True, False):
            least = np.full(len(sizes), NEVER)
            if some.any():
                least[some] = np.minimum.reduceat(rank, ends[:-1][some])
            if again:
                rank[rank == np.repeat(least, sizes)] = NEVER
            out.append(np.where(least < NEVER, least % len(self.df), -1))
        return out[0], out[1]

    def plan(self, rows: DataFrame) -> DataFrame:
        """A table (t1, t2, id, size, ...) with the column shard. The driver gets one number for each of at most 2**TERM_BITS terms.

        The table of terms is broadcast, as it has that bound; that of the pairs grows with
        the corpus, and is broadcast only where it is counted to have at most PAIRS rows.
        """
        spark = rows.sparkSession
        found = rows.groupBy("t1").agg(F.sum("size").alias("size")).orderBy("t1").toPandas()
        loads = found["size"].to_numpy()
        hot = loads > self.room
        light = np.where(hot, 0, loads)
        base, parts = (np.cumsum(light) - light) // self.room, np.where(hot, -(-loads // self.room), 1)
        first = base.max(initial=0) + 1
        base[hot] = first + np.cumsum(parts[hot]) - parts[hot]
        terms = spark.createDataFrame(pd.DataFrame({"t1": found["t1"], "base": base, "parts": parts}), "t1 int, base long, parts long")
        out = rows.join(F.broadcast(terms), "t1")
        spread = F.lit(0)
        if hot.any():
            heavy = F.broadcast(terms.filter("parts > 1").select("t1"))
            many = F.ceil(F.sum("size") / self.room).cast("long").alias("many")
            pairs = cut(rows.join(heavy, "t1", "left_semi").groupBy("t1", "t2").agg(many).filter("many > 1"))
            out = out.join(F.broadcast(pairs) if small(pairs, PAIRS) else pairs, ["t1", "t2"], "left")
            spread = F.pmod(F.xxhash64("id"), F.coalesce("many", F.lit(1)))
        return out.withColumn("shard", F.col("base") + F.pmod(F.pmod(F.xxhash64("t2"), F.col("parts")) + spread, F.col("parts")))


def arrange(lengths: list[int], index: Bm25, window: int) -> list[int]:
    """The order in which documents follow each other: seeds, each with the neighbours that fill its window."""
    unused = np.ones(len(lengths), bool)
    out, seed, at, next_seed = [], None, 0, 0
    while len(out) < len(lengths):
        pick = None
        if seed is not None:
            pick = next(near, None)
        if pick is None:
            while not unused[next_seed]:
                next_seed += 1
            pick = next_seed
        unused[pick] = False
        out.append(pick)
        before, at = at, at + lengths[pick]
        if seed is None or at // window > before // window:  # it opens a window, and so seeds it
            seed, near = pick, filter(unused.__getitem__, index.nearest(pick, unused))
    return out


def pieces(lengths: list[int], order: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): a stream cut into windows, its rest into powers of two."""
    total = sum(lengths)
    ends = list(range(window, total + 1, window))
    done, rest = total - total % window, total % window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            done += 1 << bit
            ends.append(done)
    out, at, seq, begin = [], 0, 0, 0
    for d in order:
        start = 0
        while start < lengths[d]:
            take = min(lengths[d] - start, ends[seq] - at)
            out.append((d, start, take, seq, at - begin))
            start, at = start + take, at + take
            if at == ends[seq]:
                begin, seq = at, seq + 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit numbers).

    A null or blank text is its end id alone. Every row is packed, also where ids
    are missing or repeat; an empty table gives no pieces; other columns are ignored. ``tokenizer`` is a file's path that every
    executor can read (by default the installed package's).
    """
    path = tokenizer or default_tokenizer()
    rows, named_rows = numbered(docs, id_col, text_col)

    def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, ends = column_word_numbers(column)
        return (numbers >> np.uint64(64 - TERM_BITS)).astype(np.int64), ends

    def count(b: pa.RecordBatch):
        found, ends = terms(b.column(0))
        last, place = np.zeros(1 << TERM_BITS, np.int64), np.arange(len(found))
        once = np.zeros(len(found), bool)
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            last[found[x:y]] = place[x:y]
            once[x:y] = last[found[x:y]] == place[x:y]  # a term's last place in its text
        yield "df", found[once]
        yield "sums", np.repeat([0, 1], [len(found), b.num_rows])

    counts = bucket_counts(rows.select("v0"), count, TERM_BITS)
    df = counts.get("df", np.zeros(1 << TERM_BITS, np.int64))
    words, n = counts.get("sums", df)[:2].tolist()
    mean = max(1.0, words / max(1, n))
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))  # 1 MB
    deal = Deal(df, shard_bytes)
    held = docs.sparkSession.sparkContext.broadcast(deal)  # 2 MB

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = held.value.keys(*terms(b.column("v0")))
            size = pc.fill_null(pc.binary_length(b.column("v0")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t1, pa.int32()), pa.array(t2, pa.int32()), size], names=["id", "v0", "t1", "t2", "size"])

    keys = cut(map_rows(rows.select("id", "v0"), keyed, "id long, v0 string, t1 int, t2 int, size long"))
    dealt = deal.plan(keys).select("shard", "id", "v0")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        column = t.column("v0").chunk(0)
        ids = Chunks.of(path).encode(column)
        found, ends = terms(column)
        index = Bm25(np.split(found, ends[1:-1]), idf.value, mean)
        lengths = [len(x) for x in ids]
        got = pieces(lengths, arrange(lengths, index, window), window)
        names, base = t.column("id").to_pylist(), t.column("shard")[0].as_py() << 32
        parts = [ids[d][a : a + c] for d, a, c, _, _ in got]
        return pa.Table.from_arrays(
            [
                pa.array([names[d] for d, *_ in got], pa.int64()),
                pa.array([a for _, a, *_ in got], pa.int64()),
                pa.array([c for _, _, c, *_ in got], pa.int64()),
                pa.array([lengths[d] for d, *_ in got], pa.int64()),
                pa.array([base + s for *_, s, _ in got], pa.int64()),
                pa.array([o for *_, o in got], pa.int64()),
                pa.array([x.tobytes() for x in parts], pa.binary()),
            ],
            names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    out = dealt.groupBy("shard").applyInArrow(run, f"{id_col} long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return named(out, named_rows, id_col)
