"""Substring dedup over words by suffix automata of reference shards.

Each reference shard (see ``repeats``) is a suffix automaton that grows while its
regions are streamed in order. The state made for a word has a suffix link whose
length is that word's matching statistic: the longest run of words ending here
that also ends at an earlier place. A statistic of at least ``length`` words marks
a repeated window; overlapping windows join into maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, named, numbered, struct_lists, texts
from .repeats import removed_units, repeat_windows
from .shingles import WordHashes

LENGTH, GRAM = 20, 8


def matching_statistics(regions: list[list[int]]) -> list[list[int]]:
    """For each symbol of each region, how many symbols ending there also end earlier (earlier regions, or the same one).

    One automaton is grown over all regions; no match crosses their borders.
    """
    out = []
    goto: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    for region in regions:
        last, stats = 0, []
        for x in region:
            here = goto[last].get(x)
            if here is not None:  # last is the root or a whole match: a generalised step
                if size[here] == size[last] + 1:
                    last = here
                    stats.append(size[here])
                    continue
                clone = len(size)
                goto.append(goto[here].copy())
                size.append(size[last] + 1)
                link.append(link[here])
                link[here] = clone
                p = last
                while p >= 0 and goto[p].get(x) == here:
                    goto[p][x] = clone
                    p = link[p]
                last = clone
                stats.append(size[clone])
                continue
            cur = len(size)
            goto.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and x not in goto[p]:
                goto[p][x] = cur
                p = link[p]
            if p >= 0:
                q = goto[p][x]
                if size[q] == size[p] + 1:
                    link[cur] = q
                else:
                    clone = len(size)
                    goto.append(goto[q].copy())
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and goto[p].get(x) == q:
                        goto[p][x] = clone
                        p = link[p]
            stats.append(size[link[cur]])
            last = cur
        out.append(stats)
    return out


def _index(length: int):
    def run(units: list[bytes]) -> list[np.ndarray]:
        names: dict[bytes, int] = {}
        coded = [[names.setdefault(w, len(names)) for w in u.split()] for u in units]
        return [np.array(s[length - 1 :], np.int64) < length for s in matching_statistics(coded)]

    return run


def _slices(text: bytes):
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, **limits) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256.

    Words end at ASCII white space and are compared as they are. Null and blank
    texts have no words. Rows of one id are documents of their own, in the
    order of their texts' hashes; rows without an id come first; an empty table gives an
    empty result.
    """
    rows, names = numbered(docs, id_col, text_col)
    hashes = WordHashes()
    info = repeat_windows(rows, lambda t: hashes.of(t.split()), _slices, _index(length), length, gram, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {id_col: b.column(0), "n_words": [], "n_removed": [], "kept": [], "kept_sha256": []}
            for text, sent, kept in zip(texts(b.column(1)), struct_lists(b.column(2)), struct_lists(b.column(3)), strict=True):
                words = (text or b"").split()
                n = len(words)
                if len(sent[0]):
                    gone = removed_units(n, length, sent, kept)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(left)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            arrays = [out[id_col], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary()).cast(pa.string()), pa.array(out["kept_sha256"])]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    out = map_rows(rows.join(info, "id", "left").select("id", "v0", "sent", "kept"), run, f"{id_col} long, n_words long, n_removed long, kept string, kept_sha256 string")
    return named(out, names, id_col)
