"""Suffix-array dedup over bytes.

Each shard's array (see ``repeats``) is built by induced sorting in numpy: the
suffixes are classified, the leftmost-smaller (LMS) substrings are induced into
order and named, the names are sorted recursively, and the whole array is induced
from them bucket by bucket. Neighbours of the array that share a window are found in
text order, as permuted common prefixes are, a run of windows at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, named, numbered, struct_lists, texts
from .repeats import removed_units, repeat_windows
from .shingles import mix

LENGTH, GRAM = 100, 32


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, lms): whether each suffix is less than the next one, and the leftmost such of each run. t ends in a unique 0."""
    n = len(t)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))  # runs of one symbol share their class
    rises = np.append(t[start[1:]] > t[start[:-1]], True)
    smaller[:] = np.repeat(rises, np.diff(np.append(start, n)))
    return smaller, (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from the given order of the LMS suffixes."""
    seeds: list[np.ndarray] = [lms[:0]] * sigma
    order = np.argsort(t[lms], kind="stable")
    sorted_lms, symbols = lms[order], t[lms][order]
    bounds = np.searchsorted(symbols, np.arange(sigma + 1))
    for c in range(sigma):
        seeds[c] = sorted_lms[bounds[c] : bounds[c + 1]]
    kinds = t * 2 + smaller  # symbol and class in one read
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    less: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def pass_on(at: np.ndarray, want: bool, c: int, to: list[list[np.ndarray]]) -> np.ndarray:
        """Send the positions before ``at`` that are of the wanted class to their buckets; those of bucket c come back."""
        before = at[at > 0] - 1
        kind = kinds[before]
        wanted = (kind & 1) == want
        before, symbol = before[wanted], kind[wanted] >> 1
        rest = symbol != c
        own = before[~rest]
        before, symbol = before[rest], symbol[rest]
        if len(before):
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            edges = np.append(np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1]))), len(symbol))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                to[symbol[a]].append(before[a:b])
        return own

    for c in range(sigma):
        done = 0
        while done < len(larger[c]):  # a bucket grows while it is read, by runs of its own symbol
            at = np.concatenate(larger[c][done:])
            done = len(larger[c])
            own = pass_on(at, False, c, larger)
            if len(own):
                larger[c].append(own)
        pass_on(seeds[c], False, c, larger)
    for c in range(sigma - 1, -1, -1):
        done = 0
        while done < len(less[c]):
            at = np.concatenate(less[c][done:])
            done = len(less[c])
            own = pass_on(at, True, c, less)
            if len(own):
                less[c].append(own)
        if larger[c]:
            pass_on(np.concatenate(larger[c])[::-1], True, c, less)
    less[0] = [np.array([len(t) - 1], np.int32)]  # the end
    return np.concatenate([x for c in range(sigma) for x in (*larger[c], *(y[::-1] for y in reversed(less[c])))])


def sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a name sequence by their first ``depth`` names.

    Adjacent names are paired and the pairs named by rank, which halves the depth
    that is left, until the names are distinct or the depth is reached.
    """
    reach, rank = 1, names
    order = np.argsort(rank)
    while reach < depth and not (rank[order][1:] != rank[order][:-1]).all():
        follow = np.zeros_like(rank)
        if reach < len(rank):
            follow[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key)
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        rank, reach = new, reach * 2
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t by their first ``depth`` symbols at least. t: symbols from 1 and a final 0."""
    sigma = int(t.max()) + 1
    smaller, lms = classify(t)
    if len(lms) > 1:
        array = induce(t, smaller, lms, sigma)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        by = array[is_lms[array]]
        end = np.full(len(t), len(t) - 1, np.int32)
        end[lms[:-1]] = lms[1:]
        size = end[by] - by + 1
        same = size[1:] == size[:-1]
        live, k = np.flatnonzero(same), 0
        while len(live):  # adjacent LMS substrings of one length, symbol by symbol
            equal = t[by[live] + k] == t[by[live + 1] + k]
            same[live[~equal]] = False
            k += 1
            live = live[equal]
            live = live[size[live] > k]
        rank = np.cumsum(np.concatenate(([0], ~same)))
        names = np.empty(len(t), np.int64)
        names[by] = rank
        # an LMS substring moves on by two symbols at least
        lms = lms[sort_names(names[lms], depth // 2 + 1)]
    return induce(t, smaller, lms, sigma)


def shared_windows(text: bytes, array: np.ndarray, length: int) -> np.ndarray:
    """By text position: whether a suffix shares its first ``length`` bytes with the one before it in the array.

    As with permuted common prefixes, neighbours in the text are mostly neighbours of one earlier passage:
    where the last eight bytes agree on such a run, the windows of the run are settled by the
    last byte that differs in its first one.
    """
    n = len(array)
    before = np.full(n, -1, np.int32)
    before[array[1:]] = array[:-1]
    # eight bytes from each place on
    eights = np.ndarray((n + length,), "<u8", text + bytes(length + 16), strides=(1,))
    mask, tail = np.uint64(256 ** min(8, length) - 1), max(0, length - 8)
    live = np.flatnonzero(before >= 0)
    live = live[(eights[live + tail] ^ eights[before[live] + tail]) & mask == 0]
    other = before[live]
    head = np.flatnonzero(np.concatenate(([True], (live[1:] != live[:-1] + 1) | (other[1:] != other[:-1] + 1)))[: len(live)])
    last = np.full(len(head), -1)
    left, k = np.arange(len(head)), tail
    while k > 0 and len(left):
        k = max(0, k - 8)
        differ = eights[live[head[left]] + k] ^ eights[other[head[left]] + k]
        stop = np.flatnonzero(differ)
        last[left[stop]] = k + 7 - np.argmax(differ[stop].astype(">u8").view(np.uint8).reshape(-1, 8) != 0, axis=1)
        left = left[differ == 0]
    size = np.diff(np.append(head, len(live)))
    out = np.zeros(n, bool)
    out[live] = np.arange(len(live)) - np.repeat(head, size) > np.repeat(last, size)
    return out


def new_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, which of its windows start at no earlier place of the regions."""
    joined = b"\0".join(regions)  # a window holds no border, so what borders compare to is of no matter
    data = np.frombuffer(joined, np.uint8)
    symbol = np.cumsum(np.bincount(data, minlength=256) > 0).astype(np.int16)
    t = np.append(symbol[data], np.int16(0))
    starts = np.cumsum([0, *(len(r) + 1 for r in regions)])
    array = suffix_array(t, length)
    whole = np.zeros(len(t), bool)
    for s, r in zip(starts, regions, strict=False):
        whole[s : s + len(r) - length + 1] = True
    joins = shared_windows(joined, array, length)[array]
    inside = whole[array]
    at, group = array[inside], np.cumsum(~joins)[inside]
    first = np.zeros(len(t), bool)
    if len(at):
        first[np.minimum.reduceat(at, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))] = True
    return [first[s : s + len(r) - length + 1] for s, r in zip(starts, regions, strict=False)]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, **limits) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay), kept_sha256.

    Texts are UTF-8 bytes; null is empty. Rows of one id are documents of
    their own, in the order of their texts' hashes; rows without an id come first;
    an empty table gives an empty result.
    """
    rows, names = numbered(docs, id_col, text_col)
    index = lambda regions: new_windows(regions, length)
    info = repeat_windows(rows, lambda t: _BYTE[np.frombuffer(t, np.uint8)], lambda t: lambda a, b: t[a:b], index, length, gram, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {id_col: b.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for text, sent, kept in zip(texts(b.column(1)), struct_lists(b.column(2)), struct_lists(b.column(3)), strict=True):
                left, n, spans = text or b"", len(text or b""), 0
                if len(sent[0]):
                    gone = removed_units(n, length, sent, kept)
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n > 0 and gone[0])
                    left = np.frombuffer(left, np.uint8)[~gone].tobytes()
                for k, v in (("n_bytes", n), ("n_removed", n - len(left)), ("n_spans", spans), ("kept", left), ("kept_sha256", hashlib.sha256(left).hexdigest())):
                    out[k].append(v)
            kinds = (None, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([v if kind is None else pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    out = map_rows(rows.join(info, "id", "left").select("id", "v0", "sent", "kept"), run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return named(out, names, id_col)
