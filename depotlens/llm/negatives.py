"""Hard negatives by maximum inner product, with a pivot table.

Each vector gets one more component, sqrt(M^2 - |x|^2) for the greatest norm M, and
an anchor gets 0 there: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a greater inner product is
a smaller distance. For every vector the distances to a few pivots are stored
once (the pivot table). By the triangle inequality the pivot distances of an anchor
and of a vector bracket their distance, hence their score. Vectors lie in small
blocks of similar pivot distances; an anchor opens a block only if the block's
bracket can reach what the anchor still needs, then brackets single vectors, and
computes the score of the survivors exactly, in whole numbers. Brackets get a margin,
so they only ever leave out what cannot count.

Both passes, for positives and for negatives, are one join: vectors are dealt to slabs
of bounded size by hash, anchors to chunks, and every slab meets every chunk in one
group (the stated query set against all rows, in blocks). A group gives at most k
rows for each of its anchors and wish; the best of all slabs come from a window
whose rank limit Spark pushes below the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, by_row, cut, map_rows
from .vectors import is_finite, whole_numbers

SCALE, POSITIVES, NEGATIVES, EVERY, LEAST, MOST = 256, 5, 10, 100, 30, 90
#: Pivots, and the rows they are chosen from (those with the least hash of their number). They affect the speed only.
PIVOTS, CHOICE = 8, 1024
#: Vectors of a slab and anchors of a chunk, at most about; slabs of a small table; vectors of a block.
SLAB, CHUNK, SLABS, BLOCK = 65_536, 4_096, 24, 256
#: Candidates that are held before the best of them are kept, and what brackets are trusted to.
HOLD, MARGIN = 1_000_000, 1e-9


class Pivots:
    """The pivots and the greatest squared norm: what turns inner products into distances."""

    def __init__(self, sample: np.ndarray, top: int, count: int):
        """Pivots far from each other: each is the sampled vector farthest from those before it."""
        self.top = top
        points = np.column_stack([sample, self.extra((sample**2).sum(1))])
        chosen, far = [0], ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(points)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
        self.points = points[chosen]

    def extra(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top - norms))

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = x.astype(float)
        last = np.zeros(len(x)) if anchors else self.extra((x**2).sum(1))
        return np.stack([np.sqrt(((x - p[:-1]) ** 2).sum(1) + (last - p[-1]) ** 2) for p in self.points], 1)

    def scores(self, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of anchors with these squared norms, whose distance lies between ``low`` and ``high``."""
        whole = norms + self.top
        slack = MARGIN * whole + 1
        return (whole - high**2) / 2 - slack, (whole - low**2) / 2 + slack


def bracket(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distance from pivot distances: of each anchor (rows) to what lies between ``low`` and ``high`` (columns)."""
    least, most = np.zeros((len(anchors), len(low))), np.full((len(anchors), len(low)), np.inf)
    for p in range(anchors.shape[1]):
        a = anchors[:, p, None]
        np.maximum(least, np.maximum(a - high[:, p], low[:, p] - a), out=least)
        np.minimum(most, a + high[:, p], out=most)
    return least, most


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; by floating point where it is exact."""
    size = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if 100 * size >= 2**63:
        raise OverflowError("an inner product of these vectors does not fit a long")
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if size < 2**53 else a @ b.T


class Best:
    """The k best candidates of each wish: greatest score first, then smallest id, then smallest row."""

    def __init__(self, wishes: int, k: int, floor: np.ndarray):
        self.k, self.need = k, floor.astype(float)  # a score below need cannot count any more
        self.parts, self.held = [], 0
        self.kept = np.empty((0, 4), np.int64)

    def add(self, wish: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(wish):
            self.parts.append(np.column_stack([wish, score, ids, rows]))
            self.held += len(wish)
            if self.held >= HOLD:
                self.settle()

    def settle(self) -> np.ndarray:
        x = np.concatenate([self.kept, *self.parts])
        x = x[np.lexsort((x[:, 3], x[:, 2], -x[:, 1], x[:, 0]))]
        first = np.searchsorted(x[:, 0], x[:, 0])
        x = x[np.arange(len(x)) - first < self.k]
        wish, count = np.unique(x[:, 0], return_counts=True)
        full = np.flatnonzero(count == self.k)
        self.need[wish[full]] = np.maximum(self.need[wish[full]], x[np.cumsum(count)[full] - 1, 1])
        self.kept, self.parts, self.held = x, [], 0
        return x


class Slab:
    """Vectors in blocks of similar pivot distances."""

    def __init__(self, pivots: Pivots, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, far: np.ndarray):
        own = far.argmin(1) if len(far) else np.empty(0, np.int64)
        order = np.lexsort((far[np.arange(len(far)), own], own))
        self.pivots, self.ids, self.rows, self.labels, self.x, self.far = pivots, ids[order], rows[order], labels[order], x[order], far[order]
        self.starts = np.arange(0, len(order), BLOCK)
        edges = lambda f: f.reduceat(self.far, self.starts) if len(order) else self.far
        self.low, self.high = edges(np.minimum), edges(np.maximum)
        self.exact = 0  # scores that were computed

    def survivors(self, q: np.ndarray, far: np.ndarray, bounds) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray]]:
        """(anchors, vectors, scores, open) of each block; ``open`` marks the pairs that brackets could not settle.

        ``bounds(settled)`` gives the least and the greatest score that each anchor has use for at the moment.
        """
        norms = (q.astype(float) ** 2).sum(1)
        least, most = bracket(far, self.low, self.high)
        low, high = self.pivots.scores(norms[:, None], least, most)
        nearest = high.argmax(1) if len(self.starts) else np.empty(0, np.int64)
        for early in (True, False):  # each anchor's most promising block first: it raises what the others must reach
            for b, start in enumerate(self.starts):
                need, limit = bounds(not early and not b)
                at = np.flatnonzero((high[:, b] >= need) & (low[:, b] <= limit) & ((nearest == b) == early))
                if not len(at):
                    continue
                part = slice(start, start + BLOCK)
                lo, hi = self.pivots.scores(norms[at, None], *bracket(far[at], self.far[part], self.far[part]))
                mask = (hi >= need[at, None]) & (lo <= limit[at, None])
                some = np.flatnonzero(mask.any(1))
                if len(some):
                    self.exact += int(mask.sum())
                    yield at[some], part, products(q[at[some]], self.x[part]), mask[some]


def positives_of(slab: Slab, q: np.ndarray, far: np.ndarray, q_rows: np.ndarray, q_labels: np.ndarray, k: int) -> np.ndarray:
    """(anchor, score, id, row) of the k best other vectors of each anchor's label."""
    out = [np.empty((0, 4), np.int64)]
    for label in np.unique(q_labels):
        mine, at = np.flatnonzero(q_labels == label), np.flatnonzero(slab.labels == label)
        part = Slab(slab.pivots, slab.ids[at], slab.rows[at], slab.labels[at], slab.x[at], slab.far[at])
        best = Best(len(mine), k, np.full(len(mine), -np.inf))
        everything = np.full(len(mine), np.inf)
        for anchors, where, score, open_ in part.survivors(q[mine], far[mine], lambda settled, b=best, e=everything: (settled and b.settle(), (b.need, e))[1]):
            open_ &= q_rows[mine[anchors], None] != part.rows[where]
            open_ &= score >= best.need[anchors, None]
            i, j = np.nonzero(open_)
            best.add(anchors[i], score[i, j], part.ids[where][j], part.rows[where][j])
            if best.held >= 4 * k * len(mine):
                best.settle()
        found = best.settle()
        found[:, 0] = mine[found[:, 0]]
        out.append(found)
        slab.exact += part.exact
    return np.concatenate(out)


def negatives_of(slab: Slab, q: np.ndarray, far: np.ndarray, q_labels: np.ndarray, wishes: np.ndarray, k: int, least: int, most: int) -> np.ndarray:
    """(wish, score, id, row) of the k best vectors of other labels for each wish (anchor, positive score), inside its range of scores."""
    anchor, goal = wishes[:, 0], wishes[:, 1]
    floor, limit = -(-least * goal // 100), most * goal // 100  # whole scores between them, these included
    best = Best(len(wishes), k, floor)
    order = np.argsort(anchor, kind="stable")
    places = np.split(order, np.searchsorted(anchor[order], np.arange(1, len(q))))  # the wishes of each anchor

    def bounds(settled: bool) -> tuple[np.ndarray, np.ndarray]:
        if settled:
            best.settle()
        need, top = np.full(len(q), np.inf), np.full(len(q), -np.inf)
        np.minimum.at(need, anchor, best.need)
        np.maximum.at(top, anchor, limit)
        return need, top

    for anchors, where, score, open_ in slab.survivors(q, far, bounds):
        open_ &= q_labels[anchors, None] != slab.labels[where]
        for n in range(max(map(len, places), default=0)):  # the n-th wish of each anchor that has one
            has = np.flatnonzero([len(places[a]) > n for a in anchors])
            if not len(has):
                break
            wish = np.array([places[a][n] for a in anchors[has]])
            fits = open_[has] & (score[has] >= best.need[wish, None]) & (score[has] <= limit[wish, None])
            i, j = np.nonzero(fits)
            best.add(wish[i], score[has[i], j], slab.ids[where][j], slab.rows[where][j])
        if best.held >= 4 * k * len(wishes):
            best.settle()
    return best.settle()


def _pivot_table(rows: DataFrame, width: int, pivots: Pivots) -> DataFrame:
    """Vectors as bytes, padded with zeros to one width, and their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = padded(b["vector"], width)
            pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b[ROW], b["vec_id"], b["label"], pack(x), pack(pivots.distances(x))], names=[ROW, "vec_id", "label", "x", "far"])

    return map_rows(rows, run, f"{ROW} long, vec_id long, label long, x binary, far binary")


def padded(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(column), width), np.int64)
    x[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return x


def _unpack(column: pd.Series, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def _blocks(table: DataFrame, slabs: int, chunks: int, anchors: DataFrame):
    """Vectors by slab, once for each chunk, and anchors by chunk, once for each slab, grouped to meet."""
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = table.withColumns({"slab": F.pmod(F.xxhash64(ROW), F.lit(slabs)).cast("int"), "chunk": copies(chunks)})
    right = anchors.withColumns({"chunk": F.pmod(F.xxhash64(ROW, F.lit(1)), F.lit(chunks)).cast("int"), "slab": copies(slabs)})
    return left.groupBy("slab", "chunk").cogroup(right.groupBy("slab", "chunk"))


def mine_negatives(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, pivots: int = PIVOTS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives.

    Anchors are the rows whose id ``every`` divides. Positives are an anchor's first
    rows of its label, negatives the first rows of other labels whose score is
    between ``least`` and ``most`` percent of the positive's; higher scores come
    first, ties by smaller id, then by row. Rows with a null id, label or vector and
    rows with a component that is null, infinite or not a number take no part. Vectors of different
    lengths are compared as if the shorter one ended in zeros. Repeated rows
    are rows of their own, so an anchor may have its own copy as a positive and a
    repeated anchor is answered each time. Other columns are not read. An empty table,
    a lone label or an anchor without positives gives no row. Scores that could
    exceed a long raise OverflowError.
    """
    kept = embeddings.filter(is_finite(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole_numbers(vector_col, scale).alias("vector"))
    rows, _ = by_row(kept, "vec_id", "vector", ("label",))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    count, width, top = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(norm)).first()
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return spark.createDataFrame([], schema)
    width = max(width, 1)
    sample = rows.orderBy(F.xxhash64(ROW), ROW).limit(CHOICE).select("vector").toArrow()["vector"].combine_chunks()
    guide = Pivots(padded(sample, width).astype(float), top, pivots)
    table = cut(_pivot_table(rows, width, guide))
    anchors = cut(table.filter(F.col("vec_id") % every == 0))
    slabs, chunks = max(SLABS, -(-count // SLAB)), max(1, -(-anchors.count() // CHUNK))

    def slab_of(df: pd.DataFrame) -> Slab:
        return Slab(guide, df["vec_id"].to_numpy(np.int64), df[ROW].to_numpy(np.int64), df["label"].to_numpy(np.int64), _unpack(df["x"], np.int64, width), _unpack(df["far"], float, len(guide.points)))

    def first(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor", "score", "id", "row"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names, dtype=np.int64)
        q, q_rows = _unpack(right["x"], np.int64, width), right[ROW].to_numpy(np.int64)
        out = positives_of(slab_of(left), q, guide.distances(q, True), q_rows, right["label"].to_numpy(np.int64), positives)
        out[:, 0] = q_rows[out[:, 0]]
        return pd.DataFrame(out, columns=names)

    def ranked(df: DataFrame, k: int, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    found = ranked(_blocks(table, slabs, chunks, anchors).applyInPandas(first, "anchor long, score long, id long, row long"), positives, "anchor")
    found = cut(found.withColumnRenamed("anchor", ROW).groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("goals")))  # at most ``positives`` to an anchor

    def second(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor", "goal", "score", "id", "row"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names, dtype=np.int64)
        q = _unpack(right["x"], np.int64, width)
        wishes = np.array([(i, s, n) for i, goals in enumerate(right["scores"]) for n, s in enumerate(goals)], np.int64).reshape(-1, 3)
        out = negatives_of(slab_of(left), q, guide.distances(q, True), right["label"].to_numpy(np.int64), wishes[:, :2], negatives, least, most)
        anchor = right[ROW].to_numpy(np.int64)[wishes[out[:, 0], 0]]
        return pd.DataFrame(np.column_stack([anchor, wishes[out[:, 0], 2], out[:, 1:]]), columns=names)

    asked = cut(anchors.join(found, ROW).withColumn("scores", F.col("goals")["score"]).select(ROW, "label", "x", "scores"))
    mined = ranked(_blocks(table, slabs, chunks, asked).applyInPandas(second, "anchor long, goal long, score long, id long, row long"), negatives, "anchor", "goal")
    named = anchors.select(F.col("vec_id").alias("anchor_id"), F.col(ROW).alias("anchor")).join(found.select(F.col(ROW).alias("anchor"), "goals"), "anchor")
    goal = F.element_at("goals", (F.col("goal") + 1).cast("int"))
    return mined.join(named, "anchor").select("anchor_id", goal["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), goal["score"].alias("positive_score"), F.col("score").alias("negative_score"))
