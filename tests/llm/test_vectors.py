import hashlib
import math
import random

import numpy as np
import pytest

from depotlens.llm import centroids, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cluster int, x int, _row_number int"


def table(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, l, "x", 7, 7, 7) for i, v, l in rows], SCHEMA)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows_with_everything(n=400, d=4, seed=3, labels=3):
    """Clusters, ties, repeats, copies of one vector, and every awkward row."""
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        m = middle[i % 6]
        v = [x + rng.gauss(0, 0.05) for x in m] if i % 3 else [0.5] * d
        rows.append((i, v, rng.randrange(labels)))
    rows += [rows[4], rows[4], rows[40]]  # repeated rows, an anchor among them
    rows += [(5, [0.25] * d, 1), (None, [0.5] * d, 1), (901, None, 1), (902, [], 0), (903, [None] * d, 1), (904, [float("nan")] * d, 1), (905, [float("inf")] * d, 1), (906, [0.1] * (d + 1), 2), (907, [0.0] * d, None), (1000, [9.0] * d, 2)]
    return rows


def plain_clusters(rows, k, rounds, d, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if finite(v) and len(v) == d]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    distance = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    for _ in range(rounds):
        own = [min(range(len(c)), key=lambda j: (distance(v, c[j]), j)) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, own, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, v in kept:
        j = min(range(len(c)), key=lambda j: (distance(v, c[j]), j))
        out.append((i, j, distance(v, c[j])))
    return sorted(out, key=str), c


@pytest.mark.parametrize("n,k,rounds,scale", [(400, 16, 3, 64), (400, 16, 6, 3), (60, 5, 2, 1000), (3, 16, 3, 64)])
def test_clusters_are_those_of_plain_rounds(spark, n, k, rounds, scale):
    rows = rows_with_everything(n) if n > 3 else rows_with_everything(60)[:n]
    want, c = plain_clusters(rows, k, rounds, 4, scale)
    got, found = centroids.cluster_vectors(table(spark, rows).repartition(5), clusters=k, rounds=rounds, dimensions=4, scale=scale)
    assert found == c
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want


def test_report_sums_up(spark):
    out = centroids.report(*centroids.cluster_vectors(table(spark, rows_with_everything()), dimensions=4)).collect()
    by = {}
    for r in out:
        by.setdefault(r.cluster, []).append(r)
    for mine in by.values():
        assert {r.cluster_inertia for r in mine} == {sum(r.distance for r in mine)} and len({r.centroid_sha256 for r in mine}) == 1
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}


def test_no_vectors_no_clusters(spark):
    for rows in ([], [(1, None, 1), (2, [0.5], 1), (3, [float("nan")] * 64, 0)]):
        got, found = centroids.cluster_vectors(table(spark, rows))
        assert found == [] and centroids.report(got, found).collect() == []


def test_vectors_too_large_for_a_long(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        centroids.cluster_vectors(table(spark, [(i, [3e30 * i] * 4, 0) for i in range(3)]), dimensions=4)[0].collect()


def test_groups_leave_out_most_distances():
    """On clustered vectors the bounds settle most of them; each assignment is the exact one."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-3000, 3000, (32, 16))
    x = middle[rng.integers(0, 32, 20000)] + rng.integers(-60, 60, (20000, 16))
    c = x[:32].copy()
    group = centroids.group_centroids(c)
    assert 1 < group.max() + 1 <= 8
    step = centroids.Yinyang(c, group)
    state, spent = step.first(x), []
    for _ in range(6):
        new = np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(32)])
        step = centroids.Yinyang(new, group, c)
        state, c = step.again(x, *state), new
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        spent.append(step.exact / d.size)
    assert spent[-1] < 0.1, spent


def plain_negatives(rows, every, positives, negatives, least, most, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if finite(v) and i is not None and lab is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, v, lab) in enumerate(kept):
        if i % every:
            continue
        scored = [(-dot(v, w), j, m, other) for m, (j, w, other) in enumerate(kept) if m != k]
        for s, j, _, _ in sorted(x for x in scored if x[3] == lab)[:positives]:
            fits = sorted(x for x in scored if x[3] != lab and least * -s <= 100 * -x[0] <= most * -s)
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("slab,chunk,block,hold,labels", [(65536, 4096, 256, 10**6, 3), (20, 3, 4, 50, 2), (64, 2, 7, 1, 12)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, slab, chunk, block, hold, labels):
    for name, value in (("SLAB", slab), ("CHUNK", chunk), ("BLOCK", block), ("HOLD", hold), ("SLABS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = rows_with_everything(labels=labels)
    want = plain_negatives(rows, 20, 5, 10, 30, 90, 256)
    got = negatives.mine_negatives(table(spark, rows).repartition(5), every=20)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want


def test_no_anchors_no_negatives(spark):
    rows = rows_with_everything()
    for some in ([], [(1, [0.5], 1)], [(100, [0.5], 1)], [(100, [0.5], 1), (7, [0.5], 1)], [(100, [0.5], 1), (7, [0.5], 2)], [(None, None, None)]):
        assert negatives.mine_negatives(table(spark, some)).collect() == []
    assert negatives.mine_negatives(table(spark, rows), least=95, most=90).collect() == []


def test_many_pivots_and_one(spark):
    rows = rows_with_everything(200)
    want = plain_negatives(rows, 20, 5, 10, 30, 90, 256)
    for pivots in (1, 3, 64):
        assert sorted(tuple(r) for r in negatives.mine_negatives(table(spark, rows), every=20, pivots=pivots).collect()) == want


def test_brackets_leave_out_most_scores():
    """On clustered vectors few scores are computed, and none that counts is left out."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16))
    middle = (8000 * middle / np.sqrt((middle**2).sum(1))[:, None]).astype(int)
    x = middle[rng.integers(0, 20, 20000)] + rng.integers(-60, 60, (20000, 16))
    q = x[:50]
    guide = negatives.Pivots(x[:500].astype(float), float((x.astype(float) ** 2).sum(1).max()), 8)
    rows, labels = np.arange(len(x)), np.zeros(len(x), np.int64)
    slab = negatives.Slab(guide, rows, rows, labels, x, guide.distances(x))
    got = negatives.positives_of(slab, q, guide.distances(q, True), rows[:50], labels[:50], 5)
    score = q @ x.T
    score[np.arange(50), np.arange(50)] = -(2**60)
    for i in range(50):
        best = np.lexsort((rows, -score[i]))[:5]
        assert got[got[:, 0] == i][:, 2].tolist() == best.tolist()
    assert slab.exact < 0.35 * score.size, slab.exact / score.size
