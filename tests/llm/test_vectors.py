"""Bit-plane k-means and hard negatives against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import bitkmeans, negatives
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int"


def test_planes_and_popcounts():
    rng = np.random.default_rng(1)
    for top in (1, 2, 64, 1000, 2 ** 27):
        x, c = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (3, 64))
        p, q = bitkmeans.planes_of(x), bitkmeans.planes_of(c)
        assert (bitkmeans.values_of(p) == x).all() and (bitkmeans.squares(p) == (x * x).sum(1)).all()
        for i in range(3):
            assert (bitkmeans.dots(p, q[i]) == x @ c[i]).all()
    edge = np.array([[-4, 3] + [0] * 62])
    assert bitkmeans.planes_of(edge).shape == (1, 3) and (bitkmeans.values_of(bitkmeans.planes_of(edge)) == edge).all()
    assert bitkmeans.planes_of(np.zeros((2, 64), np.int64)).shape == (2, 1)


def slow_clusters(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) with plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    order = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        for c, vs in groups.items():
            centroids[c] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def test_clusters_of_the_table(spark):
    rows = table(spark, SF, "embeddings")
    got = Counter(tuple(r) for r in bitkmeans.cluster_vectors(rows).collect())
    assert got == slow_clusters([(r.vec_id, r.embedding) for r in rows.collect()])


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    one = [float(x) for x in rng.normal(size=64)]
    data = [(i, [float(x) for x in rng.normal(scale=10.0 ** (i % 4), size=64)], 1) for i in range(40)]
    data += [(50, one, 1), (51, one, None), (51, one, 2), (None, one, 3), (None, [0.0] * 64, 3), (60, None, 1), (61, [], 1), (62, one[:63], 1),
             (63, one + [1.0], 1), (64, [None] + one[1:], 1), (65, [float("nan")] + one[1:], 1), (66, one[:63] + [float("-inf")], 1), (67, [-0.0] * 64, 1)]
    rows = spark.createDataFrame(data, ROWS).withColumn("cluster", F.lit("own")).withColumn("planes", F.lit("own"))
    for k in (3, 16, 100):
        got = Counter(tuple(r) for r in bitkmeans.cluster_vectors(rows, k).collect())
        assert got == slow_clusters([(r.vec_id, r.embedding) for r in rows.collect()], k)
    assert bitkmeans.cluster_vectors(rows.limit(0)).count() == 0
    assert bitkmeans.cluster_vectors(rows.where("vec_id between 60 and 66")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        bitkmeans.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, 1)], ROWS)).collect()


def slow_negatives(rows, every=50):
    data = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            data.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, la, va in {x for x in data if x[0] % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(va, vb)), b, lb) for b, lb, vb in data if b != a)
        for s, p, lp in [x for x in scored if x[2] == la][:5]:
            hits = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, r + 1, n, -s, -m) for r, (m, n, _) in enumerate(hits)]
    return Counter(out)


def as_rows(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_negatives_of_the_table(spark):
    rows = table(spark, SF, "embeddings")
    want = slow_negatives([(r.vec_id, r.embedding, r.label) for r in rows.collect()])
    assert as_rows(negatives.hard_negatives(rows)) == want and len(want) > 100


def test_negatives_in_clusters_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    data = [(i, [float(x) for x in centres[i % 12] * (1 + 0.3 * rng.random()) + rng.normal(scale=0.4, size=16)], int(rng.integers(0, 10))) for i in range(900)]
    rows = spark.createDataFrame(data, ROWS)
    got = as_rows(negatives.hard_negatives(rows, 20, sample=300, fan=4, leaf=20, block_rows=40, block_anchors=3))
    assert got == slow_negatives(data, 20)


def test_elimination_leaves_out_leaves_and_loses_none():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (20, 8))
    data = (centres[rng.integers(0, 20, 3000)] + rng.integers(-60, 61, (3000, 8))).astype(np.int64)
    tree = negatives.fit(data[:500], 5, 20)
    leaf, passed = negatives._descend(tree, data)
    norms, ranges = (data * data).sum(1), {}
    for node, rows, d, at in passed:
        for j in set(at.tolist()):
            for i in range(d.shape[1]):
                n = norms[rows[at == j]]
                ranges[node.number, i, j] = (d[at == j, i].min(), d[at == j, i].max(), n.min(), n.max())
    anchors = data[:40]
    scores = negatives.products(anchors, data)
    top = np.sort(scores, 1)[:, -30]
    for lo, hi in ((top, np.full(40, negatives._FAR)), (top * 95 // 100 - 500, top * 95 // 100)):
        pairs = {(a, j) for rows, j in negatives._reachable(tree, ranges, anchors, lo.astype(float), hi.astype(float), np.arange(40)) for a in rows}
        need = {(a, leaf[b]) for a, b in zip(*np.nonzero((scores >= lo[:, None]) & (scores <= hi[:, None])))}
        assert need <= pairs and len(pairs) < 0.5 * 40 * tree.leaves


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    one = [float(x) for x in rng.normal(size=6)]
    data = [(i, [float(x) for x in rng.normal(size=6)], int(i % 3)) for i in range(60)]
    data += [(100, one, 1), (100, one, 1), (100, [2 * x for x in one], 1), (150, one, 2), (151, one, 1), (151, one, 1), (152, one, 1), (153, one, 2), (154, one, 2),
             (None, one, 1), (155, one, None), (156, None, 1), (157, [None] + one[1:], 1), (158, [float("nan")] + one[1:], 1), (159, [], 1), (160, one[:3], 2),
             (200, [0.0] * 6, 9), (-50, one, 1), (-7, [0.7 * x for x in one], 9), (250, one + [1.0], 1)]
    rows = spark.createDataFrame(data, ROWS).withColumn("score", F.lit("own")).withColumn("v", F.lit("own")).withColumn("leaf", F.lit("own"))
    assert as_rows(negatives.hard_negatives(rows, sample=40, fan=3, leaf=8, block_rows=16, block_anchors=2)) == slow_negatives(data)
    assert negatives.hard_negatives(rows.limit(0)).count() == 0
    assert negatives.hard_negatives(rows.where("vec_id between 1 and 40")).count() == 0
    assert negatives.hard_negatives(rows.where("vec_id = 159 or vec_id = 200")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        negatives.hard_negatives(spark.createDataFrame([(50, [1e20], 1)], ROWS)).collect()
