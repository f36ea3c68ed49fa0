"""Input columns that clash with working names, rows without ids, outlier ids, and the bounds that candidates are pruned by."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exactdup, neardup, pii, sharding

ODD = ["_id", "_mentions", "_found", "_digest", "_no_id", "id", "row", "digest", "found", "mentions", "done", "replaced", "a.b", "x y"]


def with_odd_columns(df):
    for c in ODD:
        df = df.withColumn(c, F.lit(f"mine {c}"))
    return df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))


def test_surrogates_keep_clashing_columns(spark):
    docs = with_odd_columns(spark.createDataFrame([(1, "Mail a.b@mail.example or Mr John Smith."), (2, "nothing"), (3, None)], "doc_id long, text string"))
    out = pii.pseudonymize(docs, "k", count="n")
    assert out.columns == [*docs.columns, "n"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r[c] == f"mine {c}" for r in rows.values() for c in ODD) and rows[1].m == {"k": 1}
    assert rows[1].n == 2 and "Smith" not in rows[1].text and (rows[2].text, rows[3].text) == ("nothing", None)


def test_dedup_stages_keep_clashing_columns(spark):
    words = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (2, words), (3, words + " more"), (None, "x y z"), (None, "x y z"), (4, None)], "doc_id long, text string")
    docs = with_odd_columns(docs)
    first = corpus_pipeline.without_copies(spark, docs, "")
    assert first.columns == docs.columns and Counter(r.doc_id for r in first.collect()) == Counter([2, 3, None, 4])
    second = corpus_pipeline.without_near_copies(spark, first, "")
    rows = second.collect()
    assert Counter(r.doc_id for r in rows) == Counter([2, None, 4])
    assert all(r[c] == f"mine {c}" for r in rows for c in ODD) and all(r.m == {"k": 1} for r in rows)


def test_exact_dedup_spreads_whatever_the_ids(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") == 0, -10 ** 12).when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    seen = []
    build = exactdup.build_index
    exactdup.build_index = lambda groups, buckets: (seen.append(buckets), build(groups, buckets))[1]
    try:
        assert exactdup.exact_dedup(docs, F.col("doc_id") < 0).count() == 30_000
    finally:
        exactdup.build_index = build
    assert seen == [15]


@pytest.mark.parametrize("n, base", [(1, 0), (2, 0), (3, 0), (7, 0), (15, 0), (16, 16), (17, 16), (31, 16), (32, 16), (33, 32), (40, 16)])
def test_one_more_shard_takes_rows_only_into_itself(spark, n, base):
    ids = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    now = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(ids, n, base=base).collect()}
    then = {r.doc_id: r.shard for r in sharding.shard_documents(ids, n + 1, base=base).collect()}
    assert all(grown in (shard, n) and grown == then[i] for i, (shard, grown) in now.items())


def test_a_base_is_whole_blocks():
    with pytest.raises(ValueError):
        sharding.standard_tree(15, base=16)
    with pytest.raises(ValueError):
        sharding.standard_tree(40, base=20)


def test_draws_equal_a_walk_over_the_levels(spark):
    """A plain descent with the same hash: on each level the child with the smallest weighted draw."""
    tree = [sharding.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3) for x in sharding.standard_tree(18, base=16)]
    ids = [*range(300), None, -7]
    got = {r.doc_id: r.shard for r in sharding.assign(spark.createDataFrame([(i,) for i in ids], "doc_id long"), tree).collect()}

    def draw(i, level, label, weight):
        bits = xxhash.xxh64_intdigest(f"{'' if i is None else i}|{level}|{label}", seed=42) >> 11
        return -math.log((bits + 0.5) / 2 ** 53) / weight
    for i in ids:
        leaves = tree
        for level, name in enumerate((lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard))):
            weights = Counter()
            for x in leaves:
                weights[name(x)] += x.weight
            best = min(weights, key=lambda label: draw(i, level, label, weights[label]))
            leaves = [x for x in leaves if name(x) == best]
        assert got[i] == leaves[0].shard


def test_bitmaps_bound_what_sets_share(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for i in range(300):
        n = int(rng.choice([1, 5, 60, 100, 130, 600, 3000]))
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        keep = a[rng.random(len(a)) < rng.random()]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2 ** 63, max(1, int(n * rng.random() * 0.4)), dtype=np.uint64)]))
        rows.append((i, neardup.bitmap(a).tolist(), neardup.bitmap(b).tolist()))
        want[i] = (len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    both = neardup.common_bins(F.col("a"), F.col("b"))
    got = {r.i: (r.x, r.y) for r in df.select("i", (neardup.filled(F.col("a")) - both).alias("x"), (neardup.filled(F.col("b")) - both).alias("y")).collect()}
    assert all(x <= want[i][0] and y <= want[i][1] for i, (x, y) in got.items())
    # and is near what hashes falling into free bins give: each one missed is seen unless its bin is in use
    bits = lambda words: sum(bin(w & (2 ** 64 - 1)).count("1") for w in words)
    free = {i: 1 - bits(b) / (64 * len(b)) for i, _, b in rows}
    close = [x / (want[i][0] * free[i]) for i, (x, _) in got.items() if want[i][0] > 20 and bits(rows[i][1]) < 150]
    assert len(close) > 20 and 0.8 < np.median(close) < 1.1
