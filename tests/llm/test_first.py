"""Sharding, quality rules, exact deduplication and revisit records."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import exactdup, quality, sharding, warc

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a clashing extra column."""
    rows = [(1, "a b c", "en"), (2, None, None), (3, "", "x"), (3, "", "x"), (None, "a b c", "en"), (7, "long word " * 50_000, "en"),
            (8, "été \x1f naïve x", None), (9, None, "de"), (-5, "a b c", "en")]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("own")).withColumn("shard", F.lit("own"))


def test_sharding_law(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(ids, 16).collect()
    shards = Counter(r.shard for r in rows)
    assert set(shards) == set(range(16)) and max(shards.values()) < 1.2 * min(shards.values())
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert 900 < sum(r.grown_shard == 16 for r in rows) < 1500
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_movement_stays_in_changed_subtrees(spark):
    tree = sharding.standard_tree(16)
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else x.weight) for x in tree]
    place = {x.shard: x for x in tree}
    rows = sharding.assign(sharding.assign(ids, tree), heavier, column="after").collect()
    moved = [r for r in rows if r.shard != r.after]
    assert moved
    for r in moved:
        if place[r.shard].region == place[r.after].region:  # within the region only towards the rack whose weight grew
            assert place[r.after].rack == place[5].rack
            if place[r.shard].rack == place[r.after].rack:
                assert r.after == 5
        else:
            assert place[r.after].region == place[5].region
    with pytest.raises(ValueError):
        sharding.assign(ids, [])


def test_sharding_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (2, 9, 3):
            assert (r["size"], r.text_crc32) == (1, 0)
    long = next(r for r in rows if r.doc_id == 7)
    assert (long["size"], long.text_crc32) == (500_001, zlib.crc32(b"long word " * 50_000))
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def slow_base(text):
    """The counts of the contract, by their wording."""
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered)}


@pytest.mark.parametrize("text", [None, "", " \n\t", "a " * 30, "a b c d e f g h " * 3 + "x", "one\ntwo\none\n \n\none ", "é\x1fb c | #x",
                                  "a b c d e f g h z a b c d e f g h", "w " * 9])
def test_base_counts(text):
    assert quality.measure(text)[0] == slow_base(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(50):
        codes = rng.integers(0, 1 << quality.N_FEATURES, rng.integers(1, 8)).tolist()
        field = quality.Field(tuple(rng.normal(size=quality.N_FEATURES + 1)), tuple(rng.normal(size=4)))
        scores, move = field.scores(), field.move

        def total(path):
            return sum(scores[c] for c, y in zip(codes, path) if y) + sum(move[2 * a + b] for a, b in zip(path, path[1:]))
        paths = [[i >> k & 1 for k in range(len(codes))] for i in range(1 << len(codes))]
        assert abs(total(quality.viterbi(codes, scores.tolist(), move)) - max(map(total, paths))) < 1e-9


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    field = quality.fit(quality.fit_sample(docs, labels, 150))
    used = {r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(150).collect()}
    rows = quality.assess(docs, field).join(labels, "doc_id").collect()
    held = [r for r in rows if r.doc_id not in used and not r.base_failed]
    assert len(held) > 150 and sum(r.kept == bool(r.quality) for r in held) >= 0.97 * len(held)


def test_quality_odd_rows(spark, odd):
    rows = quality.quality_rules(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(r.n_words == 0 and r.base_failed and not r.kept for i in (2, 3, 9) for r in by[i])
    assert by[7][0].n_words == 100_000 and by[7][0].base_failed
    assert quality.quality_rules(odd.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        digests = np.frombuffer(rng.bytes(32 * n), np.uint8).reshape(-1, 32)
        displacements, slots = exactdup.build(digests)
        assert sorted(slots) == list(range(n))
        assert (exactdup.lookup(displacements, n, digests) == slots).all()


@pytest.mark.parametrize("history", ["doc_id < 4", "true", "false", "doc_id is null"])
def test_exact_dedup(spark, odd, history):
    rows = exactdup.exact_dedup(odd, F.expr(history)).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    want = Counter()
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, sha) for i in ids)
    assert Counter(tuple(r) for r in rows) == want


def test_exact_dedup_empty(spark, odd):
    none = odd.limit(0)
    assert exactdup.exact_dedup(none, exactdup.some_half()).count() == 0


def test_revisits(spark):
    schema = "record_id long, url string, captured_at long, kind string, headers array<struct<name:string,value:string>>, status string"
    h = lambda **x: [(k.replace("_", "-"), v) for k, v in x.items()]
    rows = [(1, "http://A.example/x/?utm_a=1&b=2&a=1#f", 10, "response", h(etag='"1"', content_type="text/html", age="1"), None),
            (2, "https://a.example:443/x?a=1&b=2", 20, "response", h(etag='"2"', content_length="9", age="1"), None),
            (3, "a.example/x?b=2&a=1", 20, "revisit", h(etag='W/"1"', content_type="x", age="7"), None),  # 2 is not earlier
            (4, "a.example/x?b=2&a=1", 500_000, "revisit", h(etag='"2"', content_length="0", age="9", via="p"), None),
            (4, "a.example/x?b=2&a=1", 500_000, "revisit", h(etag='"2"', content_length="0", age="9", via="p"), None),
            (5, "a.example/x?a=1&b=2", 500_000, "revisit", h(etag='"1"'), None),
            (6, "a.example/x?a=1&b=2", 500_000, "revisit", None, None), (7, None, 5, "revisit", h(etag='"1"'), None),
            (8, "a.example/x?a=1&b=2", None, "revisit", h(etag='"1"'), None), (9, "b.example/", 5, "revisit", h(last_modified="d"), None),
            (10, "b.example", 4, "response", h(last_modified="d"), None), (11, "b.example", 4, "request", None, None),
            (12, "b.example", 4, "response", h(last_modified="d", x="1"), None)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.record_id, r.status, r.resolved_id, tuple(sorted(map(tuple, r.headers or [])))) for r in warc.resolve(df, stretch=100).collect()}
    assert got == {(3, "resolved", 1, (("age", "7"), ("content-type", "text/html"), ("etag", 'W/"1"'))),
                   (4, "resolved", 2, (("age", "9"), ("content-length", "9"), ("etag", '"2"'), ("via", "p"))),
                   (5, "mismatch", None, ()), (6, "no_validator", None, ()), (7, "no_response", None, ()), (8, "no_response", None, ()),
                   (9, "resolved", 12, (("last-modified", "d"), ("x", "1")))}
    assert warc.resolve(df, stretch=100).count() == 8 and warc.resolve(df.limit(0)).count() == 0
    pay = spark.createDataFrame([(1, "one"), (12, "twelve")], "record_id long, payload string")
    assert {(r.record_id, r.payload) for r in warc.with_payload(warc.resolve(df), pay).collect()} >= {(3, "one"), (9, "twelve"), (5, None)}
