"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

A document is the set of 64-bit hashes of its distinct word shingles. One permutation gives all bins: the hash's high bits
choose the bin and the smallest hash in a bin is its value; an empty bin takes the value of a filled one found along its own
sequence of probes. Bands of bins are bucket keys. In each bucket every document is paired with the smallest id, the hub, only, and links
are confirmed on the full sets. Where a bucket then still holds several components, the documents outside the hub's component are
compared with those of other components, each pair once, so that no link within a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.graph import components
from tidemark.session import written

#: Two documents of similarity 0.8 share no bucket with probability (1 - 0.8^ROWS)^BANDS, about 4e-8.
BANDS, ROWS = 56, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; A-Z lower-cased, words split at ASCII blanks.

    With fewer words the whole sequence is the one shingle; without words the set is empty. ``known`` keeps word hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        acc = mix(acc * _ODD + h[i:len(h) - size + 1 + i])
    return np.unique(acc)


def _probes(bins: np.ndarray, attempts: np.ndarray, k: int) -> np.ndarray:
    """The bin that each empty bin looks at in each attempt."""
    seed = (bins.astype(np.uint64)[:, None] << np.uint64(32)) + attempts.astype(np.uint64)
    return ((mix(seed * _ODD + np.uint64(1)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k bin values of a non-empty sorted set."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(k, np.uint64)
    filled = np.zeros(k, bool)
    out[bins[first]], filled[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~filled)
    source, attempt = out.copy(), 0
    while len(empty):
        at = _probes(empty, np.arange(attempt, attempt + 32), k)
        hit = filled[at]
        found = hit.any(axis=1)
        out[empty[found]] = source[at[found, hit[found].argmax(axis=1)]]
        empty, attempt = empty[~found], attempt + 32
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = values.reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        acc = mix(acc * _ODD + v[:, i])
    return acc.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, n_shingles, digest of the whole set and band keys (null for an empty set); ``docs`` as ``_keyed`` gives them."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            for batch in slices(batches, max_bytes=4 << 20):
                n, digests, keys = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, width, known)
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
                if len(known) > 100_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                                 ["doc_id", "key", "n_shingles", "digest", "keys"])
    return docs.select("doc_id", "text", "key").mapInArrow(sign, f"doc_id long, key {docs.schema['key'].dataType.simpleString()}, n_shingles long, digest binary, keys array<long>")


def _keyed(docs: DataFrame, key: Column | None) -> DataFrame:
    """doc_id, text and the column that tells apart the texts of one doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.xxhash64("text") if key is None else key).alias("key"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes with a number of their own, node: the smallest doc_id; where classes share it, all but one get a hash instead."""
    shared = written(classes.groupBy(F.col("first.doc_id").alias("_id")).agg(F.min("digest").alias("_owner"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared_ids")
    if shared.isEmpty():
        return classes.withColumn("node", F.col("first.doc_id"))
    told = classes.join(shared, F.col("first.doc_id") == F.col("_id"), "left")
    for salt in range(100):
        out = written(told.withColumn("node", F.when(F.col("_owner") != F.col("digest"), F.xxhash64("digest", F.lit(salt))).otherwise(F.col("first.doc_id")))
                      .drop("_id", "_owner", "_n"), "classes")
        if out.groupBy("node").count().where("count > 1").isEmpty():
            return out
    raise RuntimeError("no free numbers for classes")


#: 64-bit words of a set's bitmap. Large sets fill it, which only makes the bound weaker; with many more words the join's generated
#: method passes the size up to which the JVM compiles methods, and the join is many times slower.
_BITMAP = 12


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bins that the set's hashes are in, a bit each, as 64-bit words."""
    bins = hashes % np.uint64(64 * _BITMAP)
    words = np.zeros(_BITMAP, np.uint64)
    np.bitwise_or.at(words, (bins >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bins & np.uint64(63)))
    return words.view(np.int64)


def filled(bits: Column) -> Column:
    """How many bins are in use."""
    return F.aggregate(bits, F.lit(0), lambda n, w: n + F.bit_count(w))


def common_bins(u: Column, v: Column) -> Column:
    """How many bins two bitmaps share. Written out word by word: Spark takes lambda functions out of join conditions.

    Every further bin of u holds a hash that the other set does not have, so filled(u) less this many of u are not in v.
    """
    return reduce(lambda a, b: a + b, (F.bit_count(F.get(u, F.lit(i)).bitwiseAND(F.get(v, F.lit(i)))) for i in range(_BITMAP)))


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(node, hashes, bits): the sorted shingle hashes as bytes and their bitmap, of the rows (node, text, digest) whose set has that digest."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            for batch in slices(batches, max_bytes=4 << 20):
                found = [shingle_set(t, width, known) for t in batch.column(1).to_pylist()]
                sets = [x.tobytes() for x in found]
                own = [hashlib.blake2b(x, digest_size=16).digest() == d for x, d in zip(sets, batch.column(2).to_pylist())]
                if len(known) > 100_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array([bitmap(x) for x in found], pa.list_(pa.int64()))],
                                                 ["node", "hashes", "bits"]).filter(pa.array(own, pa.bool_()))
    return docs.select("node", "text", "digest").mapInArrow(gather, "node long, hashes binary, bits array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, texts=2, max_bytes=4 << 20):
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def across(crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) in buckets that are of different components and not with the hub; each pair in its first bucket only.

    Pairs whose bitmaps show that their sets have too little in common are left out by the join itself; no link is.
    """
    crowded = crowded.join(crowded.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")  # at most one key per band
    apart = crowded.where("component <> hub_component").select("key", F.col("node").alias("u"), F.col("n").alias("u_n"), F.col("component").alias("u_c"), F.col("keys").alias("u_keys"), F.col("bits").alias("u_bits"), F.col("rest").alias("u_rest"))
    others = crowded.where("node <> hub").select("key", F.col("node").alias("v"), F.col("n").alias("v_n"), F.col("component").alias("v_c"), F.col("keys").alias("v_keys"), F.col("bits").alias("v_bits"), F.col("rest").alias("v_rest"), "hub_component")
    first = F.col("key") == F.array_min(F.array_intersect("u_keys", "v_keys"))
    once = (F.col("u") > F.col("v")) | (F.col("v_c") == F.col("hub_component"))
    both = common_bins(F.col("u_bits"), F.col("v_bits")) + F.least(F.col("u_rest"), F.col("v_rest"))  # hashes in common, at most
    enough = 100 * both >= percent * (F.col("u_n") + F.col("v_n") - both)
    return (apart.join(others, "key").where((F.col("u_c") != F.col("v_c")) & _alike(F.col("u_n"), F.col("v_n"), percent) & once & first & enough)
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be linked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest linked doc_id), kept (it is that document).

    Null, empty and blank texts have an empty set and link with nothing. Rows that repeat a doc_id with other texts are linked each
    by its own text; where several of one component have its smallest doc_id, those of one text stay, the one with the smallest
    ``key`` (a column computed from the text, by default a hash of it; one that is given is carried to the result). Rows with the
    same id and text all count as kept. A row without an id links with nothing, has no component_id and stays. Extra columns are
    ignored; an empty table gives an empty result. Texts with equal sets are one class, whatever their number; only classes are
    compared.
    """
    texts = _keyed(docs, key)
    signed = written(signatures(texts, width, bands, rows), "signatures")
    live = signed.where("doc_id is not null and n_shingles > 0")
    classes = _numbered(written(live.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes"))
    rows_ = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = rows_.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(rows_.join(shared, "key").select("key", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), "size"), "members")
    stars = members.where((F.col("node") != F.col("hub")) & _alike(F.col("n"), F.col("hub_n"), percent)).select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    involved = classes.select("node", "digest", "first.doc_id", "first.key").join(members.select("node").distinct(), "node")
    sets = written(sets_of(texts.join(involved, ["doc_id", "key"]), width).dropDuplicates(["node"]), "sets")
    links = written(confirmed(stars, sets, percent), "links")
    linked = written(components(links), "components")

    # links between other documents than the hub, in buckets that still hold several components
    label = F.coalesce(F.col("component"), F.col("node")).alias("component")
    crowded = members.where("size > 2").join(linked, "node", "left").select("key", "node", "n", "hub", "size", label)
    mixed = crowded.groupBy("key").agg(F.max(F.when(F.col("node") == F.col("hub"), F.col("component"))).alias("hub_component"),
                                       F.min("component").alias("_a"), F.max("component").alias("_z")).where("_a <> _z").select("key", "hub_component")
    crowded = written(crowded.join(mixed, "key").join(sets.select("node", "bits", filled(F.col("bits")).alias("filled")), "node")
                      .withColumn("rest", F.col("n") - F.col("filled")), "crowded")
    more = written(confirmed(across(crowded, percent).distinct(), sets, percent), "links_across")
    if not more.isEmpty():
        linked = written(components(links.unionByName(more)), "components")

    # nodes are numbers only: the row that stays is the smallest (doc_id, key) of a component's classes
    group = classes.select("digest", "node", "first").join(linked, "node", "left")
    stays = group.where("component is not null").groupBy("component").agg(F.min("first").alias("_stays"))
    group = group.join(stays, "component", "left").select("digest", F.coalesce("_stays", "first").alias("_stays"))
    out = signed.select("doc_id", "key", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("digest")).alias("digest")).join(group, "digest", "left")
    kept = F.coalesce((F.col("doc_id") == F.col("_stays.doc_id")) & (F.col("key") == F.col("_stays.key")), F.lit(True))
    return out.select("doc_id", "n_shingles", F.coalesce("_stays.doc_id", "doc_id").alias("component_id"), kept.alias("kept"), *(["key"] if key is not None else []))


#: The links of op4 in SQL: all pairs that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
named AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM sh),
n AS (SELECT doc_id, count(*) AS n FROM named GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM named a JOIN named b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
least AS (SELECT node, min(seen) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, w.doc_id = coalesce(c, w.doc_id) AS kept
FROM words w LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = w.doc_id
"""
