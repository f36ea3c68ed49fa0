"""Exact integer k-means by bit planes.

A vector of 64 integers is packed into planes: bit i of all its components, in two's complement, is one 64-bit word. With the plane
weights w (powers of two, the last one negative) the dot product of two vectors is the sum over pairs of planes of w_i * w_j *
popcount(X_i & C_j), and the squared distance |x|^2 + |c|^2 - 2 x.c follows exactly, without touching a component. Spark packs the
vectors once and keeps them as a table of planes; each round reads it, assigns by popcounts and sums per cluster in every task
before the shuffle. Only the centroids (k times 64 sums) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

SIZE = 64
#: Components at or beyond this size would take distances beyond a long (64 components of 2 ** 28, twice, squared).
TOO_LARGE = 1 << 28


def scaled(vector: Column, factor: int) -> Column:
    """The components times ``factor``, as doubles, rounded down to long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether the vector is there, has ``size`` components, and none is null, infinite or no number."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    right = vector.isNotNull() if size is None else F.coalesce(F.size(vector) == size, F.lit(False))
    return right & F.coalesce(finite, F.lit(False))


def planes_of(values: np.ndarray) -> np.ndarray:
    """(n, p) words of the p bit planes of (n, 64) integers, the last plane the sign; p is the least that holds all values."""
    widest = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
    p = widest.bit_length() + 1
    bits = ((values[:, None, :] >> np.arange(p)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights_of(p: int) -> np.ndarray:
    """The weights of p planes."""
    w = np.int64(1) << np.arange(p, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def values_of(planes: np.ndarray) -> np.ndarray:
    """The (n, 64) integers of (n, p) plane words."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("npd,p->nd", bits.astype(np.int64), weights_of(planes.shape[1]))


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of the vectors of plane words x (n, p) with one vector c (q): weighted popcounts of ANDed planes."""
    inner = np.zeros(len(x), np.int64)
    for j, w in enumerate(weights_of(len(c))):
        if c[j]:
            inner += w * (np.bitwise_count(x & c[j]).astype(np.int64) @ weights_of(x.shape[1]))
    return inner


def squares(x: np.ndarray) -> np.ndarray:
    """Dot products of each row of plane words with itself."""
    w = weights_of(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for i in range(len(w)):
        out += w[i] * (np.bitwise_count(x & x[:, i:i + 1]).astype(np.int64) @ w)
    return out


def nearest(x: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of plane words: the number of the nearest centroid, the smaller at ties, and the squared distance."""
    own = squares(x)
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for k, c in enumerate(centroids):
        d = own + squares(c[None, :])[0] - 2 * dots(x, c)
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def _planes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, plane words) of a batch of packed vectors, one pair per number of planes that occurs."""
    column = batch.column(batch.schema.get_field_index("planes"))
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]) // 8
    for p in np.unique(lengths):
        rows = np.flatnonzero(lengths == p)
        words = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), "<u8").reshape(len(rows), p)
        yield rows, words


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Columns vec_id and planes (binary) of rows with columns vec_id and values (array of ``size`` longs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            if (np.abs(values) >= TOO_LARGE).any():
                raise ValueError(f"a component is beyond {TOO_LARGE}; distances would not fit a long")
            packed = planes_of(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], ["vec_id", "planes"])
    return rows.select("vec_id", "values").mapInArrow(run, "vec_id long, planes binary")


def assign(packed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every packed vector with cluster (int) and distance (long, squared)."""
    c = [planes_of(np.array([x], np.int64))[0] for x in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, words in _planes(batch):
                cluster[rows], distance[rows] = nearest(words, c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return packed.select("vec_id", "planes").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_sums(packed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Per cluster that has vectors: their number and componentwise sums, exact. Summed per task first."""
    c = [planes_of(np.array([x], np.int64))[0] for x in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = np.zeros(len(c), np.int64), np.zeros((len(c), SIZE), np.int64)
            for rows, words in _planes(batch):
                at, _ = nearest(words, c)
                n += np.bincount(at, minlength=len(c))
                np.add.at(sums, at, values_of(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
                                             ["cluster", "n", "sums"])
    parts = packed.select("planes").mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(SIZE)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact)


def first_centroids(packed: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest hash of ``seed`` and id; equal ids by their values, rows without an id last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = packed.orderBy(order.asc_nulls_last(), F.col("planes")).limit(k).collect()
    return [values_of(np.frombuffer(r.planes, "<u8")[None, :])[0].tolist() for r in rows]


def update(centroids: list[list[int]], sums: DataFrame) -> list[list[int]]:
    """Each centroid that has vectors becomes their exact mean, rounded down; the others stay."""
    out = list(centroids)
    for r in sums.collect():  # at most one row per centroid
        out[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(SIZE)]
    return out


def cluster_vectors(rows: DataFrame, k: int = 16, rounds: int = 3, factor: int = 64, seed: str = "1") -> DataFrame:
    """Per vector: vec_id, cluster, distance, its cluster's and the whole inertia, and the digest of its final centroid.

    Takes columns vec_id and embedding. Vectors that are null or have not exactly 64 components, or a null or non-finite one, take no
    part. Repeated ids and vectors are rows of their own; rows without an id are assigned but start as centroids last. With fewer
    than k vectors there are as many centroids; an empty table gives an empty result. Ties go to the smaller number. Components of
    2 ** 28 and more after scaling are an error, as their distances would not fit a long. Other columns are ignored.
    """
    vector = F.col("embedding")
    values = rows.where(usable(vector, SIZE)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(vector, factor).alias("values"))
    packed = written(pack(values), "planes")
    centroids = first_centroids(packed, k, seed)
    for _ in range(rounds):
        centroids = update(centroids, cluster_sums(packed, centroids))
    assigned = written(assign(packed, centroids), "assigned")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(i, inertia[i], hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in inertia]
    by_cluster = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(d).cast("long").alias("d"), F.lit(h).alias("h")) for i, d, h in facts)) if facts else None
    if by_cluster is None:
        return assigned.select("vec_id", "cluster", "distance", *(F.lit(None).cast("long").alias(x) for x in ("cluster_inertia", "inertia")),
                               F.lit(None).cast("string").alias("centroid_sha256"))
    own = F.filter(by_cluster, lambda x: x["c"] == F.col("cluster"))[0]
    return assigned.select("vec_id", "cluster", "distance", own["d"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                           own["h"].alias("centroid_sha256"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (SELECT r, arg_min(c, (d, c)) AS c FROM (SELECT e.r, k.c, sum((e.x - k.x) * (e.x - k.x)) AS d FROM e JOIN c{i} AS k ON e.place = k.place GROUP BY e.r, k.c) AS p GROUP BY r),
m{i} AS (SELECT a.c, e.place, CAST(sum(e.x) AS BIGINT) AS s, count(*) AS n FROM a{i} AS a JOIN e ON a.r = e.r GROUP BY a.c, e.place),
c{i + 1} AS (SELECT k.c, k.place, coalesce((s - ((s % n) + n) % n) // n, k.x) AS x FROM c{i} AS k LEFT JOIN m{i} AS m ON k.c = m.c AND k.place = m.place),"""


CLUSTERS_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT r, vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) AS place FROM v),
good AS (SELECT r FROM u GROUP BY r HAVING count(*) FILTER (WHERE f IS NULL OR NOT isfinite(f)) = 0),
e AS (SELECT r, vec_id, place, CAST(floor(64 * CAST(f AS DOUBLE)) AS BIGINT) AS x FROM u WHERE r IN (SELECT r FROM good)),
s AS (SELECT r, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT DISTINCT r, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM e) AS o ORDER BY h LIMIT 16),
c0 AS (SELECT s.c, e.place, e.x FROM s JOIN e ON s.r = e.r),{_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
d AS (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT e.r, k.c, sum((e.x - k.x) * (e.x - k.x)) AS d FROM e JOIN c3 AS k ON e.place = k.place GROUP BY e.r, k.c) AS p GROUP BY r),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS digest FROM c3 GROUP BY c)
SELECT v.vec_id, CAST(d.c AS INTEGER) AS cluster, CAST(d.d AS BIGINT) AS distance, CAST(sum(d.d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d.d) OVER () AS BIGINT) AS inertia, h.digest AS centroid_sha256
FROM d JOIN v ON d.r = v.r JOIN h ON d.c = h.c
"""
