"""Exact deduplication against history, through a minimal perfect hash over the history's distinct digests.

The distinct digests of the history are dealt into buckets by their first bytes; each bucket gets a hash-and-displace
function that maps its n digests one to one to n slots. A slot holds the full digest and the locator of the winning row.
Incoming digests go to their bucket, are hashed to one slot and compared with the digest there byte by byte: equal means
a repeat of the history. The others are grouped among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import written

#: Digests per bucket on average: what one call builds or looks up at once.
PER_BUCKET = 2000
_INDEX = "bucket long, n int, displacements binary, digests binary, winners binary, counts binary"
_FOUND = "digest binary, keep_id long, n long, member boolean"


def _mix(words: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of digest words and seeds."""
    x = words ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _words(digests: np.ndarray) -> np.ndarray:
    """Digests of 32 bytes as rows of four unsigned 64-bit words; bucket choice uses the first, so the hashes use the others."""
    return np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)


def build(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and the slot of each of n distinct digests (n x 32 bytes): a minimal perfect hash of one bucket."""
    n = len(digests)
    w = _words(digests)
    groups = max(1, n // 3)
    group = (_mix(w[:, 1], 0) % np.uint64(groups)).astype(np.int64)
    displacements = np.zeros(groups, np.uint32)
    slots = np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        for g in np.argsort(-sizes, kind="stable"):
            if not sizes[g]:
                break
            members = order[ends[g] - sizes[g]:ends[g]]
            for d in range(1, 1 << 31):
                at = (_mix(w[members, 2] ^ w[members, 3], d) % np.uint64(n)).astype(np.int64)
                if free[at].all() and len(np.unique(at)) == len(at):
                    break
            displacements[g], slots[members] = d, at
            free[at] = False
    return displacements, slots


def lookup(displacements: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """The one slot that each digest can be in."""
    w = _words(digests)
    with np.errstate(over="ignore"):
        group = (_mix(w[:, 1], 0) % np.uint64(len(displacements))).astype(np.int64)
        return (_mix(w[:, 2] ^ w[:, 3], displacements[group].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _rows(pdf["digest"])
    displacements, slots = build(digests)
    back = np.argsort(slots)
    return pd.DataFrame([{
        "bucket": pdf["bucket"].iloc[0], "n": len(pdf), "displacements": displacements.tobytes(), "digests": digests[back].tobytes(),
        "winners": pdf["keep_id"].to_numpy(np.int64)[back].tobytes(), "counts": pdf["n"].to_numpy(np.int64)[back].tobytes()}])


def _look_up(key, incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(incoming):
        return pd.DataFrame(columns=["digest", "keep_id", "n", "member"])
    out = pd.DataFrame({"digest": incoming["digest"], "keep_id": incoming["keep_id"], "n": incoming["n"], "member": False})
    if len(index):
        row = index.iloc[0]
        digests = _rows(incoming["digest"])
        at = lookup(np.frombuffer(row["displacements"], np.uint32), int(row["n"]), digests)
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        member = (held[at] == digests).all(axis=1)
        winners, counts = np.frombuffer(row["winners"], np.int64)[at], np.frombuffer(row["counts"], np.int64)[at]
        out["keep_id"] = np.where(member, np.maximum(winners, out["keep_id"]), out["keep_id"])
        out["n"] = np.where(member, counts + out["n"], out["n"])
        out["member"] = member
    return out


def _groups(rows: DataFrame) -> DataFrame:
    """Distinct digests with winner and count; combined before the shuffle, so a hot digest is a few rows per task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    # a null keep_id (all its rows lack an id) travels as the smallest long
    head = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.withColumn("bucket", F.pmod(head, F.lit(buckets))).fillna({"keep_id": -(1 << 63)})


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of the history's distinct digests (``_groups``)."""
    return _bucketed(groups, buckets).groupBy("bucket").applyInPandas(_build_bucket, _INDEX)


def index_rows(index: DataFrame) -> DataFrame:
    """The slots of an index as rows: digest, keep_id, n."""
    def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                held = row.digests
                yield pd.DataFrame({"digest": [held[i:i + 32] for i in range(0, len(held), 32)],
                                    "keep_id": np.frombuffer(row.winners, np.int64), "n": np.frombuffer(row.counts, np.int64)})
    return index.mapInPandas(unpack, "digest binary, keep_id long, n long")


def probe(index: DataFrame, buckets: int, groups: DataFrame) -> DataFrame:
    """Distinct incoming digests (``_groups``): joint winner and count, and whether the history has them (byte-checked)."""
    new = _bucketed(groups, buckets)
    return new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, _FOUND)


def exact_dedup(docs: DataFrame, is_history) -> DataFrame:
    """One row per document: the row of its group that stays, the group's size, and whether it is the one.

    ``is_history`` (a column) marks the rows the index is built over; the others are looked up. Which rows are history has no
    influence on the result. Of equal texts the largest doc_id stays; of rows that also share the doc_id all count as kept,
    and rows without an id stay only in a group without any id. Null texts count as empty. Extra columns are ignored.
    """
    rows = docs.select("doc_id", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"), F.coalesce(is_history, F.lit(False)).alias("old"))
    history, incoming = written(_groups(rows.where("old")), "digests"), written(_groups(rows.where(~F.col("old"))), "digests_incoming")
    # both sides of a bucket are held at once, so the larger one decides, however few the other has
    buckets = max(1, -(-max(history.count(), incoming.count()) // PER_BUCKET))
    index = written(build_index(history, buckets), "digest_index")
    found = written(probe(index, buckets, incoming), "digests_found")
    repeats = found.where("member").select("digest", "keep_id", "n")
    alone = found.where(~F.col("member")).select("digest", "keep_id", "n")
    untouched = index_rows(index).join(repeats.select("digest"), "digest", "left_anti")
    groups = repeats.unionByName(alone).unionByName(untouched)
    keep = F.when(F.col("keep_id") != -(1 << 63), F.col("keep_id"))
    return (rows.select("doc_id", "digest").join(groups, "digest")
            .select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def some_half():
    """The condition for about half of the ids, by a hash: the history in the query and the pipeline."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
