"""Substring deduplication over words, with suffix automata of reference shards.

A window of 20 words has an anchor: of its 6-word shingles the one with the smallest hash, so equal windows have equal anchors.
The consecutive windows of a text with one anchor form a region of at most 34 words. Anchors that occur once in the corpus cannot
belong to a repeated window and go. Of equal regions only the earliest can hold a window for the first time; it is the reference.
References of anchors that have several are dealt by anchor into shards and streamed in order of place through the suffix
automaton of those before them: where the matching statistic reaches 20 words, the window also starts earlier, and its words are
removed. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.neardup import mix
from tidemark.session import written

WINDOW, ANCHOR = 20, 6
#: Regions per shard on average, and distinct regions of one anchor beyond which its windows are grouped instead.
PER_SHARD, PER_ANCHOR = 20_000, 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1


class Automaton:
    """A suffix automaton of word sequences, added one after another."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None:  # the sequence is known so far
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest added substring that ends there."""
        state = n = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            out.append(n)
        return out


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values, each made of the hashes of shorter runs."""
    by_size, size = {1: h}, 1
    while 2 * size <= width:
        by_size[2 * size] = mix(by_size[size][:-size] * _ODD + by_size[size][size:])
        size *= 2
    out, have = by_size[size], size
    for more in sorted(by_size, reverse=True):
        while have + more <= width:
            n = len(h) - have - more + 1
            out, have = mix(out[:n] * _ODD + by_size[more][have:have + n]), have + more
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


class Texts:
    """The words of a batch of texts as numbers, and the regions of their windows.

    ``regions``: document, first window, number of windows, anchor. Documents of fewer words than a window have none.
    """

    def __init__(self, texts: pa.Array, window: int, width: int):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        self.words, self.ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        real = np.array([w != "" for w in self.words], bool)[self.ids]  # blanks at an end of a text give an empty word
        self.offsets = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        self.ids = self.ids[real]
        self.window, empty = window, np.empty(0, np.int64)
        self.document = self.first = self.count = self.anchor = empty
        if len(self.ids) < window:
            return
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        shingle = grams(hashes[self.ids], width)
        # the place in the low bits makes the leftmost of equal hashes the smallest
        low = np.uint64(30)
        least = least_of((shingle >> low << low) | np.arange(len(shingle), dtype=np.uint64), window - width + 1)
        owner = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        start = np.flatnonzero(owner[:len(owner) - window + 1] == owner[window - 1:])
        at = (least[start] & np.uint64((1 << 30) - 1)).astype(np.int64)
        run = np.flatnonzero(np.diff(at, prepend=-1))
        self.document = owner[start[run]]
        self.first = start[run] - self.offsets[self.document]
        self.count = np.diff(np.append(run, len(at)))
        self.anchor = shingle[at[run]].view(np.int64)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _key():
    """The order of documents; rows without an id come last, by a hash of the text, so that equal texts share a place."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST) - F.xxhash64("text").bitwiseAND((1 << 61) - 1))


def anchor_rows(docs: DataFrame, window: int, width: int) -> DataFrame:
    """(key, anchors): the anchors of each document, one for each region."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, max_bytes=5 << 20):
                t = Texts(batch.column(1), window, width)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(t.document, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(t.anchor))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "anchors"])
    return docs.select(_key().alias("key"), "text").mapInArrow(find, "key long, anchors array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, key and the compressed text."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, texts=2):
            packed = [squeeze.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "key", "packed"])
    return docs.select(F.col("doc_id").cast("long"), _key().alias("key"), "text").mapInArrow(pack, "doc_id long, key long, packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches in parts of bounded size, each with its texts."""
    unsqueeze = zstandard.ZstdDecompressor()
    for whole in batches:
        for batch in slices(iter([whole]), texts=whole.schema.get_field_index(column), max_bytes=6 << 20):
            yield batch, pa.array([None if x is None else unsqueeze.decompress(x).decode() for x in batch.column(column).to_pylist()], pa.string())


_PLACES = pa.list_(pa.struct([("anchor", pa.int64()), ("region", pa.binary()), ("start", pa.int64()), ("n", pa.int32())]))


def _with_regions(texts: DataFrame, window: int, width: int, all_texts: bool) -> DataFrame:
    """Texts with the anchors that repeat: where no region is left, the finished digest, else the text and its regions."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n_words", "kept_sha256", "packed", "places"]
        with np.errstate(over="ignore"):
            for batch, plain in _unpacked(batches, "packed"):
                t = Texts(pc.if_else(pc.is_valid(batch.column("anchors")), plain, None), window, width)
                edges = np.searchsorted(t.document, np.arange(batch.num_rows + 1))
                n_words, sha, places, packed = [], [], [], []
                for d, (anchors, raw, text) in enumerate(zip(batch.column("anchors").to_pylist(), batch.column("packed").to_pylist(), plain.to_pylist())):
                    words, found = text.encode().split(), []
                    if anchors:
                        mine = slice(edges[d], edges[d + 1])
                        wanted = np.isin(t.anchor[mine], np.array(anchors, np.int64))
                        for h, first, n in zip(*(x[mine][wanted].tolist() for x in (t.anchor, t.first, t.count))):
                            found.append({"anchor": h, "region": _digest(b" ".join(words[first:first + n + window - 1])), "start": first, "n": n})
                    n_words.append(len(words))
                    places.append(found)
                    sha.append(None if found else hashlib.sha256(b" ".join(words)).hexdigest())
                    packed.append(raw if found or all_texts else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(sha, pa.string()),
                                                  pa.array(packed, pa.binary()), pa.array(places, _PLACES)], names)
    return texts.select("doc_id", "key", "packed", "anchors").mapInArrow(
        find, "doc_id long, key long, n_words long, kept_sha256 string, packed binary, places array<struct<anchor:long,region:binary,start:long,n:int>>")


def _with_words(references: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """References (region, key, start, n, anchor) with their words, read from the documents that hold them.

    A reference comes more than once if rows share its doc_id and text.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, plain in _unpacked(batches, "packed"):
            out = []
            for key, text, wanted in zip(batch.column("key").to_pylist(), plain.to_pylist(), batch.column("wanted").to_pylist()):
                words = text.encode().split()
                for r in wanted:
                    part = b" ".join(words[r["start"]:r["start"] + r["n"] + window - 1])
                    if _digest(part) == r["region"]:  # rows that share a doc_id may differ
                        out.append(r | {"key": key, "words": part.decode()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("region", pa.binary()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("words", pa.string())]))
    wanted = references.groupBy("key").agg(F.collect_list(F.struct("region", "start", "n", "anchor")).alias("wanted"))
    texts = found.where("size(places) > 0").select("key", "packed").join(wanted, "key").select("key", "packed", "wanted")
    return texts.mapInArrow(read, "region binary, key long, start long, n int, anchor long, words string")


def repeats_in(regions: list[str], window: int) -> list[int]:
    """For each region, in order of place, the windows that an earlier region has: bit i for the window at word i."""
    automaton, out = Automaton(), []
    for text in regions:
        words = text.split(" ")
        mask = 0
        for end, n in enumerate(automaton.statistics(words)):
            if n >= window:
                mask |= 1 << (end - window + 1)
        automaton.add(words)
        out.append(mask)
    return out


def _scan_shard(window: int):
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        # equal windows share an anchor, so the automaton of a shard is the union of one per anchor
        pdf = pdf.drop_duplicates("region").sort_values(["anchor", "key", "start"])
        masks: list[int] = []
        for _, part in pdf.groupby("anchor", sort=False):
            masks += repeats_in(part["words"].tolist(), window) if len(part) > 1 else [0]
        return pd.DataFrame({"region": pdf["region"], "mask": np.array(masks, np.int64)})
    return scan


def _grouped_windows(references: DataFrame, window: int) -> DataFrame:
    """The same masks for the regions of very frequent anchors: their windows are grouped, each keeps its earliest place."""
    words = F.split("words", " ")
    rows = references.select("region", "key", "start", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_join(F.slice(words, i, window), " "))).alias("at", "text"))
    rows = rows.select("region", (F.col("key")).alias("key"), (F.col("start") + F.col("at")).alias("place"), "at", F.sha2("text", 256).alias("text"))
    earliest = rows.groupBy("text").agg(F.min(F.struct("key", "place")).alias("least"))
    bit = F.when(F.struct("key", "place") > F.col("least"), F.expr("shiftleft(1L, at)")).otherwise(F.lit(0).cast("long"))
    return rows.join(earliest, "text").groupBy("region").agg(F.sum(bit).alias("mask"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, width: int = ANCHOR, per_shard: int = PER_SHARD, per_anchor: int = PER_ANCHOR,
                   with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), and them if asked for.

    A word is removed if a window of ``window`` words covers it whose words also start at a smaller doc_id, or earlier in the same
    document. Null and blank texts have no words. Rows that share a doc_id share its places, so they do not remove each other's
    windows at the same place; rows without an id come last, by a hash of their text, and equal ones share a place. Extra columns are ignored; an empty table gives an empty result.
    """
    anchors = written(anchor_rows(docs, window, width), "document_anchors").select("key", F.explode("anchors").alias("anchor"))
    repeated = written(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "repeated_anchors")
    wanted = (anchors.join(repeated, "anchor", "left_semi")  # both sides shuffled, so that a hot anchor's rows can be split
              .groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    found = written(_with_regions(_packed(docs).join(wanted, "key", "left"), window, width, with_text), "regions")
    places = found.where("size(places) > 0").select("key", F.explode("places").alias("r")).select("key", "r.*")
    references = written(places.groupBy("region").agg(F.min(F.struct("key", "start")).alias("least"), F.first("anchor").alias("anchor"), F.first("n").alias("n"))
                         .select("region", "least.key", "least.start", "anchor", "n"), "references")
    sizes = written(references.groupBy("anchor").agg(F.count(F.lit(1)).alias("regions")).where("regions > 1"), "anchors")
    crowd = sizes.where(F.col("regions") > per_anchor)
    several = sizes.agg(F.sum("regions")).first()[0] or 0
    shards = max(1, -(-several // per_shard))
    spoken = _with_words(references.join(sizes, "anchor", "left_semi"), found, window)
    dealt = lambda rows: (rows.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
                          .groupBy("shard").applyInPandas(_scan_shard(window), "region binary, mask long"))
    if crowd.isEmpty():
        masks = dealt(spoken)
    else:
        spoken = written(spoken, "reference_words")
        frequent = spoken.join(crowd, "anchor", "left_semi").dropDuplicates(["region"])
        masks = dealt(spoken.join(crowd, "anchor", "left_anti")).unionByName(_grouped_windows(frequent, window))
    own = (references.select("region", F.col("key").alias("key0"), F.col("start").alias("start0")).join(masks, "region", "left")
           .withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))))
    first = (F.col("key") == F.col("key0")) & (F.col("start") == F.col("start0"))
    removed = (places.select("key", "region", "start", "n").join(own, "region")
               .withColumn("mask", F.when(first, F.col("mask")).otherwise(F.expr("shiftleft(1L, n) - 1"))).where("mask <> 0")
               .groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("removed")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, plain in _unpacked(batches, "packed"):
            n_removed, sha, texts = [], [], []
            for n, known, text, masks in zip(batch.column("n_words").to_pylist(), batch.column("kept_sha256").to_pylist(), plain.to_pylist(), batch.column("removed").to_pylist()):
                gone, kept = 0, None
                if text is not None:
                    words = text.encode().split()
                    edge = np.zeros(n + 1, np.int64)
                    for r in masks or []:
                        for i in range(r["mask"].bit_length()):
                            # rows that share a doc_id may bring places that this text does not have
                            if r["mask"] >> i & 1 and r["start"] + i + window <= n:
                                edge[r["start"] + i] += 1
                                edge[r["start"] + i + window] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    kept = b" ".join([w for w, g in zip(words, covered.tolist()) if not g] if gone else words)
                n_removed.append(gone)
                sha.append(known if known is not None else hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    columns = ["doc_id", "n_words", "kept_sha256", "packed"]
    changed = found.where("size(places) > 0").join(removed, "key", "left").select(*columns, "removed").mapInArrow(apply, kind)
    same = found.where("size(places) = 0").select(*columns, F.lit(None).cast("array<struct<start:long,mask:long>>").alias("removed"))
    if with_text:
        return same.mapInArrow(apply, kind).unionByName(changed)
    return same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(changed.drop("kept_text"))


#: The same result in SQL, from all windows.
REPEATS_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, hash(list_slice(w, i, i + 19)) AS h, list_slice(w, i, i + 19) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
least AS (SELECT s, min({'d': doc_id, 'i': i}) AS m FROM windows GROUP BY s),
again AS (SELECT w.doc_id, w.i FROM windows w JOIN least l ON w.s = l.s WHERE {'d': w.doc_id, 'i': w.i} > l.m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(coalesce(ps, [])) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""
