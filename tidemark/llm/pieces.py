"""SentencePiece encoding and decoding of the corpus through a relational lattice over its distinct words.

A word is a run of spaces (U+2581 to the model, plain spaces here) with the signs or the other characters that follow; no piece
crosses the border of two words, which is checked when the model is read. All substrings of a distinct
word up to the longest piece's length are exploded and joined to the piece table; the matches, grouped by word, are the edges of
its lattice, and a higher-order aggregate folds them into the best path. For a unigram model the fold is Viterbi over positions
with summed scores. A BPE model defines its best path by merges, not by sums: there the fold takes edges in order of score and
accepts an edge if it joins exactly two neighbours of the path so far. Should a merge make an edge possible that had its turn
already, or is a word longer than LONGEST, the word is encoded by the merge queue of ``merge_word`` instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from tidemark.llm.postings import NUMBERED_BYTES, asked, by_slice, distinct_terms, in_order, numbered, postings, sum_by_document
from tidemark.session import scratch_path

SPACE = "▁"
#: Characters of a word that the lattice takes: its positions are bits of one long.
LONGEST = 48
#: Pieces that are broadcast at most; the table of a larger model is joined by a shuffle.
BROADCAST_PIECES = 1_000_000
#: Characters of a piece by which its possible lengths are looked up before substrings are exploded.
HEAD_LENGTH = 3
#: Ids have 24 bits in an edge.
ID_MASK = (1 << 24) - 1
#: The bit of a fold's mask that says an edge came too late; boundaries are below it.
LATE = 1 << 62
_SIGNS = re.escape(string.punctuation)
_WORD = re.compile(f" *[{_SIGNS}]+| *[^{_SIGNS} ]+| +")
_WHOLE_WORD = re.compile(" *[^ ]+| +")


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file; pieces are written with plain spaces. ``mixing``: characters that stand next to an
    ASCII sign in some piece, other than signs and spaces."""
    pieces: dict[str, tuple[int, float]]
    byte_ids: dict[int, int]
    names: dict[int, str]
    unknown: int
    unigram: bool
    prefix: bool
    mixing: str = ""

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


@lru_cache(4)
def load(path: str) -> Model:
    """Read a model file: BPE or unigram, without normalization of its own."""
    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
        raise ValueError("only models with the identity normalizer are supported")
    kinds = proto.ModelProto.SentencePiece
    pieces = {p.piece.replace(SPACE, " "): (i, p.score) for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
    if any(" " in p.lstrip(" ") or (p.startswith("  ") and p.strip(" ")) for p in pieces):
        raise ValueError("a piece spans words")
    signs = set(string.punctuation)
    mixing = {x if y in signs else y for p in pieces for x, y in zip(p.strip(" "), p.strip(" ")[1:]) if (x in signs) != (y in signs)}
    return Model(pieces, {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}, {i: p.piece for i, p in enumerate(m.pieces)},
                 next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN), m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix,
                 "".join(sorted(mixing)))


class Words:
    """Splits a text into words as the model sees them."""

    def __init__(self, model: Model):
        self.prefix, self.mixing = model.prefix, model.mixing

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        text = (" " if self.prefix else "") + text.replace(SPACE, " ")
        whole = self.mixing and any(c in text for c in self.mixing)
        return (_WHOLE_WORD if whole else _WORD).findall(text)


def merge_word(word: str, model: Model) -> list[int]:
    """The BPE pieces of one word by a queue of merges: highest score first, then the leftmost."""
    parts: list[str | None] = list(word)
    n = len(parts)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0:
            found = model.pieces.get(parts[i] + parts[j])
            if found:
                heapq.heappush(queue, (-found[1], i, j, parts[i] + parts[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, joint = heapq.heappop(queue)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joint:
            continue
        parts[i], parts[j] = joint, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return ids_of([p for p in parts if p is not None], model)


def ids_of(parts: list[str], model: Model) -> list[int]:
    """Ids of the parts; a character without a piece becomes its UTF-8 bytes, or the unknown id in a model without bytes."""
    out = []
    for p in parts:
        if p in model.pieces:
            out.append(model.pieces[p][0])
        elif model.byte_ids:
            out += [model.byte_ids[b] for b in p.encode()]
        else:
            out.append(model.unknown)
    return out


def best_word(word: str, model: Model) -> list[int]:
    """The unigram pieces of one long word, by Viterbi."""
    least = min(s for _, s in model.pieces.values()) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + least, end - 1)]
        for start in range(max(0, end - model.longest), end):
            found = model.pieces.get(word[start:end])
            if found:
                options.append((best[start][0] + found[1], start))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    parts, end = [], len(word)
    while end:
        parts.append(word[best[end][1]:end])
        end = best[end][1]
    return ids_of(parts[::-1], model)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame([(p, i, s) for p, (i, s) in model.pieces.items()], schema)


def _bounded(table: DataFrame, model: Model) -> DataFrame:
    return F.broadcast(table) if len(model.names) <= BROADCAST_PIECES else table


def _late_able(model: Model) -> set[str]:
    """Pieces of a BPE model with a part that is merged after them: only their edges can become possible when their turn has passed."""
    rank = {p: score for p, (_, score) in model.pieces.items()}

    def later(p: str, part: str) -> bool:  # a longer part that is no piece never stands in a path; of equal scores the leftmost goes first
        return len(part) > 1 and part in rank and rank[part] <= rank[p]

    return {p for p in rank if any(later(p, p[:i]) or later(p, p[i:]) for i in range(1, len(p)))}


def _heads(spark: SparkSession, model: Model, least: int) -> DataFrame:
    """(head, lengths): for the first HEAD_LENGTH characters of longer pieces, the lengths that such pieces have, and all shorter ones
    from ``least``."""
    lengths: dict[str, set[int]] = {}
    for p in model.pieces:
        if len(p) >= HEAD_LENGTH:
            lengths.setdefault(p[:HEAD_LENGTH], set()).add(len(p))
    schema = T.StructType([T.StructField("head", T.StringType()), T.StructField("lengths", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame([(h, [*range(least, HEAD_LENGTH), *sorted(k)]) for h, k in lengths.items()], schema)


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(term, edges): the edges of each distinct word, sorted by score, start and end. Other columns of ``words`` are kept.

    Positions count from 1; e is behind the last character. For unigram models an edge is a struct (cost, s, e, id). For BPE it is a
    struct (x, ends, span) of longs: x is its order by score, start (6 bits), end (6 bits), whether it can come late (1 bit) and id
    (24 bits), ends has the bits of its two boundaries, span those from one to the other; single characters, which need no merge,
    have no edges there. Words over LONGEST have no edges. Only those substrings are exploded whose length some piece with
    the same first characters has; no piece is left out by that. The words are dealt by term
    already, and substrings stay with their word, so grouping them needs no further shuffle.
    """
    spark = words.sparkSession
    n, s, k = F.length("term"), F.col("s"), F.col("k")
    least = 1 if model.unigram else 2
    more = [c for c in words.columns if c != "term"]
    starts = words.select("term", *more, F.explode(F.when(n <= LONGEST, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(0)))).alias("s"))
    # the first start of a word carries its other columns, in a row (k = 1) that is there also without an edge
    starts = starts.select("term", "s", *(F.when(s <= 1, F.col(c)).alias(c) for c in more))
    headed = starts.withColumn("head", F.when(s > 0, F.substring("term", s, F.lit(HEAD_LENGTH)))).join(_bounded(_heads(spark, model, least), model), "head", "left")
    lengths = F.coalesce("lengths", F.array(*(F.lit(i) for i in range(least, HEAD_LENGTH))))
    if least > 1:
        lengths = F.when(s <= 1, F.concat(F.array(F.lit(1)), lengths)).otherwise(lengths)
    sized = headed.select("term", *more, "s", F.explode(lengths).alias("k")).where((s + k <= n + 1) | (k == 1))
    subs = sized.withColumn("piece", F.when((s > 0) & (k >= least), F.substring("term", s, k)))
    pieces = piece_table(spark, model)
    if not model.unigram:
        order = {score: i for i, score in enumerate(sorted({score for _, score in model.pieces.values()}, reverse=True))}
        late = _late_able(model)
        schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("code", T.LongType())])
        pieces = spark.createDataFrame([(p, order[score] << 37 | (p in late) << 24 | i) for p, (i, score) in model.pieces.items() if len(p) >= least], schema)
        x = F.col("code") + s.cast("long") * (1 << 31) + (s + k).cast("long") * (1 << 25)
        edge = F.when(F.col("code").isNotNull(), F.struct(x.alias("x"), (_bit(s) + _bit(s + k)).alias("ends"), (_bit(s + k + 1) - _bit(s)).alias("span")))
    else:
        edge = F.when(F.col("id").isNotNull(), F.struct((-F.col("score")).alias("cost"), "s", (s + k).alias("e"), "id"))
    joined = subs.join(_bounded(pieces, model), "piece", "left").withColumn("edge", edge).where("edge is not null or s <= 1 and k <= 1")
    kept = (F.first(F.when(k == 1, F.col(c)), ignorenulls=True).alias(c) for c in more)
    return joined.groupBy("term").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *kept)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _once(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once: a column mentioned inside a lambda is computed anew for each element."""
    return F.transform(F.array(x), use)[0]


def _merged(edges: Column, n: Column) -> Column:
    """The fold of a BPE lattice: a bit per boundary of the path, and LATE if an edge came too late."""
    def joins(mask: Column, x: Column) -> Column:  # both ends and just one boundary between
        return (F.bit_count(mask.bitwiseAND(x["span"])) == 3) & (mask.bitwiseAND(x["ends"]) == x["ends"])

    def folded(able: Column) -> Column:
        def step(mask: Column, x: Column) -> Column:
            def watched(after: Column) -> Column:
                return F.when(F.exists(able, lambda y: (y["x"] < x["x"]) & joins(after, y)), after.bitwiseOR(F.lit(LATE))).otherwise(after)
            return F.when(joins(mask, x), _once(mask - mask.bitwiseAND(x["span"]) + x["ends"], watched)).otherwise(mask)
        return F.aggregate(edges, _bit(n + 2) - F.lit(2), step)
    return _once(F.filter(edges, lambda x: x["x"].bitwiseAND(F.lit(1 << 24)) != 0), folded)


def _viterbi(edges: Column, n: Column, least: float) -> Column:
    """The fold of a unigram lattice over end positions: for each position the best score and where its last piece starts."""
    def step(best: Column, e: Column) -> Column:
        options = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.element_at(best, x["s"])["score"] - x["cost"]).alias("score"), (-x["s"]).alias("back")))
        skip = F.array(F.struct((F.element_at(best, e - 1)["score"] + F.lit(least)).alias("score"), (-(e - 1)).alias("back")))
        return F.concat(best, F.array(F.array_max(F.concat(options, skip))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))
    best = F.aggregate(F.sequence(F.lit(2), n + 1), first, step)
    # walk back from the end, collecting the boundaries as bits
    walk = F.aggregate(F.sequence(F.lit(1), n), F.struct((n + 1).alias("at"), _bit(n + 1).alias("mask")), lambda acc, _: F.when(
        acc["at"] > 1, F.struct((-F.element_at(best, acc["at"])["back"]).alias("at"), (acc["mask"] + _bit(-F.element_at(best, acc["at"])["back"])).alias("mask"))).otherwise(acc))
    return walk["mask"]


def _filled(terms: pa.Array, paths: pa.Array, model: Model) -> pa.Array:
    """Ids of words by their BPE paths (numbers of start, end and id, in order): what lies between two edges is single characters.
    A word without a path goes through the queue of merges."""
    flat, lengths = paths.flatten().to_numpy(), pc.fill_null(pc.list_value_length(paths), 0).to_numpy()
    covered = np.concatenate([[0], np.cumsum((flat >> 25 & 63) - (flat >> 31 & 63))])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    others = np.flatnonzero((np.diff(covered[offsets]) != pc.utf8_length(terms).to_numpy()) | paths.is_null().to_numpy(zero_copy_only=False))
    plain = pa.ListArray.from_arrays(pa.array(offsets), pa.array((flat & ID_MASK).astype(np.int32)))
    if not len(others):
        return plain
    mixed, some = [], pa.array(others)
    for term, path in zip(terms.take(some).to_pylist(), paths.take(some).to_pylist()):
        if path is None:
            mixed.append(merge_word(term, model))
            continue
        ids, at = [], 0
        for x in path:
            ids += ids_of(term[at:(x >> 31 & 63) - 1], model)
            ids.append(x & ID_MASK)
            at = (x >> 25 & 63) - 1
        mixed.append(ids + ids_of(term[at:], model))
    place = np.arange(len(terms))
    place[others] = len(terms) + np.arange(len(others))
    return pa.concat_arrays([plain, pa.array(mixed, pa.list_(pa.int32()))]).take(pa.array(place))


def encode_words(words: DataFrame, model: Model, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema: str = "") -> DataFrame:
    """(term, ids) of distinct words (column term, one row each). Other columns of ``words`` are kept.

    ``then`` makes rows of ``schema`` from the batches of that, in the same Python worker.
    """
    n = F.length("term")
    more = [c for c in words.columns if c != "term"]
    kinds = "".join(f", {c} {words.schema[c].dataType.simpleString()}" for c in more)
    edges = lattice(words, model)

    def along(mask: Column) -> Column:
        """The edges of a BPE path, those from boundary to boundary with none between, by their start."""
        path = F.filter("edges", lambda x: mask.bitwiseAND(x["span"]) == x["ends"])
        return F.when(mask < F.lit(LATE), F.sort_array(F.transform(path, lambda x: x["x"].bitwiseAND(F.lit((1 << 37) - 1)))))

    if not model.unigram:
        paths = edges.select("term", F.when(n <= LONGEST, _once(_merged(F.col("edges"), n), along)).alias("path"), *more)

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("term"), _filled(batch.column("term"), batch.column("path"), model), *(batch.column(c) for c in more)], ["term", "ids", *more])
        return paths.mapInArrow(lambda batches: then(filled(batches)), schema or f"term string, ids array<int>{kinds}")

    fold = _viterbi(F.col("edges"), n, min(s for _, s in model.pieces.values()) - 10)
    byte = sorted(model.byte_ids.items())
    byte_ids = F.array(*(F.lit(i) for _, i in byte)) if len(byte) == 256 else None

    def without_piece(s: Column, e: Column) -> Column:
        if byte_ids is None:
            return F.array(F.lit(model.unknown))
        raw = F.hex(F.substring("term", s, e - s).cast("binary"))
        return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.get(byte_ids, F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int")))

    def spelled(mask: Column) -> Column:
        """Ids of a unigram path, span by span."""
        def piece_ids(s: Column, e: Column) -> Column:
            found = F.transform(F.filter("edges", lambda y: (y["s"] == s) & (y["e"] == e)), lambda y: y["id"])
            return _once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(without_piece(s, e)))
        cuts = F.filter(F.sequence(F.lit(1), n + 1), lambda i: mask.bitwiseAND(_bit(i)) != 0)
        return _once(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda k: piece_ids(c[k], c[k + 1]))))

    done = edges.select("term", F.when(n <= LONGEST, _once(fold, spelled)).alias("ids"), *more)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            if ids.null_count:
                ids = pa.array([best_word(t, model) if i is None else i for t, i in zip(batch.column("term").to_pylist(), ids.to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("term"), ids, *(batch.column(c) for c in more)], ["term", "ids", *more])
    return done.mapInArrow(lambda batches: then(finish(batches)), schema or f"term string, ids array<int>{kinds}")


def decode(rows: DataFrame, key: str, model: Model, prefix: bool | None = None) -> DataFrame:
    """(key, text) of rows with an array column ids: pieces are looked up, put in order and joined, spaces restored.

    Byte pieces form UTF-8 text together with their neighbours; ids the model lacks, and control ids, give nothing. ``prefix``:
    whether one leading space goes, as the encoder added it (default: as the model says). Null and empty ids give an empty text.
    Rows must have distinct keys.
    """
    strip = model.prefix if prefix is None else prefix
    text = F.col("text")
    return _spelled(rows, key, model).select(key, (F.regexp_replace(text, "^ ", "") if strip else text).alias("text"))


def _spelled(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, text, n_pieces, id_sum) of rows with an array column ids, by a join of the ids with the piece table."""
    spark = rows.sparkSession
    known = {i: "".join(f"{b:02X}" for b in p.encode()) for p, (i, _) in model.pieces.items()} | {i: f"{b:02X}" for b, i in model.byte_ids.items()}
    table = spark.createDataFrame(list(known.items()), "id int, bytes string")
    joined = rows.select(key, F.posexplode_outer("ids").alias("at", "id")).join(_bounded(table, model), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("at", "bytes"))))
    return joined.groupBy(key).agg(parts.alias("parts"), F.count("id").alias("n_pieces"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum")).select(
        key, F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["bytes"]), "")), "UTF-8").alias("text"), "n_pieces", "id_sum")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) of every document, in order. Null and empty texts have no ids; keys must be distinct and not null.

    Needs a row per word of the corpus in one shuffle; where only counts are asked for, use ``piece_totals``.
    """
    model = load(path)
    split = Words(model)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([split(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], [key, "words"])

    kind = docs.schema[key].dataType.simpleString()
    words = docs.select(key, "text").mapInArrow(explode, f"{key} {kind}, words array<string>").select(key, F.posexplode_outer("words").alias("at", "term"))
    table = encode_words(distinct_terms(docs.select(F.lit(0).alias("doc_id"), "text"), split), model)
    return words.join(table, "term", "left").groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: F.coalesce(x["ids"], F.array().cast("array<int>")))).alias("ids"))


def encode_and_decode(docs: DataFrame, path: str, slice_bytes: int = NUMBERED_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pieces, id_sum, ids_crc32, text_sha256 and round_trip.

    Every document is encoded, and its ids are decoded: ids_crc32 is that of its ids in order as little-endian unsigned 32-bit
    numbers, text_sha256 that of the decoded text, and round_trip says that this text is the original (it is not where a text has
    U+2581, which decodes to a space). Null texts are empty. Rows that repeat an id or lack one are answered one by one. Extra columns are ignored; an
    empty table gives an empty result.

    Texts are read once. A slice of documents numbers its distinct words and is written; each distinct word of the corpus is encoded
    once and its ids go back to the slices that asked, where they meet the documents as sequences of numbers.
    """
    model = load(path)
    split, strip = Words(model), model.prefix
    spelled = [b""] * len(model.names)
    for known in ({i: p.encode() for p, (i, _) in model.pieces.items()}, {i: bytes([b]) for b, i in model.byte_ids.items()}):
        for i, raw in known.items():
            spelled[i] = raw
    rows, buckets = _by_bucket(numbered(docs, split, slice_bytes))
    answers = encode_words(asked(rows), model, by_slice, "slice long, answers binary")
    names = ["doc_id", "n_bytes", "n_pieces", "id_sum", "ids_crc32", "text_sha256", "round_trip"]
    types = [pa.int64()] * 5 + [pa.string(), pa.bool_()]

    def answer(rows: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        raws = pa.array(spelled, pa.large_binary())
        for head, ids, ends in in_order(rows):
            pool = raws.take(pa.array(ids))
            bounds = np.frombuffer(pool.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            data = pool.buffers()[2].to_pybytes() if len(ids) else b""
            for doc, lo, hi in zip(head, [0, *ends[:-1].tolist()], ends.tolist()):
                part = ids[lo:hi]
                raw = data[bounds[lo]:bounds[hi]]
                if strip and raw.startswith(b" "):
                    raw = raw[1:]
                digest = hashlib.sha256(raw)
                values = [int(doc["doc_id"]) if doc["has_id"] else None, int(doc["n_bytes"]), hi - lo, int(part.sum(dtype=np.int64)),
                          zlib.crc32(part.astype("<u4").tobytes()), digest.hexdigest(), digest.digest() == doc["sha256"].tobytes()]
                for column, value in zip(out, values):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    back = answers.repartition(buckets, "slice").groupBy("slice").agg(F.collect_list("answers").alias("answers"))
    met = rows.where("entries is not null").select("slice", "entries").join(back.hint("merge"), "slice", "left")
    return met.groupBy("slice").applyInArrow(
        answer, "doc_id long, n_bytes long, n_pieces long, id_sum long, ids_crc32 long, text_sha256 string, round_trip boolean")


def _by_bucket(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``numbered``, written to the shared scratch folder in buckets by slice, so that the documents need no shuffle to meet
    their answers; and the number of buckets."""
    spark = rows.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"numbered_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "slice").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name), buckets


def piece_totals(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pieces, id_sum (sum of its ids) and round_trip.

    Every distinct word of the corpus is encoded and decoded once; round_trip says that each word of the document came back as it
    was. Null and empty texts have no words. Rows that repeat an id or lack one are answered one by one. Extra columns are
    ignored; an empty table gives an empty result.
    """
    model = load(path)
    split = Words(model)
    encoded = encode_words(distinct_terms(docs, split), model)
    spelled = _spelled(encoded, "term", model)
    table = spelled.select("term", "n_pieces", "id_sum", (F.col("text") != F.col("term")).cast("long").alias("wrong"))
    out = sum_by_document(postings(docs, split), table, ["n_pieces", "id_sum", "wrong"])
    return out.select("doc_id", "n_bytes", "n_pieces", "id_sum", (F.col("wrong") == 0).alias("round_trip"))
