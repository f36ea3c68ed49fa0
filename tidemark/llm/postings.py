"""Packed postings: per-document term frequencies, joined to a per-term table and summed, without a row per document and term.

A slice of documents becomes one row per distinct term with a packed list of (place of the document in the slice, frequency).
These rows join a table with one row per term; the sums are gathered per slice before the last shuffle. One more row per slice
carries its document ids.

Where documents are to be put together again (``numbered``), a slice numbers its distinct terms: only terms and numbers go out, what
belongs to each number comes back (``by_slice``), and the texts as sequences of numbers move once, to meet it (``in_order``).
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Bytes of text in a slice, and documents in it (a place has 16 bits).
SLICE_BYTES, SLICE_DOCS = 24 << 20, 1 << 16
#: A posting is one number, 8 * (distance to the place before) + times; more than 7 times are several postings of one place.
_TIMES = 7
_HEAD = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("n_bytes", "<i8")])
_NAMES = ["term", "slice", "entries"]
_ORDERED = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("n_bytes", "<i8"), ("n_words", "<i8"), ("sha256", "u1", (32,))])
#: Bytes of text in a slice whose terms are numbered, and in a part of it: each part has a row with its documents.
NUMBERED_BYTES, PART_BYTES = 32 << 20, 4 << 20
#: A term's number has 28 bits; a slice's number is that of the task and 15 bits for the slice within it.
TERM_BITS, WITHIN_TASK = 28, 15
#: Answers that a worker gathers before it sorts them by slice.
HELD_ANSWERS = 1 << 18
#: Begins the term of a slice's head row; no term may begin so.
HEAD = "\0\0slice "
_TERMS = Callable[[str], Iterable[str]]


def _capped(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of slices: Arrow batches are gathered up to the byte bound or cut down to it."""
    ids, texts, held = [], [], 0
    for batch in slices(batches, max_bytes=slice_bytes):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if ids and (held + len(text) > slice_bytes or len(ids) == SLICE_DOCS):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text)
    if ids:
        yield ids, texts


def write_numbers(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2^28 in groups of seven bits, the high bit set but in the last; and the bytes that each takes."""
    lengths = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    out = np.zeros(int(lengths.sum()), np.uint8)
    at = np.cumsum(lengths) - lengths
    for k in range(4):
        more = lengths > k
        out[at[more] + k] = (values[more] >> (7 * k) & 127) | ((lengths[more] > k + 1) << 7)
    return out.tobytes(), lengths


def read_numbers(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a stream, and the position behind each."""
    b = np.frombuffer(stream, np.uint8)
    ends = np.flatnonzero(b < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    values = np.zeros(len(ends), np.int64)
    for k in range(4):
        more = starts + k < ends
        values[more] |= (b[starts[more] + k] & 127).astype(np.int64) << (7 * k)
    return values, ends


def distinct_terms(docs: DataFrame, terms: _TERMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The distinct terms of all texts (columns doc_id, text), one row each."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _capped(batches, slice_bytes):
            found: set[str] = set()
            for text in texts:
                found.update(terms(text))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["term"])
    return docs.select("doc_id", "text").mapInArrow(gather, "term string").distinct()


def postings(docs: DataFrame, terms: _TERMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (term, slice, entries) and, per slice, one head row: its term starts with HEAD, its entries are ids and byte counts."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _capped(batches, slice_bytes):
            named: dict[str, int] = {}
            owner, times, place = [], [], []
            for at, text in enumerate(texts):
                counts = Counter(terms(text))
                owner.append(np.fromiter((named.setdefault(t, len(named)) for t in counts), np.int64, len(counts)))
                times.append(np.fromiter(counts.values(), np.int64, len(counts)))
                place.append(np.full(len(counts), at, np.int64))
            terms_here = sorted(named)  # neighbours that look alike are cheaper to move
            rank = np.empty(len(named), np.int64)
            rank[[named[t] for t in terms_here]] = np.arange(len(named))
            owner, times, place = rank[np.concatenate(owner)] if owner else np.empty(0, np.int64), np.concatenate(times), np.concatenate(place)
            order = np.argsort(owner, kind="stable")
            owner, times, place = owner[order], times[order], place[order]
            if (times > _TIMES).any():
                parts = -(-times // _TIMES)
                owner, place = np.repeat(owner, parts), np.repeat(place, parts)
                full = np.full(len(owner), _TIMES, np.int64)
                full[np.cumsum(parts) - 1] = times - _TIMES * (parts - 1)
                times = full
            gaps = np.diff(place, prepend=0)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            gaps[first] = place[first]
            stream, lengths = write_numbers(8 * gaps + times)
            ends = np.cumsum(np.bincount(owner, lengths, len(named))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(named), [None, pa.py_buffer(np.concatenate([np.zeros(1, np.int32), ends])), pa.py_buffer(stream)])
            names = pa.array(terms_here, pa.string())
            for lo in range(0, len(named), 20_000):
                n = min(20_000, len(named) - lo)
                yield pa.RecordBatch.from_arrays([names.slice(lo, n), pa.array(np.full(n, number)), packed.slice(lo, n)], _NAMES)
            head = np.array([(i or 0, i is not None, len(t.encode())) for i, t in zip(ids, texts)], _HEAD)
            yield pa.RecordBatch.from_arrays([pa.array([f"{HEAD}{number}"]), pa.array([number]), pa.array([head.tobytes()], pa.binary())], _NAMES)
            number += 1
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "term string, slice long, entries binary")


def numbered(docs: DataFrame, terms: _TERMS, slice_bytes: int = NUMBERED_BYTES) -> DataFrame:
    """Rows (slice, first, terms, entries): of each slice its distinct terms, ``first`` the number of a row's first one, and a row with
    entries only, the parts of its documents with their terms' numbers in order. Frequent terms have small numbers.
    """
    schema = pa.schema([("slice", pa.int64()), ("first", pa.int32()), ("terms", pa.list_(pa.string())), ("entries", pa.list_(pa.binary()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << WITHIN_TASK
        last = number + (1 << WITHIN_TASK) - 1
        named: defaultdict[str, int] = defaultdict()
        named.default_factory = named.__len__
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            if number > last:
                raise ValueError("a task has too many slices")
            times = sum(np.bincount(owner, minlength=len(named)) for _, owner in parts)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(named), np.int64)
            rank[order] = np.arange(len(named))
            names = pa.array(list(named), pa.string()).take(pa.array(order))
            for lo in range(0, len(named), 20_000):
                some = names.slice(lo, 20_000)
                row = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lo], pa.int32()), row, pa.nulls(1, schema.field("entries").type)], schema=schema)
            entries = []
            for head, owner in parts:
                stream = write_numbers(rank[owner])[0]
                entries.append(np.array([len(head), len(stream)], "<i8").tobytes() + head.tobytes() + pa.compress(stream, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, schema.field("terms").type), pa.array([entries], schema.field("entries").type)], schema=schema)

        held = 0
        for ids, texts in _capped(batches, min(PART_BYTES, slice_bytes)):
            head, owner = np.zeros(len(ids), _ORDERED), []
            for at, (i, text) in enumerate(zip(ids, texts)):
                found = terms(text)
                owner.append(np.fromiter(map(named.__getitem__, found), np.int32, len(found)))
                raw = text.encode()
                head[at] = (i or 0, i is not None, len(raw), len(found), np.frombuffer(hashlib.sha256(raw).digest(), np.uint8))
                held += len(text)
            parts.append((head, np.concatenate(owner)))
            if held >= slice_bytes:
                yield from rows()
                number, held = number + 1, 0
                named.clear()
                parts.clear()
                pa.default_memory_pool().release_unused()
        if parts:
            yield from rows()
        # the worker stays for later tasks beside a JVM that needs the memory
        named.clear()
        parts.clear()
        pa.default_memory_pool().release_unused()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "slice long, first int, terms array<string>, entries array<binary>")


def asked(rows: DataFrame) -> DataFrame:
    """(term, who): each distinct term of ``numbered`` rows, with the slices that ask for it and its number in each, as one number."""
    listed = rows.where("terms is not null").select("slice", "first", F.posexplode("terms").alias("at", "term"))
    one = listed.select("term", (F.shiftleft("slice", TERM_BITS) + F.col("first") + F.col("at")).alias("who"))
    # a term is asked for once a slice: grouping within the task first would find hardly anything
    return one.repartition("term").groupBy("term").agg(F.collect_list("who").alias("who"))


def by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, answers) of batches with who and ids: the ids of the terms that a slice asked for, many in a row."""
    held: list[tuple[pa.Array, pa.Array]] = []

    def flush() -> pa.RecordBatch:
        who, ids = (pa.concat_arrays(x) for x in zip(*held))
        held.clear()
        row = np.repeat(np.arange(len(who)), pc.list_value_length(who).to_numpy())
        who = who.flatten().to_numpy()
        order = np.argsort(who)
        who, found = who[order], ids.take(pa.array(row[order]))
        counts = pc.list_value_length(found).to_numpy().astype(np.int64)
        flat, ends = found.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)])
        numbers, first = np.unique(who >> TERM_BITS, return_index=True)
        out = []
        for lo, hi in zip(first, [*first[1:], len(who)]):
            gaps = np.diff(who[lo:hi] & (1 << TERM_BITS) - 1, prepend=0)
            out.append(write_numbers(np.concatenate([[hi - lo], gaps, counts[lo:hi], flat[ends[lo]:ends[hi]]]))[0])
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(out, pa.binary())], ["slice", "answers"])

    total = 0
    for batch in batches:
        held.append((batch.column("who"), batch.column("ids")))
        total += len(batch.column("who").flatten())
        if total >= HELD_ANSWERS:
            yield flush()
            total = 0
    if total:
        yield flush()
    pa.default_memory_pool().release_unused()


def in_order(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one slice's row, the entries of ``numbered`` and the answers of ``by_slice``: for each part of its documents the head, the ids
    of all of them in order, and where each document ends."""
    ranks, counts, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for blob in rows.column("answers")[0].values or ():  # null where no document has a term
        found, _ = read_numbers(blob.as_buffer())
        n = found[0]
        ranks.append(np.cumsum(found[1:n + 1]))
        counts.append(found[n + 1:2 * n + 1])
        ids.append(found[2 * n + 1:])
    place = np.argsort(np.concatenate(ranks))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    answers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
    for blob in rows.column("entries")[0].values:
        blob = blob.as_buffer()
        n, size = np.frombuffer(blob, "<i8", 2).tolist()
        head = np.frombuffer(blob, _ORDERED, n, 16)
        words, _ = read_numbers(pa.decompress(blob[16 + n * _ORDERED.itemsize:], size, "zstd"))
        found = answers.take(pa.array(place[words]))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy().astype(np.int64))])
        yield head, found.flatten().to_numpy(), bounds[np.cumsum(head["n_words"])]
    pa.default_memory_pool().release_unused()


def sum_by_document(rows: DataFrame, table: DataFrame, values: list[str], held_slices: int = 64) -> DataFrame:
    """doc_id, n_bytes and the frequency-weighted sum of each value column of ``table`` (column term and the values), per document.

    ``rows`` are those of ``postings``. A term that the table lacks adds nothing. Sums are exact below 2^53. A frequent term has
    one row per slice; where these are many, Spark splits the skewed partition, as the join needs no order above it.
    """
    k = len(values)
    names = ["slice", "head", "entries"]
    entry = np.dtype([("place", "<u2"), ("sum", "<i8", (k,))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            packed = []
            for sums in held.values():
                at = np.flatnonzero(sums.any(axis=1))
                out = np.empty(len(at), entry)
                out["place"], out["sum"] = at, sums[at]
                packed.append(out.tobytes())
            n = len(packed)
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([False] * n), pa.array(packed, pa.binary())], names)
            held.clear()
            return batch

        for batch in batches:
            is_head = pc.starts_with(batch.column("term"), HEAD)
            heads = batch.filter(is_head)
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([heads.column("slice"), pa.array([True] * heads.num_rows), heads.column("entries")], names)
            batch = batch.filter(pc.invert(is_head))
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column("slice").to_numpy(), kind="stable")))
            entries = batch.column("entries")
            found, behind = read_numbers(b"".join(entries.to_pylist()))
            rows_end = np.searchsorted(behind, np.cumsum(pc.binary_length(entries).to_numpy()), side="right")
            lengths = np.diff(rows_end, prepend=0)
            gaps, times = found >> 3, found & 7
            run = np.cumsum(gaps)
            head = rows_end - lengths
            place = run - np.repeat(run[head] - gaps[head], lengths)
            weights = [np.repeat(pc.fill_null(batch.column(v), 0).to_numpy().astype(float), lengths) * times for v in values]
            numbers, first = np.unique(batch.column("slice").to_numpy(), return_index=True)
            cuts = np.append(head[first], len(found))
            for number, lo, hi in zip(numbers.tolist(), cuts[:-1], cuts[1:]):
                if number not in held:
                    if len(held) >= held_slices:
                        yield flush()
                    held[number] = np.zeros((SLICE_DOCS, k))
                for j, w in enumerate(weights):
                    sums = np.bincount(place[lo:hi], w[lo:hi])
                    held[number][:len(sums), j] += sums
        if held:
            yield flush()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(pdf.loc[pdf["head"], "entries"].iloc[0], _HEAD)
        sums = np.zeros((SLICE_DOCS, k), np.int64)
        for blob in pdf.loc[~pdf["head"], "entries"]:
            part = np.frombuffer(blob, entry)
            sums[part["place"]] += part["sum"]
        ids = pd.array(head["doc_id"], "Int64")
        ids[~head["has_id"]] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_bytes": head["n_bytes"]} | {v: sums[:len(head), j] for j, v in enumerate(values)})

    joined = rows.join(table.select("term", *(F.col(v).cast("long").alias(v) for v in values)), "term", "left")
    partial = joined.select("term", "slice", "entries", *values).mapInArrow(gather, "slice long, head boolean, entries binary")
    return partial.groupBy("slice").applyInPandas(finish, "doc_id long, n_bytes long, " + ", ".join(f"{v} long" for v in values))
