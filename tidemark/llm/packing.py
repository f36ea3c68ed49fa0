"""Packing of documents into sequences by a grouping genetic algorithm.

Documents are tokenized and cut into pieces. Pieces shorter than a sequence are dealt into cells of bounded size; each cell is
worked by several islands, populations of packings that evolve apart. Crossover copies whole well-filled bins of one parent into
the other, takes out the bins that hold the same pieces, and puts the displaced pieces back by best fit. After each epoch an
island's best packing migrates to the next island of its cell; the best one of all islands is the result.
"""

from __future__ import annotations

import os
import random
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept, slices
from tidemark.llm.tokencount import load
from tidemark.session import written

MAX_TOKENS = 2048
#: Pieces per cell on average; a cell's packings are held in one task.
CELL = 16_384
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 2, 3, 3
#: Encoded words that a worker keeps; the store is emptied when full.
KEPT_WORDS = 150_000
#: Bytes of text that a worker tokenizes at a time.
SLICE_BYTES = 4 << 20


@lru_cache(4)
def _word_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a pre-token, in a vocabulary that marks these."""
    vocabulary = load(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return ends if ends.any() else None


def encode_words(words: list[str], path: str) -> dict[str, bytes]:
    """The ids of each word as little-endian unsigned 32-bit numbers.

    Words go to the library in long texts. Words of letters are single pre-tokens, whose ends the ids show; the others are parted
    by a special string, which the library splits off before anything else. The library works in the task's own thread: threads of
    its own would take cores that Spark gave to other tasks, and each keeps memory.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, ends = load(path), _word_ends(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    part = next(iter(special), None)
    out: dict[str, bytes] = {}

    def run(group: list[str], ids: np.ndarray, cuts: np.ndarray, skip: int) -> None:
        raw, begin = ids.tobytes(), 0
        for w, end in zip(group, (4 * cuts).tolist()):
            out[w] = raw[begin:end]
            begin = end + 4 * skip

    letters = [w for w in words if ends is not None and w.isalpha()]
    groups = [letters[i:i + 1000] for i in range(0, len(letters), 1000)]
    for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) == len(group):  # else a letter that this library does not know as one
            run(group, ids, cuts, 0)
    rest = [w for w in words if w not in out]
    joined = [w for w in rest if part is not None and not any(s in w for s in special)]
    groups = [joined[i:i + 1000] for i in range(0, len(joined), 1000)]
    for group, e in zip(groups, tokenizer.encode_batch_fast([part.join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        run(group, ids, np.append(np.flatnonzero(ids == special[part]), len(ids)), 1)
    alone = [w for w in rest if w not in out]
    for w, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
        out[w] = np.array(e.ids, "<u4").tobytes()
    return out


@lru_cache(1 << 17)
def _parts_at_sign(letter: str, path: str) -> bool:
    """Whether the tokenizer parts this letter from any ASCII sign behind it.

    It does not where its normalizer makes the letter end in a mark (capital I with dot, many Indic letters), or where it does not
    know the letter as one.
    """
    tokenizer = load(path)
    norm = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    return all(tokenizer.pre_tokenizer.pre_tokenize_str(norm(letter + sign))[-1][1][0] == len(norm(letter + sign)) - 1 for sign in string.punctuation)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each text's followed by id 0, and where each text ends.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its blank-separated words in order; and
    the ids of letters followed by ASCII signs are those of both parts, if it parts the last letter from a sign. Arrow splits and numbers the words; each distinct part is
    encoded once while it is stored.
    """
    store = kept("packing").setdefault(path, {})
    if len(store) > KEPT_WORDS:
        store.clear()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    stem = pc.utf8_rtrim(coded.dictionary, string.punctuation)
    last = pc.utf8_slice_codeunits(stem, -1).dictionary_encode()
    parted = pa.array([len(c) == 1 and c.isalpha() and _parts_at_sign(c, path) for c in last.dictionary.to_pylist()], pa.bool_())
    letters = pc.and_(pc.utf8_is_alpha(stem), parted.take(last.indices))
    tail = pc.if_else(letters, pc.struct_field(pc.extract_regex(coded.dictionary, "(?P<tail>[!-/:-@\\[-`{-~]*)$"), "tail"), "")
    stem, tail = pc.if_else(letters, stem, coded.dictionary).dictionary_encode(), tail.dictionary_encode()
    parts = stem.dictionary.to_pylist() + tail.dictionary.to_pylist()
    store.update(encode_words(list({w for w in parts if w not in store}), path))
    store[""] = b""
    ids_of = [store[w] for w in parts] + [b"\0\0\0\0"]
    starts = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids_of])])
    pool = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(ids_of), "<u4")))
    word = coded.indices.to_numpy()
    order = np.empty(2 * len(word), np.int64)  # each word's stem and tail, and the closing id behind each text
    order[0::2], order[1::2] = stem.indices.to_numpy()[word], tail.indices.to_numpy()[word] + len(stem.dictionary)
    ends = 2 * (lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()).astype(np.int64)
    found = pool.take(pa.array(np.insert(order, ends, len(parts))))
    text_ends = found.offsets.to_numpy()[ends + np.arange(1, len(ends) + 1)] - found.offsets[0].as_py()
    return found.flatten().to_numpy(), text_ends


def tokenized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, bytes, list[int]]]:
    """(doc_ids, ids, ends) of slices of SLICE_BYTES of text: all ids as bytes, and where each document's end, see ``token_ids``."""
    for batch in slices(batches, max_bytes=SLICE_BYTES):
        flat, ends = token_ids(batch.column(1), path)
        yield batch.column(0).to_pylist(), flat.tobytes(), ends.tolist()


def pieces_of(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, row (a number of the piece), and ids if asked for.

    Null texts are empty and have the closing id alone. ``row`` differs between rows of one run.
    """
    step = 4 * max_tokens
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for doc_ids, flat, ends in tokenized(batches, path):
            out: list[list] = [[] for _ in names]
            for doc_id, begin, end in zip(doc_ids, [0, *ends[:-1]], ends):
                ids = flat[4 * begin:4 * end]
                for piece, lo in enumerate(range(0, len(ids), step)):
                    part = ids[lo:lo + step]
                    values = [doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part), row, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None]
                    for column, value in zip(out, values):
                        column.append(value)
                    row += 1
            types = [pa.int64(), pa.int32(), *([pa.int64()] * 4), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids)


class Bins:
    """Bins under construction, with best fit in constant time: the room of bins indexed by amount, in use marked by bits."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _offer(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.mask |= 1 << r

    def open(self, items: list[int]) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - sum(self.sizes[i] for i in items))
        self._offer(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            size = self.sizes[i]
            fits = self.mask >> size
            if not fits:
                self.open([i])
                continue
            r = size + (fits & -fits).bit_length() - 1
            b = self.by_room[r].pop()
            if not self.by_room[r]:
                self.mask ^= 1 << r
            self.bins[b].append(i)
            self.room[b] = r - size
            self._offer(b)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven fill: full bins and one nearly empty beat even ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def best_fit_decreasing(sizes: list[int], capacity: int, rng: random.Random | None = None) -> list[list[int]]:
    noise = (lambda i: sizes[i] * (1 + 0.1 * rng.random())) if rng else sizes.__getitem__
    out = Bins(sizes, capacity)
    out.best_fit(sorted(range(len(sizes)), key=noise, reverse=True))
    return out.bins


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of b go into a; bins of a that hold the same pieces leave; their other pieces are put back by best fit."""
    full = sorted(b, key=lambda x: sum(sizes[i] for i in x), reverse=True)[:max(1, len(b) // 2)]
    injected = [x for x in full if rng.random() < 0.5] or full[:1]
    taken = {i for x in injected for i in x}
    out, displaced = Bins(sizes, capacity), []
    for x in injected:
        out.open(list(x))
    for x in a:
        if taken.isdisjoint(x):
            out.open(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    out.best_fit(sorted(displaced, key=lambda i: (-sizes[i], i)))
    return out.bins


def mutation(a: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others are dissolved and their pieces put back by best fit."""
    order = sorted(range(len(a)), key=lambda x: sum(sizes[i] for i in a[x]))
    gone = set(order[:max(1, len(a) // 100)]) | {rng.randrange(len(a)) for _ in range(max(1, len(a) // 50))}
    out = Bins(sizes, capacity)
    for x, items in enumerate(a):
        if x not in gone:
            out.open(list(items))
    out.best_fit(sorted((i for x in gone for i in a[x]), key=lambda i: (-sizes[i], i)))
    return out.bins


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, rng: random.Random, offspring: int = OFFSPRING,
           keep: int = POPULATION) -> list[list[list[int]]]:
    """One epoch of an island: offspring by crossover and mutation, the fittest stay, best first."""
    least = -(-sum(sizes) // capacity)
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for k in range(offspring):
        if -scored[0][0][0] <= least:  # no packing has fewer bins
            break
        a, b = scored[0][2], scored[rng.randrange(len(scored))][2]
        child = mutation(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng)
        scored.append((fitness(child, sizes, capacity), len(population) + k, child))
        scored = sorted(scored, key=lambda x: (x[0], -x[1]), reverse=True)[:keep]
    return [p for _, _, p in scored]


def _pack_bins(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out.tobytes()


def _unpack_bins(blob: bytes) -> list[list[int]]:
    of = np.frombuffer(blob, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(of))[:-1])]


_STATE = "cell long, island int, best boolean, sizes binary, bins binary"


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to pieces (columns length and row, a number of the piece, among others).

    ``pieces`` must give the same rows each time it is read: pass a written table. Every piece of length 1 to ``capacity`` gets
    one place; sequences never exceed ``capacity``. Pieces of full length take a sequence each and need no packing.
    """
    if pieces.where((F.col("length") < 1) | (F.col("length") > capacity) | F.col("length").isNull()).limit(1).count():
        raise ValueError("a piece is empty or longer than a sequence")
    columns = pieces.columns
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < capacity)
    cells = max(1, -(-part.count() // cell))
    items = part.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("row")["length"].tolist()
        number = int(pdf["cell"].iloc[0])
        out = []
        for island in range(islands):
            rng = random.Random(f"{number} {island} begin")
            population = [best_fit_decreasing(sizes, capacity)] + [best_fit_decreasing(sizes, capacity, rng) for _ in range(POPULATION - 1)]
            out += state(number, island, sizes, evolve(population, sizes, capacity, rng))
        return pd.DataFrame(out)

    def state(number: int, island: int, sizes: list[int], population: list) -> list[dict]:
        blob = np.array(sizes, np.int32).tobytes()
        return [{"cell": number, "island": island, "best": k == 0, "sizes": blob, "bins": _pack_bins(p, len(sizes))} for k, p in enumerate(population)]

    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        number, island = int(pdf["cell"].iloc[0]), int(pdf["island"].iloc[0])
        sizes = np.frombuffer(pdf["sizes"].iloc[0], np.int32).tolist()
        population = [_unpack_bins(b) for b in sorted(pdf["bins"])]
        return pd.DataFrame(state(number, island, sizes, evolve(population, sizes, capacity, random.Random(f"{number} {island} {len(pdf)}"))))

    populations = items.select("cell", "row", "length").groupBy("cell").applyInPandas(begin, _STATE)
    for _ in range(epochs):  # elites also go to the next island
        populations = written(populations, "islands")
        migrants = populations.where("best").withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        populations = populations.unionByName(migrants).groupBy("cell", "island").applyInPandas(epoch, _STATE)

    def place(key, items_of: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        mine = items_of.sort_values("row")
        sizes = mine["length"].tolist()
        bins = max((_unpack_bins(b) for b in sorted(states["bins"])), key=lambda p: fitness(p, sizes, capacity))
        sequence, offset = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 24) + b, at
                at += sizes[i]
        return pd.DataFrame({"row": mine["row"].to_numpy(), "sequence_id": sequence, "offset": offset})

    best = populations.where("best").select("cell", "bins")
    placed = items.select("cell", "row", "length").groupBy("cell").cogroup(best.groupBy("cell")).applyInPandas(place, "row long, sequence_id long, offset long")
    packed = part.join(placed, "row").select(*columns, "sequence_id", "offset")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the closing id alone. Repeated rows and rows without an id are packed one by one.
    Only documents longer than ``max_tokens`` are cut. Extra columns are ignored; an empty table gives an empty result.
    """
    pieces = written(pieces_of(docs, path, max_tokens), "pieces")
    return pack(pieces, max_tokens, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
