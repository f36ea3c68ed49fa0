"""Token counts and packing against the tokenizers library and brute force."""

import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, tokencount

TEXTS = [None, "", "hello world", "it's  \n\n two\t words<|endoftext|> <|endoftext|>x", "été 日本語 ᬋ 𝔸b 😀  a1 12b", "a" * 3000,
         "x y " * 4000, "hello world", " lead", "trail  ", "\x1f\x1ca \xa0b", "ͽ̈ Σας ΟΔΟΣ é", "a₄b ꟎c", "<|startoftext|>q"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, "hello world", "x"), (None, "no id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokencount.count_tokens(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("cell", [4, 10_000])
def test_pack_documents(docs, cell):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4"))
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cell=cell).collect()
    want = Counter((d, i // 2048, i, len(x[i:i + 2048]), zlib.crc32(x[i:i + 2048].tobytes())) for d, xs in ids.items() for x in xs for i in range(0, len(x), 2048))
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    if cell > 100:
        assert len(sequences) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_ids_come_along(docs):
    rows = packing.pieces_of(docs, public_tokenizers.path("word_bpe_49k.json"), 100, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_every_letter_before_a_sign():
    """Words end in each letter there is, then in signs; some letters become letter and mark, which joins the signs."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(0x30000)) if c.isalpha()]
    words = ["TATİLİ.", "TATİLİ,b", "\u09dc\u09dd).", *(f"ab{c}." for c in letters), *(f"{c}'s?!" for c in letters[::7])]
    ids, ends = packing.token_ids(pa.array(words), path)
    for w, lo, hi, e in zip(words, [0, *ends[:-1]], ends, t.encode_batch(words, add_special_tokens=False)):
        assert ids[lo:hi].tolist() == e.ids + [0], w


def test_words_are_tokenized_in_small_slices_and_one_thread(monkeypatch):
    """A worker's memory follows the slice and the library's threads: with 12 MB and a thread a core the pipeline went over its limit."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([f"{i} river, stone. " * 512 for i in range(1500)])], ["doc_id", "text"])
    sizes, plain = [], packing.token_ids
    monkeypatch.setattr(packing, "token_ids", lambda texts, path: sizes.append(sum(map(len, texts.to_pylist()))) or plain(texts, path))
    found = list(packing.tokenized(iter([batch]), public_tokenizers.path("word_bpe_49k.json")))
    assert [i for ids, _, _ in found for i in ids] == list(range(1500)) and all(len(flat) == 4 * ends[-1] for _, flat, ends in found)
    assert sum(sizes) == sum(map(len, batch.column(1).to_pylist())) and max(sizes) <= 4 << 20
    threads = """
import os, public_tokenizers
from tidemark.llm import packing
path = public_tokenizers.path("word_bpe_49k.json")
packing.load(path)
before = len(os.listdir("/proc/self/task"))
packing.encode_words([f"w{i}" for i in range(20_000)], path)
assert len(os.listdir("/proc/self/task")) == before
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("TOKENIZERS_", "RAYON_"))}
    subprocess.run([sys.executable, "-c", threads], check=True, env=env, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))


def fewest(sizes, capacity):
    best = len(sizes)
    for owner in product(*(range(i + 1) for i in range(len(sizes)))):
        room = Counter()
        for s, b in zip(sizes, owner):
            room[b] += s
        if max(room.values()) <= capacity:
            best = min(best, len(room))
    return best


def test_genetic_packing_is_near_the_best():
    rng = random.Random(5)
    for _ in range(12):
        sizes = [rng.randint(1, 20) for _ in range(7)]
        population = [packing.best_fit_decreasing(sizes, 20, rng) for _ in range(3)]
        for _ in range(4):
            population = packing.evolve(population, sizes, 20, rng)
        assert sorted(i for b in population[0] for i in b) == list(range(7))
        assert all(sum(sizes[i] for i in b) <= 20 for b in population[0])
        assert len(population[0]) == fewest(sizes, 20)


def test_crossover_improves_on_best_fit():
    rng = random.Random(2)
    sizes = [n for _ in range(120) for n in (lambda a, b: (a, b, 100 - a - b))(rng.randint(26, 36), rng.randint(26, 36))]
    start = packing.best_fit_decreasing(sizes, 100)
    population = [start] + [packing.best_fit_decreasing(sizes, 100, rng) for _ in range(2)]
    for _ in range(30):
        population = packing.evolve(population, sizes, 100, rng)
    assert packing.fitness(population[0], sizes, 100) > packing.fitness(start, sizes, 100)


def test_pack_refuses_what_never_fits(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(11, 1)], "length long, row long"), 10)
