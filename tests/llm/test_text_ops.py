"""Pieces, near-duplicates, repeated passages and surrogates against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import graph, neardup, pieces, pii, substring
from tidemark.llm.queries import LLM_QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, component_id string, text2 string"
EMPTY = [None, "", " \n\t "]


def table(spark, texts, extra=()):
    rows = [(i, t, "c", "x") for i, t in enumerate(texts)] + [(i, t, "c", "x") for i, t in extra]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    texts = [None, "", " ", "  a", "a ", "\n", "a\tb", "▁a", "ﬁ① x", "m².x, (a)b.c ²²..", "--(x)!!y", "x" * 300, "     many    spaces  ", "日本語😀" * 30, "thetheatre of ints \x00",
             *("".join(rng.choice("  etaoinshr▁dlu.é") for _ in range(rng.randint(1, 60))) for _ in range(60)), "word " * 20_000]
    df = table(spark, texts)
    encoded = pieces.encode_documents(df, MODEL)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert all(got[i] == sp.encode(t or "") for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in pieces.decode(encoded, "doc_id", pieces.load(MODEL)).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in enumerate(texts))
    doubled = df.unionByName(table(spark, [], [(3, "  a"), (None, "hello you")]))
    rows = Counter((r.doc_id, r.n_pieces, r.id_sum, r.round_trip) for r in pieces.piece_totals(doubled, MODEL).collect())
    ids = [(r.doc_id, sp.encode(r.text or "")) for r in doubled.collect()]
    assert rows == Counter((d, len(x), sum(x), True) for d, x in ids)
    assert pieces.piece_totals(df.limit(0), MODEL).count() == 0


def test_documents_are_encoded_and_decoded(spark):
    """Ids in order, the decoded text and the round trip of whole documents, against the library."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", " ", "b a", "a b", "▁a", " ▁ a", "日本語😀 x\n\ty", "the word " * 3000, "a.b (c) m²."]
    df = table(spark, texts, [(3, "a b"), (3, "a b"), (None, "no id"), (None, "▁")]).repartition(3)

    def wanted(text):
        ids = sp.encode(text or "")
        return (len((text or "").encode()), len(ids), sum(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), sp.decode(ids) == (text or ""))
    want = Counter((r.doc_id, *wanted(r.text)) for r in df.collect())
    assert Counter(tuple(r) for r in pieces.encode_and_decode(df, MODEL).collect()) == want
    assert not wanted("▁a")[-1] and wanted("a b")[2:4] != wanted("b a")[2:4]
    assert pieces.encode_and_decode(df.limit(0), MODEL).count() == 0
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = LLM_QUERIES["op3_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert Counter(tuple(r) for r in rows) == Counter((r.doc_id, *wanted(r.text)) for r in given.collect())


def test_words_stay_behind_when_documents_are_put_in_order(spark):
    """The shuffle by slice carries places and ids only: with the words the query went over its limit of disk."""
    plan = pieces.encode_and_decode(table(spark, ["a b"]), MODEL)._jdf.queryExecution().executedPlan().toString()
    group = next(line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line)
    assert "entries#" in group and "term#" not in group


def test_documents_wait_for_their_answers(spark):
    """Texts are read once and do not move: the only shuffle by slice is that of the answers, the other side is read in buckets."""
    plan = pieces.encode_and_decode(table(spark, ["a b"]), MODEL)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(slice" in line]
    assert len(shuffles) == 1 and "Bucketed: true" in plan and plan.count("MapInArrow ") == 1


def test_slices_get_their_own_answers(spark):
    """Many slices in a task, some without a word, ask for the same words and get them in their own order."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = [*given, *[""] * 5, None, "the end of the end", *given[:10], "x" * 5000, "end of the"]
    df = table(spark, texts).repartition(2)
    slices = pieces.numbered(df, pieces.Words(pieces.load(MODEL)), 3000).where("entries is not null")
    assert slices.count() > 10 and slices.select("slice").distinct().count() == slices.count()
    got = {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in pieces.encode_and_decode(df, MODEL, 3000).collect()}
    ids = {r.doc_id: sp.encode(r.text or "") for r in df.collect()}
    assert got == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for d, x in ids.items()}
    empty = pieces.encode_and_decode(table(spark, [None, "", ""]), MODEL, 3000).collect()
    assert [(r.n_bytes, r.n_pieces) for r in empty] == [(0, 0)] * 3


def test_merge_order_is_watched(spark):
    """A model where a merge makes a better piece possible late: the lattice hands the word to the merge queue."""
    table_ = {c: (i, -100.0) for i, c in enumerate(" abcd")} | {"bc": (10, -5.0), "abc": (11, -1.0), "cd": (12, -2.0), " a": (13, -6.0)}
    model = pieces.Model(table_, {}, {}, 99, False, True)
    words = [" abc", " abcd", " bcd", " dcba", " bcbc"]
    got = {r.term: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "term string"), model).collect()}
    assert got == {w: pieces.merge_word(w, model) for w in words}


def test_unigram_lattice(spark):
    rng = random.Random(9)
    table_ = {c: (i, -rng.random() * 4 - 2) for i, c in enumerate(" abc")} | {x: (10 + i, -rng.random() * 5) for i, x in enumerate(["ab", "bc", "abc", " a", "ca", "bca"])}
    model = pieces.Model(table_, {}, {}, 99, True, True)
    words = [" " + "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    got = {r.term: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in sorted(set(words))], "term string"), model).collect()}
    assert got == {w: pieces.best_word(w, model) for w in words}


def shingles(text, width):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_near(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = list(EMPTY) + ["one", "ONE", "one two", "One  Two", "é É"]
    for n in (3, 6, 12, 30, 80):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(7):  # copies with a changed word, a chain of changes, an added word
                words = list(base)
                words[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(words))
                if rng.random() < 0.5:
                    base = words
            texts.append(" ".join(base + ["tail"]).upper())
    df = table(spark, texts, [(5, "one two"), (None, "one two"), (None, None)])
    want = slow_near(list(enumerate(texts)), width)
    rows = neardup.near_duplicates(df, width, 80).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert got == want and len(rows) == df.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_links_that_no_star_has(spark):
    """a-b are alike, and both share buckets with a smaller third that is alike to neither: found across components."""
    words = [f"w{i}" for i in range(60)]
    hub = " ".join(words)
    a = " ".join(words[:48] + [f"x{i}" for i in range(12)])
    b = " ".join(words[:48] + [f"x{i}" for i in range(9)] + ["y1", "y2", "y3"])
    df = table(spark, [hub, a, b])
    rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 1, 80, bands=400, rows=1).collect()}
    assert rows == {0: 0, 1: 1, 2: 1}


def test_texts_of_one_id_are_linked_each_by_its_own_set(spark):
    words = {c: [f"{c}{i}" for i in range(40)] for c in "abcd"}
    text = {c: " ".join(w) for c, w in words.items()} | {c.upper(): " ".join(w + ["more"]) for c, w in words.items()}
    rows = [(5, text["a"]), (5, text["b"]), (5, text["c"]), (9, text["A"]), (9, text["B"]), (2, text["C"]), (2, text["d"]), (2, text["D"])]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.key): (r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, [], order), 2, 80, key=F.col("text")).collect()}
        assert {k: v for k, v in got.items() if k[1] not in (text["d"], text["D"])} == {
            (5, text["a"]): (5, True), (5, text["b"]): (5, True), (5, text["c"]): (2, False),
            (9, text["A"]): (5, False), (9, text["B"]): (5, False), (2, text["C"]): (2, True)}
        assert got[2, text["d"]] == (2, True) and got[2, text["D"]] == (2, False)  # linked and of one id: the smaller key
        plain = neardup.near_duplicates(table(spark, [], order), 2, 80)
        assert plain.columns == ["doc_id", "n_shingles", "component_id", "kept"] and plain.where("kept").count() == 4


def test_recall_of_small_sets():
    """Sets of every size at similarity just over 0.8 share a bucket."""
    rng = np.random.default_rng(0)
    with np.errstate(over="ignore"):
        for n in (5, 9, 10, 20, 45, 100):
            missed = 0
            for _ in range(60):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                b = np.delete(a, rng.choice(n, n // 5, replace=False))
                keys = [set(neardup.band_keys(neardup.signature(s, 336), 56, 6)) for s in (a, b)]
                missed += not keys[0] & keys[1]
            assert missed == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    least = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == least
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_repeats(rows, window):
    least = {}
    for key, words in rows:
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            least[w] = min(least.get(w, (key, i)), (key, i))
    out = []
    for key, words in rows:
        gone = {i + k for i in range(len(words) - window + 1) if least[tuple(words[i:i + window])] < (key, i) for k in range(window)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("per_anchor", [20_000, 1])
def test_repeats(spark, per_anchor):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    texts = list(EMPTY) + ["a " * 70, "a b " * 40, " ".join(passage), " ".join(passage) + "\n" + " ".join(passage[:30])]
    for _ in range(40):
        own = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randint(0, 60))]
        at, lo, n = rng.randint(0, len(own)), rng.randrange(30), rng.randint(10, 40)
        texts.append(" ".join(own[:at] + passage[lo:lo + n] + own[at:]))
    texts += [texts[10], texts[12]]
    df = table(spark, texts)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring.remove_repeats(df, per_anchor=per_anchor, per_shard=20, with_text=True).collect())
    assert got == Counter(slow_repeats([(i, words_of(t)) for i, t in enumerate(texts)], 20))
    odd = df.unionByName(table(spark, [], [(5, texts[5]), (None, texts[20]), (None, None)]))
    rows = [(r.doc_id if r.doc_id is not None else (1 << 63) - 1, words_of(r.text)) for r in odd.collect()]
    want = Counter(x[1:4] for x in slow_repeats(rows, 20))
    assert Counter(tuple(r)[1:4] for r in substring.remove_repeats(odd).collect()) == want
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(3)
    for _ in range(60):
        known = [[rng.choice("ab") for _ in range(rng.randint(1, 9))] for _ in range(3)]
        automaton = substring.Automaton()
        for words in known:
            automaton.add(words)
        subs = {tuple(w[i:j]) for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        query = [rng.choice("abc") for _ in range(12)]
        want = [max((n for n in range(end + 2) if tuple(query[end + 1 - n:end + 1]) in subs or n == 0)) for end in range(12)]
        assert automaton.statistics(query) == want


def test_surrogates(spark):
    texts = ["Mail Bob.Smith@Mail5.Example.com or bob.smith@mail5.example.com.", "call +1 (017) 555-7713, +10175557713; card 4432507379035540 or 4432-5073-7903-5540",
             "Mr John Smith, Mrs SMITH, Mrs. Anna Smith and Herr Smith. Госпожа Анна Иванова", "no 10.0.0.300, ip 233.254.104.120, v 1.2.3.4.5, 1234567890123",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and "quoted words"', None, "", "plain 12345 it's", "bob.smith@mail5.example.com " * 3000]
    df = table(spark, texts, [(0, texts[0]), (None, texts[1])])
    rows = pii.pseudonymize(df, "k", count="n").collect()
    assert len(rows) == df.count() and set(rows[0].asDict()) == {"doc_id", "text", "component_id", "text2", "n"}
    by = {r.doc_id: r for r in rows}
    assert [by[i].n for i in range(9)] == [2, 4, 5, 1, 1, 0, 0, 0, 3000]
    assert (by[5].text, by[6].text, by[7].text) == (None, "", texts[7])
    a, b = re.findall(r"\S+@\S+\w", by[0].text)
    assert a != "Bob.Smith@Mail5.Example.com" and a.lower() == b and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{4}@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", a)
    assert set(by[8].text.split()) == {b}
    p, q, c, d = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), (\+1\d{10}); card (4\d{15}) or (4\d{3}-\d{4}-\d{4}-\d{4})", by[1].text).groups()
    assert re.sub(r"\D", "", p) == q[1:] and d.replace("-", "") == c and sum(sum(map(int, str(int(x) * (1 + i % 2)))) for i, x in enumerate(reversed(c))) % 10 == 0
    assert by[None].text == by[1].text
    names = re.fullmatch(r"Mr (\w+) (\w+), Mrs (\w+), Mrs\. (\w+) (\w+) and Herr (\w+)\. Госпожа (\w+) (\w+)", by[2].text)
    john, s1, s2, anna, s3, s4, ana, iva = names.groups() if names else [None] * 8
    assert names and s2 == s1.upper() and s1 == s3 == s4 and "Smith" not in by[2].text
    assert john in pii.GIVEN["latin", "m"] and anna in pii.GIVEN["latin", "f"] and ana in pii.GIVEN["cyrillic", "f"] and re.fullmatch("[А-я]+", iva)
    assert by[3].text.startswith("no 10.0.0.300, ip ") and by[3].text.endswith(", v 1.2.3.4.5, 1234567890123") and "233.254.104.120" not in by[3].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and "quoted words"', by[4].text) and "04dbebab" not in by[4].text
    assert pii.pseudonymize(df, "other").where("doc_id = 0").first().text != by[0].text
    assert pii.pseudonymize(df.limit(0), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    """More names than the lists have, and a space of mail addresses that is nearly used up."""
    entities = [("given_f", f"name{i}") for i in range(300)] + [("mail", f"{c}@x.io") for c in "abcdefghijklmnopqrstuvwxyz"] + [("phone", f"555123{i:04d}") for i in range(200)]
    rows = pii.assign_surrogates(spark.createDataFrame(entities, "kind string, canon string"), "k").collect()
    assert len(rows) == len(entities) == len({(r.kind, r.surrogate) for r in rows})
    assert not {(r.kind, r.surrogate) for r in rows} & set(entities)
