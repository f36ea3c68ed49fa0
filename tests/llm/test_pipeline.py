"""The pipeline and the query contracts on the smallest tables, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_text_ops import slow_near
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
PRIVATE = re.compile(r"\S+@\S+\.\w+|(?<!\d)\d{16}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}|(?<=token = \")\w+")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # quality: the field is the operator's own fit, its verdicts are recomputed
    field = quality.fit(quality.fit_sample(docs, labels))
    good = []
    for i, r in rows.items():
        base, codes, sizes = quality.measure(r.text)
        path = quality.viterbi(codes, field.scores().tolist(), field.move)
        content = sum(n for n, y in zip(sizes, path) if y)
        if not quality.base_fails(base["n_words"], base["n_repeat_words"]) and 2 * content >= base["n_words"]:
            good.append(i)
    last = {}
    for i in sorted(good):
        last[rows[i].text] = i
    distinct = sorted(last.values())
    kept = sorted(i for i, (_, _, keep) in slow_near([(i, rows[i].text) for i in distinct], 5).items() if keep)
    # the stages one by one
    df = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES, (good, distinct, kept, kept)):
        df = stage(spark, df, SF)
        assert df.columns == docs.columns
        got = {r.doc_id: r for r in df.collect()}
        assert sorted(got) == sorted(want)
    for i, r in got.items():
        assert not set(PRIVATE.findall(rows[i].text)) & set(PRIVATE.findall(r.text))
        if not re.search(r"\d|[\"'@]", rows[i].text):
            assert r.text == rows[i].text
        assert r.n_chars == len(r.text)
    # packing of what is left
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, r in got.items():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in packed} == want and len(packed) == len(want)
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_judge_rows_without_an_id_or_with_a_repeated_one(spark, tmp_path):
    """Every stage's verdict is a row's own; of rows equal in id and text the dedup stages leave one."""
    rng = random.Random(3)
    plain = [" ".join(rng.choice(["river", "stone", "garden", "window", "letter", "morning", "paper", "silver", "forest", "table"]) + str(rng.randrange(30)) for _ in range(60)) for _ in range(5)]
    like = plain[2] + " tail"  # one added word: a near copy
    a, b, c, d, e = plain
    schema = "doc_id long, text string, lang string"
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    given = spark.read.parquet(f"{SF}/documents.parquet")

    def run(stage, rows):
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], schema).repartition(3)
        if stage is corpus_pipeline.good_documents:  # the field is fitted on the given documents
            df = df.unionByName(given.select("doc_id", "text", F.lit("given").alias("lang")))
        df.write.parquet(str(tmp_path / f"in{stage.__name__}"))
        out = stage(spark, spark.read.parquet(str(tmp_path / f"in{stage.__name__}")), str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang"]
        return Counter((r.doc_id, r.text) for r in out.where("lang = 'x'").collect())

    good = max((r.text for r in corpus_pipeline.good_documents(spark, given, SF).collect()), key=len)
    assert run(corpus_pipeline.good_documents, [(None, good), (None, good), (7, good), (7, "no"), (None, None), (None, "")]) == Counter({(None, good): 2, (7, good): 1})
    rows = [(None, a), (None, a), (None, b), (5, b), (5, b), (4, b), (6, c), (6, d), (9, d), (-1, e), (None, e), (0, None), (None, "")]
    assert run(corpus_pipeline.without_copies, rows) == Counter([(None, a), (5, b), (6, c), (9, d), (-1, e), (0, None)])
    rows = [(None, a), (None, a), (None, like), (3, c), (8, like), (8, d), (8, d), (9, c), (2, e), (2, e.upper()), (2, b), (1, a), (1, a + " tail"), (None, None), (0, ""), (0, "")]
    got = run(corpus_pipeline.without_near_copies, rows)
    twice = {x: sum(got[(i, t)] for i, t in x) for x in [((2, e), (2, e.upper())), ((1, a), (1, a + " tail"))]}
    assert set(twice.values()) == {1}  # the same id and linked: one of them
    for x in twice:
        for k in x:
            del got[k]
    assert got == Counter([(None, a), (None, like), (3, c), (8, d), (2, b), (None, None), (0, "")])


def test_contract_columns(spark):
    first = {
        "op1_shards": "doc_id size text_crc32 law shard slot grown_shard", "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op4_near_dedup": "doc_id n_shingles component_id kept", "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op6_token_counts": "doc_id n_bytes n_tokens over_limit", "op7_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op8_substring_dedup": "doc_id n_words n_removed kept_sha256", "op11_line_dedup": "doc_id n_lines n_dropped kept_sha256"}
    n = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    for name, columns in first.items():
        df = LLM_QUERIES[name](spark, SF)
        assert df.columns[:len(columns.split())] == columns.split()
        assert df.select(F.countDistinct("doc_id")).first()[0] == n
    assert len([x for x in LLM_QUERIES if x.startswith("op")]) == 13
