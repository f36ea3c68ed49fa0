"""Lines that many documents share: levelled runs and the texts that are left, against a naive count."""

import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tidemark.llm import linededup
from tidemark.llm.common import table
from tidemark.session import scratch_path

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def naive(rows, limit, min_chars=1):
    """(id, lines, dropped, text left) of (id, text) rows."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, lines in split for k in {key(x) for x in lines})
    out = []
    for i, lines in split:
        left = [x for x in lines if len(key(x)) < min_chars or n[key(x)] < limit]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


def as_rows(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Shared \nown 1\n\nshared"), (2, "\tSHARED\r\nown 2"), (3, "shared"), (None, "shared\nÉcole"), (None, "école\nx"),
            (5, None), (5, ""), (6, "\n\n"), (7, "own 1"), (7, "own 1"), (8, " shared"), (9, "x" * 100_000 + "\nshared\n" + "y\n" * 50_000),
            (10, "a\x1cb"), (10, "a\x1cb\n"), (11, "ends\n"), (12, "ends\n"), (13, " ends")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).withColumn("gone", F.lit("own")).withColumn(
        "lines", F.lit(None).cast("string")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


@pytest.mark.parametrize("limit, min_chars, batches", [(3, 1, 4), (2, 4, 9), (1, 1, 2), (100, 1, 1)])
def test_odd_rows(odd, limit, min_chars, batches):
    out = linededup.drop_frequent_lines(odd, limit, min_chars, batches, buckets=4)
    assert set(out.columns) == {*odd.columns, "n_lines", "n_dropped"}
    assert as_rows(out) == naive([(r.doc_id, r.text) for r in odd.collect()], limit, min_chars)
    assert {r.gone for r in out.collect()} == {"own"}


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, n, d, t), k in naive([(r.doc_id, r.text) for r in docs.collect()], 10).items() for _ in range(k))
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.line_digests(docs).collect())
    assert got == want and any(d for _, _, d, _ in got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.line_digests(none).count() == 0


def test_runs_are_levelled_and_survive(spark):
    docs = spark.createDataFrame([(i, f"all\nhalf {i % 2}\nonly {i}") for i in range(36)], "doc_id long, text string")
    path = scratch_path(spark, "test_runs")
    runs = linededup.LineRuns(spark, path, limit=5, buckets=4, fan=3)
    levels = []
    for b in range(9):
        runs.add(linededup.line_counts(docs.where(f"doc_id div 4 = {b}")), str(b))
        levels.append(sorted(level for level, _ in runs.runs))
    assert levels == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1], [0, 0, 1, 1], [2]]
    again = linededup.LineRuns.open(spark, path)
    again.add(linededup.line_counts(docs), "8")  # a batch that was added before a restart
    assert (again.runs, again.limit, again.fan) == (runs.runs, 5, 3)
    want = {tuple(r) for r in spark.sql("SELECT 'all' AS k UNION ALL SELECT 'half 0' UNION ALL SELECT 'half 1'").select(*linededup.hash_of(F.col("k"))).collect()}
    assert {tuple(r) for r in again.frequent().collect()} == want
    assert again.counts().count() == 39 and again.counts().select("h1").distinct().count() == 39
    runs.retire()
    assert {tuple(r) for r in again.frequent().collect()} == want


def test_failed_batch_leaves_the_store(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    path = scratch_path(spark, "test_runs")
    runs = linededup.LineRuns(spark, path, limit=2, buckets=2)
    runs.add(linededup.line_counts(docs), "one")
    broken = linededup.line_counts(docs).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        runs.add(broken, "two")
    after = linededup.LineRuns.open(spark, path)
    assert after.batches == ["one"] and after.counts().count() == 2
    after.add(linededup.line_counts(docs), "two")
    assert after.frequent().count() == 2
