"""The collection run and evidence from exhibits on small fixed cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import estimates as es, evidence as ev
from tidemark.sources import collect as co, sinks as sk

AT = "2024-03-01 00:00:00"


def page(*rows):
    return json.dumps([{"actual": a, "estimate": 1.0, "period": p, "year": 2024, "quarter": q} for a, p, q in rows])


def run(spark, store, responses, at=AT, force=False, targets=("ok", "part", "none", "bad")):
    t = spark.createDataFrame([(x, "1231" if x == "ok" else "") for x in targets], "cik string, fye string")
    r = spark.createDataFrame(responses, "cik string, position int, doc string, error string")
    s = spark.createDataFrame([(x, json.dumps({"targetMean": 5.0}), "[]") for x in targets], "cik string, targets_doc string, ratings_doc string")
    own = spark.createDataFrame([("ok", "2024-03-31", "P3M", 2.0)], "cik string, period_end string, duration string, own_eps double")
    rows = co.collect_run(store, t, r, s, own, F.lit(at).cast("timestamp"), "v", ("2014-01-01", "2024-12-31"), force).collect()
    return {x.cik: (x.status, x["rows"], x.dropped) for x in rows}


FIRST = [("ok", 1, page((2.0, "2024-03-31", 1), (9.0, "2001-01-01", 2), (3.0, "2024-06-30", 7)), None), ("ok", 2, page((2.0, "2024-03-31", 1), (4.0, "soon", 0)), None),
         ("part", 1, page((1.0, "soon", 1), (1.5, "2024-06-30", 2)), None), ("none", 1, "[]", None), ("bad", 1, None, "http 500")]


def test_statuses_rows_and_skips(spark, tmp_path):
    store = sk.TableStore(spark, str(tmp_path / "s"))
    assert run(spark, store, FIRST) == {"ok": ("ok", 3, 0), "part": ("partial", 1, 1), "none": ("no_data", 0, 0), "bad": ("error", 0, 0)}
    rows = {(r.cik, r.fiscal_period, r.consensus_date): (r.period_end, r.eps_actual, r.basis) for r in store.read("estimates").collect()}
    assert rows == {("ok", "Q1", "2024-03-31"): ("2024-03-31", 2.0, "reported"), ("ok", "FY", "2024-12-31"): ("2024-12-31", 4.0, "unknown"), ("part", "Q2", "2024-06-30"): ("2024-06-30", 1.5, "unknown")}
    assert {r.cik for r in store.read("snapshots").collect()} == {"ok", "part"}
    cover = {r.cik: r for r in store.read("coverage").collect()}
    assert cover["part"].note == "dropped 1 rows with underivable period_end" and cover["bad"].last_success_at is None and cover["none"].last_success_at is not None
    later = [("ok", 1, page((7.0, "2024-03-31", 1)), None), ("bad", 1, page((7.0, "2024-03-31", 1)), None)]
    assert run(spark, store, later, "2024-03-01 23:59:59") == {"bad": ("ok", 1, 0)}  # the others had a success within the day
    assert run(spark, store, [("bad", 1, None, "gone")], "2024-03-01 23:59:59", force=True, targets=("bad",)) == {"bad": ("error", 0, 0)}
    bad = {r.cik: r for r in store.read("coverage").collect()}["bad"]
    assert bad.status == "error" and bad.last_success_at == dt.datetime(2024, 3, 1, 23, 59, 59)  # the last success is kept
    assert run(spark, store, later, "2024-03-02 00:00:00")["ok"] == ("ok", 1, 0)
    first = store.read("estimates").where("cik = 'ok' AND fiscal_period = 'Q1'").first()
    assert first.eps_actual == 7.0 and first.basis == "street" and first.created_at == dt.datetime(2024, 3, 1) and first.fetched_at == dt.datetime(2024, 3, 2)


def test_a_run_that_fails_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    store = sk.TableStore(spark, str(tmp_path / "s"))
    run(spark, store, FIRST)
    names = ("estimates", "snapshots", "coverage")
    before = {n: sorted(map(str, store.read(n).collect())) for n in names}
    monkeypatch.setattr(co, "_covered", lambda current, incoming: incoming.withColumn("status", F.raise_error(F.lit("lost"))))
    again = [("ok", 1, page((8.0, "2024-03-31", 1)), None)]
    with pytest.raises(Exception, match="lost"):
        run(spark, store, again, force=True)
    assert {n: sorted(map(str, store.read(n).collect())) for n in names} == before
    monkeypatch.undo()
    run(spark, store, again, force=True)
    assert store.read("estimates").where("eps_actual = 8.0").count() == 1


def exhibits(spark, *rows):
    return spark.createDataFrame([("a", *r) for r in rows], "accession string, file_name string, html string")


def test_one_budget_over_all_exhibits(spark):
    one = lambda n: f"Revenues were ${n} million in the year of which we speak"
    docs = exhibits(spark, ("b-EX99.htm", f"<p>{one(4)}. {one(5)}</p>"), ("z-ex99.htm", f"<style>x. {one(9)}. </style>{one(3)}"), ("c-ex99.htm", f"{one(1)}! 1 2 3 {one(8)}. Net income &#36;1 billion? {one(2)} "),
                    ("ex99.html", one(7)), ("main.htm", one(7)))
    want = spark.createDataFrame([("a", "total_revenues"), ("a", "net_income"), ("a", "eps_basic")], "accession string, metric string")
    size = len(one(1))
    for limit, n in ((10 * size, 5), (3 * size, 3), (4 * size - 1, 3), (size - 1, 0)):
        got = {r.metric: r for r in ev.gather_evidence(docs, want, ["accession"], limit).collect()}
        if n:
            assert got["total_revenues"].sentences == n and got["total_revenues"].evidence.startswith(". ".join(one(i) for i in range(1, min(n, 4) + 1)))
        assert ("total_revenues" in got) == (n > 0) and got["net_income"].evidence == "Net income $1 billion."


def test_answers_need_evidence(spark):
    docs = exhibits(spark, ("ex99.htm", "Total revenues were $5 million in all. "))
    lines = spark.createDataFrame([("a", k, 5000.0, "USD", "suspect", "tagged", ["old"]) for k in ("total_revenues", "net_income")],
                                  "accession string, key string, value double, metric_unit string, confidence string, source string, notes array<string>")
    answers = spark.createDataFrame([("a", k, "B", 5e6, " were  $5 million", "high", "m", None) for k in ("total_revenues", "net_income")],
                                    "accession string, key string, choice string, answer_value double, quote string, answer_confidence string, model string, error string")
    got = {r.key: r for r in ev.apply_answers(lines, docs, answers).collect()}
    good, bad = got["total_revenues"], got["net_income"]
    assert (good.value, good.confidence, good.notes) == (5e6, "verified", ["old", "adjudicated:  were  $5 million", "model: m"])
    assert (bad.value, bad.confidence, bad.problem, bad.notes[1]) == (5000.0, "suspect", "no_evidence", "adjudication skipped: no unit-explicit evidence")
    assert [r.notes for r in ev.apply_answers(lines, docs, answers.limit(0)).where("key = 'total_revenues'").collect()] == [["old"]]
