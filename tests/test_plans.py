"""Fetch plans of peer lists, their totals and reports, and token estimates of documents read several times."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import documents as docs
from tidemark.operators import filings as fl

_INDEX = "cik string, accession string, filing_date string, size long, is_xbrl int, is_inline_xbrl int, form string"


def _plans(spark, delay=0.0):
    rows = [("0000000001", "a", "2024-02-01", 100, 1, 0, "10-K"), ("0000000001", "b", "2023-05-01", 50, 0, 0, "10-Q"), ("0000000001", "c", "2001-05-01", 7, 1, 1, "10-K"),
            ("0000000001", "d", "bad", 9, 0, 0, None), ("0000000002", "e", "1999-01-01", 5, 0, 0, "8-K"), ("0000000001", "f", "2024-03-01", None, None, 1, None)]
    disk = spark.createDataFrame([("0000000001", "b"), ("0000000001", "b")], "cik string, accession string")
    return fl.fetch_plan(spark.createDataFrame(rows, _INDEX), disk, F.lit(dt.date(2024, 6, 1)), 3, delay)


def test_fetch_plan_counts_forms_in_the_window_and_adds_whole_seconds_of_delay(spark):
    got = {r.cik: r for r in _plans(spark, 2.9).collect()}
    one = got["0000000001"]
    assert (one.in_index, one.in_window, one.on_disk, one.to_fetch, one.xbrl_flagged) == (5, 3, 1, 2, 2)
    assert [tuple(f) for f in one.forms] == [("", 1), ("10-K", 1), ("10-Q", 1)]
    assert (one.first_filing, one.last_filing, one.download_bytes, one.disk_bytes) == ("2023-05-01", "2024-03-01", 150, 210)
    assert (one.requests, one.seconds) == (2 + 2 * 12, int(26 / 8.3) + 2)
    two = got["0000000002"]  # nothing in the window: the survey itself still costs two requests
    assert (two.in_window, two.to_fetch, two.first_filing, list(two.forms), two.requests, two.seconds) == (0, 0, None, [], 2, 2)


def test_peers_totals_and_documents(spark):
    peers = spark.createDataFrame([("x", 1, "1", ""), ("x", 2, "", "zz"), ("x", 3, "9", ""), ("y", 4, None, None), ("y", 5, "", " aa ")], "list string, no long, company_id string, ticker string")
    tickers = spark.createDataFrame([("AA", "0000000002")], "ticker string, cik string")
    plans = fl.peer_plans(peers, tickers, _plans(spark))
    status = {r.no: (r.status, r.to_fetch, r.note) for r in plans.collect()}
    assert status == {1: ("planned", 2, None), 2: ("skipped", 0, "ticker not in ticker map"), 3: ("error", 0, "no index"),
                      4: ("skipped", 0, "no company_id and no ticker"), 5: ("planned", 0, None)}
    totals = {r.list: (r.peers, r.planned, r.skipped, r.error, r.to_fetch) for r in fl.plan_totals(plans, ["list"]).collect()}
    assert totals == {"x": (3, 1, 1, 1, 2), "y": (2, 1, 1, 0, 0)}
    assert fl.plan_totals(plans).first().peers == 5
    documents = {r.list: r for r in fl.plan_documents(plans, ["list"], "no").collect()}
    assert [p.no for p in documents["x"].peers] == [1, 2, 3] and documents["x"].totals.error == 1
    assert documents["x"].peers[0].line.startswith("0000000001 planned 2 filings ~") and documents["y"].peers[0].status == "skipped"
    assert fl.plan_documents(plans.limit(0), ["list"], "no").count() == 0


def test_passes_multiply_the_estimate(spark):
    rows = spark.createDataFrame([(None, 3000), (0, 3000), (1, 3000), (3, 9000)], "passes int, want long")
    tokens = docs.token_estimate(F.lit("text/plain"), F.lit(99), F.lit(8000), F.lit(False), F.col("passes"))
    assert all(r.tokens == r.want for r in rows.withColumn("tokens", tokens).collect())
