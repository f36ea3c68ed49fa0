"""Join and state helpers against brute force, with one key holding a third of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activity as ac, drift as dr, facts as fx, joins as jn, prices as pr

DAY = dt.date(2024, 1, 1)


def _keyed(rnd, n):
    """Rows of (key, date, id): key 0 has a third of them."""
    return [(0 if i % 3 == 0 else rnd.randrange(1, 9), DAY + dt.timedelta(days=rnd.randrange(200)), i) for i in range(n)]


@pytest.mark.parametrize("forward,equal", [(False, False), (False, True), (True, False), (True, True)])
def test_asof_matches_brute_force(spark, forward, equal):
    rnd = random.Random(3)
    left, right = _keyed(rnd, 300), _keyed(rnd, 240)
    l = spark.createDataFrame(left, "k int, d date, id int")
    r = spark.createDataFrame(right, "k int, e date, v int")
    got = {x.id: (x.e, x.v) for x in jn.asof_join(l, r, ["k"], "d", "e", ["v"], forward=forward, allow_equal=equal, tie_break=["v"]).collect()}
    for k, d, i in left:
        ok = [(e, v) for kk, e, v in right if kk == k and ((e > d if forward else e < d) or (equal and e == d))]
        best = (min if forward else max)((e for e, _ in ok), default=None)
        want = (best, max(v for e, v in ok if e == best)) if ok else (None, None)
        assert got[i] == want


def test_estimate_is_never_from_the_future(spark):
    from tidemark.operators.estimates import estimate_before
    asks = spark.createDataFrame([("c", "s", "p", "P3M", dt.date(2025, 9, 30))], "cik string, source string, period_end string, duration string, report_date date")
    est = spark.createDataFrame([("c", "s", "p", "P3M", dt.date(2025, 9, 20), 1.0, 1), ("c", "s", "p", "P3M", dt.date(2025, 10, 1), 2.0, 2), ("c", "s", "p", "P3M", dt.date(2025, 9, 30), 3.0, 3)],
                                "cik string, source string, period_end string, duration string, consensus_date date, eps_estimate double, event_id int")
    r = estimate_before(asks, est, "report_date").first()
    assert (r.consensus_date, r.eps_estimate) == (dt.date(2025, 9, 20), 1.0)


def test_upper_median(spark):
    rnd = random.Random(5)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 6), rnd.choice([0.0, -3.0, 7.0, rnd.uniform(-1e6, 1e6), rnd.uniform(0, 10)])) for i in range(500)]
    got = {r.k: (r.median, r.n) for r in jn.upper_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k in {k for k, _ in rows}:
        vs = sorted(v for kk, v in rows if kk == k)
        assert got[k] == (vs[len(vs) // 2], len(vs))


def test_ratio_counts(spark):
    rnd = random.Random(11)
    base = [rnd.uniform(1, 5) * 10 ** rnd.randrange(0, 4) for _ in range(30)]
    vals = sorted({round(b * f, 6) * s for b in base for f in (1, 1.004, 1.006, 1000, 0.001) for s in (1, -1)})
    df = spark.createDataFrame([("g", v, 1 + i % 3) for i, v in enumerate(vals)], "g string, v double, k int")
    t = {"same": 1.0, "thousandfold": 1000.0, "thousandth": 0.001}
    got = {r.v: r for r in jn.ratio_counts(df.select("g", "v"), df, ["g"], "v", "k", t, 0.005).collect()}
    for v in vals:
        for name, ratio in t.items():
            assert got[v][name] == sum(1 + i % 3 for i, o in enumerate(vals) if abs(o / v - ratio) / ratio <= 0.005)


def test_greedy_match_uses_each_name_once(spark):
    pairs = spark.createDataFrame([("s", "amount", 1, "Amount", 1), ("s", "amount", 1, "amount_due", 3), ("s", "amount_due", 2, "amount_due", 1), ("s", "amt", 3, "Amount", 3)],
                                  "s string, name string, position int, found string, tier int")
    got = {(r.name, r.found) for r in dr.match_once(pairs, ["s"], "name", "found", "position").collect()}
    assert got == {("amount", "Amount"), ("amount_due", "amount_due")}


def test_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([("a", DAY, 1.0, 1), ("a", DAY, 2.0, 2), ("b", None, 3.0, 3)], "cik string, trade_date date, close double, fetched_at int")
    once = pr.upsert_bars(rows.where("false"), rows)
    twice = pr.upsert_bars(once, rows)
    assert once.collect() == twice.collect() == [("a", DAY, 2.0, 2)]


def _facts(rows):
    """(accession, concept, start, end, val, fp) rows of one company."""
    return [("c", a, "ifrs-full", con, "USD", s and dt.date.fromisoformat(s), dt.date.fromisoformat(e), v, fp, 2021) for a, con, s, e, v, fp in rows]


FACT = "cik string, accession string, namespace string, concept string, unit string, start_date date, end_date date, val double, fp string, fy int"


def test_own_quarter_not_the_half_year(spark):
    rows = _facts([("f1", "Revenue", "2021-04-01", "2021-06-30", 42472000.0, "Q2"), ("f1", "Revenue", "2021-01-01", "2021-06-30", 68153000.0, "Q2"),
                   ("f1", "Revenue", "2020-04-01", "2020-06-30", 33000000.0, "Q2"), ("f1", "Revenue", "2020-01-01", "2020-12-31", 133000000.0, "Q2")])
    line = fx.gap_fill_lines(spark.createDataFrame(rows, FACT)).first()
    assert (line.value, line.prior_value, line.value_text, line.confidence) == (42472000.0, 33000000.0, "$42.5M", "single_source")


def test_scale_is_corrected_by_a_later_filing(spark):
    rows = _facts([("f1", "Revenue", "2021-04-01", "2021-06-30", 37900.0, "Q2"), ("f2", "Revenue", "2022-04-01", "2022-06-30", 50000000.0, "Q2"),
                   ("f2", "Revenue", "2021-04-01", "2021-06-30", 37900000.0, "Q2")])
    got = {r.accession: (r.value_text, r.confidence) for r in fx.gap_fill_lines(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {"f1": ("$37.9M", "verified"), "f2": ("$50.0M", "single_source")}


def test_contradicting_filings_withhold_money(spark):
    rows = _facts([("f1", "Revenue", "2021-04-01", "2021-06-30", 100.0, "Q2"), ("f2", "Revenue", "2021-04-01", "2021-06-30", 170.0, "Q2")])
    assert {r.confidence for r in fx.gap_fill_lines(spark.createDataFrame(rows, FACT)).collect()} == {"suspect"}
