"""Fact operators work in place after one shuffle of the facts."""

from pyspark.sql import functions as F

from tidemark.operators import facts as fx

FACT = "cik string, accession string, namespace string, concept string, unit string, start_date date, end_date date, val double, fp string, fy int"


def _facts(spark, rows):
    from datetime import date
    day = date.fromisoformat
    return spark.createDataFrame([("c1", a, "ifrs-full", "Revenue", "USD", day(s), day(e), v, fp, 2021) for a, s, e, v, fp in rows], FACT)


def exchanges(df):
    """Shuffles of a plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_facts_are_shuffled_once(spark):
    facts = _facts(spark, [("f1", "2021-04-01", "2021-06-30", 5.0, "Q2")])
    assert exchanges(fx.gap_fill_lines(facts)) == 1
    assert exchanges(fx.scale_resolution(fx.scale_votes(fx.collapse(facts)))) == 1
    assert exchanges(fx.filing_period(fx.collapse(facts))) == 1


def test_votes_are_counted_per_fact_of_other_filings(spark):
    q = ("2021-04-01", "2021-06-30")
    rows = [("f1", *q, 5.0, "Q2"), ("f1", *q, 5.0, "Q2"), ("f1", *q, 5000.0, "Q2"), ("f2", *q, 5.01, "Q2"), ("f2", *q, 5.01, "Q2"),
            ("f3", *q, 5000.0, "Q2"), ("f4", *q, 0.0, "Q2"), ("f5", *q, 77.0, "Q2"), ("f6", "2020-04-01", "2020-06-30", 5.0, "Q2")]
    got = {r.accession: (r.peers, r.same, r.thousandfold, r.thousandth, r.irreconcilable) for r in fx.scale_votes(fx.collapse(_facts(spark, rows))).collect()}
    # f1 is not counted against itself, f4 is zero and f6 is alone in its span
    assert got == {"f1": (4, 2, 1, 0, 1), "f2": (5, 2, 2, 0, 1), "f3": (6, 1, 0, 4, 1), "f5": (6, 0, 0, 0, 6)}


def test_state_of_filings(spark):
    rows = [("f1", "2021-04-01", "2021-06-30", 5.0, "Q2"), ("f2", "2021-04-01", "2021-06-30", 5.0, "H1")]
    assert {r.accession: r.state for r in fx.fact_state(fx.collapse(_facts(spark, rows))).collect()} == {"f1": 3, "f2": 1}
    gaps = spark.createDataFrame([("f1", "fillable"), ("f2", "fillable"), ("f3", "fillable"), ("f4", "no_xbrl"), ("f5", "has_local")], "accession string, kind string")
    states = fx.fact_state(fx.collapse(_facts(spark, rows)))
    assert {r.accession: r.reason for r in fx.no_fact_records(gaps, states).select("accession", F.col("reason")).collect()} == {
        "f2": "no reporting period", "f3": "no facts for this filing", "f4": "no XBRL in the filing"}
