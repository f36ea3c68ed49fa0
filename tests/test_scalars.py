"""Single rules on small tables of cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import amounts as am, classify as cl, ids, periods as pd_, text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("1567892", "0001567892"), ("CIK1567892", "0001567892"), (" cik 12 ", "0000000012"),
                                      ("cik", None), ("", None), ("12345678901", None), ("12a", None)])
def test_cik(spark, raw, want):
    assert one(spark, ids.normalize_cik(F.col("a")), a=raw) == want


@pytest.mark.parametrize("v,unit,want", [
    (160953000.0, fv.USD, "$161.0M"), (37900000.0, fv.USD, "$37.9M"), (-1500.0, fv.USD, "-$1.5K"), (0.08, fv.USD_PER_SHARE, "$0.08"),
    (-0.04, fv.USD_PER_SHARE, "$-0.04"), (1e9, fv.USD, "$1.0B"), (999.0, fv.USD, "$999"), (0.125, fv.USD_PER_SHARE, "$0.12"), (42450.0, fv.USD, "$42.5K")])
def test_format_value(spark, v, unit, want):
    assert one(spark, am.format_value(F.col("v"), F.col("u")), v=v, u=unit) == want


def test_rounding_is_exact(spark):
    import random
    rnd = random.Random(7)
    xs = [rnd.uniform(0, 1000) for _ in range(4000)] + [k / 16 for k in range(2000)] + [k / 20 for k in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", am.fixed_text(F.col("x"), 1).alias("a"), am.fixed_text(F.col("x"), 2).alias("b")).collect()
    assert all(r.a == f"{r.x:.1f}" and r.b == f"{r.x:.2f}" for r in rows)


@pytest.mark.parametrize("fye,fy,fp,want", [
    ("1231", "2025", "FY", ("2025-12-31", "P1Y")), ("1231", "2025", "Q4", ("2025-12-31", "P3M")), ("1231", "2025", "Q1", ("2025-03-31", "P3M")),
    ("1231", "2025", "Q3", ("2025-10-01", "P3M")), ("1231", "2025", "Q2", ("2025-07-01", "P3M")), ("0630", "2025", "Q1", ("2024-09-30", "P3M")),
    ("0630", "2025", "Q2", ("2024-12-30", "P3M")), ("1231", "1800", "FY", (None, None)), ("13", "2025", "FY", (None, None)), ("1231", "2025", "H1", (None, None))])
def test_period_end(spark, fye, fy, fp, want):
    p = one(spark, pd_.derive_period_end(F.col("a"), F.col("b"), F.col("c")), a=fye, b=fy, c=fp)
    assert (p.period_end and p.period_end.isoformat(), p.duration) == want


def test_period_end_clamped(spark):
    p = one(spark, pd_.derive_period_end(F.col("a"), F.col("b"), F.col("c"), month_end=True), a="1231", b="2025", c="Q3")
    assert p.period_end == dt.date(2025, 9, 30)


@pytest.mark.parametrize("text,want", [
    ("Revenue shows 18% year-over-year growth", ("Growth", "18%")), ("a decrease of 5% in sales", ("Decline", "5%")), ("no numbers", None),
    ("growth of 7% and 3% decrease", ("Growth", "7%")), ("12% one two three four five growth", None)])
def test_growth_headline(spark, text, want):
    h = one(spark, tx.growth_highlight(F.col("a")), a=text)
    assert (None if h is None else (h.label, h.value)) == want


@pytest.mark.parametrize("a,b,want", [("total_amount", "Total Amount", True), ("invoice_number", "invoice_num", True), ("vendor", "vendor_name", True),
                                      ("customer", "supplier", False), ("abc", "abd", False), ("", "x", False), ("shippingcost", "shippingcode", True)])
def test_similar_names(spark, a, b, want):
    assert one(spark, tx.names_similar(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("inst,rend,n,want", [
    (100.0, 100.2, 0, ("verified", "both")), (100.0, 102.0, 0, ("suspect", "both")), (100.0, None, 0, ("single_source", "xbrl_instance")),
    (None, 5.0, 0, ("single_source", "rendered_html")), (None, None, 0, ("suspect", "xbrl_instance")), (100.0, 100.0, 1, ("suspect", "xbrl_instance"))])
def test_grade(spark, inst, rend, n, want):
    df = spark.createDataFrame([(inst, rend)], "i double, r double")
    g = df.select(am.grade_by_two_sources(F.col("i"), F.col("r"), F.lit(fv.USD), F.lit(n)).alias("g")).first()["g"]
    assert (g.confidence, g.source) == want


def test_weights_of_a_known_mix(spark):
    """Counts per category of one long filing history give the known split of weights."""
    mix = {"quarterly_results": 60, "business_deal": 20, "annual_report": 11, "regulatory_clinical": 4, "annual_guidance": 2,
           "corporate_action": 3, "current_report": 64, "governance": 40, "admin_update": 10, "insider_trade": 26, "unknown": 141}
    df = spark.createDataFrame(list(mix.items()), "category string, n int")
    got = {r.w: r.n for r in df.groupBy(cl.weight_of(F.col("category")).alias("w")).agg(F.sum("n").alias("n")).collect()}
    assert got == {"major": 97, "medium": 117, "minor": 167}
    assert df.where(cl.is_event(F.col("category"))).agg(F.sum("n")).first()[0] == 100
