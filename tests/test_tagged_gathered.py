"""Tagged documents are gathered from narrow rows, and a filing's candidates are picked in one grouping."""

import datetime as dt
import re

from tidemark.operators import facts as fx
from tidemark.plans import facts as pf
from tidemark.registry import Tables

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"
LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double"


def _given(spark, path):
    at = dt.datetime(2021, 8, 1)
    spark.createDataFrame([(1, 5, at), (2, 5, at), (2, 6, at), (None, 7, at)], ORDERS).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, 11, 12, 1, 1.0), (1, 11, 12, 1, 1.0), (1, 4, 10, 1, 1.0), (2, 3, 7, 6, 1.0), (None, 1, 1, 1, 1.0)], LINES).write.parquet(f"{path}/lineitem.parquet")
    return Tables(spark, str(path))


def test_documents_hold_every_line_of_a_filing(spark, tmp_path):
    got = {r.accession: r for r in pf._tagged(_given(spark, tmp_path)).collect()}
    assert set(got) == {"1", "2"}
    one, two = got["1"], got["2"]
    assert (len(one.facts), len(two.facts), one.cik, two.cik) == (9, 6, "0000000005", "0000000006")  # a line that comes twice is two facts
    assert [x.context_id for x in one.contexts] == sorted({f.context_id for f in one.facts}) and len(one.contexts) == 6
    assert [(u.unit_id, u.kind) for u in one.units] == [("usd", "usd")] and one.dei.period_end == dt.date(2021, 6, 30)
    assert (len(one.rendered), len(two.rendered), two.rendered[0].statement) == (0, 2, "balance")


def test_lines_are_shuffled_narrow_and_once(spark, tmp_path):
    plan = pf._segments(_given(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(accession" in x]
    assert len(shuffles) == 2 and all("REPARTITION_BY_NUM" in x for x in shuffles)  # before the run; the second is the first again
    scans = {re.sub(r"#\d+L?", "", x[x.index("FileScan"):]) for x in plan.splitlines() if "FileScan parquet [o_orderkey" in x}
    assert len(scans) == 1  # equal branches, so that the second shuffle is the first again


def test_values_of_the_best_alias_compete(spark):
    fact = lambda no, element, value, ctx="c": (element, ctx, "u", "-3", value, no)
    day = dt.date.fromisoformat
    rev, other = "ifrs-full:Revenue", "us-gaap:Revenues"
    facts = [fact(5, other, 1.0), fact(4, rev, 8.0), fact(3, rev, 0.0), fact(2, rev, -0.0), fact(7, rev, 8.0), fact(1, rev, 2.0, "p"), fact(0, rev, 9.0, "none")]
    contexts = [("c", day("2020-04-01"), day("2020-06-30"), None, 0, None, None), ("p", day("2019-04-01"), day("2019-06-30"), None, 0, None, None)]
    rows = [("a", contexts, [("u", "usd")], facts, [("income", rev, 8.5), ("balance", rev, 99.0)], (day("2020-06-30"), "Q2", "2020"))]
    schema = """accession string, contexts array<struct<context_id:string,start_date:date,end_date:date,instant:date,n_dims:int,axis:string,member:string>>, units array<struct<unit_id:string,kind:string>>,
        facts array<struct<element:string,context_id:string,unit_id:string,decimals:string,value:double,fact_no:bigint>>, rendered array<struct<statement:string,element:string,rendered_value:double>>,
        dei struct<period_end:date,focus:string,fy:string>"""
    picks = fx.pick_candidates(fx.own_contexts(spark.createDataFrame(rows, schema)))
    plan = picks._jdf.queryExecution().executedPlan().toString()
    assert [(r.key, r.value, str(r.value), r.n_candidates, r.prior_value, r.rendered_value, r.element) for r in picks.collect()] == [("total_revenues", 0.0, "0.0", 2, 2.0, 8.5, rev)]
    assert plan.count("ObjectHashAggregate") == 2  # the two halves of one grouping


def test_records_of_a_document_stay_in_one_row(spark):
    """A block's worth of document is read as a tree, a longer or broken one as a stream, with the same records; documents of one filing are joined together."""
    from tidemark.sources import markup as mk
    head = '<xbrl xmlns:i="http://xbrl.ifrs.org/taxonomy/2023" xmlns:d="http://xbrl.sec.gov/dei/2023">'
    context = '<context id="c"><period><startDate>2020-04-01</startDate><endDate>2020-06-30</endDate></period><segment><explicitMember dimension="x"> m </explicitMember><explicitMember/></segment></context>'
    unit = '<unit id="u"><divide><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>xbrli:shares</measure></unitDenominator></divide></unit>'
    fact = '<i:Revenue contextRef="c" unitRef="u"> 1,5<i:GrossProfit>7</i:GrossProfit>0 </i:Revenue>'
    said = "<d:DocumentPeriodEndDate>2020-06-30</d:DocumentPeriodEndDate><d:DocumentFiscalPeriodFocus>Q2</d:DocumentFiscalPeriodFocus>"
    body = head + context + unit + said + fact
    for end in ("</xbrl>", "<a>", "</b>", "<o/>" * 9000 + "</xbrl>"):
        whole, small = list(mk._instance_records("", (body + end).encode(), mk._KNOWN)), mk._small_records((body + end).encode(), {})
        bare = [{k: v for k, v in r.items() if v is not None} for r in whole if r["kind"] != "error"]
        assert len(bare) == 6 and (small is None or [{k: v for k, v in r.items() if v is not None} for r in small] == bare) and (small is None) == (end in ("<a>", "</b>"))
    rows = [("a", head + context + said + "</xbrl>"), ("a", head + unit + fact + "<a>"), (None, body + "</xbrl>"), ("b", "<xbrl/>")]
    records = mk.instance_records(spark.createDataFrame(rows, "k string, x string"), "k", "x")
    assert sorted((r.accession or "", r.kind, len(r.contexts), len(r.units), len(r.facts), len(r.dei)) for r in records.collect()) == [
        ("", "document", 1, 1, 2, 2), ("a", "document", 1, 0, 0, 2), ("a", "error", 0, 1, 2, 0), ("b", "document", 0, 0, 0, 0)]
    got = {r.accession: r for r in mk.instance_documents(records).collect()}
    assert [(f.element, f.value) for f in got["a"].facts] == [("ifrs-full:GrossProfit", 7.0), ("ifrs-full:Revenue", 15.0)]
    assert [(x.context_id, x.end_date, x.n_dims, x.member) for x in got["a"].contexts] == [("c", dt.date(2020, 6, 30), 2, "m")] and [tuple(u) for u in got["a"].units] == [("u", "usd_per_share")]
    assert got["a"].dei.focus == "Q2" and got["b"].dei is None and set(got) == {None, "a", "b"}
    assert {(r.accession, r.period_end, r.focus) for r in mk.declared_periods(records).collect()} == {("a", dt.date(2020, 6, 30), "Q2"), (None, dt.date(2020, 6, 30), "Q2")}
