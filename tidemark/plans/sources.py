"""Queries over the document decoders. Each given row becomes one small document, which is then decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import activity as ac, estimates as es, facts as fx, filings as fl
from tidemark.registry import query
from tidemark.session import scratch_path
from tidemark.sources import decoders as dec, markup as mk, readers as rd

c = F.col
_ORD = """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS accession, lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, CAST(year(o_orderdate) AS INT) AS year, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
    o_orderstatus, o_totalprice, o_custkey FROM orders"""


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


# One filing folder per company and year: a filing document (some broken), for every third a meta and for every fifth a financials one.
_FOLDERS = """SELECT lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, CAST(year(o_orderdate) AS INT) AS year, max(o_orderkey) AS k, count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS STRING) AS d
    FROM orders GROUP BY lpad(CAST(o_custkey AS STRING), 10, '0'), CAST(year(o_orderdate) AS INT)"""
_TREE_SQL = """SELECT cik, year, 'f-' || k AS accession, CASE WHEN k % 2 = 0 THEN '6-K' ELSE '20-F' END AS form, d AS filing_date, n AS size, CASE WHEN k % 3 = 0 THEN 'governance' ELSE 'unknown' END AS category,
    k % 3 = 0 AND k % 2 = 0 AS has_financials, CASE WHEN k % 5 = 0 THEN 'FY ' || year END AS period FROM src WHERE k % 7 > 0"""


def folder_documents(src):
    """(cik, year, folder, document, body) of the folders."""
    filing = F.when(c("k") % 7 == 0, F.lit("{broken")).otherwise(_json(filingDate=c("d"), form=F.when(c("k") % 2 == 0, "6-K").otherwise("20-F"), size=c("n"), isXBRL=F.lit(1)))
    meta = F.when(c("k") % 3 == 0, _json(category=F.lit("governance"), tier=F.lit(2), signals=F.struct((c("k") % 2 == 0).alias("hasFinancials"))))
    fin = F.when(c("k") % 5 == 0, _json(version=F.lit(1), period=F.struct(F.concat(F.lit("FY "), c("year")).alias("label"))))
    docs = F.array(*[F.struct(F.lit(n).alias("document"), b.alias("body")) for n, b in (("filing.json", filing), ("meta.json", meta), ("financials.json", fin))])
    return src.select("cik", "year", F.concat(F.lit("f-"), c("k")).alias("folder"), F.inline(docs)).where("body IS NOT NULL")


@query("src01_filing_documents", src=_FOLDERS, sql=f"SELECT * EXCLUDE (size) FROM ({_TREE_SQL})")
def src01(t, src):
    docs = folder_documents(src).withColumn("modified", F.lit(0).cast("timestamp"))
    return rd.assemble_documents(docs).select("cik", "year", "accession", "form", "filing_date", "category", "has_financials", c("financials.period.label").alias("period"))


# The same documents of one year per company as files, written to the shared folder and read back.
_TREE_FOLDERS = _FOLDERS.replace("CAST(year(o_orderdate) AS INT)", "1990 + CAST(o_custkey % 10 AS INT)")


@query("src01_filing_tree", src=_TREE_FOLDERS, sql=f"SELECT * EXCLUDE (size) FROM ({_TREE_SQL})")
def src01_tree(t, src):
    root = scratch_path(t.spark, "tree")
    rd.write_tree(folder_documents(src), root)
    return rd.read_filings(t.spark, root).select("cik", "year", "accession", "form", "filing_date", "category", "has_financials", c("financials.period.label").alias("period"))


@query("src02_company_index", src="SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'notes' ELSE lpad(CAST(c_custkey AS STRING), 10, '0') END AS folder, c_name, c_mktsegment FROM customer",
       sql="SELECT folder AS cik, c_name AS name, 'A' || c_custkey AS tickers, 2 AS older_pages FROM src WHERE c_custkey % 6 > 0 AND c_custkey % 7 > 0")
def src02(t, src):
    doc = F.when(c("c_custkey") % 7 == 0, F.lit("<html>")).otherwise(_json(
        name=c("c_name"), sic=F.lit("1"), tickers=F.array(F.concat(F.lit("A"), c("c_custkey"))), unknownKey=F.lit("x"),
        filings=F.struct(F.array(F.struct(F.lit("p1").alias("name")), F.struct(F.lit("p2").alias("name"))).alias("files"))))
    return dec.company_index(src.withColumn("doc_text", doc), "folder", "doc_text").select("cik", "name", F.array_join("tickers", ",").alias("tickers"), "older_pages")


@query("src03_parallel_arrays", src=_ORD, sql="""
    SELECT o_orderkey, o_orderkey || '-' || i AS accession, CASE WHEN i < 2 THEN d ELSE '' END AS filing_date, CASE WHEN i < 1 THEN o_custkey ELSE 0 END AS size, CAST(CASE WHEN i < 1 THEN 1 ELSE 0 END AS INTEGER) AS is_xbrl
    FROM src, (VALUES (0), (1), (2)) v(i)""")
def src03(t, src):
    acc = F.array(*[F.concat(c("accession"), F.lit(f"-{i}")) for i in range(3)])
    doc = _json(filings=F.struct(F.struct(acc.alias("accessionNumber"), F.array("d", "d").alias("filingDate"), F.array("o_custkey").alias("size"), F.array(F.lit(1)).alias("isXBRL")).alias("recent")))
    return dec.index_rows(src.withColumn("doc", doc), ["o_orderkey"], "doc").select("o_orderkey", "accession", "filing_date", "size", "is_xbrl")


@query("src04_company_facts", src="SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM lineitem", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'ifrs-full' ELSE 'us-gaap' END AS namespace, CASE WHEN l_partkey % 2 = 0 THEN 'Revenue' ELSE 'Revenues' END AS concept, 'total_revenues' AS key, CAST(CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS alias_rank, unit, d AS end_date, l_extendedprice * m AS val
    FROM src, (VALUES ('USD', 1.0::DOUBLE), ('ILS', 4.0::DOUBLE)) v(unit, m)""")
def src04(t, src):
    entry = lambda m: F.array(F.struct(c("d").alias("end"), (c("l_extendedprice") * m).alias("val"), F.lit("a-1").alias("accn"), F.lit("FY").alias("fp")))
    units = F.struct(F.create_map(F.lit("USD"), entry(1.0), F.lit("ILS"), entry(4.0)).alias("units"))
    even = c("l_partkey") % 2 == 0
    facts = F.create_map(F.when(even, F.lit("ifrs-full")).otherwise(F.lit("us-gaap")),
                         F.create_map(F.when(even, F.lit("Revenue")).otherwise(F.lit("Revenues")), units, F.lit("NotMapped"), units))
    docs = src.withColumn("doc", _json(cik=c("l_orderkey"), facts=facts))
    rows = dec.company_fact_rows(docs, ["l_orderkey", "l_linenumber", "l_partkey"], "doc")
    return fx.with_metric(rows).select("l_orderkey", "l_linenumber", "l_partkey", "namespace", "concept", "key", "alias_rank", "unit", c("end_date").cast("string").alias("end_date"), "val")


_CHART_SRC = "SELECT event_id, user_id, CAST(1704067200 + event_id * 86400 + 3600 * 20 AS BIGINT) AS epoch, value, event_id % 10 AS kind FROM events"


def _chart_docs(src):
    kind = c("kind")
    result = F.array(F.struct(
        F.struct(F.lit("USD").alias("currency"), F.concat(F.lit("S"), c("user_id")).alias("symbol"), F.when(kind == 1, F.lit("1mo")).otherwise(F.lit("1d")).alias("dataGranularity"),
                 F.lit(18000).cast("bigint").alias("gmtoffset")).alias("meta"),
        F.array(c("epoch"), c("epoch") + 86400, c("epoch") + 172800).alias("timestamp"),
        F.struct(F.when(kind == 2, F.array().cast("array<struct<close:array<double>,open:array<double>,volume:array<bigint>>>")).otherwise(F.array(F.struct(
            F.array(c("value"), F.lit(None).cast("double"), c("value") * 2).alias("close"), F.array(c("value") * 3).alias("open"),
            F.array(c("event_id"), c("event_id"), F.lit(None).cast("bigint")).alias("volume")))).alias("quote"),
            F.array(F.struct(F.array(c("value") / 2).alias("adjclose"))).alias("adjclose")).alias("indicators")))
    empty = _json(chart=F.struct(F.array().cast("array<string>").alias("result")))
    doc = F.when(kind == 3, F.lit(" <html>limit</html>")).when(kind == 4, empty).otherwise(_json(chart=F.struct(result.alias("result"))))
    return src.withColumn("doc", doc)


@query("src05_chart_bars", src=_CHART_SRC, sql="""
    SELECT event_id, 'S' || user_id AS symbol, strftime(make_timestamp((epoch + 18000 + i * 86400) * 1000000), '%Y-%m-%d') AS trade_date, CASE WHEN i = 0 THEN value * 3 ELSE 0 END AS open, CASE WHEN i = 0 THEN value ELSE value * 2 END AS close,
      CASE WHEN i = 0 THEN value / 2 END AS adj_close, CASE WHEN i = 0 THEN event_id ELSE 0 END AS volume FROM src, (VALUES (0), (2)) v(i) WHERE kind NOT IN (1, 2, 3, 4)""")
def src05(t, src):
    good, _ = dec.chart_bars(_chart_docs(src), ["event_id"], "doc")
    return good.select("event_id", "symbol", c("trade_date").cast("string").alias("trade_date"), "open", "close", "adj_close", "volume")


@query("dq12_rejected_charts", src=_CHART_SRC, sql="SELECT event_id, CASE kind WHEN 1 THEN 'granularity' WHEN 2 THEN 'no_quotes' WHEN 3 THEN 'html_body' ELSE 'no_result' END AS reason FROM src WHERE kind IN (1, 2, 3, 4)")
def dq12(t, src):
    return dec.chart_bars(_chart_docs(src), ["event_id"], "doc")[1]


@query("flt13_null_close", src=_CHART_SRC, sql="SELECT event_id, CAST(2 AS BIGINT) AS bars FROM src WHERE kind NOT IN (1, 2, 3, 4)")
def flt13(t, src):
    return dec.chart_bars(_chart_docs(src), ["event_id"], "doc")[0].groupBy("event_id").agg(F.count("*").alias("bars"))


@query("src06_vendor_bars", src="SELECT event_id, value, CAST(CAST(ts AS DATE) AS STRING) AS d FROM events", sql="""
    SELECT event_id, d AS trade_date, value AS close, CASE WHEN event_id % 2 = 0 THEN value / 4 END AS adj_close, event_id AS volume FROM src""")
def src06(t, src):
    stamp = F.when(c("event_id") % 3 == 0, F.concat(c("d"), F.lit("T00:00:00.000Z"))).when(c("event_id") % 3 == 1, F.concat(c("d"), F.lit("T10:00:00+02:00"))).otherwise(c("d"))
    doc = F.to_json(F.array(F.struct(stamp.alias("date"), c("value").alias("open"), c("value").alias("close"), c("event_id").alias("volume"),
                                     F.when(c("event_id") % 2 == 0, c("value") / 4).alias("adjClose"))))
    return dec.vendor_bars(src.withColumn("doc", doc), ["event_id"], "doc").select("event_id", "trade_date", "close", "adj_close", "volume")


@query("src07_earnings", src="SELECT event_id, value, CAST(event_id % 7 AS INT) AS q, CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS period FROM events", sql="""
    SELECT event_id, CASE WHEN q = 0 THEN 'FY' ELSE 'Q' || q END AS fiscal_period, CASE WHEN period = 'soon' THEN '' ELSE period END AS period_end, CASE WHEN q = 0 THEN 'P1Y' ELSE 'P3M' END AS duration,
      CASE WHEN period = 'soon' THEN '2024-12-31' ELSE period END AS consensus_date, value AS eps_actual FROM src WHERE q <= 4""")
def src07(t, src):
    doc = F.to_json(F.array(F.struct(c("value").alias("actual"), c("period"), F.lit(2024).alias("year"), c("q").alias("quarter"))))
    return dec.earnings_rows(src.select("event_id", doc.alias("doc")), "doc").select("event_id", "fiscal_period", "period_end", "duration", "consensus_date", "eps_actual")


@query("src08_snapshot", src="SELECT c_custkey, c_acctbal, CAST(c_custkey % 9 AS INT) AS n FROM customer", sql="""
    SELECT c_custkey, c_acctbal AS pt_mean, CAST(CASE WHEN c_custkey % 4 > 0 THEN n + 2 ELSE 0 END AS INTEGER) AS buy, CAST(CASE WHEN c_custkey % 4 > 0 THEN 3 + n ELSE 0 END AS INTEGER) AS sell, CAST(CASE WHEN c_custkey % 4 > 0 THEN 2 * n + 6 END AS INTEGER) AS analyst_count FROM src""")
def src08(t, src):
    targets = src.select("c_custkey", _json(targetMean=c("c_acctbal")).alias("doc"))
    rec = F.to_json(F.array(F.struct(c("n").alias("buy"), F.lit(2).alias("strongBuy"), F.lit(1).alias("hold"), F.lit(3).alias("sell"), c("n").alias("strongSell")), F.struct(
        F.lit(99).alias("buy"), F.lit(9).alias("strongBuy"), F.lit(9).alias("hold"), F.lit(9).alias("sell"), F.lit(9).alias("strongSell"))))
    recs = src.select("c_custkey", F.when(c("c_custkey") % 4 == 0, F.lit("[]")).otherwise(rec).alias("doc"))
    return dec.snapshot_rows(targets, recs, ["c_custkey"], "doc").select("c_custkey", "pt_mean", "buy", "sell", "analyst_count")


@query("src09_ticker_map", src="SELECT c_custkey FROM customer", sql="SELECT 'TK' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM src WHERE c_custkey % 5 > 0")
def src09(t, src):
    doc = F.to_json(F.create_map(F.lit("0"), F.struct(c("c_custkey").alias("cik_str"), F.when(c("c_custkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("tk"), c("c_custkey"))).alias("ticker"))))
    return dec.ticker_rows(src.select(doc.alias("doc")), "doc")


_XML_SRC = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100.0E0 + 0.5E0) AS BIGINT) AS cents, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM lineitem"


def _instance_docs(src):
    xml = F.concat(
        F.lit('<?xml version="1.0"?><x:xbrl xmlns:x="http://www.xbrl.org/2003/instance" xmlns:i="http://xbrl.ifrs.org/taxonomy/2023" xmlns:d="http://xbrl.sec.gov/dei/2023"><x:context id="c1"><x:entity><x:segment>'),
        F.when(c("l_partkey") % 3 == 0, F.lit('<x:explicitMember dimension="a:Axis"> co:OneMember </x:explicitMember>')).otherwise(F.lit("")),
        F.lit("</x:segment></x:entity><x:period>"),
        F.when(c("l_partkey") % 2 == 0, F.concat(F.lit("<x:startDate>2020-01-01</x:startDate><x:endDate>"), c("d"), F.lit("</x:endDate>"))).otherwise(F.concat(F.lit("<x:instant>"), c("d"), F.lit("</x:instant>"))),
        F.lit('</x:period></x:context><x:unit id="u1">'),
        F.when(c("l_linenumber") == 5, F.lit("<x:divide><x:unitNumerator><x:measure>iso4217:USD</x:measure></x:unitNumerator><x:unitDenominator><x:measure>xbrli:shares</x:measure></x:unitDenominator></x:divide>")).otherwise(F.lit("<x:measure>iso4217:usd</x:measure>")),
        F.lit("</x:unit><d:DocumentPeriodEndDate>"), c("d"), F.lit('</d:DocumentPeriodEndDate><d:DocumentFiscalPeriodFocus>Q2</d:DocumentFiscalPeriodFocus><i:Revenue contextRef="c1" unitRef="u1" decimals="-3"> 1,'),
        F.lpad((c("cents") % 1000).cast("string"), 3, "0"), F.lit('</i:Revenue><i:Revenue contextRef="c1" unitRef="u1">text</i:Revenue><i:Other contextRef="c1">7</i:Other>'),
        F.when(c("l_partkey") % 11 == 0, F.lit("<unclosed>")).otherwise(F.lit("</x:xbrl>")))
    return src.withColumn("xml", xml).withColumn("accession", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"))


_ACC_SQL = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cents AS accession"


@query("src10_tagged_facts", src=_XML_SRC, sql=f"""
    SELECT {_ACC_SQL}, 'ifrs-full:Revenue' AS element, CAST(1000 + cents % 1000 AS DOUBLE) AS value, CASE WHEN l_partkey % 2 = 0 THEN '2020-01-01' END AS start_date, CASE WHEN l_partkey % 2 = 0 THEN d END AS end_date,
      CASE WHEN l_partkey % 2 > 0 THEN d END AS instant, CAST(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_dims, CASE WHEN l_partkey % 3 = 0 THEN 'co:OneMember' END AS member, CASE WHEN l_linenumber = 5 THEN 'usd_per_share' ELSE 'usd' END AS kind FROM src""")
def src10(t, src):
    s = fx.star(mk.instance_documents(mk.instance_records(_instance_docs(src), "accession", "xml")))
    return s.select("accession", "element", "value", *[c(x).cast("string").alias(x) for x in ("start_date", "end_date", "instant")], "n_dims", "member", "kind")


@query("src10_declared_period", src=_XML_SRC, sql=f"SELECT {_ACC_SQL}, 'Q2' AS focus, d AS period_end FROM src")
def src10_dei(t, src):
    dei = mk.declared_periods(mk.instance_records(_instance_docs(src), "accession", "xml"))
    return dei.select("accession", "focus", c("period_end").cast("string").alias("period_end"))


@query("src11_choose_instance", src="""SELECT CAST(l_orderkey AS STRING) AS accession, CASE l_linenumber WHEN 1 THEN 'co-2020_htm.xml' WHEN 2 THEN 'co-2020_cal.xml' WHEN 3 THEN 'FilingSummary.xml' WHEN 4 THEN 'co-2019.xml' WHEN 5 THEN 'a-owner.xml' ELSE 'doc.htm' END AS file_name,
      CASE WHEN l_linenumber = 4 THEN '<?xml version="1.0"?><!-- <a> --><xbrli:xbrl xmlns="x">' ELSE '<ownershipDocument>' END AS head FROM lineitem""", sql="""
    SELECT accession, CASE WHEN bool_or(file_name = 'co-2020_htm.xml') THEN 'co-2020_htm.xml' ELSE 'co-2019.xml' END AS file_name FROM src GROUP BY accession HAVING bool_or(file_name IN ('co-2020_htm.xml', 'co-2019.xml'))""")
def src11(t, src):
    return mk.choose_instance(src)


def _summary_docs(src):
    report = lambda cat, name, file: F.concat(F.lit(f"<Report><ShortName>{name}</ShortName><HtmlFileName>"), F.lit(file), F.lit(f"</HtmlFileName><MenuCategory>{cat}</MenuCategory></Report>"))
    return src.withColumn("xml", F.concat(
        F.lit("<FilingSummary><MyReports>"), report("Cover", "Cover page", "R1.htm"), report("Statements", "Balance Sheet (Parenthetical)", "R3.htm"),
        F.when(c("o_orderkey") % 3 > 0, report("statements ", "CONSOLIDATED BALANCE SHEETS", "R2.htm")).otherwise(F.lit("")),
        F.concat(F.lit("<Report><ShortName>Statements of Operations</ShortName><HtmlFileName> R"), c("o_orderkey"), F.lit(".htm </HtmlFileName><MenuCategory>Statements</MenuCategory></Report>")),
        report("Statements", "Profit or Loss again", "R9.htm"), report("Statements", "Cash Flows", ""),
        F.lit("</MyReports></FilingSummary>")))


@query("src12_statement_roles", src=_ORD, sql="""
    SELECT accession, 'income' AS role, 'R' || o_orderkey || '.htm' AS file FROM src UNION ALL SELECT accession, 'balance', 'R2.htm' FROM src WHERE o_orderkey % 3 > 0""")
def src12(t, src):
    return mk.statement_roles(_summary_docs(src), ["accession"], "xml")


@query("dq07_role_notes", src=_ORD, sql="""
    SELECT accession, 'cashFlow' AS role, 'detector_F_role_unresolved: no cashFlow statement' AS note FROM src UNION ALL SELECT accession, 'balance', 'detector_F_role_unresolved: no balance statement' FROM src WHERE o_orderkey % 3 = 0
    UNION ALL SELECT accession, 'income', 'R' || o_orderkey || '.htm: no scale in caption, assumed thousands' FROM src WHERE o_orderkey % 4 = 0""")
def dq07(t, src):
    roles = mk.statement_roles(_summary_docs(src), ["accession"], "xml")
    scales = src.select("accession", F.concat(F.lit("R"), c("o_orderkey"), F.lit(".htm")).alias("file"), (c("o_orderkey") % 4 == 0).alias("scale_assumed"))
    return mk.role_notes(src, roles, scales)


@query("src13_rendered_rows", src="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, 'ifrs-full:Revenue' AS element, 'Total & net' AS label, '$ ' || l_partkey || ',000|(' || l_suppkey || ')' AS vals, CASE WHEN l_partkey % 3 = 0 THEN 1e6 ELSE 1e3 END AS scale, l_partkey % 3 = 1 AS scale_assumed,
      CAST(l_partkey AS DOUBLE) * 1000 * CASE WHEN l_partkey % 3 = 0 THEN 1e6 ELSE 1e3 END AS scaled FROM src""")
def src13(t, src):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]
    html = F.concat(
        F.lit("<script>var a='<tr><td>1</td></tr>';</script><table><tr class='h'><th>Income "),
        F.when(c("l_partkey") % 3 == 0, F.lit("USD ($) $ in Millions")).when(c("l_partkey") % 3 == 1, F.lit("no scale")).otherwise(F.lit("- $ in Thousands")),
        F.lit("</th><th>2020</th></tr><tr><td>Heading only</td><td>5</td></tr><tr><td><a onclick=\"show('defref_ifrs-full_Revenue')\">Total &amp; \n net</a></td><td>&nbsp;</td><td>[1]</td><td>$ "),
        c("l_partkey"), F.lit(",000&#160;</td><td>("), c("l_suppkey"), F.lit(")</td></tr></table>"))
    html = F.regexp_replace(html, r"\[1\]", "note")
    rows = mk.rendered_rows_with_values(src.withColumn("html", html), keys, "html")
    return rows.select(*keys, "element", "label", F.array_join("values", "|").alias("vals"), "scale", "scale_assumed", "scaled")


@query("src14_exhibit_header", src="SELECT doc_id, text, source FROM documents", sql="""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'EX-99.1' ELSE '6-K' END AS doc_type, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || source || '|Second' ELSE '' END AS titles FROM src""")
def src14(t, src):
    doc = F.concat(F.lit("<DOCUMENT>\n<type>"), F.when(c("doc_id") % 3 == 0, F.lit("EX-99.1")).otherwise(F.lit("6-K")), F.lit(" \n<DESCRIPTION>Title "), c("source"),
                   F.lit("\n<TEXT>"), c("text"), F.lit("\n<DESCRIPTION> Second \n<DESCRIPTION>Title "), c("source"), F.lit("\n<DESCRIPTION> \n"))
    return src.select("doc_id", mk.exhibit_header(doc).alias("h")).select("doc_id", "h.doc_type", F.array_join("h.titles", "|").alias("titles"))


@query("src15_ownership", src="SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders", sql="""
    SELECT o_orderkey, CASE WHEN k = 3 THEN NULL WHEN k = 1 THEN 'Rep ' || o_custkey ELSE 'Own ' || o_custkey END AS person, CASE WHEN k = 0 THEN 'CFO' END AS title, CASE WHEN k = 3 THEN NULL WHEN k = 2 THEN 'S' ELSE 'A' END AS code,
      CASE WHEN k <> 3 THEN CAST(o_orderkey AS VARCHAR) END AS shares, CASE WHEN k <> 3 THEN d END AS transaction_date FROM src""")
def src15(t, src):
    k = c("k")
    xml = F.concat(
        F.lit('<o:ownershipDocument xmlns:o="urn:o">'),
        F.when(k == 1, F.concat(F.lit("<o:reportingPersonName> Rep "), c("o_custkey"), F.lit(" </o:reportingPersonName>"))).otherwise(F.concat(F.lit("<o:rptOwnerName>Own "), c("o_custkey"), F.lit("</o:rptOwnerName>"))),
        F.when(k == 0, F.lit("<o:officerTitle>CFO</o:officerTitle>")).otherwise(F.lit("<o:officerTitle> </o:officerTitle>")),
        F.when(k == 2, F.lit("<o:transactionCode>S</o:transactionCode>")).otherwise(F.lit("<o:transactionAcquiredDisposedCode><o:value>A</o:value></o:transactionAcquiredDisposedCode>")),
        F.lit("<o:transactionShares>\n<o:value>"), c("o_orderkey"), F.lit("</o:value></o:transactionShares><o:periodOfReport>"), c("d"), F.lit("</o:periodOfReport>"),
        F.when(k == 3, F.lit("<broken>")).otherwise(F.lit("</o:ownershipDocument>")))
    return src.select("o_orderkey", mk.ownership(xml).alias("o")).select("o_orderkey", "o.person", "o.title", c("o.transaction_code").alias("code"), "o.shares", "o.transaction_date")


@query("src16_body_snippet", src="SELECT page_id, url, html FROM pages", sql=r"""
    WITH x AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS txt FROM src)
    SELECT page_id, lower(substr(txt, 1, 2000)) AS snippet FROM x WHERE length(txt) > 80""")
def src16(t, src):
    docs = src.select("page_id", F.lit(1).alias("position"), "html").unionByName(src.select("page_id", F.lit(0).alias("position"), F.lit("<p>short</p>").alias("html")))
    return mk.body_snippets(docs, ["page_id"], ["position"], "html")


@query("src16_folder_snippet", src="SELECT page_id, html FROM pages", sql=r"""
    WITH x AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS txt FROM src),
    y AS (SELECT page_id, txt, trim('Body ' || txt) AS other FROM x)
    SELECT page_id, lower(substr(CASE WHEN page_id % 3 = 0 AND length(other) > 80 THEN other WHEN length(txt) > 80 THEN txt WHEN length(other) > 80 THEN other ELSE '' END, 1, 2000)) AS snippet FROM y""")
def src16_folder(t, src):
    named = F.when(c("page_id") % 3 == 0, "b.html").when(c("page_id") % 3 == 1, "missing.htm")
    files = F.array(*(F.struct(F.lit(n).alias("name"), x.alias("html")) for n, x in (
        ("z.htm", c("html")), ("a.htm", F.lit("<p>short</p>")), ("a-index.html", F.lit("<p>" + "index " * 30 + "</p>")),
        ("b.html", F.concat(F.lit("<div>Body </div>"), c("html"))), ("a.txt", c("html")))))
    return mk.folder_snippets(src.select("page_id", named.alias("primary"), F.inline(files)), ["page_id"], "name", "primary", "html")


@query("src17_whole_texts", sql="SELECT doc_id, lang, length(text) AS chars, strlen(text) AS bytes, sha256(text) AS content_hash, len(string_split(text, chr(10))) AS lines FROM documents")
def src17(t):
    return t.documents.select("doc_id", "lang", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"),
                              F.sha2("text", 256).alias("content_hash"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("lines"))


@query("src18_graded_artifacts", src=_ORD, sql="""
    SELECT accession, 'income' AS statement, 'total_revenues' AS key, o_totalprice AS value, 'verified' AS confidence FROM src WHERE o_orderkey % 3 = 0 UNION ALL SELECT accession, 'balance', 'cash_and_equivalents', o_totalprice / 2, 'suspect' FROM src WHERE o_orderkey % 3 = 0""")
def src18(t, src):
    line = lambda k, v, conf: F.array(F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(conf).alias("confidence")))
    doc = _json(version=F.lit(1), statements=F.struct(line("total_revenues", c("o_totalprice"), "verified").alias("income"), line("cash_and_equivalents", c("o_totalprice") / 2, "suspect").alias("balance")))
    artifacts = src.where("o_orderkey % 3 = 0").select("accession", F.from_json(doc, rd.FINANCIALS).alias("financials"))
    return rd.financial_lines(src.select("accession").join(artifacts, "accession", "left"), ["accession"]).select("accession", "statement", "key", "value", "confidence")


@query("src19_table_reads", views="bars", sql="SELECT cik, trade_date::VARCHAR AS trade_date, close, coalesce(adj_close, 0) AS adj_close, coalesce(volume, 0) AS volume FROM bars WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def src19(t):
    rng = c("trade_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))
    return t.bars.where(rng).select("cik", c("trade_date").cast("string").alias("trade_date"), "close", F.coalesce("adj_close", F.lit(0.0)).alias("adj_close"), F.coalesce("volume", F.lit(0)).alias("volume"))


_LINE_SRC = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'note ' ELSE 'PROGRESS ' END || event_type || '  ' || CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 5 = 1 THEN '-3' ELSE CAST(event_id % 40 AS STRING) END || ' ' || CAST(user_id % 20 AS STRING) AS line FROM events"""


@query("src20_progress_lines", src=_LINE_SRC, sql="""
    WITH p AS (SELECT event_id, string_split_regex(line, '\\s+') AS w FROM src)
    SELECT event_id, w[2] AS stage, CAST(greatest(0, least(TRY_CAST(w[3] AS INTEGER), CAST(w[4] AS INTEGER))) AS INTEGER) AS done, CAST(w[4] AS INTEGER) AS total FROM p WHERE w[1] = 'PROGRESS' AND TRY_CAST(w[3] AS INTEGER) IS NOT NULL AND CAST(w[4] AS INTEGER) > 0""".replace("\\\\", "\\"))
def src20(t, src):
    return ac.progress_rows(src, "line").select("event_id", "stage", "done", "total")


@query("src21_peer_list", src="SELECT c_custkey, c_name FROM customer", sql="""
    SELECT c_custkey, c_name || '-' || i AS peer, i = 1 AND c_custkey % 2 = 0 AS fetch FROM src, (VALUES (0), (1)) v(i)""")
def src21(t, src):
    peers = F.array(F.struct(F.concat(c("c_name"), F.lit("-0")).alias("company_name"), F.lit(None).cast("boolean").alias("fetch")),
                    F.struct(F.concat(c("c_name"), F.lit("-1")).alias("company_name"), (c("c_custkey") % 2 == 0).alias("fetch")))
    docs = src.select("c_custkey", _json(company_name=c("c_name"), similar_companies=peers).alias("doc"))
    return dec.peer_rows(docs, ["c_custkey"], "doc").select("c_custkey", c("company_name").alias("peer"), "fetch")


@query("src22_targets", views="companies", sql="""
    SELECT cik, 'corpus' AS mode, ticker_a AS ticker, fye FROM companies WHERE ticker_a <> '' UNION ALL
    SELECT cik, 'peers', 'OVR' || cik_no, CASE WHEN fye = '' THEN '1231' ELSE fye END FROM companies WHERE cik_no % 4 = 0""")
def src22(t):
    cos = t.companies.withColumn("tickers", F.array("ticker_a", "ticker_b"))
    given = t.companies.where("cik_no % 4 = 0").select("cik", F.concat(F.lit("OVR"), c("cik_no")).alias("ticker"))
    a = fl.resolve_targets(cos).select("cik", F.lit("corpus").alias("mode"), "ticker", "fye")
    b = fl.resolve_targets(cos, given, "1231").select("cik", F.lit("peers").alias("mode"), "ticker", "fye")
    return a.unionByName(b)
