"""Decoders of vendor and index JSON documents: one document column in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.ids import normalize_cik
from tidemark.functions.periods import exchange_date, quarter_label

c = F.col

SUBMISSIONS = """cik string, name string, sic string, sicDescription string, category string, phone string,
    tickers array<string>, exchanges array<string>, fiscalYearEnd string, stateOfIncorporationDescription string,
    addresses struct<business: struct<city: string, stateOrCountryDescription: string>,
                     mailing: struct<city: string, stateOrCountryDescription: string>>,
    formerNames array<struct<name: string>>,
    filings struct<recent: struct<accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>,
                                  form: array<string>, primaryDocument: array<string>, size: array<bigint>,
                                  isXBRL: array<int>, isInlineXBRL: array<int>>,
                   files: array<struct<name: string>>>"""
COMPANY_FACTS = """cik bigint, entityName string, facts map<string, map<string, struct<units: map<string, array<struct<
    start: string, `end`: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>>>>>>"""
CHART = """chart struct<result: array<struct<
    meta: struct<currency: string, symbol: string, exchangeName: string, dataGranularity: string, gmtoffset: bigint, firstTradeDate: bigint>,
    timestamp: array<bigint>,
    indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>,
                       adjclose: array<struct<adjclose: array<double>>>>>>>"""
VENDOR_BARS = "array<struct<date: string, open: double, high: double, low: double, close: double, volume: bigint, adjClose: double>>"
EARNINGS = "array<struct<actual: double, estimate: double, surprise: double, surprisePercent: double, period: string, year: int, quarter: int>>"
TARGETS = "targetHigh double, targetLow double, targetMean double, targetMedian double"
RECOMMENDATIONS = "array<struct<buy: int, hold: int, sell: int, strongBuy: int, strongSell: int, period: string>>"
TICKER_MAP = "map<string, struct<cik_str: bigint, ticker: string>>"
PEERS = """company_name string, company_id string, ticker string, similar_companies array<struct<company_name: string, company_id: string,
    ticker: string, relation_type: string, description: string, `fetch`: boolean>>"""


def company_index(docs: DataFrame, folder: str, text: str) -> DataFrame:
    """Companies from submission documents; folders that are no company key and unreadable documents are skipped."""
    return (docs.withColumn("cik", normalize_cik(c(folder))).withColumn("doc", F.from_json(c(text), SUBMISSIONS))
            .where("cik IS NOT NULL AND doc IS NOT NULL AND doc.name IS NOT NULL")
            .select("cik", c("doc.name").alias("name"), F.coalesce("doc.tickers", F.array().cast("array<string>")).alias("tickers"),
                    F.coalesce("doc.exchanges", F.array().cast("array<string>")).alias("exchanges"), c("doc.sic").alias("sic"),
                    c("doc.fiscalYearEnd").alias("fye"), c("doc.addresses").alias("addresses"), c("doc.formerNames").alias("formerNames"),
                    F.size(F.coalesce("doc.filings.files", F.array())).alias("older_pages")))


def index_rows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Index entries from the parallel arrays of submission documents; short arrays give "" and 0."""
    r = c("_d.filings.recent")
    fields = {"accession": "accessionNumber", "filing_date": "filingDate", "report_date": "reportDate", "form": "form",
              "primary_document": "primaryDocument", "size": "size", "is_xbrl": "isXBRL", "is_inline_xbrl": "isInlineXBRL"}
    n = F.size(F.coalesce(r["accessionNumber"], F.array().cast("array<string>")))
    row = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        *[F.coalesce(F.get(r[src], i), F.lit(0 if src in ("size", "isXBRL", "isInlineXBRL") else "")).alias(dst)
          for dst, src in fields.items()]))
    return (docs.withColumn("_d", F.from_json(c(text), SUBMISSIONS)).where(n > 0)
            .select(*keys, F.inline(row)))


def company_fact_rows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Facts from Company Facts documents: namespace, concept, unit and entry, one row each."""
    d = docs.select(*keys, F.from_json(c(text), COMPANY_FACTS).alias("_d"))
    ns = d.select(*keys, F.explode("_d.facts").alias("namespace", "_c"))
    con = ns.select(*keys, "namespace", F.explode("_c").alias("concept", "_u"))
    uni = con.select(*keys, "namespace", "concept", F.explode("_u.units").alias("unit", "_e"))
    return (uni.select(*keys, "namespace", "concept", "unit", F.inline("_e"))
            .withColumn("start_date", F.try_to_date("start")).withColumn("end_date", F.try_to_date("end"))
            .withColumnRenamed("accn", "accession").drop("start", "end"))


def chart_problem(text: Column, parsed: Column) -> Column:
    """Why a chart document must not be read; NULL when it may."""
    first = F.get(parsed["chart"]["result"], F.lit(0))
    return (F.when(F.startswith(F.ltrim(text), F.lit("<")), F.lit("html_body"))
            .when(F.coalesce(F.size(parsed["chart"]["result"]), F.lit(0)) <= 0, F.lit("no_result"))
            .when(F.coalesce(F.size(first["indicators"]["quote"]), F.lit(0)) <= 0, F.lit("no_quotes"))
            .when(F.coalesce(first["meta"]["dataGranularity"], F.lit("")) != "1d", F.lit("granularity")))


def chart_bars(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars of good chart documents, and the rejected documents with the reason."""
    d = docs.withColumn("_p", F.from_json(c(text), CHART))
    d = d.withColumn("reason", chart_problem(c(text), c("_p")))
    r, q = F.get("_p.chart.result", F.lit(0)), F.get(F.get("_p.chart.result", F.lit(0))["indicators"]["quote"], F.lit(0))
    adj = F.get(r["indicators"]["adjclose"], F.lit(0))["adjclose"]
    stamps = F.coalesce(r["timestamp"], F.array().cast("array<bigint>"))
    rows = F.transform(stamps, lambda ts, i: F.struct(
        exchange_date(ts, F.coalesce(r["meta"]["gmtoffset"], F.lit(0))).alias("trade_date"),
        *[F.coalesce(F.get(q[x], i), F.lit(0.0)).alias(x) for x in ("open", "high", "low")], F.get(q["close"], i).alias("close"),
        F.get(adj, i).alias("adj_close"), F.coalesce(F.get(q["volume"], i), F.lit(0)).alias("volume")))
    good = d.where("reason IS NULL").select(*keys, r["meta"]["symbol"].alias("symbol"), r["meta"]["currency"].alias("currency"), F.inline(rows))
    return good.where("close IS NOT NULL"), d.where("reason IS NOT NULL").select(*keys, "reason")


def vendor_bars(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Daily bars of the second vendor; the first ten characters of the date count."""
    d = docs.select(*keys, F.inline(F.from_json(c(text), VENDOR_BARS)))
    return d.select(*keys, F.substring("date", 1, 10).alias("trade_date"), "open", "high", "low", "close", c("adjClose").alias("adj_close"), "volume")


def earnings_rows(docs: DataFrame, text: str) -> DataFrame:
    """Estimate rows from vendor earnings documents; quarter 0 is the year, other quarters outside 1 to 4 are dropped."""
    rest = [x for x in docs.columns if x != text]
    d = docs.select(*rest, F.inline(F.from_json(c(text), EARNINGS)))
    period = F.when(c("quarter") == 0, F.lit("FY")).otherwise(quarter_label(c("quarter")))
    end = F.when(F.try_to_date("period", "yyyy-MM-dd").isNotNull(), c("period")).otherwise(F.lit(""))
    return (d.withColumn("fiscal_period", period).where("fiscal_period IS NOT NULL").withColumn("period_end", end)
            .withColumn("fiscal_year", c("year").cast("string"))
            .withColumn("duration", F.when(c("fiscal_period") == "FY", F.lit("P1Y")).otherwise(F.lit("P3M")))
            .withColumn("consensus_date", F.when(c("period_end") != "", c("period_end")).otherwise(F.concat(F.lpad(c("fiscal_year"), 4, "0"), F.lit("-12-31"))))
            .select(*rest, "fiscal_year", "fiscal_period", "period_end", "duration", "consensus_date", c("estimate").alias("eps_estimate"),
                    c("actual").alias("eps_actual"), c("surprise").alias("eps_surprise"), c("surprisePercent").alias("eps_surprise_pct"),
                    F.lit("USD").alias("currency")))


def snapshot_rows(targets: DataFrame, recommendations: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Price targets with the first recommendation counts; strong votes count with their side."""
    t = targets.select(*keys, F.from_json(c(text), TARGETS).alias("t"))
    r = recommendations.select(*keys, F.get(F.from_json(c(text), RECOMMENDATIONS), F.lit(0)).alias("r"))
    n = lambda x: F.coalesce(c(f"r.{x}"), F.lit(0))
    some = c("r").isNotNull()
    buy, hold, sell = n("buy") + n("strongBuy"), n("hold"), n("sell") + n("strongSell")
    return t.join(r, keys, "left").select(
        *keys, c("t.targetMean").alias("pt_mean"), c("t.targetHigh").alias("pt_high"), c("t.targetLow").alias("pt_low"), c("t.targetMedian").alias("pt_median"),
        buy.alias("buy"), hold.alias("hold"), sell.alias("sell"), F.when(some, buy + hold + sell).alias("analyst_count"))


def ticker_rows(docs: DataFrame, text: str) -> DataFrame:
    """Ticker to company key; blank tickers are dropped."""
    d = docs.select(F.explode(F.from_json(c(text), TICKER_MAP)).alias("_k", "v"))
    return (d.where(F.coalesce(c("v.ticker"), F.lit("")) != "")
            .select(F.upper("v.ticker").alias("ticker"), F.lpad(c("v.cik_str").cast("string"), 10, "0").alias("cik")))


def peer_rows(docs: DataFrame, keys: list[str], text: str, on_empty: str = "error") -> DataFrame:
    """Peers of each list with ``fetch`` false where it is not given; an empty list is an error (or skipped)."""
    d = docs.withColumn("_d", F.from_json(c(text), PEERS))
    peers = c("_d.similar_companies")
    if on_empty == "error":
        peers = F.when(F.coalesce(F.size(peers), F.lit(0)) <= 0, F.raise_error(F.lit("peer list is empty"))).otherwise(peers)
    return (d.select(*keys, F.inline(peers)).withColumn("fetch", F.coalesce("fetch", F.lit(False))))
