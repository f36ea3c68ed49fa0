"""Queries over daily bars: coverage and download planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.amounts import adjusted_or_raw  # noqa: F401
from tidemark.operators import filings as fl, prices as pr
from tidemark.plans.filings import _ON_DISK, as_of
from tidemark.registry import query

c = F.col

# Coverage rows: one per user, with the state its last fetch left behind.
_COV_SRC = """SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, user_id, CASE user_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'no_symbol' WHEN 3 THEN 'ok' WHEN 4 THEN 'not_found' ELSE CAST(NULL AS STRING) END AS status,
    CASE WHEN user_id % 6 = 3 AND user_id % 4 = 3 THEN CAST(NULL AS DATE) ELSE min(CAST(ts AS DATE)) END AS earliest, max(CAST(ts AS DATE)) AS latest, max(ts) AS last_attempt_at, CASE WHEN user_id % 3 = 0 THEN max(ts) END AS last_success_at,
    make_date(2024, 1, 5) AS want_from, CASE WHEN user_id % 5 = 0 THEN make_date(2024, 1, 20) ELSE make_date(2024, 2, 10) END AS want_to FROM events GROUP BY user_id"""
_NOW = "2024-01-30 03:00:00"


def now():
    return F.lit(_NOW).cast("timestamp")


def _ts(src):
    return src.withColumn("last_attempt_at", c("last_attempt_at").cast("timestamp")).withColumn("last_success_at", c("last_success_at").cast("timestamp"))


_MAY = f"(status IS NULL OR status = 'ok' OR date_diff('microsecond', last_attempt_at, TIMESTAMP '{_NOW}') >= 21600000000)"


@query("flt10_retry_gate", src=_COV_SRC, sql=f"SELECT cik, {_MAY} AS may_retry, coalesce(date_diff('microsecond', last_success_at, TIMESTAMP '{_NOW}') < 86400000000, false) AS recent FROM src")
def flt10(t, src):
    s = _ts(src)
    return s.select("cik", pr.retry_allowed(c("status"), c("last_attempt_at"), now()).alias("may_retry"), pr.recently_done(c("last_success_at"), now()).alias("recent"))


@query("jn21_covers_window", src=_COV_SRC, sql="SELECT cik, coalesce(status = 'ok' AND earliest <= want_from AND latest >= want_to, false) AS covered FROM src")
def jn21(t, src):
    return src.select("cik", pr.covers(c("status"), c("earliest"), c("latest"), c("want_from"), c("want_to")).alias("covered"))


_ACT = f"CASE WHEN status = 'ok' AND earliest IS NOT NULL AND earliest <= want_from AND latest >= want_to THEN 'none' WHEN NOT {_MAY} THEN 'wait' WHEN status = 'ok' AND earliest IS NOT NULL THEN 'delta' ELSE 'backfill' END"


@query("cov01_price_action", src=_COV_SRC, sql=f"SELECT cik, {_ACT} AS action FROM src")
def cov01(t, src):
    return pr.price_action(_ts(src), now()).select("cik", "action")


@query("cov02_delta_range", src=_COV_SRC, sql=f"SELECT cik, (latest + 1)::VARCHAR AS date_from, '2024-01-30' AS date_to FROM src WHERE latest + 1 <= DATE '2024-01-30'")
def cov02(t, src):
    return pr.delta_ranges(src, now()).select("cik", c("from").cast("string").alias("date_from"), c("to").cast("string").alias("date_to"))


@query("cov03_backward_chunks", src="SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS cik, CASE WHEN c_custkey % 3 = 0 THEN make_date(2024, 2, 29) ELSE make_date(2024, 7, 15) END AS to_date, CASE WHEN c_custkey % 7 = 2 THEN CAST(NULL AS DATE) ELSE make_date(CAST(1980 + c_custkey % 45 AS INT), CAST(1 + c_custkey % 12 AS INT), 3) END AS first_trade FROM customer", sql="""
    WITH RECURSIVE w(cik, first_trade, chunk, e, s, open_ended) AS (SELECT cik, coalesce(first_trade, DATE '1970-01-01'), 0, to_date, make_date(year(to_date) - 5, month(to_date), 1) + (CAST(day(to_date) AS INT) - 1), first_trade IS NULL FROM src UNION ALL
      SELECT cik, first_trade, chunk + 1, s - 1, make_date(year(s - 1) - 5, month(s - 1), 1) + (CAST(day(s - 1) AS INT) - 1), open_ended FROM w WHERE s > first_trade)
    SELECT cik, CAST(chunk AS INTEGER) AS chunk, s::VARCHAR AS chunk_from, e::VARCHAR AS chunk_to, open_ended FROM w""")
def cov03(t, src):
    return pr.backward_chunks(src, "to_date", "first_trade", 5, "1970-01-01").select("cik", c("chunk").cast("int").alias("chunk"), c("chunk_from").cast("string").alias("chunk_from"), c("chunk_to").cast("string").alias("chunk_to"), "open_ended")


@query("cov04_step_outcome", src=_COV_SRC, views="bars", sql="""
    SELECT s.cik, CASE WHEN status = 'ok' THEN 'ok' WHEN status = 'no_symbol' THEN 'skipped' ELSE 'error' END AS result, coalesce(n, 0) AS bars FROM src s LEFT JOIN (SELECT cik, count(*) AS n FROM bars GROUP BY cik) b USING (cik)""")
def cov04(t, src):
    return pr.step_outcome(src, t.bars)


@query("cov06_need_flags", views="filings", sql=f"""
    WITH d AS (SELECT cik, filing_no FROM filings WHERE filing_no IN ({_ON_DISK})) SELECT cik, bool_or(year >= 1996 AND filing_no NOT IN (SELECT filing_no FROM d)) AS fetch_needed, bool_or(filing_no IN (SELECT filing_no FROM d) AND filing_no % 3 = 0) AS meta_needed FROM filings GROUP BY cik""")
def cov06(t):
    disk = t.filings.join(t.lineitem.where("l_linenumber <= 2").select(c("l_orderkey").alias("filing_no")), "filing_no", "left_semi")
    return fl.step_needs(t.filings, disk, disk.where("filing_no % 3 > 0"), as_of(), 5)


_CHUNK_SRC = "SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, day(ts) AS chunk, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'not_found' ELSE 'ok' END AS result, CASE WHEN event_type IN ('view') AND user_id % 3 = 0 THEN event_id ELSE 0 END AS bars FROM events"


@query("cov07_chunk_status", src=_CHUNK_SRC, sql="SELECT cik, CASE WHEN max(bars) > 0 THEN 'ok' WHEN bool_or(result = 'not_found') THEN 'not_found' ELSE 'error' END AS status, CAST(sum(bars) AS BIGINT) AS bars FROM src GROUP BY cik")
def cov07(t, src):
    return pr.chunk_status(src)


@query("agg10_price_coverage", views="bars", sql="SELECT cik, min(trade_date)::VARCHAR AS earliest, max(trade_date)::VARCHAR AS latest, count(*) AS n FROM bars GROUP BY cik")
def agg10(t):
    return pr.bar_coverage(t.bars).select("cik", c("earliest").cast("string").alias("earliest"), c("latest").cast("string").alias("latest"), "n")


@query("top10_price_order", views="bars", sql="SELECT cik, trade_date::VARCHAR AS trade_date, close FROM bars WHERE trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def top10(t):
    rng = c("trade_date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return t.bars.where(rng).orderBy("cik", "trade_date").select("cik", c("trade_date").cast("string").alias("trade_date"), "close")


@query("set02_fallback_source", views="bars", sql="""
    WITH p AS (SELECT cik, trade_date, close FROM bars WHERE (day(trade_date) // 10) % 2 = 0), s AS (SELECT DISTINCT cik, trade_date FROM p) SELECT cik, trade_date::VARCHAR AS trade_date, close, 'primary' AS source FROM p
    UNION ALL SELECT cik, trade_date::VARCHAR, close * 2, 'fallback' FROM bars b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cik = b.cik AND s.trade_date = b.trade_date)""")
def set02(t):
    tens = F.floor(F.dayofmonth("trade_date") / 10)
    primary = t.bars.where(tens % 2 == 0).select("cik", "trade_date", "close")
    fallback = t.bars.select("cik", "trade_date", (c("close") * 2).alias("close"))
    return pr.with_fallback(primary, fallback, ["cik", "trade_date"]).withColumn("trade_date", c("trade_date").cast("string"))
