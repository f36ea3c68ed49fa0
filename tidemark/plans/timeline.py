"""Queries over company timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import facts as fx, filings as fl, prices as pr, timeline as tl
from tidemark.plans.scalars import METRICS_SQL, RULES_SQL, format_sql
from tidemark.registry import query

c = F.col

# Filings of a user's company on the event calendar: events are filings, days are bars.
_EV_SRC = """SELECT event_id AS accession, lpad(CAST(user_id AS STRING), 10, '0') AS cik, CAST(ts AS DATE) AS filing_date,
    CASE event_id % 9 WHEN 0 THEN 'quarterly_results' WHEN 1 THEN 'annual_report' WHEN 2 THEN 'business_deal' WHEN 3 THEN 'governance' WHEN 4 THEN 'insider_trade' WHEN 5 THEN 'current_report'
      WHEN 6 THEN 'annual_guidance' ELSE 'unknown' END AS category,
    CASE event_id % 9 WHEN 0 THEN 'major' WHEN 1 THEN 'major' WHEN 2 THEN 'major' WHEN 3 THEN 'medium' WHEN 5 THEN 'medium' WHEN 6 THEN 'major' ELSE 'minor' END AS weight,
    'Q' || CAST(1 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 4 AS STRING) AS q, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, value, event_type FROM events"""
# Trading days: every bar counts, moved to an even day of the month up to the 26th, so that some events fall between days and after the last.
_EARLY = "CASE WHEN day(trade_date) > 26 THEN trade_date - 14 ELSE trade_date END"
_DAYS = f"SELECT DISTINCT cik, d + CAST(day(d) % 2 AS INT) AS trade_date FROM (SELECT cik, {_EARLY} AS d FROM bars) x"
_SNAP_CTE = f"""days AS ({_DAYS}), sn AS (SELECT s.*, (SELECT min(d.trade_date) FROM days d WHERE d.cik = s.cik AND d.trade_date >= s.filing_date) AS snapped FROM src s)"""


def _days(t):
    return t.select(_DAYS, "bars")


@query("jn12_next_trading_day", src=_EV_SRC, views="bars", sql=f"WITH {_SNAP_CTE} SELECT accession, snapped::VARCHAR AS snapped FROM sn WHERE snapped IS NOT NULL")
def jn12(t, src):
    return tl.snap_forward(src, _days(t)).select("accession", c("snapped").cast("string").alias("snapped"))


@query("win14_report_days", src=_EV_SRC, views="bars", sql=f"WITH {_SNAP_CTE} SELECT DISTINCT cik, snapped::VARCHAR AS snapped FROM sn WHERE snapped IS NOT NULL AND category IN ('quarterly_results', 'annual_report')")
def win14(t, src):
    return tl.report_days(tl.snap_forward(src, _days(t))).select("cik", c("snapped").cast("string").alias("snapped"))


@query("win06_lane_slots", src=_EV_SRC, views="bars", sql=f"""
    WITH {_SNAP_CTE}, l AS (SELECT *, CASE WHEN category IN ('quarterly_results', 'annual_report') THEN 'financial' ELSE 'general' END AS lane FROM sn WHERE snapped IS NOT NULL)
    SELECT accession, lane, row_number() OVER (PARTITION BY cik, snapped, lane ORDER BY CASE WHEN lane = 'financial' THEN category ELSE CASE weight WHEN 'major' THEN '0' WHEN 'medium' THEN '1' ELSE '2' END END, accession) - 1 AS slot, count(*) OVER (PARTITION BY cik, snapped, lane) AS day_count FROM l""")
def win06(t, src):
    return tl.lane_slots(tl.snap_forward(src, _days(t))).select("accession", "lane", c("slot").cast("bigint").alias("slot"), "day_count")


_BOUND_SQL = """WITH sp AS (SELECT cik, min(d) AS lo, max(d) AS hi FROM {src} GROUP BY cik), m AS (SELECT s.cik, CASE WHEN date_diff('day', lo, hi) > 730 THEN date_trunc('year', d) ELSE date_trunc('month', d) END AS p, min(d) AS b FROM {src} s JOIN sp USING (cik) GROUP BY ALL)
    SELECT cik, b::VARCHAR AS boundary FROM m UNION SELECT cik, lo::VARCHAR FROM sp UNION SELECT cik, hi::VARCHAR FROM sp"""


@query("win10_month_boundaries", views="bars", sql=_BOUND_SQL.format(src="(SELECT cik, trade_date AS d FROM bars)"))
def win10(t):
    return tl.period_boundaries(t.bars).select("cik", c("boundary").cast("string").alias("boundary"))


@query("set07_year_boundaries", views="filings", sql=_BOUND_SQL.format(src="(SELECT cik, filing_date AS d FROM filings)"))
def set07(t):
    return tl.period_boundaries(t.filings.withColumn("trade_date", c("filing_date"))).select("cik", c("boundary").cast("string").alias("boundary"))


_LADDER = "[1.0::DOUBLE, 2.5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000, 20000, 25000, 50000, 100000, 200000, 250000, 500000, 1000000, 2000000, 2500000, 5000000, 10000000, 20000000, 25000000, 50000000, 100000000, 200000000, 250000000, 500000000]"


@query("agg25_volume_axis", views="bars", sql=f"""
    WITH a AS (SELECT cik, max(volume) FILTER (volume > 0)::DOUBLE AS hi, min(volume) FILTER (volume > 0)::DOUBLE AS lo FROM bars GROUP BY cik),
    b AS (SELECT cik, coalesce(hi, 0) AS top, coalesce(lo * 0.85::DOUBLE, 1) AS low FROM a), e AS (SELECT *, least(greatest(top * 10, CASE WHEN top > 0 THEN top ELSE 1 END), 500e6::DOUBLE) AS cap FROM b),
    g AS (SELECT *, list_filter({_LADDER}, lambda x: x <= cap) AS st FROM e)
    SELECT cik, low, CASE WHEN top > 0 THEN top * 1.05::DOUBLE ELSE 1 END AS linear_max, coalesce(list_max(list_filter(st, lambda x: x <= low)), st[1], 1) AS axis_min, coalesce(list_min(list_filter(st, lambda x: x > top)), list_max(st), cap) AS axis_max FROM g""")
def agg25(t):
    return tl.volume_axis(t.bars)


# ---- highlights from graded lines ----

_LINE_SRC = """SELECT accession, CASE line_no WHEN 1 THEN 'total_revenues' WHEN 2 THEN 'cost_of_revenues' WHEN 4 THEN 'net_income' WHEN 5 THEN 'eps_basic' WHEN 6 THEN 'cash_and_equivalents' ELSE 'total_assets' END AS key,
    CASE WHEN line_no = 5 THEN 'USD/share' ELSE 'USD' END AS metric_unit, price * 101.0E0 AS value, CASE WHEN part_no % 3 = 0 THEN (CAST(supp_no AS DOUBLE) - 40.0E0) / 8.0E0 END AS yoy,
    CASE WHEN part_no % 2 = 0 THEN price * 97.0E0 END AS prior_value, CASE WHEN part_no % 5 > 0 THEN 'vs 1997-12-31' ELSE '' END AS prior_label,
    CASE WHEN part_no % 7 = 0 THEN 'suspect' ELSE 'verified' END AS confidence, part_no * 1000000 + supp_no * 100 + line_no AS position FROM fact_lines"""
_HL_CTE = f"""pub AS (SELECT * FROM src WHERE confidence = 'verified' QUALIFY row_number() OVER (PARTITION BY accession, key ORDER BY position, value) = 1),
    hl AS (SELECT p.*, d.display, d.metric_rank, {format_sql('value', 'p.metric_unit')} || CASE WHEN yoy IS NOT NULL THEN ' (' || CASE WHEN yoy < 0 THEN '-' ELSE '+' END || printf('%.1f', abs(yoy)) || '% YoY)'
        WHEN prior_label <> '' AND prior_value IS NOT NULL THEN ' (' || prior_label || ': ' || {format_sql('prior_value', 'p.metric_unit')} || ')' ELSE '' END AS txt FROM pub p JOIN {METRICS_SQL} ON d.key = p.key WHERE d.metric_rank < 5),
    hs AS (SELECT accession, string_agg(display || '=' || txt, '; ' ORDER BY metric_rank) AS highlights FROM hl GROUP BY accession)"""


def _joined(metrics):
    return F.array_join(F.transform(metrics, lambda m: F.concat(m["label"], F.lit("="), m["value"])), "; ")


@query("scl21_metric_highlights", src=_LINE_SRC, views="fact_lines", sql=f"WITH {_HL_CTE} SELECT accession, highlights FROM hs")
def scl21(t, src):
    return tl.metric_highlights(src).select("accession", _joined(c("metrics")).alias("highlights"))


_WIN_CTE = """cv AS (SELECT cik, cik_no, min(filing_date) AS lo, max(filing_date) AS hi FROM filings GROUP BY ALL), wn AS (SELECT cik, lo, hi, CASE WHEN cik_no % 3 = 0 THEN DATE '1999-06-30' END AS wt FROM cv),
    wo AS (SELECT *, coalesce(wt, hi) AS t0 FROM wn), wp AS (SELECT *, make_date(year(t0) - 2, month(t0), 1) + (CAST(day(t0) AS INT) - 1) AS f0 FROM wo),
    win AS (SELECT cik, greatest(f0, lo) AS f, least(t0, hi) AS t FROM wp WHERE f0 <= t0 AND greatest(f0, lo) <= least(t0, hi))"""


@query("qry02_timeline", src=_LINE_SRC, views="fact_lines filings", sql=rf"""
    WITH {_HL_CTE}, {_WIN_CTE}, ev AS (SELECT f.*, coalesce(d.weight, 'minor') AS weight, coalesce(d.why, '') AS why, hs.highlights AS hh FROM filings f JOIN win ON f.cik = win.cik AND f.filing_date BETWEEN win.f AND win.t
      JOIN {RULES_SQL} ON d.category = f.category AND d.is_event LEFT JOIN hs ON hs.accession = f.accession)
    SELECT accession, form, category, weight, why, CASE WHEN category IN ('quarterly_results', 'annual_report') THEN CASE WHEN hh IS NOT NULL THEN hh WHEN filing_no % 5 IN (0, 4) THEN 'Growth=' || regexp_extract(summary, '([0-9]+)%', 1) || '%'
      WHEN filing_no % 5 = 1 THEN 'Decline=' || regexp_extract(summary, '([0-9]+)%', 1) || '%' END END AS highlights FROM ev""")
def qry02(t, src):
    windows = tl.company_windows(fl.coverage(t.filings), F.lit(None).cast("date"), F.when(c("cik").cast("bigint") % 3 == 0, F.lit("1999-06-30").cast("date")))
    ev = tl.events_in_window(t.filings, windows, "financials", tl.metric_highlights(src))
    return ev.select("accession", "form", "category", "weight", "why", F.when(c("highlights").isNotNull(), _joined(c("highlights"))).alias("highlights"))


# Bars are moved 25 years back, into the years of the filings.
@query("qry02_timeline_head", views="companies filings bars", sql=rf"""
    WITH {_WIN_CTE}, b AS (SELECT cik, trade_date - 9131 AS d FROM bars), tk AS (SELECT cik, CASE WHEN ticker_a <> '' THEN ticker_a ELSE ticker_b END AS ticker FROM companies),
    e AS (SELECT win.cik, count(*) AS n FROM filings f JOIN win ON f.cik = win.cik AND f.filing_date BETWEEN win.f AND win.t GROUP BY 1), p AS (SELECT win.cik, count(*) AS n FROM b JOIN win ON b.cik = win.cik AND d BETWEEN win.f AND win.t GROUP BY 1),
    cov AS (SELECT cik, CASE WHEN CAST(cik AS BIGINT) % 4 = 1 THEN 'error' ELSE 'ok' END AS status, min(d) AS lo, max(d) AS hi FROM b GROUP BY cik)
    SELECT tk.cik, ticker, win.f::VARCHAR AS date_from, win.t::VARCHAR AS date_to, coalesce(e.n, 0) AS events, CASE WHEN ticker = '' THEN 0 ELSE coalesce(p.n, 0) END AS prices, CASE WHEN ticker = '' THEN 'no_symbol' ELSE status END AS price_status,
      CASE WHEN ticker <> '' THEN lo::VARCHAR END AS price_earliest, CASE WHEN ticker <> '' THEN hi::VARCHAR END AS price_latest
    FROM tk JOIN win ON win.cik = tk.cik LEFT JOIN e ON e.cik = tk.cik LEFT JOIN p ON p.cik = tk.cik LEFT JOIN cov ON cov.cik = tk.cik""")
def qry02_head(t):
    windows = tl.company_windows(fl.coverage(t.filings), F.lit(None).cast("date"), F.when(c("cik").cast("bigint") % 3 == 0, F.lit("1999-06-30").cast("date")))
    bars = t.bars.withColumn("trade_date", F.date_sub("trade_date", 9131))
    companies = t.companies.select("cik", F.filter(F.array("ticker_a", "ticker_b"), lambda x: x != "").alias("tickers"))
    coverage = pr.bar_coverage(bars).withColumn("status", F.when(c("cik").cast("bigint") % 4 == 1, F.lit("error")).otherwise(F.lit("ok")))
    head = tl.timeline_head(companies, windows, tl.events_in_window(t.filings, windows, "all"), tl.prices_in_window(bars, windows), coverage)
    text = lambda x, n: c(x).cast("string").alias(n)
    return head.select("cik", "ticker", text("from", "date_from"), text("to", "date_to"), "events", "prices", "price_status", text("price_earliest", "price_earliest"), text("price_latest", "price_latest"))


@query("qry02_timeline_prices", views="bars", sql="""
    SELECT cik, trade_date::VARCHAR AS trade_date, close, coalesce(adj_close, 0) AS adj_close, coalesce(volume, 0) AS volume FROM bars WHERE trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def qry02_prices(t):
    w = t.bars.select("cik").distinct().select("cik", F.lit("2024-01-10").cast("date").alias("from"), F.lit("2024-01-20").cast("date").alias("to"), F.lit(True).alias("window_ok"))
    return tl.prices_in_window(t.bars, w).withColumn("trade_date", c("trade_date").cast("string"))


# ---- clusters ----

_CL_SRC = f"""SELECT accession, cik, filing_date, category, CASE WHEN category = 'annual_report' AND k % 3 > 0 THEN 'P1Y' ELSE 'P3M' END AS duration,
    CASE WHEN category = 'annual_report' THEN 'FY' ELSE q END AS focus, CASE WHEN category = 'annual_report' THEN 'FY 20' ELSE q || ' 20' END || CAST(10 + k % 3 AS STRING) AS label,
    CAST(NULL AS DATE) AS end_date, CASE WHEN k % 5 > 0 THEN CAST(floor(value * 8.0E0) AS DOUBLE) END AS revenue, CASE WHEN k % 4 > 0 THEN CAST(floor(value * 3.0E0) AS DOUBLE) END AS net_income,
    CASE WHEN k % 3 > 0 THEN floor(value * 2.0E0) / 4.0E0 END AS eps, CASE WHEN k % 2 > 0 THEN CAST(floor(value * 16.0E0) AS DOUBLE) END AS cash FROM ({_EV_SRC}) AS e"""
_REP_CTE = """rep AS (SELECT *, category = 'annual_report' AS annual, category <> 'annual_report' AND focus = 'Q4' AS q4, regexp_extract(label, '(20[0-9]{2})', 1) AS fy FROM src WHERE category IN ('quarterly_results', 'annual_report') AND coalesce(revenue, net_income, eps, cash) IS NOT NULL),
    qs AS (SELECT cik, fy, count(*) AS quarters, sum(revenue) AS revenue3, sum(net_income) AS net_income3, sum(eps) AS eps3 FROM rep WHERE NOT annual AND NOT q4 GROUP BY ALL)"""


@query("agg26_synthesised_q4", src=_CL_SRC, sql=f"""
    WITH {_REP_CTE} SELECT r.accession, coalesce(quarters = 3, false) AS synthesised, CASE WHEN quarters = 3 THEN revenue - revenue3 END AS revenue_q4, CASE WHEN quarters = 3 THEN net_income - net_income3 END AS net_income_q4,
      CASE WHEN quarters = 3 THEN eps - eps3 END AS eps_q4, CASE WHEN quarters = 3 THEN cash END AS cash_q4 FROM rep r LEFT JOIN qs USING (cik, fy) WHERE r.annual""")
def agg26(t, src):
    reports = tl.report_events(src)
    return tl.synthesised_q4(reports.where("annual"), tl.quarter_sums(reports)).select("accession", "synthesised", "revenue_q4", "net_income_q4", "eps_q4", "cash_q4")


_PLACE_CTE = f"""days AS ({_DAYS}), sn AS (SELECT s.*, (SELECT min(d.trade_date) FROM days d WHERE d.cik = s.cik AND d.trade_date >= s.filing_date) AS snapped FROM rep s),
    pl AS (SELECT a.*, coalesce((SELECT max_by(q.snapped, (q.filing_date, q.accession)) FROM sn q WHERE q.q4 AND q.cik = a.cik AND q.fy = a.fy AND q.snapped IS NOT NULL AND (q.filing_date, q.accession) < (a.filing_date, a.accession)), a.snapped) AS day FROM sn a WHERE a.annual AND a.snapped IS NOT NULL)"""


@query("jn19_annual_on_q4", src=_CL_SRC, views="bars", sql=f"""
    WITH {_REP_CTE}, {_PLACE_CTE} SELECT cik, day::VARCHAR AS snapped, max_by(accession, (filing_date, accession)) AS annual FROM pl GROUP BY ALL""")
def jn19(t, src):
    return tl.clusters(src, _days(t)).where("annual IS NOT NULL").select("cik", c("snapped").cast("string").alias("snapped"), "annual")


@query("qry06_clusters", src=_CL_SRC, views="bars", sql=f"""
    WITH {_REP_CTE}, {_PLACE_CTE}, qd AS (SELECT * FROM sn WHERE NOT annual AND snapped IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik, snapped ORDER BY filing_date DESC, accession DESC) = 1),
    ad AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY cik, day ORDER BY filing_date DESC, accession DESC) = 1),
    b AS (SELECT coalesce(q.cik, a.cik) AS cik, coalesce(q.snapped, a.day) AS snapped, q.accession AS quarterly, a.accession AS annual, a.fy, q.revenue AS qr, q.net_income AS qn, q.eps AS qe, q.cash AS qc, a.revenue AS ar, a.net_income AS an, a.eps AS ae, a.cash AS ac FROM qd q FULL JOIN ad a ON q.cik = a.cik AND q.snapped = a.day)
    SELECT b.cik, b.snapped::VARCHAR AS snapped, quarterly, annual, coalesce(quarterly IS NULL AND quarters = 3, false) AS synthesised, CASE WHEN quarterly IS NULL AND quarters = 3 THEN ar - revenue3 ELSE qr END AS revenue_q, CASE WHEN quarterly IS NULL AND quarters = 3 THEN an - net_income3 ELSE qn END AS net_income_q,
      CASE WHEN quarterly IS NULL AND quarters = 3 THEN ae - eps3 ELSE qe END AS eps_q, CASE WHEN quarterly IS NULL AND quarters = 3 THEN ac ELSE qc END AS cash_q, ar AS revenue_fy, an AS net_income_fy, ae AS eps_fy, ac AS cash_fy FROM b LEFT JOIN qs ON b.cik = qs.cik AND b.fy = qs.fy""")
def qry06(t, src):
    return tl.clusters(src, _days(t)).withColumn("snapped", c("snapped").cast("string"))
