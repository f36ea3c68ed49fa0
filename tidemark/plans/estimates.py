"""Queries over analyst estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import estimates as es
from tidemark.plans.scalars import scl43  # noqa: F401  (the normalising query lives with the scalars)
from tidemark.registry import query
from tidemark.session import scratch_path

c = F.col
_ROW_SRC = """SELECT event_id, lpad(CAST(user_id AS STRING), 10, '0') AS cik, CASE event_id % 4 WHEN 0 THEN '' ELSE '2024-03-31' END AS period_end, CASE event_id % 5 WHEN 0 THEN ' ' ELSE 'P3M' END AS duration,
    CASE event_id % 3 WHEN 0 THEN '' ELSE '2024-01-15' END AS consensus_date FROM events"""


@query("flt11_estimates_with_period", src=_ROW_SRC, sql="SELECT cik, count(*) FILTER (event_id % 4 > 0 AND event_id % 5 > 0 AND event_id % 3 > 0) AS kept, count(*) FILTER (NOT (event_id % 4 > 0 AND event_id % 5 > 0 AND event_id % 3 > 0)) AS dropped FROM src GROUP BY cik")
def flt11(t, src):
    return es.count_dropped(src, ["cik"])


@query("flt12_consensus_range", views="estimates", sql="SELECT event_id, cik FROM estimates WHERE consensus_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
def flt12(t):
    return t.estimates.where(c("consensus_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))).select("event_id", "cik")


@query("jn10_estimate_before", views="estimates reports", sql="""
    SELECT r.event_id, e.consensus_date::VARCHAR AS consensus_date, e.eps_estimate FROM reports r LEFT JOIN LATERAL (SELECT * FROM estimates e WHERE e.cik = r.cik AND e.source = r.source AND e.period_end = r.period_end AND e.duration = r.duration
      AND e.consensus_date < r.report_date ORDER BY consensus_date DESC, event_id DESC LIMIT 1) e ON true""")
def jn10(t):
    return es.estimate_before(t.reports, t.estimates, "report_date", ["event_id"]).select("event_id", c("consensus_date").cast("string").alias("consensus_date"), "eps_estimate")


_OWN_SQL = "(SELECT cik, period_end, duration, max_by(eps_actual, event_id) AS own_eps FROM reports WHERE event_id % 3 > 0 GROUP BY ALL)"


def _own(t):
    lines = t.reports.where("event_id % 3 > 0").select("cik", "period_end", "duration", c("event_id").alias("accession"), c("eps_actual").alias("value"),
                                                        F.lit("eps_basic").alias("key"), F.lit("verified").alias("confidence"))
    return es.own_eps(lines)


@query("jn11_own_eps", views="estimates reports", sql=f"SELECT e.event_id, o.own_eps FROM estimates e LEFT JOIN {_OWN_SQL} o USING (cik, period_end, duration)")
def jn11(t):
    return es.with_basis(t.estimates.withColumn("eps_actual", c("eps_estimate")), _own(t)).select("event_id", "own_eps")


@query("dq13_eps_basis", views="estimates reports", sql=f"""
    SELECT e.event_id, CASE WHEN own_eps IS NULL THEN 'unknown' WHEN abs(e.eps_estimate - own_eps) / abs(own_eps) <= 0.05 THEN 'reported' ELSE 'street' END AS basis FROM estimates e LEFT JOIN {_OWN_SQL} o USING (cik, period_end, duration)""")
def dq13(t):
    return es.with_basis(t.estimates.withColumn("eps_actual", c("eps_estimate")), _own(t)).select("event_id", "basis")


@query("top09_estimate_order", views="estimates", sql="SELECT cik, event_id, row_number() OVER (PARTITION BY cik ORDER BY period_end, consensus_date, event_id) AS position FROM estimates")
def top09(t):
    from pyspark.sql import Window as W
    order = W.partitionBy("cik").orderBy("period_end", "consensus_date", "event_id")
    return t.estimates.select("cik", "event_id", F.row_number().over(order).cast("bigint").alias("position"))


@query("cov05_quota_plan", views="companies estimates", sql="SELECT c.cik, coalesce(n, 0) AS existing, 4 AS expected, 3 AS calls FROM companies c LEFT JOIN (SELECT cik, count(*) AS n FROM estimates GROUP BY cik) e USING (cik)")
def cov05(t):
    return es.quota_plan(t.companies.select("cik"), t.estimates, True)


@query("qry05_estimates_view", views="companies estimates", sql="""
    WITH w AS (SELECT cik, CASE WHEN cik_no % 4 = 0 THEN 'vendor' WHEN cik_no % 4 = 2 THEN 'other' ELSE 'finnhub' END AS source FROM companies), x AS (SELECT cik, CASE WHEN event_id % 3 = 0 THEN 'finnhub' ELSE source END AS source, event_id FROM estimates)
    SELECT w.cik, w.source, x.event_id FROM w LEFT JOIN x ON x.cik = w.cik AND x.source = w.source""")
def qry05(t):
    coverage = t.companies.select("cik", F.when(c("cik_no") % 4 == 0, F.lit("vendor")).when(c("cik_no") % 4 == 2, F.lit("other")).when(c("cik_no") % 4 == 1, F.lit("")).alias("provider"))
    stored = t.estimates.withColumn("source", F.when(c("event_id") % 3 == 0, F.lit("finnhub")).otherwise(c("source")))
    return es.estimates_view(coverage, stored).select("cik", "source", "event_id")


_KEYED = """SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, 'vendor' AS source, '2024' AS fiscal_year, 'Q' || CAST(1 + event_id % 4 AS STRING) AS fiscal_period, 'P3M' AS duration, CAST(CAST(ts AS DATE) AS STRING) AS consensus_date,
    value AS eps_estimate, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'EUR' END AS currency, event_id AS fetched_at, event_id AS created_at FROM events"""


@query("snk03_estimate_upsert", src=_KEYED, sql="""
    WITH c AS (SELECT *, 0 AS nw FROM src WHERE fetched_at % 3 > 0), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cik, source, fiscal_year, fiscal_period, duration, consensus_date ORDER BY fetched_at DESC) = 1),
    u AS (SELECT * FROM k UNION ALL SELECT * REPLACE (CASE WHEN currency = '' THEN 'USD' ELSE currency END AS currency), 1 AS nw FROM src WHERE fetched_at % 3 = 0)
    SELECT cik, fiscal_period, consensus_date, arg_max(eps_estimate, (nw, fetched_at)) AS eps_estimate, arg_max(currency, (nw, fetched_at)) AS currency, min(created_at) AS created_at FROM u GROUP BY cik, source, fiscal_year, fiscal_period, duration, consensus_date""")
def snk03(t, src):
    from tidemark.operators.joins import first_match
    stored = src.where("fetched_at % 3 > 0")
    rest = ["eps_estimate", "currency", "fetched_at", "created_at"]
    current = first_match(stored, es.ESTIMATE_KEYS, [-c("fetched_at")], rest)
    return es.upsert_estimates(current, src.where("fetched_at % 3 = 0")).select("cik", "fiscal_period", "consensus_date", "eps_estimate", "currency", "created_at")


# Three runs: even events, where some companies fail; twelve hours later only those are due; a day later all, with the odd events.
_RUN_SRC = """SELECT event_id, user_id, lpad(CAST(user_id AS STRING), 10, '0') AS cik, value AS eps_actual, CAST(event_id % 5 AS INT) AS quarter, CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS period FROM events"""
_RUN_AT = ["2024-02-01 00:00:00", "2024-02-01 12:00:00", "2024-02-02 13:00:00"]
_WINDOW = ("2014-01-01", "2024-12-31")
_RUN_CTE = """j AS (SELECT s.*, c.fye, c.cik_no, CASE WHEN quarter = 0 THEN 'FY' ELSE 'Q' || quarter END AS fp FROM src s JOIN companies c USING (cik)),
    d AS (SELECT *, CASE WHEN fye <> '' THEN make_date(2024, CAST(substr(fye, 1, 2) AS INT), 1) - CASE fp WHEN 'Q3' THEN 3 WHEN 'Q2' THEN 6 WHEN 'Q1' THEN 9 ELSE 0 END * INTERVAL 1 MONTH + CAST(CAST(substr(fye, 3, 2) AS INT) - 1 AS INT) * INTERVAL 1 DAY END AS dd FROM j),
    n AS (SELECT *, coalesce(strftime(dd, '%Y-%m-%d'), CASE WHEN period = 'soon' THEN '' ELSE period END) AS period_end, CASE WHEN fp = 'FY' THEN 'P1Y' ELSE 'P3M' END AS duration, CASE WHEN period = 'soon' THEN '2024-12-31' ELSE period END AS consensus_date FROM d),
    own AS (SELECT cik, period_end, duration, arg_min(eps_actual, event_id) AS own_eps FROM n WHERE period_end <> '' GROUP BY ALL),
    r AS (SELECT n.*, run FROM n, (VALUES (1), (2), (3)) v(run) WHERE cik_no % 7 > 0 AND CASE run WHEN 1 THEN event_id % 2 = 0 AND cik_no % 11 > 0 WHEN 2 THEN cik_no % 11 = 0 ELSE event_id % 2 = 1 END),
    st AS (SELECT c.cik, c.cik_no, v.run, CASE WHEN c.cik_no % 7 > 0 AND c.cik_no % 11 = 0 AND v.run = 1 AND count(s.event_id) > 0 THEN 'error' WHEN count(r.event_id) = 0 THEN 'no_data' WHEN count(r.event_id) FILTER (r.period_end = '') > 0 THEN 'partial' ELSE 'ok' END AS status,
        count(r.event_id) FILTER (r.period_end = '') AS dropped FROM companies c CROSS JOIN (VALUES (1), (2), (3)) v(run) LEFT JOIN r ON r.cik = c.cik AND r.run = v.run LEFT JOIN (SELECT cik, min(event_id) AS event_id FROM src WHERE event_id % 2 = 0 GROUP BY cik) s ON s.cik = c.cik GROUP BY c.cik, c.cik_no, v.run)"""


def _collected(t, src):
    """The store after the three runs."""
    from tidemark.sources.collect import collect_run
    from tidemark.sources.decoders import earnings_rows
    from tidemark.sources.sinks import TableStore
    companies = t.companies.select("cik", "cik_no", "fye")
    row = F.struct(c("eps_actual").alias("actual"), c("eps_actual").alias("estimate"), "period", F.lit(2024).alias("year"), "quarter")
    docs = src.join(companies.hint("merge"), "cik").select("cik", "cik_no", "fye", "event_id", c("event_id").alias("position"), F.when(c("cik_no") % 7 == 0, F.lit("[]")).otherwise(F.to_json(F.array(row))).alias("doc"), F.lit(None).cast("string").alias("error"))
    known = es.with_period(es.normalize_estimates(earnings_rows(docs.drop("error"), "doc")))
    own = known.groupBy("cik", "period_end", "duration").agg(F.min_by("eps_actual", "event_id").alias("own_eps"))
    snaps = companies.select("cik", F.to_json(F.struct((c("cik_no") * 1.0).alias("targetMean"))).alias("targets_doc"), F.to_json(F.array(F.struct(F.lit(1).alias("buy"), F.lit(2).alias("sell")))).alias("ratings_doc"))
    store = TableStore(t.spark, scratch_path(t.spark, "estimates"))
    failing = docs.where("event_id % 2 = 0").withColumn("error", F.when((c("cik_no") % 11 == 0) & (c("cik_no") % 7 > 0), F.lit("http 500")))
    for at, answers in zip(_RUN_AT, (failing, docs, docs.where("event_id % 2 = 1"))):
        collect_run(store, companies.select("cik", "fye"), answers.select("cik", "position", "doc", "error"), snaps, own, F.lit(at).cast("timestamp"), "vendor", _WINDOW)
    return store


@query("qry08_collect_estimates", views="companies", src=_RUN_SRC, sql=f"""
    WITH {_RUN_CTE} SELECT r.cik, '2024' AS fiscal_year, fp AS fiscal_period, r.duration, consensus_date, arg_max(r.period_end, (run, event_id)) AS period_end, arg_max(eps_actual, (run, event_id)) AS eps_actual,
      arg_max(CASE WHEN own_eps IS NULL THEN 'unknown' WHEN CASE WHEN abs(own_eps) < 1e-9 THEN abs(eps_actual - own_eps) < 1e-9 ELSE abs(eps_actual - own_eps) / abs(own_eps) <= {fv.BASIS_TOLERANCE} END THEN 'reported' ELSE 'street' END, (run, event_id)) AS basis, min(run)::INTEGER AS created_run FROM r LEFT JOIN own ON own.cik = r.cik AND own.period_end = r.period_end AND own.duration = r.duration WHERE r.period_end <> '' GROUP BY ALL""")
def qry08(t, src):
    created = F.array_position(F.array(*map(F.lit, _RUN_AT)), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).cast("int")
    return _collected(t, src).read("estimates").select("cik", "fiscal_year", "fiscal_period", "duration", "consensus_date", "period_end", "eps_actual", "basis", created.alias("created_run"))


@query("qry08_collection_state", views="companies", src=_RUN_SRC, sql=f"""
    WITH {_RUN_CTE}, seen AS (SELECT cik, max(run) AS last_run, max(run) FILTER (status <> 'error') AS ok_run, arg_max(status, run) AS status, arg_max(dropped, run) AS dropped FROM st WHERE run <> 2 OR cik IN (SELECT cik FROM st WHERE run = 1 AND status = 'error') GROUP BY cik)
    SELECT cik, status, CASE status WHEN 'no_data' THEN 'no data' WHEN 'partial' THEN 'dropped ' || dropped || ' rows with underivable period_end' ELSE '' END AS note, list_extract(['{_RUN_AT[0]}', '{_RUN_AT[1]}', '{_RUN_AT[2]}'], last_run) AS last_attempt_at, list_extract(['{_RUN_AT[0]}', '{_RUN_AT[1]}', '{_RUN_AT[2]}'], ok_run) AS last_success_at FROM seen""")
def qry08_state(t, src):
    at = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return _collected(t, src).read("coverage").select("cik", "status", "note", at("last_attempt_at"), at("last_success_at"))


@query("qry08_snapshots", views="companies", src=_RUN_SRC, sql=f"""
    WITH {_RUN_CTE} SELECT DISTINCT cik, CASE WHEN run = 3 THEN '2024-02-02' ELSE '2024-02-01' END AS as_of, cik_no * 1.0::DOUBLE AS pt_mean, 1 AS buy, 2 AS sell FROM st WHERE status IN ('ok', 'partial') AND (run <> 2 OR cik IN (SELECT cik FROM st WHERE run = 1 AND status = 'error'))""")
def qry08_snapshots(t, src):
    return _collected(t, src).read("snapshots").select("cik", "as_of", "pt_mean", "buy", "sell")
