"""Queries over what the writers store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import activity as ac, estimates as es, prices as pr
from tidemark.plans.prices import _COV_SRC, _ts
from tidemark.registry import query
from tidemark.session import scratch_path
from tidemark.sources import sinks as sk

c = F.col


@query("snk01_write_once", src="SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS value FROM orders", sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 55 = 0 THEN 1900 ELSE year END AS year, CASE WHEN o_orderkey % 5 = 0 THEN value + 20 WHEN o_orderkey % 3 = 0 THEN value ELSE value + 1 END AS value FROM src""")
def snk01(t, src):
    path = scratch_path(t.spark, "artifacts")
    sk.write_new(src.where("o_orderkey % 3 = 0"), path, ["o_orderkey"], partition=["year"])
    later = src.withColumn("value", c("value") + 1)
    sk.write_new(later, path, ["o_orderkey"], partition=["year"])
    sk.write_new(later.withColumn("value", c("value") + 5), path, ["o_orderkey"], dry_run=True)
    sk.write_new(later.withColumn("value", c("value") + 9), path, ["o_orderkey"], partition=["year"])
    forced = src.where("o_orderkey % 5 = 0").withColumn("value", c("value") + 20).withColumn("year", F.when(c("o_orderkey") % 55 == 0, 1900).otherwise(c("year")))
    sk.write_new(forced.union(forced), path, ["o_orderkey"], partition=["year"], force=True)
    return t.spark.read.parquet(path).select("o_orderkey", c("year").cast("int").alias("year"), "value")


_BAR_SRC = "SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS DATE) ELSE CAST(ts AS DATE) END AS trade_date, value AS close, event_id AS fetched_at FROM events"


@query("snk02_bar_upsert", src=_BAR_SRC, sql="""
    SELECT cik, trade_date::VARCHAR AS trade_date, arg_max(close, (CASE WHEN fetched_at % 2 = 0 THEN 0 ELSE 1 END, fetched_at)) AS close FROM src WHERE trade_date IS NOT NULL GROUP BY ALL""")
def snk02(t, src):
    table = sk.KeyedTable(t.spark, scratch_path(t.spark, "bars"), ["cik"])
    table.merge(src.where("fetched_at % 2 = 0"), pr.upsert_bars)
    table.merge(src.where("fetched_at % 2 = 1"), pr.upsert_bars)
    table.merge(src.where("fetched_at % 2 = 1"), pr.upsert_bars)
    return table.read().select("cik", c("trade_date").cast("string").alias("trade_date"), "close")


@query("snk04_snapshot_upsert", src="SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, event_type AS source, CAST(CAST(ts AS DATE) AS STRING) AS as_of, value AS pt_mean, event_id AS fetched_at FROM events", sql="""
    SELECT cik, source, as_of, arg_max(pt_mean, (fetched_at % 2, fetched_at)) AS pt_mean FROM src GROUP BY ALL""")
def snk04(t, src):
    stored = es.upsert_snapshots(src.where("false"), src.where("fetched_at % 2 = 0"))
    return es.upsert_snapshots(stored, src.where("fetched_at % 2 = 1")).select("cik", "source", "as_of", "pt_mean")


@query("snk05_coverage_upsert", src=_COV_SRC, views="bars", sql="""
    WITH a AS (SELECT lpad(CAST(CASE WHEN user_id % 5 = 0 THEN user_id + 500000 ELSE user_id END AS VARCHAR), 10, '0') AS cik, arg_max(CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'partial' WHEN 'signup' THEN 'no_data' ELSE 'error' END, (ts, event_id)) AS st, max(ts) AS at, max(ts) FILTER (event_type IN ('view', 'click', 'signup')) AS ok FROM events GROUP BY 1),
    b AS (SELECT cik, min(trade_date) AS e, max(trade_date) AS l FROM bars GROUP BY cik)
    SELECT coalesce(s.cik, a.cik) AS cik, b.e::VARCHAR AS earliest, b.l::VARCHAR AS latest, coalesce(a.st, s.status) AS status, epoch_us(coalesce(a.at, s.last_attempt_at)) AS attempt_us, epoch_us(coalesce(a.ok, s.last_success_at)) AS success_us FROM src s FULL JOIN a ON a.cik = s.cik LEFT JOIN b ON b.cik = coalesce(s.cik, a.cik)""")
def snk05(t, src):
    new = F.when(c("event_type") == "view", F.lit("ok")).when(c("event_type") == "click", F.lit("partial")).when(c("event_type") == "signup", F.lit("no_data")).otherwise(F.lit("error"))
    # attempts at every fifth company count for one that has no coverage row yet, so that its own keeps its old state
    company = F.when(c("user_id") % 5 == 0, c("user_id") + 500000).otherwise(c("user_id"))
    attempts = t.events.select(F.lpad(company.cast("string"), 10, "0").alias("cik"), new.alias("new_status"), F.lit("").alias("note"),
                                                         c("ts").cast("timestamp").alias("attempted_at"), c("event_id").alias("attempt_no"))
    out = pr.refresh_coverage(_ts(src).withColumn("note", F.lit("")), t.bars, attempts)
    return out.select("cik", c("earliest").cast("string").alias("earliest"), c("latest").cast("string").alias("latest"), "status",
                      F.unix_micros("last_attempt_at").alias("attempt_us"), F.unix_micros("last_success_at").alias("success_us"))


@query("snk07_status_report", views="projects", sql="""
    SELECT '{"project_id":' || project_id || ',"status":"' || status || '","n_events":' || n_events || '}' AS line FROM projects""")
def snk07(t):
    path = scratch_path(t.spark, "report")
    sk.write_report(t.projects.select("project_id", "status", "n_events"), path)
    return t.spark.read.text(path).select(c("value").alias("line"))


@query("snk08_append_rows", src="SELECT event_id, user_id, event_type FROM events", sql="SELECT event_id, user_id, event_type FROM src")
def snk08(t, src):
    path = scratch_path(t.spark, "log")
    sk.append_rows(src.where("event_id % 2 = 0"), path)
    sk.append_rows(src.where("event_id % 2 = 1"), path)
    return t.spark.read.parquet(path)


@query("snk09_cascading_delete", views="projects log_events", sql="""
    SELECT 'project' AS part, project_id AS id FROM projects WHERE status <> 'error' UNION ALL SELECT 'event', event_id FROM log_events WHERE project_id NOT IN (SELECT project_id FROM projects WHERE status = 'error')""")
def snk09(t):
    doomed = t.projects.where("status = 'error'")
    return (ac.without_projects(t.projects, doomed).select(F.lit("project").alias("part"), c("project_id").alias("id"))
            .unionByName(ac.without_projects(t.log_events, doomed).select(F.lit("event").alias("part"), c("event_id").alias("id"))))


# Updates of every fourth user are for a project that does not exist.
_UPD_SRC = "SELECT CASE WHEN user_id % 4 = 0 THEN user_id + 500000 ELSE user_id END AS project_id, event_id, ts AS updated_at, CASE event_type WHEN 'view' THEN 'converting' WHEN 'click' THEN 'llm_done' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'uploaded' END AS new_status FROM events"


@query("snk10_status_update", src=_UPD_SRC, views="projects", sql="""
    SELECT p.project_id, coalesce(u.st, p.status) AS status, epoch_us(CASE WHEN u.st IN ('complete', 'error') THEN u.at WHEN u.st IS NULL THEN p.created_at END) AS completed_us FROM projects p LEFT JOIN (SELECT project_id, arg_max(new_status, (updated_at, event_id)) AS st, max(updated_at) AS at FROM src GROUP BY 1) u USING (project_id)""")
def snk10(t, src):
    p = t.projects.withColumn("completed_at", c("created_at"))
    return ac.apply_status(p, src).select("project_id", "status", F.unix_micros(c("completed_at").cast("timestamp")).alias("completed_us"))


@query("snk11_build_meta", src="""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '20-F' WHEN 1 THEN '3' ELSE '6-K' END AS form, CASE o_orderkey % 3 WHEN 0 THEN 'Quarter Financial Results' WHEN 1 THEN 'Dividend notice' ELSE '' END AS title, o_orderkey % 4 = 0 AS has_meta FROM orders""", sql="""
    SELECT o_orderkey, CASE WHEN form = '20-F' THEN 'annual_report' WHEN form = '3' THEN 'insider_initial' WHEN title = 'Quarter Financial Results' THEN 'quarterly_results' WHEN title = 'Dividend notice' THEN 'corporate_action' ELSE 'current_report' END AS category,
      CASE WHEN form = '20-F' THEN 'MAJOR' WHEN form = '3' THEN 'MINOR' WHEN title = 'Quarter Financial Results' THEN 'MAJOR' ELSE 'MODERATE' END AS tier_label, CASE WHEN title <> '' THEN title WHEN form = '20-F' THEN 'Annual report with audited financials and MD&A' ELSE form END AS summary FROM src WHERE NOT has_meta""")
def snk11(t, src):
    from tidemark.sources.meta import build_meta
    docs = src.select("o_orderkey", "form", F.filter(F.array("title"), lambda x: x != "").alias("titles"), F.lit("").alias("body"), F.lit(False).alias("is_xbrl"),
                      F.struct(*[F.lit(None).cast("string").alias(x) for x in ("person", "title", "transaction_code", "shares")]).alias("owner"))
    have = src.where("has_meta").select("o_orderkey")
    return build_meta(docs, have, ["o_orderkey"]).select("o_orderkey", "category", c("tier_label"), "summary")
