"""Queries over processing logs and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import activity as ac
from tidemark.registry import query

c = F.col


def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


TIMING_SQL = """(SELECT project_id, CASE WHEN s IS NULL THEN 0.0 WHEN e > s THEN date_diff('microsecond', s, e) / 1e6 ELSE date_diff('microsecond', s, TIMESTAMP '2024-02-01 00:00:00') / 1e6 END AS duration_sec,
      s IS NOT NULL AND NOT coalesce(e > s, false) AS in_progress
    FROM (SELECT project_id, max(created_at) FILTER (stage = 'llm_request' AND outcome <> 'error') AS s, max(created_at) FILTER (stage IN ('llm_call', 'llm_done')) AS e FROM log_events GROUP BY project_id))"""
ERROR_SQL = "(SELECT project_id, max_by(message, created_at) AS message FROM log_events WHERE outcome = 'error' OR stage = 'error' OR contains(lower(message), 'cancelled') GROUP BY project_id)"
SNIPPET = "CASE WHEN event_id % 3 = 0 THEN 'model-' || CAST(k AS STRING) WHEN event_id % 3 = 1 THEN '' ELSE ' ' || CAST(k AS STRING) || 'x ' END"
CALL_SQL = f"(SELECT project_id, trim(max_by(sn, created_at)) AS snippet FROM (SELECT *, {SNIPPET} AS sn FROM log_events) WHERE stage = 'llm_call' AND outcome <> 'error' AND trim(sn) <> '' GROUP BY project_id)"


@query("win07_call_timing", views="log_events", sql=f"SELECT project_id, CAST(duration_sec AS DOUBLE) AS duration_sec, in_progress FROM {TIMING_SQL}")
def win07(t):
    return ac.call_timing(t.log_events, as_of())


@query("win08_last_error", views="log_events", sql=f"SELECT project_id, message FROM {ERROR_SQL}")
def win08(t):
    return ac.last_error(t.log_events)


@query("win09_last_call", views="log_events", sql=f"SELECT project_id, snippet AS model FROM {CALL_SQL}")
def win09(t):
    return ac.last_call(t.log_events.withColumn("snippet", F.expr(SNIPPET)), "snippet").select("project_id", c("info.model").alias("model"))


@query("agg21_completed_at", views="projects log_events", sql="""
    SELECT p.project_id, p.status, epoch_us(CASE WHEN p.status = 'complete' THEN d.done END) AS completed_us FROM projects p LEFT JOIN (SELECT project_id, max(created_at) AS done FROM log_events WHERE stage = 'complete' GROUP BY 1) d USING (project_id)""")
def agg21(t):
    p = t.projects.withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    return ac.fill_completed_at(p, t.log_events).select("project_id", "status", F.unix_micros(c("completed_at").cast("timestamp")).alias("completed_us"))


@query("qry12_document_status", views="projects log_events", sql=f"""
    SELECT p.project_id, p.status, CAST(CASE p.status WHEN 'uploaded' THEN 8 WHEN 'converting' THEN 28 WHEN 'llm_pending' THEN 45 WHEN 'llm_done' THEN 62 WHEN 'post_processing' THEN 82 WHEN 'complete' THEN 100 WHEN 'error' THEN 100 ELSE 5 END AS INTEGER) AS pct,
      CASE p.status WHEN 'uploaded' THEN 'Queued' WHEN 'converting' THEN 'Extracting text' WHEN 'llm_pending' THEN 'Analyzing with LLM' WHEN 'llm_done' THEN 'LLM complete' WHEN 'post_processing' THEN 'Saving results' WHEN 'complete' THEN 'Complete' WHEN 'error' THEN 'Error' ELSE 'on hold' END AS label,
      CASE WHEN p.status = 'error' THEN coalesce(e.message, '') ELSE '' END AS error, CAST(coalesce(t.duration_sec, 0) AS DOUBLE) AS duration_sec, coalesce(t.in_progress, false) AS in_progress, coalesce(i.snippet, '') AS model
    FROM projects p LEFT JOIN {TIMING_SQL} t USING (project_id) LEFT JOIN {ERROR_SQL} e USING (project_id) LEFT JOIN {CALL_SQL} i USING (project_id)""")
def qry12(t):
    return ac.document_status(t.projects, t.log_events.withColumn("snippet", F.expr(SNIPPET)), "snippet", as_of())
