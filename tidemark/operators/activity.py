"""Processing logs: call timing, errors, run states, progress and run totals per project."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import fixed_values as fv

c = F.col
CALL_INFO = ("model string, provider string, prompt_files string, total_prompt_chars bigint, response_chars bigint, "
             "response_duration_sec double")


def weighted_progress(base: Column, span: Column, done: Column, total: Column) -> Column:
    """Percent reached inside a step that covers ``span`` percent from ``base``; whole numbers, 0 to 100."""
    step = F.floor(F.try_divide(span * done, total)).cast("bigint")
    return F.when(total <= 0, base.cast("bigint")).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), base + step)))


def progress_rows(lines: DataFrame, text: str, token: str = "PROGRESS") -> DataFrame:
    """Stage, done and total from log lines of four words that start with the token; other lines are dropped."""
    parts = F.split(F.trim(c(text)), r"\s+")
    done, total = F.get(parts, F.lit(2)).try_cast("int"), F.get(parts, F.lit(3)).try_cast("int")
    return (lines.withColumn("_p", parts).withColumn("_d", done).withColumn("total", total)
            .where((F.size("_p") == 4) & (F.get("_p", F.lit(0)) == token) & c("_d").isNotNull() & (c("total") > 0))
            .withColumn("stage", F.get("_p", F.lit(1)))
            .withColumn("done", F.greatest(F.lit(0), F.least(c("_d"), c("total")))).drop("_p", "_d"))


def call_info(snippet: Column) -> Column:
    """Call details from a JSON snippet; any other text is the model name itself."""
    parsed = F.from_json(snippet, CALL_INFO)
    is_json = F.try_parse_json(snippet).isNotNull() & F.startswith(F.trim(snippet), F.lit("{"))
    plain = F.struct(snippet.alias("model"), *[F.lit(None).cast(t).alias(n) for n, t in
                     (x.split(" ") for x in CALL_INFO.split(", ")[1:])])
    return F.when(is_json, parsed).otherwise(plain)


def call_audit(model: Column, provider: Column, system: Column, user: Column, images: Column) -> Column:
    """JSON record of one model call as logged: sizes in characters and number of images."""
    return F.to_json(F.struct(
        model.alias("model"), provider.alias("provider"), F.length(system).alias("system_chars"),
        F.length(user).alias("user_chars"), (F.length(system) + F.length(user)).alias("total_prompt_chars"),
        images.alias("image_count")))


def call_timing(events: DataFrame, as_of: Column) -> DataFrame:
    """Per project: seconds from its last good request to the last answer after it, or so far.

    Two maxima decide it: an answer later than the last request exists exactly when the last answer is.
    """
    start = F.max(F.when((c("stage") == "llm_request") & (F.trim("outcome") != "error"), c("created_at")))
    end = F.max(F.when(c("stage").isin("llm_call", "llm_done"), c("created_at")))
    t = events.groupBy("project_id").agg(start.alias("_s"), end.alias("_e"))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    ended = F.coalesce(c("_e") > c("_s"), F.lit(False))
    until = F.when(ended, micros(c("_e"))).otherwise(micros(as_of))
    return t.select("project_id",
                    F.when(c("_s").isNull(), 0.0).otherwise(F.greatest(F.lit(0), until - micros(c("_s"))) / 1e6).alias("duration_sec"),
                    (c("_s").isNotNull() & ~ended).alias("in_progress"))


def last_error(events: DataFrame) -> DataFrame:
    """Newest message per project that reports an error or a cancellation."""
    bad = (F.trim("outcome") == "error") | (c("stage") == "error") | F.contains(F.lower("message"), F.lit("cancelled"))
    return events.where(bad).groupBy("project_id").agg(F.max_by("message", F.struct("created_at", "event_id")).alias("message"))


def last_call(events: DataFrame, snippet: str) -> DataFrame:
    """Details of the newest good call with a snippet per project."""
    good = (c("stage") == "llm_call") & (F.trim("outcome") != "error") & (F.trim(c(snippet)) != "")
    newest = events.where(good).groupBy("project_id").agg(
        F.max_by(F.trim(c(snippet)), F.struct("created_at", "event_id")).alias("snippet"))
    return newest.withColumn("info", call_info(c("snippet")))


def fill_completed_at(projects: DataFrame, events: DataFrame) -> DataFrame:
    """Completion time of complete projects without one: their last completion event."""
    done = events.where(c("stage") == "complete").groupBy("project_id").agg(F.max("created_at").alias("_done"))
    missing = (c("status") == "complete") & c("completed_at").isNull()
    return (projects.join(done, "project_id", "left")
            .withColumn("completed_at", F.when(missing, c("_done")).otherwise(c("completed_at"))).drop("_done"))


def status_counts(projects: DataFrame) -> DataFrame:
    return projects.groupBy("status").agg(F.count("*").alias("n"))


def run_totals(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over all runs, zero where there is none."""
    return runs.agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in columns])


def recent(df: DataFrame, time: str, tie: str, limit: int, cap: int | None = None) -> DataFrame:
    """Newest rows, at most ``limit`` (and ``cap``)."""
    n = limit if cap is None else min(limit, cap)
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def apply_status(projects: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest status per project; a terminal one sets the completion time, any other clears it."""
    latest = updates.groupBy("project_id").agg(F.max(F.struct("updated_at", "event_id", "new_status")).alias("_u"))
    j = projects.join(latest, "project_id", "left")
    changed = c("_u").isNotNull()
    terminal = c("_u.new_status").isin(fv.TERMINAL_STATUSES)
    return (j.withColumn("completed_at", F.when(changed & terminal, c("_u.updated_at")).when(~changed, c("completed_at")))
            .withColumn("status", F.coalesce(c("_u.new_status"), c("status"))).drop("_u"))


def without_projects(df: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows whose project is not deleted (used for the parent and each child table)."""
    return df.join(doomed.select("project_id").distinct(), "project_id", "left_anti")


def document_status(projects: DataFrame, events: DataFrame, snippet: str, as_of: Column) -> DataFrame:
    """Status view of a document: percent, label, error when it failed, call timing and details."""
    from tidemark.functions.classify import status_label, status_percent
    info = last_call(events, snippet).select("project_id", c("info.model").alias("model"))
    j = (projects.join(call_timing(events, as_of), "project_id", "left")
         .join(last_error(events), "project_id", "left").join(info, "project_id", "left"))
    return j.select("project_id", "status", status_percent(c("status")).alias("pct"), status_label(c("status")).alias("label"),
                    F.when(c("status") == "error", F.coalesce("message", F.lit(""))).otherwise(F.lit("")).alias("error"),
                    F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"),
                    F.coalesce("in_progress", F.lit(False)).alias("in_progress"), F.coalesce("model", F.lit("")).alias("model"))
