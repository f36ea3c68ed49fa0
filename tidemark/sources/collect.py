"""A collection run of analyst estimates: what is due, what came back, and one commit of all that follows from it.

Joins by company are told to sort: Spark takes the size of a table from its compressed files, where a company is a few bytes, and would
send all of them to the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import estimates as es, prices as pr
from tidemark.session import written
from tidemark.sources.decoders import earnings_rows, snapshot_rows
from tidemark.sources.sinks import TableStore

c = F.col
COVERAGE = "cik string, status string, provider string, note string, last_attempt_at timestamp, last_success_at timestamp"


def _covered(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Coverage after a run: the new row, with the last success kept where there is no new one."""
    old = current.select("cik", c("last_success_at").alias("_old")).hint("merge")
    new = incoming.join(old, "cik", "left").withColumn("last_success_at", F.coalesce("last_success_at", "_old")).drop("_old")
    return current.join(incoming.select("cik").hint("merge"), "cik", "left_anti").unionByName(new)


def due_targets(targets: DataFrame, coverage: DataFrame, as_of: Column, force: bool = False) -> DataFrame:
    """The targets (cik, ...) that were not fetched with success within the last day, or all of them with ``force``."""
    if force:
        return targets
    recent = coverage.where(pr.recently_done(c("last_success_at"), as_of)).select("cik").hint("merge")
    return targets.join(recent, "cik", "left_anti")


def collect_run(store: TableStore, targets: DataFrame, responses: DataFrame, snapshots: DataFrame | None, own_eps: DataFrame, as_of: Column,
                provider: str, window: tuple[str, str], force: bool = False) -> DataFrame:
    """Take one run's answers into the tables estimates, snapshots and coverage of a store; all three change together or not at all.

    ``targets`` has cik and fye, ``responses`` cik, position, doc (earnings JSON, several pages may be) and error, ``snapshots`` cik,
    targets_doc and ratings_doc, ``own_eps`` the companies' own figures (cik, period_end, duration, own_eps). Targets with a recent
    success are left alone. Of rows with one key in a run the last by position counts. A target with an error gets no rows; one
    without any row in the window has no_data; one of which rows were dropped, as they have no period, is partial. Gives the report
    of the run: cik, status, rows, dropped, note, for the targets that were due.
    """
    stored = store.read("coverage")
    coverage = stored if stored is not None else store.spark.createDataFrame([], COVERAGE)
    due = written(due_targets(targets, coverage, as_of, force), "due")
    answers = responses.join(due.hint("merge"), "cik")
    errors = answers.where("error IS NOT NULL").groupBy("cik").agg(F.min("error").alias("error"))
    rows = earnings_rows(answers.join(errors.select("cik").hint("merge"), "cik", "left_anti").select("cik", "fye", "position", "doc"), "doc")
    rows = written(es.normalize_estimates(rows.where(c("consensus_date").between(*window))), "normalized")
    counts = es.count_dropped(rows, ["cik"])
    report = due.select("cik").join(errors.hint("merge"), "cik", "left").join(counts.hint("merge"), "cik", "left")
    kept, dropped = F.coalesce("kept", F.lit(0)), F.coalesce("dropped", F.lit(0))
    status = (F.when(c("error").isNotNull(), "error").when(kept + dropped == 0, "no_data").when(dropped > 0, "partial").otherwise("ok"))
    note = (F.when(c("error").isNotNull(), c("error")).when(kept + dropped == 0, F.lit("no data"))
            .when(dropped > 0, F.concat(F.lit("dropped "), dropped.cast("string"), F.lit(" rows with underivable period_end"))).otherwise(F.lit("")))
    report = written(report.select("cik", status.alias("status"), kept.alias("rows"), dropped.alias("dropped"), note.alias("note")), "report")

    values = ["period_end", "eps_estimate", "eps_actual", "eps_surprise", "eps_surprise_pct", "currency", "basis"]
    based = es.with_basis(es.with_period(rows), own_eps.hint("merge")).withColumn("source", F.lit(provider))
    last = based.groupBy(*es.ESTIMATE_KEYS).agg(F.max(F.struct("position", *values)).alias("_v"))
    estimates = last.select(*es.ESTIMATE_KEYS, *[c(f"_v.{x}").alias(x) for x in values], as_of.alias("fetched_at"), as_of.alias("created_at"))
    success = F.when(c("status") != "error", as_of)
    covered = report.select("cik", "status", F.lit(provider).alias("provider"), "note", as_of.alias("last_attempt_at"), success.alias("last_success_at"))

    commit = store.begin()
    commit.merge("estimates", ["cik"], estimates, es.upsert_estimates)
    if snapshots is not None:
        served = snapshots.join(report.where("status IN ('ok', 'partial')").select("cik").hint("merge"), "cik")
        one = snapshot_rows(served.select("cik", c("targets_doc").alias("doc")), served.select("cik", c("ratings_doc").alias("doc")).hint("merge"), ["cik"], "doc")
        one = one.select("cik", F.lit(provider).alias("source"), F.to_date(as_of).cast("string").alias("as_of"), *[x for x in one.columns if x != "cik"], as_of.alias("fetched_at"))
        commit.merge("snapshots", ["cik"], one, es.upsert_snapshots)
    commit.merge("coverage", ["cik"], covered, _covered)
    commit.done()
    return report
