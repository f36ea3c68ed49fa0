"""A collection run sends no table of companies to the driver."""

from pyspark.sql import functions as F

from tidemark.session import written
from tidemark.sources import collect as co


def test_companies_are_joined_by_sorting_however_small_their_files_are(spark):
    targets = written(spark.range(50).select(F.format_string("%010d", "id").alias("cik"), F.lit("1231").alias("fye")), "targets")
    at = F.lit("2024-03-01 00:00:00").cast("timestamp")
    coverage = written(targets.where("cik < '0000000020'").select("cik", F.lit("ok").alias("status"), F.lit("v").alias("provider"), F.lit("").alias("note"), at.alias("last_attempt_at"), at.alias("last_success_at")), "coverage")
    due = co.due_targets(targets, coverage, at)
    covered = co._covered(coverage, coverage.withColumn("last_success_at", F.lit(None).cast("timestamp")))
    for df in (due, covered):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert due.count() == 30 and covered.where("last_success_at IS NOT NULL").count() == 20
