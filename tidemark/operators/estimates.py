"""Analyst estimates: normalising, point-in-time reading, basis, collection runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fv
from tidemark.functions import amounts as am, periods as pd_
from tidemark.functions.ids import blank_to_null
from tidemark.operators.joins import asof_join
from tidemark.operators.prices import upsert

c = F.col
ESTIMATE_KEYS = ["cik", "source", "fiscal_year", "fiscal_period", "duration", "consensus_date"]


def normalize_estimates(rows: DataFrame) -> DataFrame:
    """Derived period end and duration override the vendor's; missing dates and currency get their defaults."""
    p = pd_.derive_period_end(c("fye"), c("fiscal_year"), c("fiscal_period"))
    return (rows.withColumn("_p", p)
            .withColumn("period_end", F.coalesce(c("_p.period_end").cast("string"), blank_to_null(c("period_end"))))
            .withColumn("duration", F.coalesce(c("_p.duration"), c("duration")))
            .withColumn("consensus_date", F.coalesce(blank_to_null(c("consensus_date")), c("period_end")))
            .withColumn("currency", F.coalesce(blank_to_null(c("currency")), F.lit("USD"))).drop("_p"))


def has_period(rows: DataFrame) -> Column:
    filled = [F.trim(F.coalesce(c(x), F.lit(""))) != "" for x in ("period_end", "duration", "consensus_date")]
    return filled[0] & filled[1] & filled[2]


def with_period(rows: DataFrame) -> DataFrame:
    return rows.where(has_period(rows))


def count_dropped(rows: DataFrame, keys: list[str]) -> DataFrame:
    ok = has_period(rows)
    return rows.groupBy(*keys).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def estimate_before(asks: DataFrame, estimates: DataFrame, before: str, tie_break: list[str] | None = None) -> DataFrame:
    """The last estimate dated strictly before each ask, same company, source, period end and duration.

    Of several estimates of that day, the one with the greatest ``tie_break`` columns (default: the greatest estimate).
    """
    return asof_join(asks, estimates, ["cik", "source", "period_end", "duration"], before, "consensus_date",
                     ["eps_estimate"], tie_break=[*(tie_break or []), "eps_estimate"])


def own_eps(lines: DataFrame) -> DataFrame:
    """Reported basic EPS per company, period end and duration; of several filings the greatest accession."""
    return (lines.where((c("key") == "eps_basic") & am.publishable(c("confidence")))
            .groupBy("cik", "period_end", "duration").agg(F.max_by("value", F.struct("accession", "value")).alias("own_eps")))


def with_basis(estimates: DataFrame, own: DataFrame) -> DataFrame:
    """Whether the vendor's actual is the company's own figure or a street one."""
    return (estimates.join(own, ["cik", "period_end", "duration"], "left")
            .withColumn("basis", am.eps_basis(c("eps_actual"), c("own_eps"))))


def upsert_estimates(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Estimates by their six keys, last write wins, the first creation time kept, currency defaults to USD."""
    shaped = incoming.withColumn("currency", F.coalesce(blank_to_null(c("currency")), F.lit("USD")))
    return upsert(current, shaped, ESTIMATE_KEYS, ["fetched_at"], keep_first=["created_at"])


def upsert_snapshots(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming, ["cik", "source", "as_of"], ["fetched_at"])


def quota_plan(targets: DataFrame, estimates: DataFrame, with_snapshot: bool) -> DataFrame:
    """Calls a collection run would make, against what is stored."""
    have = estimates.groupBy("cik").agg(F.count("*").alias("existing"))
    return (targets.join(have, "cik", "left")
            .select("cik", F.coalesce("existing", F.lit(0)).alias("existing"), F.lit(4).alias("expected"),
                    F.lit(3 if with_snapshot else 1).alias("calls")))


def estimates_view(coverage: DataFrame, estimates: DataFrame, source: str = "") -> DataFrame:
    """Coverage with the periods of the asked source, else of the source that served the company, else of the default source."""
    chosen = F.lit(source) if source else F.coalesce(blank_to_null(c("provider")), F.lit(fv.DEFAULT_ESTIMATE_SOURCE))
    return (coverage.withColumn("source", chosen).join(estimates, ["cik", "source"], "left"))
