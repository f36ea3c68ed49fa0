"""Daily bars: upsert, coverage, what to download next, which source serves a stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fv
from tidemark.functions.periods import shift_years

c = F.col


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep_first: list[str] = ()) -> DataFrame:
    """One row per key: the last written. Columns in ``keep_first`` keep the first written value.

    ``order`` columns say which row is later; stored rows come before incoming ones at a tie.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    values = [x for x in current.columns if x not in keys]
    last = F.max_by(F.struct(*values), F.struct("_new", *order)).alias("_v")
    firsts = [F.min(x).alias(f"_first_{x}") for x in keep_first]
    out = both.groupBy(*keys).agg(last, *firsts)
    return out.select(*[c(f"_first_{x}").alias(x) if x in keep_first else (c(x) if x in keys else c(f"_v.{x}").alias(x))
                        for x in current.columns])


def upsert_bars(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bars by company and day; bars without a day are skipped, a blank company is an error."""
    good = incoming.where("trade_date IS NOT NULL").withColumn(
        "cik", F.when(F.coalesce("cik", F.lit("")) == "", F.raise_error(F.lit("bar without a company key"))).otherwise(c("cik")))
    return upsert(current, good, ["cik", "trade_date"], ["fetched_at"])


def bar_coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("cik").agg(F.min("trade_date").alias("earliest"), F.max("trade_date").alias("latest"), F.count("*").alias("n"))


def refresh_coverage(coverage: DataFrame, bars: DataFrame, attempts: DataFrame) -> DataFrame:
    """Coverage rows after fetch attempts: range recomputed from the bars, last success kept when there is no new one."""
    span = bar_coverage(bars).select("cik", "earliest", "latest")
    good = c("new_status").isin("ok", "partial", "no_data")
    tried = attempts.groupBy("cik").agg(
        F.max_by(F.struct("new_status", "note"), F.struct("attempted_at", "attempt_no")).alias("_a"),
        F.max("attempted_at").alias("_at"), F.max(F.when(good, c("attempted_at"))).alias("_ok"))
    j = coverage.select("cik", "status", "note", "last_attempt_at", "last_success_at").join(tried, "cik", "full_outer").join(span, "cik", "left")
    return j.select("cik", "earliest", "latest", F.coalesce("_a.new_status", "status").alias("status"),
                    F.when(c("_a").isNotNull(), c("_a.note")).otherwise(c("note")).alias("note"),
                    F.coalesce("_at", "last_attempt_at").alias("last_attempt_at"),
                    F.coalesce("_ok", "last_success_at").alias("last_success_at"))


def retry_allowed(status: Column, last_attempt: Column, as_of: Column) -> Column:
    """Never tried and ok rows always; others only six hours after the last attempt."""
    age = F.unix_micros(as_of) - F.unix_micros(last_attempt)
    return F.when(status.isNull() | (status == "ok"), F.lit(True)).otherwise(age >= fv.RETRY_FLOOR_HOURS * 3600 * 1000000)


def recently_done(last_success: Column, as_of: Column) -> Column:
    """Successfully fetched less than a day ago."""
    age = F.unix_micros(as_of) - F.unix_micros(last_success)
    return F.coalesce(age < fv.RECENT_SUCCESS_HOURS * 3600 * 1000000, F.lit(False))


def covers(status: Column, earliest: Column, latest: Column, want_from: Column, want_to: Column) -> Column:
    return F.coalesce((status == "ok") & (earliest <= want_from) & (latest >= want_to), F.lit(False))


def price_action(coverage: DataFrame, as_of: Column) -> DataFrame:
    """What each company needs for its window: nothing, a delta, a full backfill, or to wait.

    Needs columns status, earliest, latest, last_attempt_at, want_from, want_to.
    """
    has = F.coalesce((c("status") == "ok") & c("earliest").isNotNull(), F.lit(False))
    full = covers(c("status"), c("earliest"), c("latest"), c("want_from"), c("want_to"))
    may = retry_allowed(c("status"), c("last_attempt_at"), as_of)
    return coverage.withColumn("action", F.when(has & full, F.lit("none")).when(~may, F.lit("wait"))
                               .when(has, F.lit("delta")).otherwise(F.lit("backfill")))


def delta_ranges(coverage: DataFrame, as_of: Column) -> DataFrame:
    """The days still missing after the latest bar; current companies have none."""
    return (coverage.withColumn("from", F.date_add("latest", 1)).withColumn("to", as_of.cast("date"))
            .where(c("from") <= c("to")))


def backward_chunks(companies: DataFrame, to: str, first_trade: str, years: int, floor: str) -> DataFrame:
    """Download stretches of ``years`` years, newest first, back to the first trade date.

    Each stretch ends the day before the one after it starts; the last one reaches the first trade date. Where that date is
    unknown the walk goes on to ``floor`` (a date before any listing) and open_ended is true: the run stops at the first
    stretch that the vendor has nothing for.
    """
    known = F.coalesce(c(first_trade), F.lit(floor).cast("date"))
    limit = F.greatest(F.lit(0), F.ceil(F.months_between(c(to), known) / (12 * years)).cast("int"))
    n = F.explode(F.sequence(F.lit(0), limit)).alias("chunk")
    rows = companies.select("*", n)
    # Starts move back year by year; the one-day steps accumulate before each year shift.
    walked = F.aggregate(F.sequence(F.lit(0), c("chunk")), F.struct(c(to).alias("e"), shift_years(c(to), -years).alias("s")),
                         lambda acc, i: F.when(i == 0, acc).otherwise(F.struct(
                             F.date_sub(acc["s"], 1).alias("e"), shift_years(F.date_sub(acc["s"], 1), -years).alias("s"))))
    out = (rows.withColumn("_w", walked).withColumn("chunk_from", c("_w.s")).withColumn("chunk_to", c("_w.e"))
           .withColumn("open_ended", c(first_trade).isNull()))
    return out.where((c("chunk") == 0) | (F.date_add("chunk_to", 1) > known)).drop("_w")


def step_outcome(coverage: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of the price step per company, from its coverage row and stored bars."""
    n = bar_coverage(bars).select("cik", "n")
    j = coverage.join(n, "cik", "left")
    return j.select("cik", F.when(c("status") == "ok", F.lit("ok")).when(c("status") == "no_symbol", F.lit("skipped"))
                    .otherwise(F.lit("error")).alias("result"), F.coalesce("n", F.lit(0)).alias("bars"))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary source; the fallback serves only the stretches the primary does not."""
    served = primary.select(*keys).distinct()
    return primary.withColumn("source", F.lit("primary")).unionByName(
        fallback.join(served, keys, "left_anti").withColumn("source", F.lit("fallback")))


def chunk_status(chunks: DataFrame) -> DataFrame:
    """Status per company over its stretches: ok once any bars arrived, else the error that stopped it."""
    got = F.max(c("bars") > 0)
    worst = F.max_by("result", F.struct((c("result") == "not_found").cast("int"), c("result")))
    return chunks.groupBy("cik").agg(F.when(got, F.lit("ok")).when(worst == "not_found", F.lit("not_found"))
                                     .otherwise(F.lit("error")).alias("status"), F.sum("bars").alias("bars"))
