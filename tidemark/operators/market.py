"""Prices around events: trading-day ordinals, reactions, rolling statistics, distributed ranks, correlation, walk-forward fits.

No step sorts a whole series or group in one task. Ordinals come from counts per month and carried offsets, so "n trading days on"
is an equi-join; rolling frames run over stretches of a series with a halo of the rows before; ranks come from range partitions with
carried offsets; a fit per fold comes from prefix sums of moments per period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.amounts import adjusted_or_raw
from tidemark.operators.joins import asof_join, numbered, with_halo
from tidemark.session import written

c = F.col


def priced(bars: DataFrame, keys: list[str] = ("cik",)) -> DataFrame:
    """The adjusted price, or the raw close, and the volume of each day that has a price."""
    price = adjusted_or_raw(c("adj_close"), c("close")).cast("double")
    return bars.select(*keys, "trade_date", price.alias("price"), c("volume").cast("double").alias("volume")).where("price IS NOT NULL AND trade_date IS NOT NULL")


def trading_ordinals(days: DataFrame, keys: list[str] = ("cik",), day: str = "trade_date") -> DataFrame:
    """Add ``n``, the number of the trading day within its series, from 1. Days must be distinct within a series.

    Days are numbered within their month, with the counts of the months before carried.
    """
    return numbered(days, list(keys), day, lambda d: F.trunc(d, "month"))


def prices_at(asks: DataFrame, series: DataFrame, steps: list[int], keys: list[str] = ("cik",)) -> DataFrame:
    """Day and price ``steps`` trading days from each asked day (keys, n): columns day_<step> and price_<step>, null outside the series.

    Asks must be distinct; a step is an equi-join on ordinals.
    """
    name = lambda s: str(s).replace("-", "m")
    wanted = asks.select(*keys, "n", F.explode(F.array(*map(F.lit, steps))).alias("_step")).withColumn("_at", c("n") + c("_step"))
    there = series.select(*keys, c("n").alias("_at"), c("trade_date").alias("_day"), c("price").alias("_price"))
    pick = lambda v, s: F.max(F.when(c("_step") == s, c(v)))
    return wanted.join(there, [*keys, "_at"], "left").groupBy(*keys, "n").agg(
        *[x for s in steps for x in (pick("_day", s).alias(f"day_{name(s)}"), pick("_price", s).alias(f"price_{name(s)}"))])


def price_reaction(events: DataFrame, bars: DataFrame, steps: list[int] = (1, 3, 5), date: str = "filing_date", keys: list[str] = ("cik",)) -> DataFrame:
    """Percent change of the price 1, 3 and 5 trading days after an event against the trading day before it.

    An event on a day without trading counts on the next trading day (snapped). Adds snapped, base_day, base_price, and day_k and
    return_k for each step; what lies outside the stored series is null, also the base of an event on the first day.
    """
    keys = list(keys)
    series = trading_ordinals(priced(bars, keys), keys)
    on = asof_join(events, series, keys, date, "trade_date", ["n"], forward=True, allow_equal=True).withColumnRenamed("trade_date", "snapped")
    at = prices_at(on.where("n IS NOT NULL").select(*keys, "n").distinct(), series, [-1, *steps], keys)
    j = on.join(at, [*keys, "n"], "left")
    base = c("price_m1")
    moved = [x for s in steps for x in (c(f"day_{s}"), F.when(base > 0, (c(f"price_{s}") / base - 1) * 100).alias(f"return_{s}"))]
    return j.select(*events.columns, "snapped", c("day_m1").alias("base_day"), base.alias("base_price"), *moved)


def abnormal_return(reactions: DataFrame, benchmark: DataFrame, steps: list[int] = (1, 3, 5)) -> DataFrame:
    """Add abnormal_k, the reaction less the benchmark's change between the same days.

    ``benchmark`` has one row per trade_date with its level. A day on which the benchmark has none takes its last level before.
    """
    one = F.lit("benchmark").alias("_index")
    reactions = written(reactions, "reactions")
    asked = reactions.select(F.explode(F.array("base_day", *[f"day_{s}" for s in steps])).alias("_day")).where("_day IS NOT NULL").distinct().select(one, "_day")
    levels = asof_join(asked, benchmark.select(one, "trade_date", "level"), ["_index"], "_day", "trade_date", ["level"], allow_equal=True)
    levels = written(levels.select("_day", "level"), "levels")  # a row per day
    out = reactions.join(levels.select(c("_day").alias("base_day"), c("level").alias("_base")), "base_day", "left")
    for s in steps:
        out = out.join(levels.select(c("_day").alias(f"day_{s}"), c("level").alias(f"_level_{s}")), f"day_{s}", "left")
        change = F.when(c("_base") > 0, (c(f"_level_{s}") / c("_base") - 1) * 100)
        out = out.withColumn(f"abnormal_{s}", c(f"return_{s}") - change).drop(f"_level_{s}")
    return out.select(*reactions.columns, *[f"abnormal_{s}" for s in steps])


def rolling_stats(bars: DataFrame, back: int = 30, stretch: int = 250, keys: list[str] = ("cik",)) -> DataFrame:
    """Per trading day, from the ``back`` days before it: volatility, momentum and the volume against its mean.

    Columns: keys, trade_date, n, price, daily_return, volatility (sample deviation of the daily returns), momentum (last price over
    first), volume_spike, frame_days (days in the frame; fewer than ``back`` at the start of a series). The day itself is not in its
    frame. Null where the frame has too few values or a divisor is zero.
    """
    keys = list(keys)
    rows = with_halo(trading_ordinals(priced(bars, keys), keys), back + 1, stretch)
    line = W.partitionBy(*keys, "_s").orderBy("n")
    frame = line.rowsBetween(-back, -1)
    before = F.lag("price").over(line)
    rows = rows.withColumn("daily_return", F.when(before > 0, c("price") / before - 1))
    first, mean = F.first("price").over(frame), F.avg("volume").over(frame)
    return (rows.withColumns({"volatility": F.when(F.count("daily_return").over(frame) > 1, F.stddev_samp("daily_return").over(frame)),
                              "momentum": F.when(first > 0, F.last("price").over(frame) / first - 1),
                              "volume_spike": F.when(mean > 0, c("volume") / mean), "frame_days": F.count("price").over(frame)})
            .where("_own").select(*keys, "trade_date", "n", "price", "daily_return", "volatility", "momentum", "volume_spike", "frame_days"))


def feature_vectors(bars: DataFrame, ahead: int = 5, keys: list[str] = ("cik",)) -> DataFrame:
    """Rolling statistics of each trading day with the target: the price ``ahead`` days on against the day before, in percent."""
    keys = list(keys)
    stats = written(rolling_stats(bars, keys=keys), "rolling")
    at = prices_at(stats.select(*keys, "n"), stats, [-1, ahead], keys)
    target = F.when(c("price_m1") > 0, (c(f"price_{ahead}") / c("price_m1") - 1) * 100)
    return stats.join(at.select(*keys, "n", target.alias("target")), [*keys, "n"])


def ranks(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Per key and distinct value: ties (rows that have it), below (rows of the key with a smaller value) and total.

    Exact. Equal values are counted first; what is left is cut into ranges of key and value over all tasks, so a key that holds most
    rows is ranked by many of them. Only one row per key and range is carried on. Null values have no rank.
    """
    keys = list(keys)
    counts = rows.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight or F.lit(1)).cast("bigint").alias("ties"))
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()), "ranges")
    piece = dealt.groupBy(*keys, "_p").agg(F.sum("ties").alias("_k"))
    up_to = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = piece.select(*keys, "_p", F.coalesce(F.sum("_k").over(up_to), F.lit(0)).alias("_before"), F.sum("_k").over(W.partitionBy(*keys)).alias("total"))
    inside = F.coalesce(F.sum("ties").over(W.partitionBy(*keys, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("_inside", inside)
    return numbered.join(offsets, [*keys, "_p"]).select(*keys, value, "ties", (c("_before") + c("_inside")).cast("bigint").alias("below"), c("total").cast("bigint").alias("total"))


def mean_rank() -> Column:
    """The rank of a value, from 1; equal values share the mean of their places."""
    return c("below") + (c("ties") + 1) / 2


def percent_rank() -> Column:
    """Share of the other rows that are smaller; 0 for the only row."""
    return F.when(c("total") > 1, c("below") / (c("total") - 1)).otherwise(F.lit(0.0))


def percentiles(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add percentile, the percent rank of each row's value within its group (null for a null value)."""
    known = ranks(rows, group, value).select(*group, value, percent_rank().alias("percentile"))
    return rows.join(known, [*group, value], "left").select(*rows.columns, "percentile")


def correlations(rows: DataFrame, target: str, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation of each feature with the target, over the rows that have both.

    Columns: keys, feature, n, pearson, spearman, significant (Fisher's transform of the Pearson coefficient beyond 1.959964 standard
    errors, that is p < 0.05; false below four rows). Null where feature or target has one value only.
    """
    group = [*keys, "feature"]
    long = rows.select(*keys, c(target).cast("double").alias("y"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("x")) for f in features))))
    pairs = written(long.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*group, "x", "y").agg(F.count("*").alias("w")), "pairs")
    rx = ranks(pairs, group, "x", "w").select(*group, "x", (mean_rank() - (c("total") + 1) / 2).alias("_rx"))
    ry = ranks(pairs, group, "y", "w").select(*group, "y", (mean_rank() - (c("total") + 1) / 2).alias("_ry"))
    both = pairs.join(rx, [*group, "x"]).join(ry, [*group, "y"])
    mean = pairs.groupBy(*group).agg((F.sum(c("x") * c("w")) / F.sum("w")).alias("_mx"), (F.sum(c("y") * c("w")) / F.sum("w")).alias("_my"))
    dx, dy, w = c("x") - c("_mx"), c("y") - c("_my"), c("w")
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    sums = both.join(mean, group).groupBy(*group).agg(
        F.sum("w").alias("n"), varied.alias("_v"), F.sum(dx * dy * w).alias("_xy"), F.sum(dx * dx * w).alias("_xx"), F.sum(dy * dy * w).alias("_yy"),
        F.sum(c("_rx") * c("_ry") * w).alias("_rxy"), F.sum(c("_rx") * c("_rx") * w).alias("_rxx"), F.sum(c("_ry") * c("_ry") * w).alias("_ryy"))
    one = lambda a, b, d: F.when(c("_v"), F.try_divide(c(a), F.sqrt(c(b)) * F.sqrt(c(d))))
    out = sums.select(*group, "n", one("_xy", "_xx", "_yy").alias("pearson"), one("_rxy", "_rxx", "_ryy").alias("spearman"))
    z = F.when((c("n") > 3) & (F.abs("pearson") < 1), F.abs(F.atanh("pearson")) * F.sqrt(c("n") - 3) > 1.959964)
    return out.withColumn("significant", F.coalesce(z, (F.abs("pearson") >= 1) & (c("n") > 3), F.lit(False)))


def period_moments(rows: DataFrame, period: str, target: str, features: list[str]) -> DataFrame:
    """Per period: count, sums and sums of products of features and target, over rows that have all. Sums of periods add up."""
    value = [c(f).cast("double") for f in features] + [c(target).cast("double")]
    whole = rows.where(F.forall(F.array(*value), lambda v: v.isNotNull()))
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(value)]
    products = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(value) for j, b in enumerate(value) if i <= j]
    return whole.groupBy(period).agg(F.count("*").cast("double").alias("n"), *sums, *products)


def fit_before(moments: DataFrame, period: str, size: int, ridge: float = 0.0) -> DataFrame:
    """Least squares per period from all periods strictly before it: trained_on, intercept, weights (array of ``size``).

    From prefix sums of the moments, one row per period; no row of the data is read again. Null where there are too few rows or the
    features depend on each other. ``ridge`` is added to the diagonal of the centred products.
    """
    sums = [x for x in moments.columns if x != period]
    earlier = W.orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    prefix = moments.select(period, *[F.sum(x).over(earlier).alias(x) for x in sums])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.fillna(0.0).to_dict("records"):
                n, weights, intercept = r["n"], None, None
                if n > size:
                    mean = np.array([r[f"s{i}"] for i in range(size + 1)]) / n
                    full = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(size + 1)] for i in range(size + 1)]) - n * np.outer(mean, mean)
                    left = full[:size, :size] + ridge * np.eye(size)
                    scale = np.sqrt(np.maximum(np.diag(left), 1e-300))
                    if (np.diag(left) > 0).all() and np.linalg.cond(left / np.outer(scale, scale)) < 1e10:
                        weights = np.linalg.solve(left, full[:size, size])
                        intercept = float(mean[size] - weights @ mean[:size])
                out.append((r[period], int(n), intercept, None if weights is None else weights.tolist()))
            yield pd.DataFrame(out, columns=[period, "trained_on", "intercept", "weights"])
    return prefix.mapInPandas(solve, f"{period} {moments.schema[period].dataType.simpleString()}, trained_on long, intercept double, weights array<double>")


def walk_forward(rows: DataFrame, period: str, target: str, features: list[str], ridge: float = 0.0) -> DataFrame:
    """Add trained_on and predicted: each row's target as fitted on all rows of earlier periods. Rows without a fit have none."""
    folds = fit_before(period_moments(rows, period, target, features), period, len(features), ridge)
    guess = F.aggregate(F.zip_with(F.array(*(c(f).cast("double") for f in features)), "weights", lambda a, b: a * b), c("intercept"), lambda a, b: a + b)
    return rows.join(folds, period, "left").withColumn("predicted", guess).drop("intercept", "weights")


def forecast_quality(predictions: DataFrame, period: str, target: str) -> DataFrame:
    """Per period, and over all with a null period: predicted rows, hit_rate of the sign, mean absolute error, and Sharpe ratio.

    The strategy earns the target where a rise is predicted and its negative where a fall is; the ratio is its mean over its sample
    deviation, null below two rows or without any.
    """
    sign = F.signum("predicted")
    earned = sign * c(target)
    known = predictions.where(c("predicted").isNotNull() & c(target).isNotNull())
    return known.rollup(period).agg(
        F.count("*").alias("n"), F.avg((sign == F.signum(c(target))).cast("double")).alias("hit_rate"), F.avg(F.abs(c("predicted") - c(target))).alias("mae"),
        F.when((F.count("*") > 1) & (F.stddev_samp(earned) > 0), F.avg(earned) / F.stddev_samp(earned)).alias("sharpe"))


def insider_kind(code: Column) -> Column:
    """What an insider transaction code says: open_market for purchases and sales, compensation for awards and the like, else other."""
    code = F.upper(F.trim(code))
    return F.when(code.isin("P", "S"), F.lit("open_market")).when(code.isin("A", "D", "F", "M"), F.lit("compensation")).otherwise(F.lit("other"))


def surprise(rows: DataFrame, actual: str, estimate: str, on: str, dated: str, days: int = 30) -> DataFrame:
    """Add surprise_pct, the actual against the estimate in percent of the estimate, and whether the estimate is of the last ``days`` days."""
    pct = F.when(c(estimate) != 0, (c(actual) - c(estimate)) / c(estimate) * 100)
    return rows.withColumns({"surprise_pct": pct, "in_window": F.coalesce(F.datediff(on, dated) <= days, F.lit(False))})
