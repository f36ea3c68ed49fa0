"""Join shapes Spark has no single operator for: as-of in time, banded ratios, upper medians.

All of them first reduce each side to one row per key and point, then split what is left of a key by a
time or size bucket, so that one very frequent key is spread over many tasks and never paired with itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              values: list[str], *, forward: bool = False, allow_equal: bool = False,
              tie_break: list[str] | None = None, bucket: str | Callable[[Column], Column] = "month") -> DataFrame:
    """Left join each row to the nearest right row before it (or after it with ``forward``).

    Adds ``values`` and ``right_time`` of the match; rows without a match keep NULLs. Without
    ``allow_equal`` a right row at the same time is not seen. Several right rows of one key and time
    are decided by the greatest ``tie_break``. ``bucket`` cuts the time into stretches: a unit of dates, or for
    numbers a function that does not fall.
    """
    stretch = bucket if callable(bucket) else lambda t: F.date_trunc(bucket, t)
    tie = F.struct(*[F.col(x) for x in tie_break or values])
    candidates = (right.where(F.col(right_time).isNotNull()).groupBy(*keys, right_time)
                  .agg(F.max_by(F.struct(*values), tie).alias("v"))
                  .select(*keys, F.col(right_time).alias("_t"),
                          F.struct(F.col(right_time).alias("at"), *[F.col(f"v.{v}").alias(v) for v in values]).alias("_c"),
                          F.lit(0 if allow_equal else 1).alias("_o"), F.lit(False).alias("_probe")))
    kind = candidates.schema["_c"].dataType
    probes = (left.select(*keys, F.col(left_time).alias("_t")).where(F.col("_t").isNotNull()).distinct()
              .select(*keys, "_t", F.lit(None).cast(kind).alias("_c"),
                      F.lit(1 if allow_equal else 0).alias("_o"), F.lit(True).alias("_probe")))
    both = candidates.unionByName(probes).withColumn("_b", stretch(F.col("_t")))
    order = [F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_o")]
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("_near", F.last("_c", ignorenulls=True).over(inside))
    edge = F.min_by if forward else F.max_by
    per_bucket = both.groupBy(*keys, "_b").agg(edge("_c", F.when(F.col("_c").isNotNull(), F.col("_t"))).alias("_edge"))
    across = (W.partitionBy(*keys).orderBy(F.col("_b").desc() if forward else F.col("_b").asc())
              .rowsBetween(W.unboundedPreceding, -1))
    carried = per_bucket.select(*keys, "_b", F.last("_edge", ignorenulls=True).over(across).alias("_carry"))
    matched = (seen.where("_probe").join(carried, [*keys, "_b"], "left")
               .select(*keys, F.col("_t").alias(left_time), F.coalesce("_near", "_carry").alias("_m")))
    out = left.join(matched, [*keys, left_time], "left")
    return out.select(*left.columns, F.col("_m.at").alias(right_time), *[F.col(f"_m.{v}").alias(v) for v in values])


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median", weight: str | None = None) -> DataFrame:
    """Element ``n // 2`` (from zero) of each key's sorted values, with the number of values.

    ``weight`` names a column that says how many times a row's value counts.

    Exact: counts per order-preserving size bucket locate the bucket of the middle element; only that
    bucket's distinct values are ranked.
    """
    size = F.col(value).cast("double")
    step = F.when(size == 0, F.lit(0)).otherwise(F.signum(size) * (F.floor(F.log2(F.abs(size)) * 8) + 16384))
    bucketed = df.where(F.col(value).isNotNull()).withColumn("_b", step.cast("bigint"))
    # Negative sizes order by falling magnitude, so their bucket number is already reversed by the sign.
    counts = bucketed.groupBy(*keys, "_b", F.col(value).alias("_v")).agg(F.sum(weight or F.lit(1)).alias("_n"))
    per_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    up_to = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    target = (per_bucket.withColumn("_cum", F.sum("_bn").over(up_to)).withColumn("n", F.sum("_bn").over(whole))
              .withColumn("_pos", F.floor(F.col("n") / 2) + 1)
              .where((F.col("_cum") >= F.col("_pos")) & (F.col("_cum") - F.col("_bn") < F.col("_pos")))
              .select(*keys, "_b", "n", (F.col("_pos") - (F.col("_cum") - F.col("_bn"))).alias("_in")))
    ranked = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (counts.join(target, [*keys, "_b"]).withColumn("_c", F.sum("_n").over(ranked))
            .where((F.col("_c") >= F.col("_in")) & (F.col("_c") - F.col("_n") < F.col("_in")))
            .select(*keys, F.col("_v").alias(name), "n"))


def ratio_counts(asked: DataFrame, values: DataFrame, group: list[str], value: str, count: str,
                 targets: dict[str, float], tolerance: float) -> DataFrame:
    """For each asked value of a group: how many rows of the group lie at each target ratio to it.

    ``asked`` has distinct non-zero values per group, ``values`` one row per group and distinct non-zero
    value with its row count. A value is compared only with values in the size buckets a target ratio can
    reach, never with its whole group. Adds one column per target; values that reach nothing are left out.
    """
    width, slack = 0.25, 1.1 * tolerance
    log_size = F.log(F.abs(F.col(value)))
    bucket = lambda x: F.floor(x / F.lit(width)).cast("bigint")

    def probes(label: str, ratio: float) -> Column:
        at = log_size + F.lit(math.log(ratio))
        return F.transform(F.array_distinct(F.array(bucket(at - slack), bucket(at + slack))), lambda h: F.struct(
            F.lit(label).alias("_label"), F.lit(float(ratio)).alias("_ratio"), h.alias("_h")))
    reach = [probes(label, ratio) for label, ratio in targets.items()]
    asks = asked.select(*group, F.col(value).alias("_own"), F.signum(F.col(value)).alias("_s"),
                        F.inline(F.concat(*reach)))
    others = values.select(*group, F.col(value).alias("_other"), F.col(count).alias("_k"),
                           F.signum(F.col(value)).alias("_s"), bucket(log_size).alias("_h"))
    near = asks.join(others, [*group, "_s", "_h"]).where(
        F.abs(F.col("_other") / F.col("_own") - F.col("_ratio")) / F.col("_ratio") <= tolerance)
    return near.groupBy(*group, F.col("_own").alias(value)).agg(
        *[F.coalesce(F.sum(F.when(F.col("_label") == label, F.col("_k"))), F.lit(0)).alias(label) for label in targets])


def first_match(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: the columns of its first row in a total order (combined before the shuffle)."""
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_f"))
            .select(*keys, *[F.col(f"_f.{x}").alias(x) for x in columns]))


def numbered(df: DataFrame, keys: list[str], order: str, bucket: Callable[[Column], Column], name: str = "n") -> DataFrame:
    """Add ``name``, the place of each row within its key in the order of a column, from 1. The column must be distinct within a key.

    ``bucket`` cuts the order into stretches (a function of the column that does not fall). Rows are numbered within their stretch
    and the counts of the stretches before are carried over one row per stretch, so a long key is many tasks.
    """
    cut = df.withColumn("_b", bucket(F.col(order)))
    before = F.sum("_k").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_k")).select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order))
    return cut.join(offsets, [*keys, "_b"]).withColumn(name, (F.col("_before") + inside).cast("bigint")).drop("_b", "_before")


def with_halo(series: DataFrame, halo: int, stretch: int, n: str = "n") -> DataFrame:
    """The rows of a numbered series in stretches (``_s``) of consecutive places, each with copies of the ``halo`` rows before it.

    Copies have ``_own`` false. So a frame that looks back at most ``halo`` rows is complete within (series, stretch).
    """
    if stretch < halo:
        raise ValueError("a stretch must be at least as long as its halo")
    i = F.col(n) - 1
    s = F.floor(i / stretch).cast("bigint")
    places = F.when(i - s * stretch >= stretch - halo, F.array(s, s + 1)).otherwise(F.array(s))
    return series.withColumn("_home", s).withColumn("_s", F.explode(places)).withColumn("_own", F.col("_s") == F.col("_home")).drop("_home")
