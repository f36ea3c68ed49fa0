"""Prices around events against brute force, with one series and one group holding most rows."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as jn, market as mk

DAY = dt.date(2019, 12, 20)
BARS = "cik string, trade_date date, close double, adj_close double, volume long"


def _bars(rnd, days):
    """Bars of company "hot" on most of the days, of others on some; prices sometimes adjusted, volumes sometimes missing."""
    out = []
    for cik, share in (("hot", 0.8), ("a", 0.1), ("b", 0.02)):
        for i in range(days):
            if rnd.random() < share:
                out.append((cik, DAY + dt.timedelta(days=i), 10 + rnd.random(), rnd.choice([None, 0.0, 5 + rnd.random()]), rnd.choice([None, 0, rnd.randrange(1, 99)])))
    return out


def _series(bars):
    out = {}
    for cik, day, close, adj, volume in sorted(bars):
        out.setdefault(cik, []).append((day, adj if adj else close, volume))
    return out


def test_ordinals_count_trading_days(spark):
    bars = _bars(random.Random(1), 500)
    got = {(r.cik, r.trade_date): r.n for r in mk.trading_ordinals(spark.createDataFrame(bars, BARS)).collect()}
    assert got == {(k, row[0]): i + 1 for k, rows in _series(bars).items() for i, row in enumerate(rows)}


def test_reaction_and_abnormal_return(spark):
    rnd = random.Random(2)
    bars = _bars(rnd, 200)
    series = _series(bars)
    events = [(i, rnd.choice(["hot", "hot", "a", "b", "none"]), DAY + dt.timedelta(days=rnd.randrange(-5, 205))) for i in range(300)]
    bench = {DAY + dt.timedelta(days=i): 100 + rnd.random() for i in range(30, 200, 4)}
    rx = mk.price_reaction(spark.createDataFrame(events, "accession int, cik string, filing_date date"), spark.createDataFrame(bars, BARS))
    got = {r.accession: r for r in mk.abnormal_return(rx, spark.createDataFrame(list(bench.items()), "trade_date date, level double")).collect()}
    assert len(got) == 300
    level = lambda d: next((bench[x] for x in sorted(bench, reverse=True) if x <= d), None)
    seen = set()
    for i, cik, day in events:
        rows = series.get(cik, [])
        at = next((k for k, row in enumerate(rows) if row[0] >= day), None)
        base = rows[at - 1] if at else None
        assert got[i].snapped == (rows[at][0] if at is not None else None) and got[i].base_day == (base[0] if base else None)
        for k in (1, 3, 5):
            then = rows[at + k] if base and at + k < len(rows) else None
            want = (then[1] / base[1] - 1) * 100 if then else None
            assert got[i][f"return_{k}"] == (pytest.approx(want) if then else None)
            b = level(base[0]) if base else None
            less = want - (level(then[0]) / b - 1) * 100 if then and b else None
            assert got[i][f"abnormal_{k}"] == (pytest.approx(less) if less is not None else None)
            seen.add((base is None, then is None, less is None))
    assert {(True, True, True), (False, True, True), (False, False, True), (False, False, False)} <= seen


@pytest.mark.parametrize("stretch", [31, 40, 1000])
def test_rolling_frames_are_complete(spark, stretch):
    bars = _bars(random.Random(3), 400)
    got = {(r.cik, r.n): r for r in mk.rolling_stats(spark.createDataFrame(bars, BARS), 30, stretch).collect()}
    series = _series(bars)
    assert len(got) == sum(map(len, series.values()))
    for cik, rows in series.items():
        returns = [None] + [b[1] / a[1] - 1 for a, b in zip(rows, rows[1:])]
        for i, (day, price, volume) in enumerate(rows):
            r, frame = got[cik, i + 1], rows[max(0, i - 30):i]
            past = [x for x in returns[max(0, i - 30):i] if x is not None]
            assert r.trade_date == day and r.frame_days == len(frame)
            assert r.volatility == (pytest.approx(statistics.stdev(past)) if len(past) > 1 else None)
            assert r.momentum == (pytest.approx(frame[-1][1] / frame[0][1] - 1) if frame else None)
            volumes = [x[2] for x in frame if x[2] is not None]
            mean = sum(volumes) / len(volumes) if volumes else 0
            assert r.volume_spike == (pytest.approx(volume / mean) if mean and volume is not None else None)


def test_no_window_over_a_whole_series(spark):
    plan = mk.rolling_stats(spark.createDataFrame([("a", DAY, 1.0, None, 1)], BARS))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_b#" in line or "_s#" in line for line in windows)
    with pytest.raises(ValueError):
        jn.with_halo(spark.range(1), 31, 30)


def test_ranks_with_ties_and_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [(("hot" if i % 10 else "rare"), rnd.choice([None, -0.5, 0.0, 7.25, float(rnd.randrange(3000))])) for i in range(20000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "industry string, v double")
    got = {(r.industry, r.v): r for r in mk.ranks(df, ["industry"], "v").select("*", mk.mean_rank().alias("mean"), mk.percent_rank().alias("pct")).collect()}
    for name in ("hot", "rare", "one"):
        values = sorted(v for k, v in rows if k == name and v is not None)
        below = {}
        for i, v in enumerate(values):
            below.setdefault(v, i)
        assert {v for k, v in got if k == name} == set(values)
        for v, b in below.items():
            n = values.count(v) if v in (-0.5, 0.0, 7.25) else None
            r = got[name, v]
            assert (r.below, r.total) == (b, len(values)) and (n is None or r.ties == n) and r["mean"] == b + (r.ties + 1) / 2
            assert r.pct == (pytest.approx(b / (len(values) - 1)) if len(values) > 1 else 0.0)
    shares = mk.percentiles(df, ["industry"], "v")
    assert shares.count() == len(rows) and shares.where("percentile IS NULL").count() == sum(v is None for _, v in rows)


def test_ranks_spread_a_hot_group_over_tasks(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("v"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        counts = df.groupBy("k", "v").count().repartitionByRange("k", "v").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset(conf)
    assert len(counts) == 8 and max(r["count"] for r in counts) < 60_000


def test_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400).round(1)
    y = x ** 3 + rng.normal(size=400)
    rows = [(float(a), float(b), 1.0, None if i % 3 else float(i), float(rng.integers(0, 2))) for i, (a, b) in enumerate(zip(x, y))]
    got = {r.feature: r for r in mk.correlations(spark.createDataFrame(rows, "x double, y double, same double, some double, noise double"), "y", ["x", "same", "some", "noise"]).collect()}

    def rank(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2
    assert got["x"].n == 400 and got["x"].significant and got["x"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got["x"].spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert (got["same"].pearson, got["same"].spearman, got["same"].significant) == (None, None, False)
    some = [(r[3], r[1]) for r in rows if r[3] is not None]
    assert got["some"].n == len(some) and got["some"].spearman == pytest.approx(np.corrcoef(rank(np.array([a for a, _ in some])), rank(np.array([b for _, b in some])))[0, 1])


def test_walk_forward_equals_full_refits(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        x = [float(v) for v in rng.normal(size=3)]
        rows.append((i // 50, *x, float(2 * x[0] - x[1] + 0.5 + rng.normal())))
    rows += [(3, None, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0, None), (20, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "period int, a double, b double, c double, y double")
    out = mk.walk_forward(df, "period", "y", ["a", "b", "c"])
    for r in out.collect():
        past = [x for x in rows if x[0] < r.period and None not in x]
        if r.a is None:
            assert r.predicted is None
            continue
        assert r.trained_on == len(past)
        if not past:
            assert r.predicted is None
            continue
        m = np.array([[1.0, *x[1:4]] for x in past])
        beta = np.linalg.lstsq(m, np.array([x[4] for x in past]), rcond=None)[0]
        assert r.predicted == pytest.approx(beta @ [1.0, r.a, r.b, r.c])
    quality = {r.period: r for r in mk.forecast_quality(out, "period", "y").collect()}
    assert quality[None].n == 551 and quality[None].hit_rate > 0.7 and quality[20].sharpe is None
    twice = mk.walk_forward(df.withColumn("b", F.col("a") * 2), "period", "y", ["a", "b"])
    assert twice.where("predicted IS NOT NULL").count() == 0  # features that depend on each other have no fit
    assert mk.walk_forward(df.withColumn("b", F.col("a") * 2), "period", "y", ["a", "b"], ridge=1.0).where("predicted IS NOT NULL").count() == 552


def test_empty_series(spark):
    none = spark.createDataFrame([], BARS)
    assert mk.rolling_stats(none).count() == 0
    assert mk.feature_vectors(none).count() == 0
    one = spark.createDataFrame([(1, "a", DAY)], "accession int, cik string, filing_date date")
    assert [(r.snapped, r.return_1) for r in mk.price_reaction(one, none).collect()] == [(None, None)]
    assert mk.correlations(spark.createDataFrame([], "x double, y double"), "y", ["x"]).count() == 0
