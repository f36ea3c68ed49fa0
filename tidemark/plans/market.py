"""Queries over prices around events: reactions, rolling statistics, correlation, walk-forward fits, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import estimates as es, market as mk
from tidemark.registry import query

c = F.col

# Filings dated up to two days around an event, so that some fall on days without trading and some past the last bar.
_EV_SRC = "SELECT event_id AS accession, lpad(CAST(user_id AS STRING), 10, '0') AS cik, CAST(CAST(ts AS DATE) + CAST(event_id % 5 - 2 AS INT) * INTERVAL 1 DAY AS DATE) AS filing_date FROM events"
_PRICE = "CASE WHEN adj_close <> 0 THEN adj_close ELSE close END"
_SERIES_CTE = f"sr AS (SELECT cik, trade_date, {_PRICE} AS price, row_number() OVER (PARTITION BY cik ORDER BY trade_date) AS n FROM bars WHERE {_PRICE} IS NOT NULL)"
_REACT_CTE = _SERIES_CTE + """,
    on_day AS (SELECT s.accession, s.cik, (SELECT min(d.n) FROM sr d WHERE d.cik = s.cik AND d.trade_date >= s.filing_date) AS n FROM src s),
    rx AS (SELECT o.accession, o.cik, z.trade_date AS snapped, b.trade_date AS base_day, b.price AS base_price, p1.trade_date AS day_1, p3.trade_date AS day_3, p5.trade_date AS day_5,
        CASE WHEN b.price > 0 THEN (p1.price / b.price - 1) * 100 END AS return_1, CASE WHEN b.price > 0 THEN (p3.price / b.price - 1) * 100 END AS return_3, CASE WHEN b.price > 0 THEN (p5.price / b.price - 1) * 100 END AS return_5
      FROM on_day o LEFT JOIN sr z ON z.cik = o.cik AND z.n = o.n LEFT JOIN sr b ON b.cik = o.cik AND b.n = o.n - 1 LEFT JOIN sr p1 ON p1.cik = o.cik AND p1.n = o.n + 1
        LEFT JOIN sr p3 ON p3.cik = o.cik AND p3.n = o.n + 3 LEFT JOIN sr p5 ON p5.cik = o.cik AND p5.n = o.n + 5)"""


@query("ext01_surprise", views="reports estimates", sql="""
    WITH m AS (SELECT r.event_id, r.eps_actual, r.report_date, max(e.consensus_date) AS consensus_date, max_by(e.eps_estimate, (e.consensus_date, e.event_id, e.eps_estimate)) AS eps_estimate
      FROM reports r LEFT JOIN estimates e ON e.cik = r.cik AND e.source = r.source AND e.period_end = r.period_end AND e.duration = r.duration AND e.consensus_date < r.report_date GROUP BY ALL)
    SELECT event_id, consensus_date::VARCHAR AS consensus_date, CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / eps_estimate * 100 END AS surprise_pct, coalesce(report_date - consensus_date <= 7, false) AS in_window FROM m""")
def ext01(t):
    near = es.estimate_before(t.reports, t.estimates, "report_date", ["event_id"])
    return mk.surprise(near, "eps_actual", "eps_estimate", "report_date", "consensus_date", 7).select(
        "event_id", c("consensus_date").cast("string").alias("consensus_date"), "surprise_pct", "in_window")


@query("ext02_price_reaction", src=_EV_SRC, views="bars", sql=f"WITH {_REACT_CTE} SELECT accession, snapped::VARCHAR AS snapped, base_day::VARCHAR AS base_day, base_price, return_1, return_3, return_5 FROM rx")
def ext02(t, src):
    return mk.price_reaction(src, t.bars).select("accession", c("snapped").cast("string").alias("snapped"), c("base_day").cast("string").alias("base_day"),
                                                 "base_price", "return_1", "return_3", "return_5")


# The benchmark is the mean price of the day, and has no level on every seventh day of the month.
_LEVELS = f"SELECT trade_date, avg({_PRICE}) AS level FROM bars WHERE day(trade_date) % 7 > 0 GROUP BY trade_date"


@query("ext03_abnormal_return", src=_EV_SRC, views="bars", sql=f"""
    WITH {_REACT_CTE}, lv AS ({_LEVELS}), dy AS (SELECT DISTINCT trade_date FROM bars), la AS (SELECT dy.trade_date, max_by(lv.level, lv.trade_date) AS level FROM dy JOIN lv ON lv.trade_date <= dy.trade_date GROUP BY dy.trade_date)
    SELECT accession, return_1 - (l1.level / b.level - 1) * 100 AS abnormal_1, return_3 - (l3.level / b.level - 1) * 100 AS abnormal_3, return_5 - (l5.level / b.level - 1) * 100 AS abnormal_5
    FROM rx LEFT JOIN la b ON b.trade_date = base_day LEFT JOIN la l1 ON l1.trade_date = day_1 LEFT JOIN la l3 ON l3.trade_date = day_3 LEFT JOIN la l5 ON l5.trade_date = day_5""")
def ext03_abnormal(t, src):
    level = mk.priced(t.bars).where("day(trade_date) % 7 > 0").groupBy("trade_date").agg(F.avg("price").alias("level"))
    return mk.abnormal_return(mk.price_reaction(src, t.bars), level).select("accession", "abnormal_1", "abnormal_3", "abnormal_5")


_ROLL_CTE = f"""mr AS (SELECT cik, trade_date, {_PRICE} AS price, CAST(volume AS DOUBLE) AS volume, row_number() OVER (PARTITION BY cik ORDER BY trade_date) AS n FROM market_bars),
    md AS (SELECT *, CASE WHEN lag(price) OVER w > 0 THEN price / lag(price) OVER w - 1 END AS daily_return FROM mr WINDOW w AS (PARTITION BY cik ORDER BY n)),
    ms AS (SELECT cik, trade_date, n, price, daily_return, stddev_samp(daily_return) OVER f AS volatility, CASE WHEN first_value(price) OVER f > 0 THEN last_value(price) OVER f / first_value(price) OVER f - 1 END AS momentum,
      CASE WHEN avg(volume) OVER f > 0 THEN volume / avg(volume) OVER f END AS volume_spike, count(price) OVER f AS frame_days FROM md WINDOW f AS (PARTITION BY cik ORDER BY n ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


@query("ext03_rolling_stats", views="market_bars", sql=f"WITH {_ROLL_CTE} SELECT cik, trade_date::VARCHAR AS trade_date, n, daily_return, volatility, momentum, volume_spike, frame_days FROM ms")
def ext03_rolling(t):
    return mk.rolling_stats(t.market_bars).select("cik", c("trade_date").cast("string").alias("trade_date"), "n", "daily_return", "volatility", "momentum", "volume_spike", "frame_days")


_VECTOR_CTE = _ROLL_CTE + """,
    fv AS (SELECT s.*, CASE WHEN b.price > 0 THEN (p.price / b.price - 1) * 100 END AS target FROM ms s LEFT JOIN ms b ON b.cik = s.cik AND b.n = s.n - 1 LEFT JOIN ms p ON p.cik = s.cik AND p.n = s.n + 5)"""


def _pair_sql(feature: str) -> str:
    return f"SELECT '{feature}' AS feature, CAST({feature} AS DOUBLE) AS x, target AS y FROM fv WHERE {feature} IS NOT NULL AND target IS NOT NULL"


_FEATURES = ["volatility", "momentum", "volume_spike", "daily_return"]


@query("ext04_correlations", views="market_bars", sql=f"""
    WITH {_VECTOR_CTE}, pr AS ({' UNION ALL '.join(map(_pair_sql, _FEATURES))} UNION ALL SELECT 'constant', 1.0, target FROM fv WHERE target IS NOT NULL),
    rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM pr),
    co AS (SELECT feature, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM rk GROUP BY feature)
    SELECT feature, n, pearson, spearman, coalesce(abs(atanh(pearson)) * sqrt(n - 3) > 1.959964, false) AS significant FROM co""")
def ext04(t):
    vectors = mk.feature_vectors(t.market_bars).withColumn("constant", F.lit(1.0))
    return mk.correlations(vectors, "target", [*_FEATURES, "constant"])


@query("ext05_walk_forward", views="market_bars", sql=f"""
    WITH {_VECTOR_CTE}, r AS (SELECT date_trunc('quarter', trade_date) AS q, momentum AS x, target AS y FROM fv), ok AS (SELECT * FROM r WHERE x IS NOT NULL AND y IS NOT NULL),
    fit AS (SELECT d.q, regr_slope(ok.y, ok.x) AS b, regr_intercept(ok.y, ok.x) AS a FROM (SELECT DISTINCT q FROM r) d JOIN ok ON ok.q < d.q GROUP BY d.q HAVING count(*) > 1),
    p AS (SELECT r.q, r.y, fit.a + fit.b * r.x AS g FROM r JOIN fit USING (q) WHERE r.x IS NOT NULL AND r.y IS NOT NULL),
    e AS (SELECT *, sign(g) * y AS s FROM p)
    SELECT CAST(CAST(q AS DATE) AS VARCHAR) AS quarter, count(*) AS n, avg(CASE WHEN sign(g) = sign(y) THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(abs(g - y)) AS mae, CASE WHEN count(*) > 1 AND stddev_samp(s) > 0 THEN avg(s) / stddev_samp(s) END AS sharpe
    FROM e GROUP BY GROUPING SETS ((q), ())""")
def ext05(t):
    rows = mk.feature_vectors(t.market_bars).withColumn("quarter", F.trunc("trade_date", "quarter").cast("string"))
    return mk.forecast_quality(mk.walk_forward(rows, "quarter", "target", ["momentum"]), "quarter", "target")


_INDUSTRY_SRC = "SELECT o_orderkey AS filing_no, c_mktsegment AS industry, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CASE WHEN o_orderkey % 11 > 0 THEN floor(CAST(o_totalprice AS DOUBLE) / 1000.0E0) END AS growth FROM orders JOIN customer ON o_custkey = c_custkey"


@query("ext06_industry_percentile", src=_INDUSTRY_SRC, sql="""
    SELECT filing_no, CASE WHEN growth IS NOT NULL THEN percent_rank() OVER (PARTITION BY industry, quarter, growth IS NULL ORDER BY growth) END AS percentile FROM src""")
def ext06(t, src):
    return mk.percentiles(src, ["industry", "quarter"], "growth").select("filing_no", "percentile")


_CODE_SRC = "SELECT l_orderkey AS filing_no, l_linenumber AS line_no, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN ' s' ELSE CASE l_linestatus WHEN 'O' THEN 'P' ELSE 'F' END END AS code, CAST(l_quantity AS DOUBLE) AS shares FROM lineitem"


@query("ext06_insider_kind", src=_CODE_SRC, sql="""
    SELECT CASE WHEN upper(trim(code)) IN ('P', 'S') THEN 'open_market' WHEN upper(trim(code)) IN ('A', 'D', 'F', 'M') THEN 'compensation' ELSE 'other' END AS kind, count(*) AS n, sum(shares) AS shares FROM src GROUP BY 1""")
def ext06_insider(t, src):
    return src.groupBy(mk.insider_kind(c("code")).alias("kind")).agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))
