"""Company timelines: events, highlights, trading-day snapping, lanes, clusters, axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import fixed_values as fv
from tidemark.functions import amounts as am, periods as pd_, text as tx
from tidemark.functions.classify import is_event, metric_table, weight_of, why_it_matters
from tidemark.operators.joins import asof_join
from tidemark.session import written

c = F.col


def report_period(label: Column, duration: Column, end: Column, focus: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) != "", F.struct(label.alias("label"), duration.alias("duration"),
                                                                end.alias("end_date"), focus.alias("focus")))


def lane_filter(events: DataFrame, lane: str) -> DataFrame:
    """All events, major ones, or those that carry news; an unknown lane shows all."""
    if lane == "major":
        return events.where(weight_of(c("category")) == "major")
    if lane == "financials":
        return events.where(is_event(c("category")))
    return events


def financial_report(category: Column) -> Column:
    return category.isin(fv.REPORT_CATEGORIES)


def metric_highlights(lines: DataFrame) -> DataFrame:
    """Up to four headline metrics per filing as label and text, in display order.

    The first publishable line of a metric counts; growth is shown, else the comparable.
    """
    ranks = metric_table(lines.sparkSession).where(c("key").isin(fv.METRIC_RANK)).select("key", "display", "metric_rank")
    first = (lines.where(am.publishable(c("confidence")) & c("key").isin(fv.METRIC_RANK)).groupBy("accession", "key")
             .agg(F.min_by(F.struct("value", "metric_unit", "yoy", "prior_value", "prior_label"), F.struct("position", "value")).alias("l")))
    shown = am.format_value(c("l.value"), c("l.metric_unit"))
    text = (F.when(c("l.yoy").isNotNull(), F.concat(shown, F.lit(" ("), am.signed_percent(c("l.yoy")), F.lit(" YoY)")))
            .when((F.coalesce(c("l.prior_label"), F.lit("")) != "") & c("l.prior_value").isNotNull(),
                  F.concat(shown, F.lit(" ("), c("l.prior_label"), F.lit(": "),
                           am.format_value(c("l.prior_value"), c("l.metric_unit")), F.lit(")")))
            .otherwise(shown))
    return (first.join(F.broadcast(ranks), "key").withColumn("text", text).groupBy("accession")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("metric_rank", c("display").alias("label"), c("text").alias("value")))),
                             lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value"))).alias("metrics")))


def events_in_window(filings: DataFrame, windows: DataFrame, lane: str = "all", highlights: DataFrame | None = None) -> DataFrame:
    """Timeline events: filings inside their company's window with weight, reason, period and highlights."""
    j = filings.join(windows.where("window_ok").select("cik", "from", "to"), "cik")
    rows = lane_filter(j.where(c("filing_date").between(c("from"), c("to"))), lane)
    k = c("category")
    rows = rows.withColumn("weight", weight_of(k)).withColumn("why", why_it_matters(k))
    if highlights is not None:
        rows = rows.join(highlights, "accession", "left")
    else:
        rows = rows.withColumn("metrics", F.lit(None).cast("array<struct<label:string,value:string>>"))
    headline = tx.growth_highlight(c("summary"))
    from_lines = F.size("metrics") > 0
    return (rows.withColumn("highlights", F.when(~financial_report(k), None).when(from_lines, c("metrics"))
                            .when(headline.isNotNull(), F.array(headline)))
            .withColumn("highlight_source", F.when(c("highlights").isNull(), None)
                        .when(from_lines, F.lit("financials")).otherwise(F.lit("summary_parse"))).drop("metrics", "from", "to"))


def company_windows(coverage: DataFrame, want_from: Column, want_to: Column) -> DataFrame:
    w = pd_.clamp_window(want_from, want_to, c("earliest"), c("latest"))
    return coverage.withColumn("_w", w).select("cik", c("_w.from").alias("from"), c("_w.to").alias("to"), c("_w.window_ok").alias("window_ok"))


def prices_in_window(bars: DataFrame, windows: DataFrame) -> DataFrame:
    return (bars.join(windows.where("window_ok").select("cik", "from", "to"), "cik")
            .where(c("trade_date").between(c("from"), c("to")))
            .select("cik", "trade_date", "close", F.coalesce("adj_close", F.lit(0.0)).alias("adj_close"),
                    F.coalesce("volume", F.lit(0)).alias("volume")))


def timeline_head(companies: DataFrame, windows: DataFrame, events: DataFrame, prices: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per company with a window: ticker, window, events and price points in it, and the state of its stored prices.

    ``companies`` has cik and tickers (the first one counts), ``coverage`` cik, status, earliest and latest. A company without a
    ticker has no prices, whatever is stored, and the status no_symbol.
    """
    ticker = F.coalesce(F.get("tickers", F.lit(0)), F.lit(""))
    n_events = events.groupBy("cik").agg(F.count("*").alias("events"))
    n_prices = prices.groupBy("cik").agg(F.count("*").alias("prices"))
    state = coverage.select("cik", c("status").alias("price_status"), c("earliest").alias("price_earliest"), c("latest").alias("price_latest"))
    j = (companies.withColumn("ticker", ticker).join(windows.where("window_ok"), "cik").join(n_events, "cik", "left")
         .join(n_prices, "cik", "left").join(state, "cik", "left"))
    known = c("ticker") != ""
    return j.select("cik", "ticker", "from", "to", F.coalesce("events", F.lit(0)).alias("events"), F.when(known, F.coalesce("prices", F.lit(0))).otherwise(F.lit(0)).alias("prices"),
                    F.when(known, c("price_status")).otherwise(F.lit("no_symbol")).alias("price_status"),
                    F.when(known, c("price_earliest")).alias("price_earliest"), F.when(known, c("price_latest")).alias("price_latest"))


def snap_forward(events: DataFrame, bars: DataFrame, date: str = "filing_date") -> DataFrame:
    """Add the trading day an event shows on: its own, else the next; events after the last bar are dropped."""
    days = bars.select("cik", c("trade_date").alias("snapped"))
    return asof_join(events, days, ["cik"], date, "snapped", [], forward=True, allow_equal=True,
                     tie_break=["snapped"]).where("snapped IS NOT NULL")


def lane_slots(events: DataFrame) -> DataFrame:
    """Position of each event among those of its day and lane, and how many share the day.

    General events order by weight, financial reports by category; accession breaks ties.
    """
    fin = financial_report(c("category"))
    rank = F.when(c("weight") == "major", 0).when(c("weight") == "medium", 1).otherwise(2)
    order = F.when(fin, c("category")).otherwise(rank.cast("string"))
    day = W.partitionBy("cik", "snapped", "lane")
    return (events.withColumn("lane", F.when(fin, F.lit("financial")).otherwise(F.lit("general")))
            .withColumn("slot", F.row_number().over(day.orderBy(order, "accession")) - 1)
            .withColumn("day_count", F.count("*").over(day)))


def filter_tree(events: DataFrame) -> DataFrame:
    """Events per form, and per form and category below it."""
    return (events.rollup("form", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
            .where("gid < 3").select("form", F.when(c("gid") == 0, c("category")).alias("category"), "n"))


def visible(events: DataFrame, choices: DataFrame) -> DataFrame:
    """Events whose form and category the user has not switched off; unseen pairs are shown."""
    return (events.join(choices.select("form", "category", "checked"), ["form", "category"], "left")
            .where(F.coalesce("checked", F.lit(True))).drop("checked"))


def events_per_year(events: DataFrame) -> DataFrame:
    return events.groupBy("cik", F.year("filing_date").alias("year")).agg(F.count("*").alias("n"))


def report_days(snapped: DataFrame) -> DataFrame:
    """Distinct trading days that carry a financial report."""
    return snapped.where(financial_report(c("category"))).select("cik", "snapped").distinct()


def period_boundaries(bars: DataFrame) -> DataFrame:
    """First trading day of every month (of every year past two years of data), plus the first and last day."""
    span = bars.groupBy("cik").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    monthly = bars.groupBy("cik", F.trunc("trade_date", "MM").alias("_m")).agg(F.min("trade_date").alias("d"))
    firsts = monthly.groupBy("cik", F.trunc("_m", "YEAR").alias("_y")).agg(F.collect_list("d").alias("ds"), F.min("d").alias("y1"))
    picked = (firsts.join(span, "cik")
              .select("cik", F.explode(F.when(F.datediff("hi", "lo") > 730, F.array("y1")).otherwise(c("ds"))).alias("boundary")))
    ends = span.select("cik", F.explode(F.array("lo", "hi")).alias("boundary"))
    return picked.union(ends).distinct()


def volume_axis(bars: DataFrame) -> DataFrame:
    """Axis bounds of the volume strip per company: padded extremes and the enclosing ladder steps."""
    v = c("volume")
    agg = bars.groupBy("cik").agg(F.max(F.when(v > 0, v)).cast("double").alias("hi"), F.min(F.when(v > 0, v)).cast("double").alias("lo"))
    steps = sorted({m * 10.0 ** p for p in range(fv.AXIS_DECADES + 1) for m in fv.AXIS_STEPS if m * 10.0 ** p <= fv.AXIS_CEILING})
    ladder = F.array(*[F.lit(s) for s in steps])
    top = F.coalesce(c("hi"), F.lit(0.0))
    low = F.coalesce(c("lo") * fv.VOLUME_BOTTOM_FACTOR, F.lit(1.0))
    cap = F.least(F.greatest(top * fv.AXIS_HEADROOM, F.when(top > 0, top).otherwise(1.0)), F.lit(fv.AXIS_CEILING))
    usable = F.filter(ladder, lambda s: s <= c("cap"))
    below = F.filter(c("steps"), lambda s: s <= c("low"))
    above = F.filter(c("steps"), lambda s: s > c("top"))
    return (agg.withColumn("top", top).withColumn("low", low).withColumn("cap", cap).withColumn("steps", usable)
            .select("cik", F.when(c("top") > 0, c("top") * fv.VOLUME_TOP_FACTOR).otherwise(1.0).alias("linear_max"),
                    c("low").alias("low"),
                    F.coalesce(F.element_at(F.when(F.size(below) > 0, below), -1), F.get("steps", F.lit(0)), F.lit(1.0)).alias("axis_min"),
                    F.coalesce(F.get(above, F.lit(0)), F.element_at(F.when(F.size("steps") > 0, c("steps")), -1), c("cap")).alias("axis_max")))


# ---- financial clusters with a synthesised fourth quarter ----

FLOW_METRICS = ["revenue", "net_income", "eps"]
STOCK_METRICS = ["cash"]


def report_events(events: DataFrame) -> DataFrame:
    """Financial reports with at least one figure, their fiscal year and whether they are annual or a Q4."""
    metrics = FLOW_METRICS + STOCK_METRICS
    some = F.coalesce(*[c(m) for m in metrics]).isNotNull()
    annual = pd_.is_annual(c("duration"), c("focus")) | (c("category") == "annual_report")
    return (events.where(financial_report(c("category")) & some)
            .withColumn("annual", annual).withColumn("q4", ~annual & pd_.is_q4(c("focus"), c("label")))
            .withColumn("fy", pd_.fiscal_year_of(c("label"), c("end_date"), c("filing_date"))))


def quarter_sums(reports: DataFrame) -> DataFrame:
    """First to third quarter per company and fiscal year: how many reports and the sum of each figure."""
    return (reports.where(~c("annual") & ~c("q4")).groupBy("cik", "fy")
            .agg(F.count("*").alias("quarters"), *[F.sum(m).alias(f"{m}_q123") for m in FLOW_METRICS]))


def synthesised_q4(annual: DataFrame, sums: DataFrame) -> DataFrame:
    """Fourth-quarter figures of annual reports: year minus three quarters for flows, the year's own for stocks.

    Only where exactly three quarters are known.
    """
    j = annual.join(sums, ["cik", "fy"], "left")
    three = c("quarters") == 3
    return j.select(*annual.columns,
                    *[F.when(three, c(m) - c(f"{m}_q123")).alias(f"{m}_q4") for m in FLOW_METRICS],
                    *[F.when(three, c(m)).alias(f"{m}_q4") for m in STOCK_METRICS],
                    F.coalesce(three, F.lit(False)).alias("synthesised"))


def clusters(events: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per company and trading day that carries financial reports: the quarterly and the annual figures.

    An annual report joins the Q4 report of its fiscal year that was filed no later than it, else it stands on
    its own day. Of several reports in one place the last filed wins. Days with only an annual report get a
    synthesised fourth quarter.
    """
    metrics = FLOW_METRICS + STOCK_METRICS
    reports = report_events(events)
    snapped = written(snap_forward(reports, bars), "snapped")
    order = F.struct("filing_date", "accession")
    values = F.struct("accession", *metrics)
    quarterly = snapped.where(~c("annual"))
    q_days = quarterly.groupBy("cik", "snapped").agg(F.max_by(values, order).alias("q"))
    q4_days = quarterly.where("q4").select("cik", "fy", c("filing_date").alias("q4_filed"), c("accession").alias("q4_acc"), c("snapped").alias("q4_day"))
    annual = snapped.where("annual")
    # Events are taken in filing order: an annual report sees the Q4 reports filed before it.
    known = (annual.select("cik", "fy", "accession", "filing_date").join(q4_days, ["cik", "fy"])
             .where((c("q4_filed") < c("filing_date")) | ((c("q4_filed") == c("filing_date")) & (c("q4_acc") < c("accession"))))
             .groupBy("cik", "fy", "accession").agg(F.max_by("q4_day", F.struct("q4_filed", "q4_acc")).alias("q4_day")))
    placed = annual.join(known, ["cik", "fy", "accession"], "left").withColumn("day", F.coalesce("q4_day", "snapped"))
    a_days = placed.groupBy("cik", c("day").alias("snapped")).agg(
        F.max_by(F.struct("accession", "fy", *metrics), order).alias("a"))
    both = q_days.join(a_days, ["cik", "snapped"], "full_outer")
    sums = quarter_sums(reports)
    j = both.withColumn("fy", c("a.fy")).join(sums, ["cik", "fy"], "left")
    alone = c("q").isNull() & c("a").isNotNull() & (c("quarters") == 3)
    pick = [F.when(alone, c(f"a.{m}") - c(f"{m}_q123") if m in FLOW_METRICS else c(f"a.{m}")).otherwise(c(f"q.{m}")).alias(f"{m}_q")
            for m in metrics]
    return j.select("cik", "snapped", c("q.accession").alias("quarterly"), c("a.accession").alias("annual"), *pick,
                    *[c(f"a.{m}").alias(f"{m}_fy") for m in metrics], F.coalesce(alone, F.lit(False)).alias("synthesised"))
