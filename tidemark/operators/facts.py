"""Financial facts: which number a filing reports, and whether it can be believed.

Facts are shuffled once, by company or by filing, and collapsed to distinct values with counts, so every later step
works in place on a bounded number of rows per filing however often a value is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import fixed_values as fv
from tidemark.functions import amounts as am, periods as pd_
from tidemark.functions.classify import metric_aliases, metric_table
from tidemark.session import written

c = F.col


def is_instant(key: Column) -> Column:
    return key.isin(fv.BALANCE_KEYS)


def unit_kind(measures: Column, numerator: Column, denominator: Column, divided: Column) -> Column:
    """Meaning of a unit by what it measures, never by its id."""
    dollars = lambda ms: F.exists(ms, lambda m: F.lower(m) == "iso4217:usd")
    shares = F.exists(denominator, lambda m: F.endswith(F.lower(m), F.lit("shares")))
    return (F.when(divided & dollars(numerator) & shares, F.lit("usd_per_share"))
            .when(~divided & dollars(measures), F.lit("usd")).otherwise(F.lit("other")))


def with_metric(facts: DataFrame) -> DataFrame:
    """Keep facts of known concepts and add metric key, display, unit and alias rank (fixed 23-row table)."""
    aliases = metric_aliases(facts.sparkSession).withColumnRenamed("unit", "metric_unit")
    return (facts.withColumn("element", F.concat_ws(":", "namespace", "concept"))
            .join(F.broadcast(aliases), "element"))


def in_metric_unit(facts: DataFrame) -> DataFrame:
    """Keep dollars for money and dollars per share for per-share metrics; nothing is converted."""
    wanted = F.when(c("metric_unit") == fv.USD_PER_SHARE, F.lit("USD/shares")).otherwise(F.lit("USD"))
    return facts.where(c("unit") == wanted)


def collapse(facts: DataFrame) -> DataFrame:
    """Distinct values per filing, metric, alias and span, with how often each was reported.

    The facts of a company are brought together here, as its Company Facts document holds them. All that is grouped by company,
    filing, metric or span from then on stays in place: the facts are shuffled once.
    """
    keys = ["cik", "accession", "key", "metric_unit", "alias_rank", "start_date", "end_date", "fp", "fy", "val"]
    return in_metric_unit(with_metric(facts)).select(*keys).repartition("cik").groupBy(*keys).agg(F.count("*").alias("n_rows"))


_ALL = (W.unboundedPreceding, W.unboundedFollowing)
_FILING, _METRIC = ["_filing", "cik", "accession"], ["_metric", "cik", "key"]


def _hashed(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A hash of the keys as a column to put before them in a window, so that rows are sorted by a number and not by long equal texts."""
    return rows if name in rows.columns else rows.withColumn(name, F.xxhash64(*keys))


def with_period(collapsed: DataFrame) -> DataFrame:
    """Each row with the period its filing is about: the latest fitting end date of the filing's anchor metric.

    The anchor is revenue, else the first income metric that has facts. Filings without an income fact,
    a known fiscal focus or a fitting span have no period: its columns are null.
    """
    # in the order of metrics, so that what is done per metric next needs no further sort
    collapsed = _hashed(collapsed, "_filing", ["cik", "accession"])
    filing = W.partitionBy(*_FILING).orderBy("key").rowsBetween(*_ALL)
    no = F.when(c("key").isin(fv.INCOME_KEYS), F.array_position(F.array(*[F.lit(k) for k in fv.INCOME_KEYS]), c("key")))
    days = pd_.span_days(c("start_date"), c("end_date"))
    rows = collapsed.withColumn("_no", no)
    order = F.when(c("_no").isNotNull(), F.struct("_no", "alias_rank", "end_date", "start_date", "val"))
    latest = lambda d: F.max(F.when(c("_no").isNotNull() & pd_.in_band(days, F.lit(d)), F.struct((-c("_no")).alias("k"), c("end_date").alias("e")))).over(filing)
    rows = rows.select(*collapsed.columns, F.min("_no").over(filing).alias("_anchor"), F.min_by(F.struct("fp", "fy"), order).over(filing).alias("_f"),
                       latest("P3M").alias("_q"), latest("P1Y").alias("_y"))
    duration = pd_.strict_duration(c("_f.fp"))
    rows = rows.withColumn("_d", duration).withColumn("_best", F.when(c("_d") == "P1Y", c("_y")).otherwise(c("_q")))
    found = c("_d").isNotNull() & (c("_best.k") == -c("_anchor")) & c("cik").isNotNull() & c("accession").isNotNull()
    label = pd_.period_of(c("_f.fp"), c("_f.fy"))["label"]
    return rows.select(*collapsed.columns, *[F.when(found, x).alias(n) for x, n in (
        (c("_f.fp"), "focus"), (c("_f.fy"), "focus_year"), (c("_d"), "duration"), (label, "label"), (c("_best.e"), "period_end"))])


def filing_period(collapsed: DataFrame) -> DataFrame:
    """The period each filing is about, a row per filing that has one."""
    rows = with_period(collapsed).where("duration IS NOT NULL")
    one = F.first(F.struct("focus", "focus_year", "duration", "label", "period_end"))
    return rows.groupBy("cik", "accession").agg(one.alias("_p")).select(
        "cik", "accession", "_p.focus", c("_p.focus_year").alias("fy"), "_p.duration", "_p.label", "_p.period_end")


def with_picks(collapsed: DataFrame) -> DataFrame:
    """Each row with its filing's period, the value picked for its metric (``_cur``) and the comparable of a year before (``_prior``).

    Best alias rank wins. The comparable of a balance metric is the previous 31 December, else about a
    year before; of other metrics the same span about a year before, nearest to 365 days. The row that holds the
    pick itself has ``_picked`` true.
    """
    metric = W.partitionBy(*_FILING, "key").rowsBetween(*_ALL)
    days = pd_.span_days(c("start_date"), c("end_date"))
    instant = is_instant(c("key"))
    fits = F.when(instant, c("start_date").isNull()).otherwise(pd_.in_band(days, c("duration"))) & ~c("key").isin(fv.CASH_FLOW_KEYS)
    gap = F.datediff("period_end", "end_date")
    year_end = F.make_date(F.year("period_end") - 1, F.lit(12), F.lit(31))
    is_year_end = instant & fits & (c("end_date") == year_end)
    comparable = (fits & gap.between(*fv.YEAR_DAYS)) | is_year_end
    place = ["val", "start_date", "end_date", "alias_rank", "fp", "fy"]
    by_rank = F.struct(c("alias_rank"), c("start_date"), c("val"))
    by_gap = F.struct((~is_year_end).cast("int"), F.abs(gap - 365), c("alias_rank"), c("start_date"), c("val"))
    rows = with_period(collapsed)
    marked = rows.select("*", F.min_by(F.struct(*place), F.when(fits & (c("end_date") == c("period_end")), by_rank)).over(metric).alias("_cur"),
                         F.min_by(F.struct("val", "end_date"), F.when(comparable, by_gap)).over(metric).alias("_prior"))
    picked_here = c("_cur").isNotNull()
    for x in place:
        picked_here = picked_here & c(x).eqNullSafe(c(f"_cur.{x}"))
    return marked.withColumn("_picked", picked_here)


_PICK = ["cik", "accession", "key", "metric_unit", "duration", "label", "period_end", "val AS value", "start_date", "end_date",
         "_prior.val AS prior_value", "_prior.end_date AS prior_end"]


def picked(collapsed: DataFrame) -> DataFrame:
    """The value of each metric for its filing's own period, and the comparable of a year before."""
    return with_picks(collapsed).where("_picked").selectExpr(*_PICK)


_RATIOS = {"same": 1.0, "thousandfold": 1000.0, "thousandth": 0.001}


def with_votes(rows: DataFrame) -> DataFrame:
    """Per picked figure: how many facts of other filings for the same span agree, are 1000 times as large, a thousandth, or none of these.

    ``rows`` are all rows of ``with_picks``. Only money that is not zero votes or is voted on; other picks have null votes. A pick is compared
    with the distinct values of its span, each with its count, and the filing's own rows are taken off: no pair of filings is formed.
    """
    votes = (c("val") != 0) & (c("metric_unit") == fv.USD)
    n_votes = F.when(votes, c("n_rows"))
    # the filing's own facts for the span of its pick, classed against it
    metric = W.partitionBy(*_FILING, "key").rowsBetween(*_ALL)
    own = F.when(c("start_date").eqNullSafe(c("_cur.start_date")) & (c("end_date") == c("_cur.end_date")), n_votes)
    mine = [F.coalesce(F.sum(F.when(am.close_to(F.try_divide("val", "_cur.val"), r), own)).over(metric), F.lit(0)).alias(f"_{k}") for k, r in _RATIOS.items()]
    started = F.coalesce("start_date", F.lit("0001-01-01").cast("date"))
    rows = rows.select("*", *mine, F.sum(own).over(metric).alias("_all"), started.alias("_start"))
    rows = _hashed(rows, "_span", ["cik", "key", "_start", "end_date"])
    group = ["_span", "cik", "key", "_start", "end_date"]
    by_value = W.partitionBy(*group).orderBy("val")
    value = W.partitionBy(*group, "val").rowsBetween(*_ALL)
    first = F.lag("val").over(by_value).isNull() | (F.lag("val").over(by_value) != c("val"))
    rows = rows.select("*", F.when(votes & first, F.struct(c("val").alias("v"), F.sum("n_rows").over(value).alias("k"))).alias("_value"))
    span = by_value.rowsBetween(*_ALL)
    rows = rows.select("*", F.collect_list("_value").over(span).alias("_values"), F.sum(n_votes).over(span).alias("_n"))
    picks = rows.where("_picked")
    near = lambda r: F.aggregate("_values", F.lit(0).cast("bigint"), lambda s, x: s + F.when(am.close_to(F.try_divide(x["v"], c("val")), r), x["k"]).otherwise(F.lit(0)))
    out = picks.select("*", *[F.when(votes, near(r) - c(f"_{k}")).alias(k) for k, r in _RATIOS.items()], F.when(votes, c("_n") - c("_all")).alias("peers"))
    other = c("peers") - c("same") - c("thousandfold") - c("thousandth")
    return out.withColumn("irreconcilable", other).drop("_value", "_values", "_n", "_all", "_start", "_span", *[f"_{k}" for k in _RATIOS])


_VOTES = [*_RATIOS, "peers", "irreconcilable"]


def scale_votes(collapsed: DataFrame) -> DataFrame:
    """Votes of ``with_votes`` on each picked money figure that another filing reports something for."""
    return with_votes(with_picks(collapsed)).where("peers > 0").select("cik", "accession", "key", *_VOTES)


def _resolution(total) -> dict[str, Column]:
    """Sums of a filing's votes and what follows from them; ``total`` sums a column over the filing."""
    v1, v1000, other = total(c("same") + c("thousandth")), total(c("thousandfold")), total(c("irreconcilable"))
    bad = (other > 0) | ((v1 > 0) & (v1000 > 0))
    return {"votes_1": v1, "votes_1000": v1000, "votes_other": other, "irreconcilable": bad,
            "factor": F.when(~bad & (v1000 > 0), 1000.0).otherwise(1.0)}


def scale_resolution(votes: DataFrame) -> DataFrame:
    """One factor per filing, 1 or 1000; irreconcilable when the votes contradict each other."""
    return votes.groupBy("cik", "accession").agg(*[x.alias(n) for n, x in _resolution(F.sum).items()])


def with_floor(collapsed: DataFrame) -> DataFrame:
    """Each row with the upper median size of its company's metric and the number of values (``_median``, ``_n_sizes``)."""
    rows = _hashed(collapsed, "_metric", ["cik", "key"]).withColumn("_size", F.when(c("val") != 0, F.abs("val")))
    by_size = W.partitionBy(*_METRIC).orderBy("_size")
    weight = F.when(c("_size").isNotNull(), c("n_rows"))
    up_to, n = F.sum(weight).over(by_size.rowsBetween(W.unboundedPreceding, W.currentRow)), F.sum(weight).over(by_size.rowsBetween(*_ALL))
    rows = rows.select("*", up_to.alias("_up_to"), n.alias("_n_sizes"))
    middle = F.min(F.when(c("_up_to") >= F.floor(c("_n_sizes") / 2) + 1, c("_size"))).over(by_size.rowsBetween(*_ALL))
    return rows.withColumn("_median", middle).drop("_size", "_up_to")


def magnitude_floor(collapsed: DataFrame) -> DataFrame:
    """A hundredth of the upper median size of each company metric, where three values exist."""
    return (with_floor(collapsed).where("_n_sizes >= 3").groupBy("cik", "key")
            .agg(F.first("_median").alias("median"), F.first("_n_sizes").alias("n")).withColumn("floor", c("median") / 100))


def gap_fill_lines(facts: DataFrame) -> DataFrame:
    """Graded metric lines per filing from Company Facts: period, scale, pick, comparable, growth, grade."""
    rows = with_floor(with_picks(collapse(facts)))
    filing = W.partitionBy(*_FILING)
    voted = with_votes(rows)
    # only figures with votes of other filings count for the filing's scale
    resolved = _resolution(lambda x: F.sum(F.when(c("peers") > 0, x)).over(filing))
    j = voted.select(*[F.expr(x) for x in _PICK], "peers", "_median", "_n_sizes", resolved["irreconcilable"].alias("irreconcilable"), resolved["factor"].alias("factor"))
    money = c("metric_unit") == fv.USD
    factor = F.when(money, F.coalesce("factor", F.lit(1.0))).otherwise(1.0)
    withheld = money & F.coalesce("irreconcilable", F.lit(False))
    plausible = ~F.coalesce(c("_n_sizes") >= 3, F.lit(False)) | (F.abs("value") >= c("_median") / 100)
    instant = is_instant(c("key"))
    value, prior = c("value") * factor, c("prior_value") * factor
    return j.select(
        "cik", "accession", "key", "metric_unit", "duration", "label", "period_end", value.alias("value"),
        am.format_value(value, c("metric_unit")).alias("value_text"), prior.alias("prior_value"),
        F.when(instant & c("prior_end").isNotNull(), F.concat(F.lit("vs "), c("prior_end").cast("string"))).alias("prior_label"),
        F.when(~instant, am.yoy_percent(value, prior)).alias("yoy"),
        F.when(withheld, F.lit(fv.SUSPECT))
        .otherwise(am.grade_gap_fill(F.coalesce("peers", F.lit(0)), plausible)).alias("confidence"),
        F.lit(fv.FROM_COMPANY_FACTS).alias("source"))


def fact_state(collapsed: DataFrame) -> DataFrame:
    """How far the facts of each filing reach (``state``): 1 facts, 2 a period of its own, 3 a headline metric for it."""
    state = F.when(c("_picked"), 3).when(c("period_end").isNotNull(), 2).otherwise(1)
    return with_picks(collapsed).groupBy("accession").agg(F.max(state).alias("state"))


def no_fact_records(gaps: DataFrame, states: DataFrame) -> DataFrame:
    """Filings that stay without figures, with the reason: not tagged, no facts, no own period, or no headline metric for it."""
    j = gaps.join(states, "accession", "left").where("coalesce(state, 0) < 3 AND kind <> 'has_local'")
    reason = (F.when(c("kind") == "no_xbrl", F.lit("no XBRL in the filing")).when(c("state") == 1, F.lit("no reporting period"))
              .when(c("state") == 2, F.lit("no headline metric for the period")).otherwise(F.lit("no facts for this filing")))
    return j.withColumn("reason", reason).drop("state")


def classify_gaps(filings: DataFrame, local_lines: DataFrame, bundles: DataFrame) -> DataFrame:
    """Report filings by how their figures can be had: already local, fillable from facts, or not at all.

    A local artifact counts only without a withheld income or balance line.
    """
    from_filing = [fv.FROM_INSTANCE, fv.FROM_RENDERED, fv.FROM_BOTH, fv.FROM_ADJUDICATED]
    local = (local_lines.where(c("statement").isin("income", "balance")).groupBy("accession")
             .agg((F.max(c("source").isin(from_filing)) & ~F.max(c("confidence") == fv.SUSPECT)).alias("_local")))
    tagged = bundles.select("accession").distinct().withColumn("_tagged", F.lit(True))
    return (filings.where(c("category").isin(fv.REPORT_CATEGORIES))
            .join(local, "accession", "left").join(tagged, "accession", "left")
            .withColumn("kind", F.when(F.coalesce("_local", F.lit(False)), F.lit("has_local"))
                        .when(c("_tagged").isNotNull(), F.lit("fillable")).otherwise(F.lit("no_xbrl")))
            .drop("_local", "_tagged"))


# ---- facts read from a filing's own tagged document ----

def star(documents: DataFrame) -> DataFrame:
    """Tagged facts with their context's span and dimensions and their unit's meaning, a row per fact.

    ``documents`` has a row per filing (accession) with its contexts, units and facts as arrays, and maybe more columns, which stay. Facts
    without their context or unit are left out; of several contexts of one id in a document the smallest counts. Rows stay where their filing is.
    """
    of = lambda array, ids, key: F.get(array, F.array_position(ids, key).cast("int") - 1)
    held = F.struct("contexts", "units", F.transform("contexts", lambda x: x["context_id"]).alias("cids"), F.transform("units", lambda x: x["unit_id"]).alias("uids"))
    joined = lambda d: F.transform("facts", lambda f: F.struct(f.alias("f"), of(d["contexts"], d["cids"], f["context_id"]).alias("x"), of(d["units"], d["uids"], f["unit_id"]).alias("u")))
    # the ids are bound to a variable: a column mentioned inside a lambda is computed anew for each element
    found = F.transform(F.array(held), joined)[0]
    kept = documents.withColumn("_found", F.filter(found, lambda j: j["x"].isNotNull() & j["u"].isNotNull()))
    rest = [x for x in documents.columns if x not in ("contexts", "units", "facts")]
    rows = kept.select(*rest, F.inline("_found"))
    return rows.select(*rest, "f.*", *[f"x.{n}" for n in ("start_date", "end_date", "instant", "n_dims", "axis", "member")], "u.kind")


def own_contexts(documents: DataFrame) -> DataFrame:
    """Documents (with ``dei``, what each declares of its period) of filings with an undimensioned context of their own period.

    ``chosen`` names it, the comparable one and the instants.
    """
    p = pd_.period_of(c("dei.focus"), c("dei.fy"))
    d = documents.where("dei IS NOT NULL").withColumn("_p", p).withColumn("_plain", F.filter("contexts", lambda x: x["n_dims"] == 0))
    end = c("dei.period_end")
    gap = lambda x: F.datediff(end, x["end_date"])
    fits = lambda x: x["instant"].isNull() & pd_.in_band(pd_.span_days(x["start_date"], x["end_date"]), c("_p.duration"))
    first = lambda test, value: F.array_min(F.transform(F.filter("_plain", test), value))
    prior_year_end = F.make_date(F.year(end) - 1, F.lit(12), F.lit(31))
    d = (d.withColumn("_cur", first(lambda x: fits(x) & (x["end_date"] == end), lambda x: F.struct(x["context_id"].alias("id"), x["start_date"].alias("s"), x["end_date"].alias("e"))))
         .where("_cur.id IS NOT NULL")
         .withColumn("_prior", first(lambda x: fits(x) & gap(x).between(*fv.YEAR_DAYS), lambda x: F.struct(F.abs(gap(x) - 365).alias("gap"), x["context_id"].alias("id")))))
    chosen = F.struct(end.alias("period_end"), c("_p.duration").alias("duration"), c("_p.label").alias("label"), c("dei.focus").alias("focus"), c("_cur.id").alias("cur_span"),
                      c("_prior.id").alias("prior_span"), first(lambda x: x["instant"] == end, lambda x: x["context_id"]).alias("cur_instant"),
                      first(lambda x: x["instant"] == prior_year_end, lambda x: x["context_id"]).alias("prior_instant"), c("_cur.s").alias("span_start"), c("_cur.e").alias("span_end"))
    return d.withColumn("chosen", chosen).drop("_p", "_plain", "_cur", "_prior")


def pick_candidates(documents: DataFrame) -> DataFrame:
    """Per filing and metric: the first consolidated fact of the best alias, how many distinct values compete
    for it, the comparable value and, where ``rendered`` (statement, element, rendered_value) shows it, the rendered one.

    ``documents`` come from ``own_contexts``; where they have the ``cik``, it stays.
    """
    wanted_unit = F.when(c("metric_unit") == fv.USD_PER_SHARE, F.lit("usd_per_share")).otherwise(F.lit("usd"))
    aliases = metric_aliases(documents.sparkSession).withColumnRenamed("unit", "metric_unit").join(
        metric_table(documents.sparkSession).select("key", "statement"), "key")
    instant = is_instant(c("key"))
    slot = (F.when(c("context_id") == F.when(instant, c("chosen.cur_instant")).otherwise(c("chosen.cur_span")), F.lit("cur"))
            .when(c("context_id") == F.when(instant, c("chosen.prior_instant")).otherwise(c("chosen.prior_span")), F.lit("prior")))
    rows = star(documents.drop("dei")).where("n_dims = 0").join(F.broadcast(aliases), "element").where(c("kind") == wanted_unit).withColumn("slot", slot).where("slot IS NOT NULL")
    shown = F.array_max(F.transform(F.filter("rendered", lambda r: (r["statement"] == c("statement")) & (r["element"] == c("element"))), lambda r: r["rendered_value"]))
    kept = F.struct(*[x for x in documents.columns if x == "cik"], c("chosen.period_end").alias("period_end"), c("chosen.duration").alias("duration"), c("chosen.label").alias("label"))
    # the smallest of a slot's structs is the first fact of its best alias; -0.0 and 0.0 are one value
    fact = F.struct("alias_rank", "fact_no", (c("value") + 0.0).alias("value"), "decimals", "element", shown.alias("shown"))
    first = lambda s: F.min(F.when(c("slot") == s, c("_f")))
    known = rows.select("accession", "key", "metric_unit", "slot", fact.alias("_f"), kept.alias("_k")).where("_f IS NOT NULL")
    out = known.groupBy("accession", "key", "metric_unit").agg(
        first("cur").alias("_c"), first("prior").alias("_p"), F.collect_set(F.when(c("slot") == "cur", F.struct("_f.alias_rank", "_f.value"))).alias("_values"), F.first("_k").alias("_k"))
    return out.where("_c IS NOT NULL").select(
        "accession", "key", "metric_unit", c("_c.element").alias("element"), c("_c.value").alias("value"), c("_c.decimals").alias("decimals"),
        F.size(F.filter("_values", lambda v: v["alias_rank"] == c("_c.alias_rank"))).cast("bigint").alias("n_candidates"), c("_p.value").alias("prior_value"),
        c("_c.shown").alias("rendered_value"), "_k.*")


def signals(n_candidates: Column, decimals: Column, value: Column, unit: Column) -> Column:
    """Names of the detectors that fire on one picked fact."""
    return F.array_compact(F.array(F.when(n_candidates > 1, F.lit(fv.DETECTOR_E)),
                                   F.when(am.implausible_tag(decimals, value, unit), F.lit(fv.DETECTOR_B))))


def graded_lines(documents: DataFrame) -> DataFrame:
    """Lines with confidence, source and notes from the two-source comparison.

    ``documents`` come from ``own_contexts``; their ``rendered`` values are already scaled.
    """
    metrics = metric_table(documents.sparkSession).drop("metric_unit", "metric_no", "metric_rank")
    j = pick_candidates(documents).join(F.broadcast(metrics), "key")
    flags = signals(c("n_candidates"), c("decimals"), c("value"), c("metric_unit"))
    g = am.grade_by_two_sources(c("value"), c("rendered_value"), c("metric_unit"), F.size("_flags"))
    disagree = (F.size("_flags") == 0) & c("rendered_value").isNotNull() & ~am.agree(c("value"), c("rendered_value"), c("metric_unit"))
    return (j.withColumn("_flags", flags).withColumn("_g", g)
            .withColumn("notes", F.when(disagree, F.array(F.lit(fv.DETECTOR_A))).otherwise(c("_flags")))
            .withColumn("confidence", c("_g.confidence")).withColumn("source", c("_g.source"))
            .withColumn("yoy", F.when(c("statement") != "balance", am.yoy_percent(c("value"), c("prior_value"))))
            .withColumn("prior_label", F.when((c("statement") == "balance") & c("prior_value").isNotNull(),
                                              F.concat(F.lit("vs "), F.make_date(F.year("period_end") - 1, F.lit(12), F.lit(31)).cast("string"))).otherwise(F.lit("")))
            .drop("_flags", "_g"))


def mark(lines: DataFrame, hits: DataFrame, keys: list[str], note: str) -> DataFrame:
    """Withhold the named lines of the hit filings and say why."""
    flag = hits.select("accession").distinct().withColumn("_hit", F.lit(True))
    j = lines.join(flag, "accession", "left")
    hit = c("_hit").isNotNull() & c("key").isin(keys)
    return (j.withColumn("confidence", F.when(hit, F.lit(fv.SUSPECT)).otherwise(c("confidence")))
            .withColumn("notes", F.when(hit, F.array_append("notes", F.lit(note))).otherwise(c("notes"))).drop("_hit"))


def mark_arithmetic(lines: DataFrame) -> DataFrame:
    """Withhold publishable revenue, cost and gross profit of a filing where revenue minus cost is not gross profit (more than 1 apart)."""
    keys = ["total_revenues", "cost_of_revenues", "gross_profit"]
    one = lambda k: F.max(F.when((c("key") == k) & am.publishable(c("confidence")), c("value"))).over(W.partitionBy("accession"))
    hit = F.coalesce(F.abs((c("_r") - c("_c")) - c("_g")) > 1, F.lit(False)) & c("key").isin(keys)
    j = lines.select("*", *[one(k).alias(n) for k, n in zip(keys, ("_r", "_c", "_g"))]).withColumn("_hit", hit)
    return (j.withColumn("confidence", F.when(c("_hit"), F.lit(fv.SUSPECT)).otherwise(c("confidence")))
            .withColumn("notes", F.when(c("_hit"), F.array_append("notes", F.lit(fv.DETECTOR_C))).otherwise(c("notes"))).drop("_hit", "_r", "_c", "_g"))


def chain_breaks(lines: DataFrame) -> DataFrame:
    """Revenue lines contradicted by the filing of a year before or after (both sides, one row per line).

    A filing is compared with the company's filing of the same duration that ends a year earlier, up to 14
    days off; of several the earliest end counts, of equal ends the greatest accession. When exactly one of
    the two sides already carries an implausible-tagging signal, only that side is marked.
    """
    rev = lines.where(c("key") == "total_revenues").select(
        "cik", "accession", "duration", "period_end", "value", "prior_value",
        F.array_contains("notes", F.lit(fv.DETECTOR_B)).alias("explained"))
    # One filing per company, duration and end date: the greatest accession, whether it has revenue or not.
    one = (lines.select("cik", "duration", "period_end", "accession").groupBy("cik", "duration", "period_end")
           .agg(F.max("accession").alias("accession")))
    earlier = one.join(rev.select("cik", "accession", c("value").alias("then_value"), c("explained").alias("then_explained")),
                       ["cik", "accession"], "left").withColumnRenamed("accession", "then_accession") \
                 .withColumnRenamed("period_end", "then_end")
    drift = fv.CHAIN_DRIFT_DAYS
    anchor = pd_.shift_years(c("period_end"), -1)
    asks = (rev.where("prior_value IS NOT NULL").withColumn("_a", anchor)
            .withColumn("then_end", F.explode(F.sequence(F.date_sub("_a", drift), F.date_add("_a", drift)))))
    j = asks.join(earlier, ["cik", "duration", "then_end"])
    # One earlier filing per line: the earliest end in the band.
    near = (j.groupBy("cik", "accession", "duration", "period_end", "prior_value", "explained")
            .agg(F.min_by(F.struct("then_accession", "then_value", "then_explained"), c("then_end")).alias("_t"))
            .select("cik", "accession", "prior_value", "explained", "_t.*"))
    bad = near.where(c("then_value").isNotNull() & ~am.agree(c("prior_value"), c("then_value"), F.lit(fv.USD)))
    only_then, only_now = c("then_explained") & ~c("explained"), c("explained") & ~c("then_explained")
    sides = F.array_compact(F.array(F.when(~only_then, c("accession")), F.when(~only_now, c("then_accession"))))
    return bad.select("cik", F.explode(sides).alias("accession")).distinct()


def mark_chain(lines: DataFrame) -> DataFrame:
    return mark(lines, chain_breaks(lines), ["total_revenues"], fv.DETECTOR_D)


def segment_facts(documents: DataFrame) -> DataFrame:
    """Revenue by axis and member: facts with exactly one dimension over the filing's own span, in dollars, of the best alias that has any.

    ``documents`` come from ``own_contexts``.
    """
    aliases = metric_aliases(documents.sparkSession).where(c("key") == "total_revenues").select("element", "alias_rank")
    rows = (star(documents.select("accession", "contexts", "units", "facts", "chosen")).where("n_dims = 1 AND kind = 'usd'").join(F.broadcast(aliases), "element")
            .where((c("start_date") == c("chosen.span_start")) & (c("end_date") == c("chosen.span_end")))
            .groupBy("accession", "alias_rank", "axis", "member")
            .agg(F.min_by("value", F.struct("fact_no", "value")).alias("value")))
    return rows.withColumn("_best", F.min("alias_rank").over(W.partitionBy("accession"))).where("alias_rank = _best").drop("_best")


def segments(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """Revenue by member of the one axis that adds up closest to the total."""
    from tidemark.functions.text import member_name
    axis, filing = W.partitionBy("accession", "axis"), W.partitionBy("accession")
    rows = segment_facts(documents).select("*", F.sum("value").over(axis).alias("axis_sum"), F.count("*").over(axis).alias("n_members"))
    rows = rows.join(totals.select("accession", c("value").alias("total")), "accession", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    nearest = F.min(F.struct(F.abs(c("axis_sum") - c("total")).alias("delta"), c("axis"))).over(filing)
    out = rows.withColumn("_p", nearest).where(c("axis").eqNullSafe(c("_p.axis")))
    ok = (c("n_members") >= 2) & (c("total") != 0) & am.agree(c("axis_sum"), c("total"), F.lit(fv.USD))
    return out.select("accession", "axis", "member", member_name(c("member")).alias("name"), "value",
                      F.coalesce(ok, F.lit(False)).alias("reconciles"), "n_members")


def extract_filings(own: DataFrame, company_of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The full local extraction: graded lines and revenue segments of every filing, with whether they reconcile.

    ``own`` comes from ``own_contexts``; ``company_of`` (accession, cik) is needed where its rows do not name the company.
    """
    graded = mark_arithmetic(graded_lines(own))
    lines = written(graded if company_of is None else graded.join(company_of, "accession"), "checked_lines")
    # what the arithmetic withholds was publishable before it
    totals = lines.where((c("key") == "total_revenues") & (am.publishable(c("confidence")) | F.array_contains("notes", F.lit(fv.DETECTOR_C))))
    return mark_chain(lines), segments(own, totals)


def suspects(lines: DataFrame) -> DataFrame:
    """Withheld metrics and the filings that hold them, income and balance lines only."""
    return (lines.where(c("statement").isin("income", "balance") & (c("confidence") == fv.SUSPECT))
            .agg(F.count("*").alias("metrics"), F.countDistinct("accession").alias("filings")))


def report_table(lines: DataFrame) -> DataFrame:
    """One row per filing with the headline figures; a withheld figure says so."""
    shown = F.when(am.publishable(c("confidence")), am.format_value(c("value"), c("metric_unit"))).otherwise(F.lit("WITHHELD"))
    one = lambda k, v: F.max(F.when(c("key") == k, v))
    rev = "total_revenues"
    return lines.groupBy("accession").agg(
        one(rev, shown).alias("revenue"), one(rev, am.format_value(c("prior_value"), F.lit(fv.USD))).alias("prior"),
        one(rev, c("yoy")).alias("yoy"), one("net_income", shown).alias("net_income"),
        one("eps_basic", shown).alias("eps"), one("cash_and_equivalents", shown).alias("cash"))


def fill_report(gaps: DataFrame, lines: DataFrame) -> DataFrame:
    """How a gap-fill run went: filled, without facts, left alone, and metrics withheld."""
    per = lines.groupBy("accession").agg(F.count_if((c("confidence") == fv.SUSPECT)
                                                    & c("key").isin(fv.INCOME_KEYS + fv.BALANCE_KEYS)).alias("_w"))
    j = gaps.join(per, "accession", "left")
    fillable = c("kind") == "fillable"
    return j.agg(F.count_if(fillable & c("_w").isNotNull()).alias("filled"),
                 F.count_if((c("kind") == "no_xbrl") | (fillable & c("_w").isNull())).alias("no_facts"),
                 F.count_if(c("kind") == "has_local").alias("skipped_local"),
                 F.coalesce(F.sum(F.when(fillable, c("_w"))), F.lit(0)).alias("withheld"))


def local_wins(local: DataFrame, filled: DataFrame) -> DataFrame:
    """Locally extracted lines, complemented by filled lines of filings that have none."""
    return local.unionByName(filled.join(local.select("accession").distinct(), "accession", "left_anti"))
