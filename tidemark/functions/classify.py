"""Category, tier and summary of a filing, and lookups against the fixed dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import fixed_values as fv


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed dictionary for a key column."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def metric_aliases(spark: SparkSession) -> DataFrame:
    """One row per known element: its metric key, unit and alias rank."""
    rows = [(el, key, display, unit, rank) for key, display, unit, els in fv.METRICS for rank, el in enumerate(els)]
    return spark.createDataFrame(rows, "element string, key string, display string, unit string, alias_rank int")


def metric_table(spark: SparkSession) -> DataFrame:
    """One row per metric: display name, unit, statement, dictionary order and display rank."""
    statement = {**dict.fromkeys(fv.INCOME_KEYS, "income"), **dict.fromkeys(fv.BALANCE_KEYS, "balance"),
                 **dict.fromkeys(fv.CASH_FLOW_KEYS, "cashFlow")}
    unranked = len(fv.METRIC_RANK) + 1
    rows = [(key, display, unit, statement[key], i, fv.METRIC_RANK.index(key) if key in fv.METRIC_RANK else unranked)
            for i, (key, display, unit, _) in enumerate(fv.METRICS)]
    return spark.createDataFrame(
        rows, "key string, display string, metric_unit string, statement string, metric_no int, metric_rank int")


def weight_of(category: Column) -> Column:
    return lookup({c: w for c, w, _, _ in fv.CATEGORY_RULES}, category, F.lit("minor"))


def is_event(category: Column) -> Column:
    return F.coalesce(category.isin([c for c, _, e, _ in fv.CATEGORY_RULES if e]), F.lit(False))


def why_it_matters(category: Column) -> Column:
    return lookup({c: w for c, _, _, w in fv.CATEGORY_RULES}, category, F.lit(""))


def status_label(status: Column) -> Column:
    bare = F.trim(status)
    return (F.when(bare == "", F.lit("Pending"))
            .otherwise(lookup({s: label for s, label, _ in fv.STATUS_STEPS}, bare, F.translate(status, "_", " "))))


def status_percent(status: Column) -> Column:
    return lookup({s: p for s, _, p in fv.STATUS_STEPS}, F.trim(status), F.lit(5))


def _has(text: Column, *phrases: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _result(tier: int, category: str | Column, *tags: str) -> Column:
    cat = F.lit(category) if isinstance(category, str) else category
    tag_list = F.array(*[F.lit(t) for t in tags]) if tags else F.array().cast("array<string>")
    return F.struct(F.lit(tier).alias("tier"), cat.alias("category"), tag_list.alias("tags"))


def classify_filing(form: Column, titles: Column, body: Column, is_xbrl: Column) -> Column:
    """Tier, category and tags of a filing; a 6-K is judged by phrases in its exhibit titles and body."""
    text = F.concat(F.lower(F.array_join(titles, " ")), F.lit(" "), body)
    results = _has(text, "financial results")
    # Ordered: the first condition that holds decides.
    six_k = [
        ((is_xbrl & _has(text, "to announce", "will announce")), _result(3, "earnings_preview")),
        (is_xbrl | (results & ~_has(text, "announce")), _result(1, "quarterly_results", "financials")),
        (results & _has(text, "to announce"), _result(3, "earnings_preview", "financials")),
        (_has(text, "annual guidance", "guidance of $", "revenue", "ebitda") & _has(text, "guidance")
         & ~_has(text, "reports"), _result(1, "annual_guidance", "guidance")),
        (_has(text, "dividend") & _has(text, "withholding tax", "payment date has been changed")
         & _has(text, "changed"), _result(2, "admin_update", "dividend")),
        (_has(text, "dividend"), _result(2, "corporate_action", "dividend")),
        (_has(text, "annual general meeting", "proxy statement", "agm"), _result(2, "governance", "governance")),
        (_has(text, "fda approval", "fda approved"), _result(1, "regulatory_clinical", "regulatory")),
        (_has(text, "agreement", "million sales", "supply", "partnership", "acquisition", "merger"),
         _result(1, "business_deal", "business")),
        (_has(text, "conference", "presented at", "investor", "deck"), _result(3, "investor_relations")),
    ]
    by_text = _result(2, "current_report")
    for condition, outcome in reversed(six_k):
        by_text = F.when(condition, outcome).otherwise(by_text)
    kind = F.replace(F.upper(form), F.lit("SCHEDULE "), F.lit(""))
    annual = F.when(is_xbrl, _result(1, "annual_report", "financials", "xbrl")) \
              .otherwise(_result(1, "annual_report", "financials", "annual"))
    return (F.when(kind == "20-F", annual)
            .when(kind.isin("13G/A", "13G"), _result(4, "ownership_disclosure", "ownership"))
            .when(kind == "3", _result(3, "insider_initial", "insider"))
            .when(kind == "4", _result(3, "insider_trade", "insider"))
            .when(kind == "6-K", by_text)
            .otherwise(_result(3, "unknown")))


def filing_summary(form: Column, category: Column, titles: Column, body: Column, owner: Column) -> Column:
    """One-line summary: an exhibit title, else an ownership sentence, else a default for the form."""
    nonblank = lambda c: F.when(c != "", c)
    first = F.get(titles, F.lit(0))
    about_results = F.get(F.filter(titles, lambda x: F.contains(F.lower(x), F.lit("financial results"))), F.lit(0))
    title = F.when((category == "quarterly_results") & (F.size(titles) > 1), F.coalesce(about_results, first)) \
             .otherwise(first)
    person, role = nonblank(owner["person"]), F.coalesce(nonblank(owner["title"]), F.lit("insider"))
    code = F.coalesce(nonblank(owner["transaction_code"]), F.lit("?"))
    shares = F.coalesce(nonblank(owner["shares"]), F.lit("?"))
    large = F.lit("Large shareholder ownership update")
    return (F.when(F.size(titles) > 0, F.substring(title, 1, 240))
            .when((form == "3") & person.isNotNull(),
                  F.concat(F.lit("Initial insider ownership report: "), person, F.lit(" ("), role, F.lit(")")))
            .when((form == "4") & person.isNotNull(),
                  F.concat(F.lit("Insider transaction: "), person, F.lit(" ("), role, F.lit(") — code "), code,
                           F.lit(", "), shares, F.lit(" shares")))
            .when(form == "20-F", F.lit("Annual report with audited financials and MD&A"))
            .when(form.isin("13G/A", "13G"), F.when(person.isNull(), large).otherwise(F.concat(large, F.lit(": "), person)))
            .when((category == "governance") & F.contains(body, F.lit("shareholders approved")),
                  F.lit("Annual general meeting results — shareholder proposals approved"))
            .when((category == "admin_update") & F.contains(body, F.lit("payment date has been changed")),
                  F.lit("Dividend payment date change"))
            .otherwise(form))
