"""Filings and companies: identity, counting, paging, search, missing documents, fetch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import fixed_values as fv
from tidemark.functions.amounts import human_bytes, human_duration
from tidemark.functions.ids import blank_to_null, normalize_cik, strip_zeros


def identity(companies: DataFrame) -> DataFrame:
    """Add the head office (business address, else mailing) and the non-blank former names."""
    def place(a: str) -> Column:
        city, country = F.coalesce(F.col(f"{a}.city"), F.lit("")), F.coalesce(F.col(f"{a}.stateOrCountryDescription"), F.lit(""))
        return F.when((city != "") | (country != ""), F.struct(city.alias("city"), country.alias("country")))
    return (companies
            .withColumn("hq", F.coalesce(place("addresses.business"), place("addresses.mailing")))
            .withColumn("former_names", F.filter(F.transform("formerNames", lambda f: f["name"]),
                                                 lambda n: n.isNotNull() & (n != "")))
            .drop("addresses", "formerNames"))


def filing_columns(folders: DataFrame) -> DataFrame:
    """Filing rows from one row per folder (cik, year, folder) with its decoded documents as structs filing, meta and financials.

    A folder without a usable filing document (form and date) is dropped; meta and financials are optional. Year is the folder's,
    not the filing date's.
    """
    f, m = F.col("filing"), F.col("meta")
    usable = (F.coalesce(f["form"], F.lit("")) != "") & (F.coalesce(f["filingDate"], F.lit("")) != "")
    return folders.where(usable).select(
        "cik", "year", "folder", F.coalesce(blank_to_null(f["accessionNumber"]), F.col("folder")).alias("accession"),
        f["filingDate"].alias("filing_date"), f["reportDate"].alias("report_date"), f["form"].alias("form"),
        F.coalesce(blank_to_null(m["category"]), F.lit(fv.UNKNOWN_CATEGORY)).alias("category"),
        F.coalesce(m["tier"], F.lit(0)).alias("tier"), F.coalesce(m["tierLabel"], F.lit("")).alias("tier_label"),
        F.coalesce(m["summary"], F.lit("")).alias("summary"), m["tags"].alias("tags"),
        F.coalesce(m["signals"]["hasFinancials"], F.lit(False)).alias("has_financials"),
        F.coalesce(m["signals"]["exhibitCount"], F.lit(0)).alias("exhibit_count"),
        F.when(F.col("financials").isNotNull(), F.struct(*[F.col(f"financials.{x}").alias(x) for x in ("period", "statements", "parseNotes")])).alias("financials"))


def assemble_filings(filing: DataFrame, meta: DataFrame, financials: DataFrame | None = None) -> DataFrame:
    """Filing rows from decoded documents in tables of their own, each keyed by (cik, year, folder)."""
    keys = ["cik", "year", "folder"]
    packed = lambda df, name: df.select(*keys, F.struct(*[x for x in df.columns if x not in keys]).alias(name))
    j = packed(filing, "filing").join(packed(meta, "meta"), keys, "left")
    if financials is None:
        return filing_columns(j.withColumn("financials", F.lit(None).cast("struct<period:string,statements:string,parseNotes:string>"))).drop("financials")
    return filing_columns(j.join(financials.select(*keys, "financials"), keys, "left"))


def count_by(filings: DataFrame, dimension: str, *, blank: str | None = None, skip_blank: bool = False) -> DataFrame:
    """Filings per value of one column; blanks are renamed, skipped or kept."""
    value = F.col(dimension)
    if skip_blank:
        filings = filings.where(F.coalesce(value, F.lit("")) != "")
    if blank is not None:
        value = F.coalesce(blank_to_null(value), F.lit(blank))
    return filings.groupBy("cik", value.alias("value")).agg(F.count("*").alias("n"))


def company_summary(filings: DataFrame) -> DataFrame:
    """Per company the years on disk and the filings by form, category and tier, each a list of (value, n) by value.

    Blank forms, tiers and years are not counted, blank categories are unknown. All facets are counted in one shuffle.
    """
    facet = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    year = F.when(F.col("year") > 0, F.col("year").cast("string"))
    facets = F.array(facet("year", year), facet("form", blank_to_null(F.col("form"))), facet("tier", blank_to_null(F.col("tier_label"))),
                     facet("category", F.coalesce(blank_to_null(F.col("category")), F.lit(fv.UNKNOWN_CATEGORY))))
    counts = (filings.select("cik", F.explode(facets).alias("f")).select("cik", "f.*").where("value IS NOT NULL")
              .groupBy("cik", "facet", "value").agg(F.count("*").alias("n")))
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("facet") == name, F.struct("value", "n"))))
    return counts.groupBy("cik").agg(pick("year").alias("years"), pick("form").alias("by_form"), pick("category").alias("by_category"), pick("tier").alias("by_tier"))


def filing_counts(filings: DataFrame) -> DataFrame:
    """Counts by form, category and tier label in long form, from one pass over the filings."""
    pairs = F.array(
        F.struct(F.lit("form").alias("dim"), F.col("form").alias("value")),
        F.struct(F.lit("category").alias("dim"), F.coalesce(blank_to_null(F.col("category")), F.lit(fv.UNKNOWN_CATEGORY)).alias("value")),
        F.struct(F.lit("tier").alias("dim"), F.col("tier_label").alias("value")))
    return (filings.select("cik", F.inline(pairs)).where(F.col("value") != "")
            .groupBy("cik", "dim", "value").agg(F.count("*").alias("n")))


def coverage(filings: DataFrame) -> DataFrame:
    """First and last filing date, number of filings, the years on disk and how many carry financials."""
    return filings.groupBy("cik").agg(
        F.min("filing_date").alias("earliest"), F.max("filing_date").alias("latest"), F.count("*").alias("total"),
        F.array_sort(F.collect_set("year")).alias("years"), F.count_if("has_financials").alias("with_financials"))


def indexed_not_on_disk(index: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Distinct indexed accessions per company that have no folder."""
    wanted = index.where(F.coalesce("accession", F.lit("")) != "").select("cik", "accession").distinct()
    return wanted.join(on_disk.select("cik", "accession"), ["cik", "accession"], "left_anti") \
                 .groupBy("cik").agg(F.count("*").alias("missing"))


def company_detail(companies: DataFrame, filings: DataFrame, index: DataFrame) -> DataFrame:
    """Identity, coverage and the number of indexed filings that are not on disk."""
    return (companies.join(coverage(filings), "cik", "left")
            .join(indexed_not_on_disk(index, filings), "cik", "left")
            .withColumn("missing", F.coalesce("missing", F.lit(0)))
            .withColumn("total", F.coalesce("total", F.lit(0)))
            .withColumn("with_financials", F.coalesce("with_financials", F.lit(0))))


def newest_first(filings: DataFrame) -> DataFrame:
    return filings.orderBy(F.desc("filing_date"), F.desc("accession"))


def filings_of(filings: DataFrame, year: int = 0, form: str = "") -> DataFrame:
    if year > 0:
        filings = filings.where(F.col("year") == year)
    if form:
        filings = filings.where(F.lower("form") == form.lower())
    return filings


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows of one page in a total order; ``limit <= 0`` means all rows after the offset."""
    out = df.orderBy(*order)
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit > 0 else out


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows also carry the number of rows before paging."""
    total = df.select(F.count("*")).scalar()
    return page(df, order, limit, offset).withColumn("total", total)


def search_score(query: Column, tickers: Column, name: Column, former: Column, cik: Column) -> Column:
    """How well a company answers a search text; 0 is no match. Tickers come before names.

    The first ticker that matches in any way decides, even where a later one matches better.
    """
    q = F.lower(F.trim(query))

    def one(ticker: Column) -> Column:
        t = F.lower(F.trim(ticker))
        return (F.when(t == "", 0).when(t == q, fv.SCORE_EXACT_TICKER).when(F.startswith(t, q), fv.SCORE_TICKER_PREFIX)
                .when(F.contains(t, q), fv.SCORE_TICKER_SUBSTRING).otherwise(0))
    by_ticker = F.coalesce(F.get(F.filter(F.transform(tickers, one), lambda s: s > 0), F.lit(0)), F.lit(0))
    low = F.lower(name)
    tokens = F.split(F.trim(low), r"\s+")
    return (F.when(q == "", 0).when(by_ticker > 0, by_ticker)
            .when(F.startswith(low, q), fv.SCORE_NAME_PREFIX)
            .when(F.exists(tokens, lambda t: F.startswith(t, q)), fv.SCORE_NAME_TOKEN_PREFIX)
            .when(F.contains(low, q), fv.SCORE_NAME_SUBSTRING)
            .when(F.exists(former, lambda f: F.contains(F.lower(f), q)), fv.SCORE_FORMER_NAME)
            .when(q.rlike("^[0-9]+$") & F.startswith(strip_zeros(cik), strip_zeros(q)), fv.SCORE_CIK_PREFIX)
            .otherwise(0))


def search(companies: DataFrame, text: str, limit: int = fv.MAX_SEARCH_RESULTS) -> DataFrame:
    """Best matches for one search text, at most 20 (a top-k report)."""
    if limit <= 0 or limit > fv.MAX_SEARCH_RESULTS:
        limit = fv.MAX_SEARCH_RESULTS
    scored = companies.withColumn("score", search_score(F.lit(text), F.col("tickers"), F.col("name"),
                                                        F.col("former_names"), F.col("cik")))
    return scored.where("score > 0").orderBy(F.desc("score"), "name", "cik").limit(limit)


def facet_list(counts: DataFrame, keys: list[str], top: int | None = None, last: str = fv.UNKNOWN_CATEGORY) -> DataFrame:
    """Values of a facet by falling count with a bar width; the unknown value is listed last.

    ``top`` is the size of a collapsed view; without it every value is listed.
    """
    whole = W.partitionBy(*keys)
    order = W.partitionBy(*keys).orderBy((F.col("value") == last).cast("int"), F.desc("n"), "value")
    out = (counts.withColumn("bar", F.greatest(F.lit(1), F.floor(100 * F.col("n") / F.max("n").over(whole) + 0.5)).cast("bigint"))
           .withColumn("position", F.row_number().over(order)))
    return out if top is None else out.where(F.col("position") <= top)


# ---- what to fetch ----

def in_window(filing_date: Column, as_of: Column, years: int) -> Column:
    """Filed in the last ``years`` calendar years; unreadable dates are not."""
    year = F.substring(filing_date.cast("string"), 1, 4).try_cast("int")
    return F.coalesce((F.length(filing_date.cast("string")) >= 4) & (year >= F.year(as_of) - years), F.lit(False))


def resolve_peers(peers: DataFrame, tickers: DataFrame) -> DataFrame:
    """Company key of each peer by its own id, else its ticker, else the reason there is none.

    The ticker map is one row per ticker; Spark broadcasts it only when its size allows.
    """
    own = F.trim(F.coalesce("company_id", F.lit("")))
    sign = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    p = peers.withColumn("_own", own).withColumn("_t", sign)
    known = tickers.select(F.upper("ticker").alias("_t"), F.col("cik").alias("_hit"))
    j = p.join(known, "_t", "left")
    by_id = normalize_cik(F.col("_own"))
    return (j.withColumn("cik", F.when(F.col("_own") != "", by_id).otherwise(F.when(F.col("_t") != "", F.col("_hit"))))
            .withColumn("note", F.when((F.col("_own") != "") & by_id.isNull(), F.lit("invalid company_id"))
                        .when((F.col("_own") == "") & (F.col("_t") == ""), F.lit("no company_id and no ticker"))
                        .when((F.col("_own") == "") & F.col("_hit").isNull(), F.lit("ticker not in ticker map")))
            .drop("_own", "_t", "_hit"))


def fetch_plan(index: DataFrame, on_disk: DataFrame, as_of: Column, years: int, peer_delay: float = 0) -> DataFrame:
    """Filings to fetch per company with download, disk, request and time estimates.

    ``forms`` lists (form, n) of the filings in the window; a null form is blank. ``peer_delay``: seconds to wait between peers, whole
    ones count. Filings are counted per company and form first, so a company with very many filings is one row per form.
    """
    have = on_disk.select("cik", "accession").distinct().withColumn("_have", F.lit(True))
    win = in_window(F.col("filing_date"), as_of, years)
    j = index.join(have, ["cik", "accession"], "left").withColumn("_w", win)
    flagged = (F.coalesce("is_xbrl", F.lit(0)) == 1) | (F.coalesce("is_inline_xbrl", F.lit(0)) == 1)
    counts = {"in_index": F.count("*"), "in_window": F.count_if("_w"), "on_disk": F.count_if(F.col("_w") & F.col("_have").isNotNull()),
              "to_fetch": F.count_if(F.col("_w") & F.col("_have").isNull()), "xbrl_flagged": F.count_if(F.col("_w") & flagged),
              "download_bytes": F.coalesce(F.sum(F.when(F.col("_w"), F.col("size"))), F.lit(0)).cast("bigint")}
    dated = F.when(F.col("_w"), F.col("filing_date"))
    by_form = j.groupBy("cik", F.coalesce("form", F.lit("")).alias("form")).agg(
        *[x.alias(k) for k, x in counts.items()], F.min(dated).alias("first_filing"), F.max(dated).alias("last_filing"))
    agg = by_form.groupBy("cik").agg(
        *[F.sum(k).cast("bigint").alias(k) for k in counts], F.min("first_filing").alias("first_filing"), F.max("last_filing").alias("last_filing"),
        F.sort_array(F.collect_list(F.when(F.col("in_window") > 0, F.struct("form", F.col("in_window").alias("n"))))).alias("forms"))
    requests = (F.lit(2) + F.col("to_fetch") * fv.FILES_PER_FILING).cast("bigint")
    return (agg.withColumn("disk_bytes", (F.col("download_bytes").cast("double") * F.lit(fv.DISK_EXPANSION)).cast("bigint"))
            .withColumn("requests", requests)
            .withColumn("seconds", (F.col("requests").cast("double") / F.lit(fv.REQUESTS_PER_SECOND)).cast("bigint") + F.lit(int(peer_delay)).cast("bigint")))


def peer_plans(peers: DataFrame, tickers: DataFrame, plans: DataFrame) -> DataFrame:
    """A plan row per peer: planned, skipped where it has no company key, error where its company has no index.

    Counts of peers that are not planned are 0 and their lists of forms empty. Columns of ``plans`` follow those of the peer.
    """
    j = resolve_peers(peers, tickers).join(plans, "cik", "left")
    status = F.when(F.col("cik").isNull(), F.lit("skipped")).when(F.col("in_index").isNull(), F.lit("error")).otherwise(F.lit("planned"))
    numbers = ["in_index", "in_window", "on_disk", "to_fetch", "xbrl_flagged", "download_bytes", "disk_bytes", "requests", "seconds"]
    return (j.withColumn("status", status).withColumn("note", F.when(status == "error", F.lit("no index")).otherwise(F.col("note")))
            .withColumns({x: F.coalesce(x, F.lit(0).cast("bigint")) for x in numbers})
            .withColumn("forms", F.coalesce("forms", F.array().cast(plans.schema["forms"].dataType))))


def plan_totals(plans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Peers by status and the sums of their estimates, over all plans or per ``keys``."""
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x)
            for x in ("to_fetch", "download_bytes", "disk_bytes", "requests", "seconds")]
    return plans.groupBy(*(keys or [])).agg(
        F.count("*").alias("peers"), F.count_if(F.col("status") == "planned").alias("planned"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "error").alias("error"), *sums)


def plan_report(plans: DataFrame) -> DataFrame:
    """One text line per peer."""
    return plans.withColumn("line", F.when(
        F.col("status") != "planned", F.concat_ws(" ", "cik", "status", F.coalesce("note", F.lit(""))))
        .otherwise(F.concat(F.col("cik"), F.lit(" planned "), F.col("to_fetch"), F.lit(" filings ~"),
                            human_bytes(F.col("disk_bytes")), F.lit(" ~"), human_duration(F.col("seconds")))))


def plan_documents(plans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One report document per peer list (``keys``): its totals, and its peers in ``order`` with status, note and a text line.

    A document is one row, so a list must fit a row; very many lists are spread over all tasks.
    """
    totals = [x for x in plan_totals(plans, keys).columns if x not in keys]
    peers = plan_report(plans).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "status", "note", "cik", "to_fetch", "line"))).alias("peers"))
    return plan_totals(plans, keys).select(*keys, F.struct(*totals).alias("totals")).join(peers, keys)


def step_needs(index: DataFrame, filing_docs: DataFrame, meta_docs: DataFrame, as_of: Column, years: int) -> DataFrame:
    """Per company: must fetch (a filing in the window has no folder), must build meta (one is missing)."""
    wanted = index.where(in_window(F.col("filing_date"), as_of, years)).select("cik", "accession").distinct()
    fetch = wanted.join(filing_docs.select("cik", "accession"), ["cik", "accession"], "left_anti") \
                  .groupBy("cik").agg(F.count("*").alias("to_fetch"))
    meta = filing_docs.select("cik", "accession").join(meta_docs.select("cik", "accession"), ["cik", "accession"], "left_anti") \
                      .groupBy("cik").agg(F.count("*").alias("to_describe"))
    companies = index.select("cik").distinct()
    return (companies.join(fetch, "cik", "left").join(meta, "cik", "left")
            .select("cik", F.coalesce(F.col("to_fetch") > 0, F.lit(False)).alias("fetch_needed"),
                    F.coalesce(F.col("to_describe") > 0, F.lit(False)).alias("meta_needed")))


def document_gaps(filings: DataFrame, files: DataFrame) -> DataFrame:
    """Filings whose primary document is named but absent, viewer paths and XML aside."""
    named = filings.where((F.coalesce("primary_document", F.lit("")) != "")
                          & ~F.contains("primary_document", F.lit("/")) & ~F.endswith("primary_document", F.lit(".xml")))
    have = files.select("accession", F.col("file_name").alias("primary_document"))
    return named.join(have, ["accession", "primary_document"], "left_anti")


def run_status(steps: DataFrame) -> DataFrame:
    """A run is complete without errors, partial when some step succeeded, else an error."""
    ok, err = F.count_if(F.col("result") == "ok"), F.count_if(F.col("result") == "error")
    return (steps.groupBy("cik").agg(ok.alias("ok"), err.alias("errors"))
            .withColumn("status", F.when(F.col("errors") == 0, F.lit("complete"))
                        .when(F.col("ok") > 0, F.lit("partial")).otherwise(F.lit("error"))))


def resolve_targets(companies: DataFrame, override: DataFrame | None = None, default_fye: str = "") -> DataFrame:
    """Companies to collect estimates for: valid key, a ticker (given, else the first), fiscal year end."""
    base = companies.withColumn("cik", normalize_cik(F.col("cik"))).where("cik IS NOT NULL")
    if override is not None:
        base = base.join(override.select("cik", F.col("ticker").alias("_given")), "cik")
    else:
        base = base.withColumn("_given", F.lit(None).cast("string"))
    ticker = F.coalesce(blank_to_null(F.col("_given")), blank_to_null(F.get("tickers", F.lit(0))))
    return (base.withColumn("ticker", F.trim(ticker)).where("ticker IS NOT NULL")
            .select("cik", "ticker", F.coalesce(blank_to_null(F.col("fye")), F.lit(default_fye)).alias("fye"), "name"))
