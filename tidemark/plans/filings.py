"""Queries over filings and companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import documents as docs
from tidemark.operators import activity, filings as fl, timeline as tl
from tidemark.plans.scalars import RULES_SQL
from tidemark.plans.views import for_check
from tidemark.registry import query
from tidemark.session import scratch_path, written
from tidemark.sources import sinks as sk

c = F.col
def as_of():
    return F.lit("2001-06-30").cast("date")


def _company_arrays(df):
    return df.withColumn("tickers", F.array("ticker_a", "ticker_b")).withColumn("former_names", F.array("former_a"))


# ---- filters ----

@query("flt01_year_form", views="filings", sql="SELECT accession, cik, form FROM filings WHERE year = 1998 AND lower(form) = '6-k'")
def flt01(t):
    return fl.filings_of(t.filings, 1998, "6-k").select("accession", "cik", "form")


@query("flt02_date_window", views="filings", sql="SELECT accession FROM filings WHERE filing_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def flt02(t):
    return t.filings.where(c("filing_date").between(F.lit("1997-03-01").cast("date"), F.lit("1998-02-28").cast("date"))).select("accession")


@query("flt03_lane", views="filings", sql=f"""
    SELECT lane, f.accession FROM filings f LEFT JOIN {RULES_SQL} ON f.category = d.category, (VALUES ('all'), ('major'), ('financials'), ('other')) AS l(lane)
    WHERE lane IN ('all', 'other') OR (lane = 'major' AND d.weight = 'major') OR (lane = 'financials' AND d.is_event)""")
def flt03(t):
    parts = [tl.lane_filter(t.filings, lane).select(F.lit(lane).alias("lane"), "accession") for lane in ("all", "major", "financials", "other")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("flt04_report_categories", views="filings", sql="SELECT accession, category FROM filings WHERE category IN ('quarterly_results', 'annual_report')")
def flt04(t):
    return t.filings.where(tl.financial_report(c("category"))).select("accession", "category")


_RAW_SRC = """SELECT lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, CAST(year(o_orderdate) AS INT) AS year, 'dir-' || CAST(o_orderkey AS STRING) AS folder,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS acc, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS filing_date,
      CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS STRING) ELSE o_orderstatus END AS form, o_orderkey FROM orders"""


@query("flt05_usable_filings", src=_RAW_SRC, sql="""
    SELECT folder, CASE WHEN acc = '' THEN folder ELSE acc END AS accession, form, filing_date FROM src WHERE coalesce(form, '') <> '' AND filing_date <> ''""")
def flt05(t, src):
    filing = src.select("cik", "year", "folder", c("acc").alias("accessionNumber"), c("filing_date").alias("filingDate"),
                        F.lit("").alias("reportDate"), "form")
    meta = src.where("false").select("cik", "year", "folder", F.lit("").alias("category"), F.lit(1).alias("tier"), F.lit("").alias("tierLabel"),
                                     F.lit("").alias("summary"), F.array(F.lit("")).alias("tags"),
                                     F.struct(F.lit(True).alias("hasFinancials"), F.lit(1).alias("exhibitCount")).alias("signals"))
    return fl.assemble_filings(filing, meta).select("folder", "accession", "form", "filing_date")


@query("flt09_trailing_years", src="""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'n/a-date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS d FROM orders""",
       sql="SELECT o_orderkey, d FROM src WHERE length(d) >= 4 AND TRY_CAST(substr(d, 1, 4) AS INTEGER) >= 1998")
def flt09(t, src):
    return src.where(fl.in_window(c("d"), as_of(), 3)).select("o_orderkey", "d")


@query("flt16_selected_peers", src="SELECT c_custkey, c_custkey % 3 = 0 AS wanted, c_custkey % 6 = 0 AS blank FROM customer",
       sql="SELECT c_custkey FROM src WHERE wanted AND NOT blank")
def flt16(t, src):
    fetch = F.when(~c("blank"), c("wanted"))
    return src.where(F.coalesce(fetch, F.lit(False))).select("c_custkey")


_PRIMARY_SRC = """SELECT CAST(o_orderkey AS STRING) AS accession, CASE o_orderkey % 6 WHEN 0 THEN 'x/view.htm' WHEN 1 THEN 'doc.xml' WHEN 2 THEN '' ELSE 'doc1.htm' END AS primary_document FROM orders"""


@query("flt17_document_gaps", src=_PRIMARY_SRC, sql="""
    SELECT s.accession, s.primary_document FROM src s WHERE s.primary_document = 'doc1.htm' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE CAST(l.l_orderkey AS VARCHAR) = s.accession AND l.l_linenumber = 1)""")
def flt17(t, src):
    files = t.lineitem.select(c("l_orderkey").cast("string").alias("accession"), F.concat(F.lit("doc"), c("l_linenumber"), F.lit(".htm")).alias("file_name"))
    return fl.document_gaps(src, files).select("accession", "primary_document")


_CHOICE_SQL = "SELECT form, category, CAST(sum(filing_no) % 2 AS INTEGER) = 0 AS checked FROM filings WHERE filing_no % 3 > 0 GROUP BY form, category HAVING count(*) % 5 > 0"


@query("flt18_visible_events", views="filings", sql=f"""
    SELECT f.accession FROM filings f LEFT JOIN ({_CHOICE_SQL}) ch ON f.form = ch.form AND f.category = ch.category WHERE coalesce(ch.checked, true)""")
def flt18(t):
    choices = (t.filings.where("filing_no % 3 > 0").groupBy("form", "category").agg(F.sum("filing_no").alias("s"), F.count("*").alias("n"))
               .where("n % 5 > 0").select("form", "category", (c("s") % 2 == 0).alias("checked")))
    return tl.visible(t.filings, choices).select("accession")


@query("flt19_lane_split", views="filings", sql="""
    SELECT cik, CAST(count(*) FILTER (category IN ('quarterly_results', 'annual_report')) AS BIGINT) AS financial, CAST(count(*) FILTER (category NOT IN ('quarterly_results', 'annual_report')) AS BIGINT) AS general
    FROM filings GROUP BY cik""")
def flt19(t):
    fin = tl.financial_report(c("category"))
    return t.filings.groupBy("cik").agg(F.count_if(fin).alias("financial"), F.count_if(~fin).alias("general"))


@query("flt21_admission", src="""SELECT doc_id, n_chars * 30000 AS size, CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf; x=1' WHEN 2 THEN 'video/mp4' WHEN 3 THEN '' ELSE 'application/zip' END AS declared, 'f' || CAST(doc_id AS STRING) || '.csv' AS name FROM documents""", sql="""
    SELECT doc_id, CASE WHEN size > 52428800 THEN 'too_large' WHEN declared IN ('video/mp4', 'application/zip') THEN 'unsupported_type' ELSE 'admitted' END AS verdict FROM src""")
def flt21(t, src):
    reason = docs.admission_reason(docs.mime_of(c("name"), c("declared")), c("size"))
    return src.select("doc_id", F.coalesce(reason, F.lit("admitted")).alias("verdict"))


# ---- joins ----

@query("jn01_filing_meta", src=_RAW_SRC, sql="""
    SELECT s.folder, CASE WHEN s.o_orderkey % 3 = 0 THEN CASE WHEN s.o_orderkey % 4 = 0 THEN 'unknown' ELSE 'governance' END ELSE 'unknown' END AS category,
      CASE WHEN s.o_orderkey % 3 = 0 THEN CAST(s.o_orderkey % 4 AS INTEGER) ELSE 0 END AS tier, s.o_orderkey % 3 = 0 AND s.o_orderkey % 2 = 0 AS has_financials
    FROM src s WHERE coalesce(form, '') <> '' AND filing_date <> ''""")
def jn01(t, src):
    filing = src.select("cik", "year", "folder", c("acc").alias("accessionNumber"), c("filing_date").alias("filingDate"), F.lit("").alias("reportDate"), "form")
    meta = src.where("o_orderkey % 3 = 0").select(
        "cik", "year", "folder", F.when(c("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.lit("governance")).alias("category"),
        (c("o_orderkey") % 4).cast("int").alias("tier"), F.lit("X").alias("tierLabel"), F.lit("s").alias("summary"), F.array(F.lit("t")).alias("tags"),
        F.struct((c("o_orderkey") % 2 == 0).alias("hasFinancials"), F.lit(1).alias("exhibitCount")).alias("signals"))
    return fl.assemble_filings(filing, meta).select("folder", "category", "tier", "has_financials")


_ON_DISK = "SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2"


@query("jn02_indexed_not_on_disk", views="filings", sql=f"""
    SELECT cik, count(DISTINCT accession) AS missing FROM filings WHERE filing_no NOT IN ({_ON_DISK}) GROUP BY cik""")
def jn02(t):
    disk = t.filings.join(t.lineitem.where("l_linenumber <= 2").select(c("l_orderkey").alias("filing_no")), "filing_no", "left_semi")
    return fl.indexed_not_on_disk(t.filings, disk)


@query("jn03_step_needs", views="filings", sql=f"""
    WITH d AS (SELECT cik, filing_no FROM filings WHERE filing_no IN ({_ON_DISK})), m AS (SELECT filing_no FROM d WHERE filing_no % 5 > 0)
    SELECT cik, bool_or(year >= 1998 AND filing_no NOT IN (SELECT filing_no FROM d)) AS fetch_needed,
      bool_or(filing_no IN (SELECT filing_no FROM d) AND filing_no NOT IN (SELECT filing_no FROM m)) AS meta_needed FROM filings GROUP BY cik""")
def jn03(t):
    disk = t.filings.join(t.lineitem.where("l_linenumber <= 2").select(c("l_orderkey").alias("filing_no")), "filing_no", "left_semi")
    return fl.step_needs(t.filings, disk, disk.where("filing_no % 5 > 0"), as_of(), 3)


_PEER_SRC = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN 'bad id' ELSE '' END AS company_id,
      CASE o_orderkey % 5 WHEN 0 THEN '' ELSE ' t' || CAST(o_custkey AS STRING) || ' ' END AS ticker FROM orders"""


@query("jn04_resolve_peer", src=_PEER_SRC, sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN lpad(company_id, 10, '0') WHEN o_orderkey % 4 > 1 THEN lpad(CAST(k.c_custkey AS VARCHAR), 10, '0') END AS cik,
      CASE WHEN o_orderkey % 4 = 1 THEN 'invalid company_id' WHEN o_orderkey % 4 > 1 AND trim(ticker) = '' THEN 'no company_id and no ticker' WHEN o_orderkey % 4 > 1 AND k.c_custkey IS NULL THEN 'ticker not in ticker map' END AS note
    FROM src LEFT JOIN (SELECT c_custkey, 'T' || c_custkey AS tk FROM customer WHERE c_custkey % 2 = 0) k ON upper(trim(ticker)) = k.tk""")
def jn04(t, src):
    tickers = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("T"), c("c_custkey")).alias("ticker"), F.lpad(c("c_custkey").cast("string"), 10, "0").alias("cik"))
    return fl.resolve_peers(src, tickers).select("o_orderkey", "cik", "note")


# ---- aggregates ----

@query("agg01_filing_counts", views="filings", sql="""
    SELECT cik, 'form' AS dim, form AS value, count(*) AS n FROM filings GROUP BY ALL UNION ALL
    SELECT cik, 'category', CASE WHEN category = '' THEN 'unknown' ELSE category END, count(*) FROM filings GROUP BY ALL UNION ALL
    SELECT cik, 'tier', tier_label, count(*) FROM filings WHERE tier_label <> '' GROUP BY ALL""")
def agg01(t):
    return fl.filing_counts(t.filings)


@query("agg02_coverage", views="filings", sql="""
    SELECT cik, CAST(min(filing_date) AS VARCHAR) AS earliest, CAST(max(filing_date) AS VARCHAR) AS latest, count(*) AS total, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM filings GROUP BY cik""")
def agg02(t):
    return fl.coverage(t.filings).select("cik", c("earliest").cast("string").alias("earliest"), c("latest").cast("string").alias("latest"), "total",
                                         F.array_join(c("years").cast("array<string>"), ",").alias("years"))


@query("agg03_with_financials", views="filings", sql="SELECT cik, count(*) FILTER (has_financials) AS with_financials FROM filings GROUP BY cik")
def agg03(t):
    return fl.coverage(t.filings).select("cik", "with_financials")


_INDEX_SRC = """SELECT lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, CAST(o_orderkey AS STRING) AS accession, CAST(o_orderdate AS DATE) AS filing_date,
    CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(o_orderkey % 3 AS INT) AS is_xbrl, CAST(o_orderkey % 5 AS INT) AS is_inline_xbrl, o_orderpriority AS form, o_orderkey FROM orders"""
_PLAN_SQL = f"""SELECT cik, count(*) AS in_index, count(*) FILTER (w) AS in_window, count(*) FILTER (w AND d) AS on_disk, count(*) FILTER (w AND NOT d) AS to_fetch,
      count(*) FILTER (w AND (is_xbrl = 1 OR is_inline_xbrl = 1)) AS xbrl_flagged, CAST(min(filing_date) FILTER (w) AS VARCHAR) AS first_filing, CAST(max(filing_date) FILTER (w) AS VARCHAR) AS last_filing,
      CAST(coalesce(sum(size) FILTER (w), 0) AS BIGINT) AS download_bytes, CAST(trunc(coalesce(sum(size) FILTER (w), 0)::DOUBLE * 1.4::DOUBLE) AS BIGINT) AS disk_bytes,
      CAST(2 + 12 * count(*) FILTER (w AND NOT d) AS BIGINT) AS requests, CAST(trunc((2 + 12 * count(*) FILTER (w AND NOT d))::DOUBLE / 8.3::DOUBLE) AS BIGINT) + 2 AS seconds, coalesce(any_value(forms), '') AS forms
    FROM (SELECT *, year(filing_date) >= 1998 AS w, o_orderkey IN ({_ON_DISK}) AS d FROM src)
    LEFT JOIN (SELECT cik, string_agg(form || ':' || n, ',' ORDER BY form) AS forms FROM (SELECT cik, form, count(*) AS n FROM src WHERE year(filing_date) >= 1998 GROUP BY cik, form) GROUP BY cik) USING (cik) GROUP BY cik"""


def _plan(t, src):
    disk = t.lineitem.where("l_linenumber <= 2").select(c("l_orderkey").cast("string").alias("accession"))
    return fl.fetch_plan(src, src.select("cik", "accession").join(disk, "accession", "left_semi"), as_of(), 3, peer_delay=2.5)


def _forms():
    return F.array_join(F.transform(c("forms"), lambda x: F.concat(x["form"], F.lit(":"), x["n"])), ",").alias("forms")


@query("agg04_fetch_plan", src=_INDEX_SRC, sql=_PLAN_SQL)
def agg04(t, src):
    p = _plan(t, src)
    return p.withColumns({"first_filing": c("first_filing").cast("string"), "last_filing": c("last_filing").cast("string"), "forms": _forms()})


_STATUS = "CASE WHEN in_index % 7 = 0 THEN 'skipped' WHEN in_index % 11 = 0 THEN 'error' ELSE 'planned' END"


@query("agg05_plan_totals", src=_INDEX_SRC, sql=f"""
    SELECT count(*) AS peers, count(*) FILTER (s = 'planned') AS planned, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'error') AS error, CAST(sum(to_fetch) AS BIGINT) AS to_fetch,
      CAST(sum(download_bytes) AS BIGINT) AS download_bytes, CAST(sum(disk_bytes) AS BIGINT) AS disk_bytes, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(seconds) AS BIGINT) AS seconds FROM (SELECT *, {_STATUS} AS s FROM ({_PLAN_SQL}))""")
def agg05(t, src):
    return fl.plan_totals(_plan(t, src).withColumn("status", F.expr(_STATUS)))


@query("agg06_status_counts", src="SELECT user_id, event_type FROM events", sql="""
    SELECT user_id, count(*) FILTER (event_type = 'view') AS complete, count(*) FILTER (event_type = 'click') AS partial, count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'error') AS error FROM src GROUP BY user_id""")
def agg06(t, src):
    names = {"view": "complete", "click": "partial", "signup": "skipped", "error": "error"}
    return src.groupBy("user_id").agg(*[F.count_if(c("event_type") == k).alias(v) for k, v in names.items()])


@query("agg07_run_status", src="""SELECT CAST(user_id AS STRING) || '-' || CAST(day(ts) AS STRING) AS cik, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS result FROM events""", sql="""
    SELECT cik, count(*) FILTER (result = 'ok') AS ok, count(*) FILTER (result = 'error') AS errors, CASE WHEN count(*) FILTER (result = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (result = 'ok') > 0 THEN 'partial' ELSE 'error' END AS status FROM src GROUP BY cik""")
def agg07(t, src):
    return fl.run_status(src)


_RUN_SRC = "SELECT event_id, event_type AS source, ts AS started_at, CAST(floor(value) AS BIGINT) AS navigations, user_id % 5 AS clicks, CAST(NULL AS BIGINT) AS downloads FROM events"


@query("agg08_run_totals", src=_RUN_SRC, sql="SELECT count(*) AS runs, CAST(coalesce(sum(navigations), 0) AS BIGINT) AS navigations, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(downloads), 0) AS BIGINT) AS downloads FROM src")
def agg08(t, src):
    return activity.run_totals(src, ["navigations", "clicks", "downloads"])


@query("agg09_projects_by_status", views="projects", sql="SELECT status, count(*) AS n FROM projects GROUP BY status")
def agg09(t):
    return activity.status_counts(t.projects)


@query("agg11_filter_tree", views="filings", sql="""
    SELECT form, NULL AS category, count(*) AS n FROM filings GROUP BY form UNION ALL SELECT form, category, count(*) FROM filings GROUP BY form, category""")
def agg11(t):
    return tl.filter_tree(t.filings)


@query("agg12_events_per_year", views="filings", sql=f"""
    SELECT f.cik, CAST(year(f.filing_date) AS INTEGER) AS year, count(*) AS n FROM filings f JOIN {RULES_SQL} ON f.category = d.category WHERE d.is_event GROUP BY ALL""")
def agg12(t):
    return tl.events_per_year(tl.lane_filter(t.filings, "financials"))


@query("agg23_files_by_name", src="SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 1 THEN 'filing.json' WHEN 2 THEN 'meta.json' WHEN 3 THEN 'financials.json' ELSE 'doc.htm' END AS file_name FROM lineitem", sql="""
    SELECT o_custkey AS company, file_name, count(*) AS n FROM src JOIN orders ON o_orderkey = l_orderkey WHERE file_name <> 'doc.htm' GROUP BY ALL""")
def agg23(t, src):
    named = src.where("file_name <> 'doc.htm'").groupBy("l_orderkey", "file_name").agg(F.count("*").alias("k"))
    return (named.join(t.orders.select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("company")), "l_orderkey")
            .groupBy("company", "file_name").agg(F.sum("k").alias("n")))


# ---- sort, limit, top-k ----

@query("top01_newest_first", views="filings", sql="SELECT accession, CAST(filing_date AS VARCHAR) AS filing_date FROM filings")
def top01(t):
    return fl.newest_first(t.filings).select("accession", c("filing_date").cast("string").alias("filing_date"))


def _search_sql(q: str) -> str:
    tk = ("CASE WHEN lower(trim({t})) = '' THEN 0 WHEN lower(trim({t})) = '" + q + "' THEN 100 WHEN starts_with(lower(trim({t})), '" + q
          + "') THEN 95 WHEN contains(lower(trim({t})), '" + q + "') THEN 85 ELSE 0 END")
    digits = q.isdigit()
    short = q.lstrip("0") or "0"
    by_cik = f"WHEN starts_with(CAST(cik_no AS VARCHAR), '{short}') THEN 50" if digits else ""
    return f"""SELECT cik, name, CAST(score AS INTEGER) AS score FROM (SELECT *, CASE WHEN ta > 0 THEN ta WHEN tb > 0 THEN tb WHEN starts_with(lower(name), '{q}') THEN 90
      WHEN len(list_filter(string_split_regex(trim(lower(name)), '\\s+'), lambda x: starts_with(x, '{q}'))) > 0 THEN 80 WHEN contains(lower(name), '{q}') THEN 70 WHEN contains(lower(former_a), '{q}') THEN 60 {by_cik} ELSE 0 END AS score
      FROM (SELECT *, {tk.format(t='ticker_a')} AS ta, {tk.format(t='ticker_b')} AS tb FROM companies)) WHERE score > 0 ORDER BY score DESC, name, cik LIMIT 20"""


@query("top02_search_name", views="companies", sql=_search_sql("hold"))
def top02(t):
    return fl.search(_company_arrays(t.companies), " HOLD ").select("cik", "name", "score")


@query("top02_search_ticker", views="companies", sql=_search_sql("x1"))
def top02_ticker(t):
    return fl.search(_company_arrays(t.companies), "x1", 50).select("cik", "name", "score")


@query("qry03_company_search", views="companies", sql=_search_sql("12"))
def qry03(t):
    return fl.search(_company_arrays(t.companies), "12").select("cik", "name", "score")


@query("top03_page", views="filings", sql="""
    SELECT accession, (SELECT count(*) FROM filings WHERE year = 1997) AS total FROM filings WHERE year = 1997 ORDER BY filing_date DESC, accession DESC LIMIT 25 OFFSET 50""")
def top03(t):
    return fl.page_with_total(fl.filings_of(t.filings, 1997), [F.desc("filing_date"), F.desc("accession")], 25, 50).select("accession", "total")


@query("qry04_filings_page", views="filings", sql="""
    SELECT accession, form, CAST(filing_date AS VARCHAR) AS filing_date, (SELECT count(*) FROM filings WHERE year = 1999 AND form = '20-F') AS total FROM filings WHERE year = 1999 AND form = '20-F' ORDER BY filing_date DESC, accession DESC LIMIT 20""")
def qry04(t):
    return fl.page_with_total(fl.filings_of(t.filings, 1999, "20-f"), [F.desc("filing_date"), F.desc("accession")], 20).select(
        "accession", "form", c("filing_date").cast("string").alias("filing_date"), "total")


@query("top04_recent_runs", src=_RUN_SRC, sql="SELECT event_id, source, navigations FROM src ORDER BY started_at DESC, event_id DESC LIMIT 50")
def top04(t, src):
    return activity.recent(src, "started_at", "event_id", 50, 500).select("event_id", "source", "navigations")


@query("top05_recent_events", views="log_events", sql="SELECT event_id, project_id, stage FROM log_events ORDER BY created_at DESC, event_id DESC LIMIT 20")
def top05(t):
    return activity.recent(t.log_events, "created_at", "event_id", 20).select("event_id", "project_id", "stage")


@query("top08_tree_order", views="filings", sql="SELECT form, n FROM (SELECT form, count(*) AS n FROM filings GROUP BY form) ORDER BY n DESC, form")
def top08(t):
    return t.filings.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form")


def _facet_sql(value, limit=""):
    return f"""
    WITH n AS (SELECT cik, {value} AS value, count(*) AS n FROM filings GROUP BY ALL)
    SELECT cik, value, n, CAST(greatest(1, floor(100 * n / max(n) OVER (PARTITION BY cik) + 0.5)) AS BIGINT) AS bar FROM n {limit}"""


@query("top12_facets", views="filings", sql=_facet_sql("CASE WHEN category = '' THEN 'unknown' ELSE category END"))
def top12(t):
    return fl.facet_list(fl.count_by(t.filings, "category", blank="unknown"), ["cik"]).select("cik", "value", "n", "bar")


@query("top12_form_facets", views="filings", sql=_facet_sql("form"))
def top12_forms(t):
    return fl.facet_list(fl.count_by(t.filings, "form"), ["cik"]).select("cik", "value", "n", "bar")


@query("top12_form_facets_collapsed", views="filings", sql=_facet_sql("form", "QUALIFY row_number() OVER (PARTITION BY cik ORDER BY n DESC, value) <= 8"))
def top12_collapsed(t):
    return fl.facet_list(fl.count_by(t.filings, "form"), ["cik"], top=8).select("cik", "value", "n", "bar")


@query("set04_distinct_years", views="filings", sql="SELECT DISTINCT cik, year FROM filings")
def set04(t):
    return t.filings.select("cik", "year").distinct()


# ---- composites ----

def _counts_sql(name, value, keep):
    return f"(SELECT cik, string_agg(v || ':' || n, ',' ORDER BY v) AS {name} FROM (SELECT cik, {value} AS v, count(*) AS n FROM disk WHERE {keep} GROUP BY ALL) GROUP BY cik)"


@query("qry01_company_detail", views="companies filings", sql=f"""
    WITH disk AS (SELECT * FROM filings WHERE filing_no IN ({_ON_DISK}))
    SELECT c.cik, c.name, CAST(v.earliest AS VARCHAR) AS earliest, CAST(v.latest AS VARCHAR) AS latest, coalesce(v.total, 0) AS total, coalesce(v.wf, 0) AS with_financials, coalesce(m.missing, 0) AS missing,
      coalesce(years, '') AS years, coalesce(by_form, '') AS by_form, coalesce(by_category, '') AS by_category, coalesce(by_tier, '') AS by_tier
    FROM companies c LEFT JOIN (SELECT cik, min(filing_date) AS earliest, max(filing_date) AS latest, count(*) AS total, count(*) FILTER (has_financials) AS wf FROM disk GROUP BY cik) v ON c.cik = v.cik
    LEFT JOIN (SELECT cik, count(*) AS missing FROM filings WHERE filing_no NOT IN ({_ON_DISK}) GROUP BY cik) m ON c.cik = m.cik
    LEFT JOIN {_counts_sql('years', 'CAST(year AS VARCHAR)', 'year > 0')} y ON c.cik = y.cik LEFT JOIN {_counts_sql('by_form', 'form', "form <> ''")} f ON c.cik = f.cik
    LEFT JOIN {_counts_sql('by_category', "CASE WHEN category = '' THEN 'unknown' ELSE category END", 'true')} g ON c.cik = g.cik LEFT JOIN {_counts_sql('by_tier', 'tier_label', "tier_label <> ''")} t ON c.cik = t.cik""")
def qry01(t):
    disk = t.filings.join(t.lineitem.where("l_linenumber <= 2").select(c("l_orderkey").alias("filing_no")), "filing_no", "left_semi")
    text = lambda name: F.coalesce(F.array_join(F.transform(c(name), lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ","), F.lit("")).alias(name)
    return (fl.company_detail(t.companies, disk, t.filings).drop("years").join(fl.company_summary(disk), "cik", "left")
            .select("cik", "name", c("earliest").cast("string").alias("earliest"), c("latest").cast("string").alias("latest"), "total", "with_financials",
                    "missing", text("years"), text("by_form"), text("by_category"), text("by_tier")))


_PEER_LISTS = _PEER_SRC.replace("SELECT o_orderkey,", "SELECT o_orderkey, CAST(o_orderkey - o_orderkey % 20 AS STRING) AS list,", 1)
_NUMBERS = ["in_window", "on_disk", "to_fetch", "xbrl_flagged", "download_bytes", "disk_bytes", "requests", "seconds"]
_PEER_PLANS = f"""p AS (SELECT o_orderkey, list, CASE WHEN o_orderkey % 4 = 0 THEN lpad(company_id, 10, '0') WHEN o_orderkey % 4 > 1 THEN lpad(CAST(k.c_custkey AS VARCHAR), 10, '0') END AS cik,
        CASE WHEN o_orderkey % 4 = 1 THEN 'invalid company_id' WHEN o_orderkey % 4 > 1 AND trim(ticker) = '' THEN 'no company_id and no ticker' WHEN o_orderkey % 4 > 1 AND k.c_custkey IS NULL THEN 'ticker not in ticker map' END AS note
      FROM src LEFT JOIN (SELECT c_custkey, 'T' || c_custkey AS tk FROM customer WHERE c_custkey % 2 = 0) k ON upper(trim(ticker)) = k.tk),
    idx AS (WITH src AS ({for_check(_INDEX_SRC)}) {_PLAN_SQL}),
    plans AS (SELECT o_orderkey, list, CASE WHEN p.cik IS NULL THEN 'skipped' WHEN idx.cik IS NULL THEN 'error' ELSE 'planned' END AS status, CASE WHEN p.cik IS NOT NULL AND idx.cik IS NULL THEN 'no index' ELSE p.note END AS note,
        {', '.join(f'coalesce(idx.{x}, 0) AS {x}' for x in _NUMBERS)}, first_filing, last_filing, coalesce(forms, '') AS forms FROM p LEFT JOIN idx ON p.cik = idx.cik)"""
_TOTALS_SQL = """SELECT list, count(*) AS peers, count(*) FILTER (status = 'planned') AS planned, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error, CAST(sum(to_fetch) AS BIGINT) AS to_fetch,
    CAST(sum(download_bytes) AS BIGINT) AS download_bytes, CAST(sum(disk_bytes) AS BIGINT) AS disk_bytes, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(seconds) AS BIGINT) AS seconds FROM plans GROUP BY list"""


def _peer_plans(t, src):
    """Plans of all peers of all lists, computed once for the rows and the totals."""
    tickers = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("T"), c("c_custkey")).alias("ticker"), F.lpad(c("c_custkey").cast("string"), 10, "0").alias("cik"))
    return written(fl.peer_plans(src, tickers, _plan(t, t.select(_INDEX_SRC, "orders"))), "peer-plans")


@query("qry07_peer_fetch_plan", src=_PEER_LISTS, sql=f"""
    WITH {_PEER_PLANS}, totals AS ({_TOTALS_SQL})
    SELECT o_orderkey, plans.list, status, note, {', '.join(f'plans.{x}' for x in _NUMBERS)}, first_filing, last_filing, forms,
      peers AS list_peers, planned AS list_planned, skipped AS list_skipped, error AS list_error, totals.to_fetch AS list_to_fetch, totals.seconds AS list_seconds FROM plans JOIN totals ON plans.list = totals.list""")
def qry07(t, src):
    plans = _peer_plans(t, src)
    totals = fl.plan_totals(plans, ["list"]).select("list", *(c(x).alias(f"list_{x}") for x in ("peers", "planned", "skipped", "error", "to_fetch", "seconds")))
    return plans.join(totals, "list").select(
        "o_orderkey", "list", "status", "note", *_NUMBERS, c("first_filing").cast("string").alias("first_filing"), c("last_filing").cast("string").alias("last_filing"), _forms(),
        *[x for x in totals.columns if x != "list"])


@query("snk07_plan_report", src=_PEER_LISTS, sql=f"""
    WITH {_PEER_PLANS}, totals AS ({_TOTALS_SQL})
    SELECT list, planned, error, peers AS n_rows, to_fetch, requests, CAST(crc AS BIGINT) AS order_sum FROM totals
    JOIN (SELECT list, sum(o_orderkey * k) AS crc FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY o_orderkey) AS k FROM plans) GROUP BY list) USING (list)""")
def snk07_plan(t, src):
    path = scratch_path(t.spark, "plan-report")
    sk.write_report(fl.plan_documents(_peer_plans(t, src), ["list"], "o_orderkey"), path)
    read = t.spark.read.schema("list string, totals struct<peers:bigint,planned:bigint,skipped:bigint,error:bigint,to_fetch:bigint,requests:bigint>, peers array<struct<o_orderkey:bigint,status:string,line:string>>").json(path)
    weighted = F.aggregate(F.zip_with("peers", F.sequence(F.lit(1), F.size("peers")), lambda p, k: p["o_orderkey"] * k), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return read.select("list", "totals.planned", "totals.error", F.size("peers").cast("bigint").alias("n_rows"), "totals.to_fetch", "totals.requests", weighted.alias("order_sum"))


@query("qry10_admin_stats", views="projects log_events", sql="""
    SELECT 'status' AS section, status AS name, count(*) AS n FROM projects GROUP BY status UNION ALL
    SELECT 'recent', stage, event_id FROM (SELECT stage, event_id FROM log_events ORDER BY created_at DESC, event_id DESC LIMIT 20) UNION ALL
    SELECT 'totals', 'navigations', CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) FROM events""")
def qry10(t):
    counts = activity.status_counts(t.projects).select(F.lit("status").alias("section"), c("status").alias("name"), "n")
    newest = activity.recent(t.log_events, "created_at", "event_id", 20).select(F.lit("recent").alias("section"), c("stage").alias("name"), c("event_id").alias("n"))
    totals = activity.run_totals(t.select(_RUN_SRC, "events"), ["navigations"]).select(F.lit("totals").alias("section"), F.lit("navigations").alias("name"), c("navigations").alias("n"))
    return counts.unionByName(newest).unionByName(totals)
