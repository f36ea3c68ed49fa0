"""Queries for the scalar operators (SCL)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import fixed_values as fv
from tidemark.functions import amounts as am, classify as cl, documents as docs, ids, periods as pd_, text as tx
from tidemark.registry import query

c = F.col


def _values(rows: list[tuple], names: str) -> str:
    """A VALUES list for a check, from the fixed dictionaries."""
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS d({names})"


RULES_SQL = _values(fv.CATEGORY_RULES, "category, weight, is_event, why")
ALIASES_SQL = _values([(el, k, u, r) for k, _, u, els in fv.METRICS for r, el in enumerate(els)],
                      "element, key, metric_unit, alias_rank")
METRICS_SQL = _values([(k, d, u, i, fv.METRIC_RANK.index(k) if k in fv.METRIC_RANK else 5,
                        "income" if k in fv.INCOME_KEYS else "balance" if k in fv.BALANCE_KEYS else "cashFlow")
                       for i, (k, d, u, _) in enumerate(fv.METRICS)],
                      "key, display, metric_unit, metric_no, metric_rank, statement")
FORMAT_SQL = ("CASE WHEN {u} = 'USD/share' THEN '$' || printf('%.2f', {v}) ELSE CASE WHEN {v} < 0 THEN '-' ELSE '' END || "
              "CASE WHEN abs({v}) >= 1e9 THEN '$' || printf('%.1f', abs({v}) / 1e9) || 'B' "
              "WHEN abs({v}) >= 1e6 THEN '$' || printf('%.1f', abs({v}) / 1e6) || 'M' "
              "WHEN abs({v}) >= 1e3 THEN '$' || printf('%.1f', abs({v}) / 1e3) || 'K' "
              "ELSE '$' || printf('%.0f', abs({v})) END END")


def format_sql(v: str, u: str) -> str:
    return FORMAT_SQL.format(v=v, u=u)


@query("scl01_normalize_cik", src="""
    SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'CIK' || CAST(c_custkey AS STRING)
        WHEN 1 THEN '  cik000' || CAST(c_custkey AS STRING) || ' ' WHEN 2 THEN CAST(c_custkey AS STRING)
        WHEN 3 THEN c_name WHEN 4 THEN '12345678901' WHEN 5 THEN 'cik' ELSE 'Cik ' || CAST(c_custkey AS STRING) END AS raw
    FROM customer""", sql="""
    SELECT c_custkey, CASE WHEN regexp_full_match(bare, '[0-9]{1,10}') THEN lpad(bare, 10, '0') END AS cik
    FROM (SELECT c_custkey, trim(CASE WHEN length(trim(raw)) > 3 AND lower(substr(trim(raw), 1, 3)) = 'cik'
          THEN substr(trim(raw), 4) ELSE trim(raw) END) AS bare FROM src)""")
def scl01(t, src):
    return src.select("c_custkey", ids.normalize_cik(c("raw")).alias("cik"))


@query("scl02_strip_zeros", src="SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 10, '0') AS cik FROM customer",
       sql="SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS short_cik FROM customer")
def scl02(t, src):
    return src.select("c_custkey", ids.strip_zeros(c("cik")).alias("short_cik"))


@query("scl03_identity", src="""
    SELECT cik, name, ticker_a, ticker_b, former_a, CASE WHEN cik_no % 3 = 0 THEN '' ELSE 'City ' || CAST(nation_no AS STRING) END AS biz_city,
      CASE WHEN cik_no % 6 < 2 THEN '' ELSE 'Country ' || CAST(nation_no AS STRING) END AS biz_country,
      CASE WHEN cik_no % 5 = 0 THEN '' ELSE 'Mail ' || CAST(nation_no AS STRING) END AS mail_city, '' AS mail_country
    FROM companies""", views="companies", sql="""
    SELECT cik, name, CASE WHEN biz_city = '' AND biz_country = '' THEN nullif(mail_city, '') ELSE biz_city END AS hq_city,
      CASE WHEN biz_city = '' AND biz_country = '' THEN CASE WHEN mail_city = '' THEN NULL ELSE mail_country END ELSE biz_country END AS hq_country,
      CAST(CASE WHEN former_a = '' THEN 0 ELSE 1 END AS INTEGER) AS n_former FROM src""")
def scl03(t, src):
    from tidemark.operators.filings import identity
    shaped = src.select(
        "cik", "name", F.array("ticker_a", "ticker_b").alias("tickers"),
        F.array(F.struct(c("former_a").alias("name")), F.struct(F.lit("").alias("name"))).alias("formerNames"),
        F.struct(F.struct(c("biz_city").alias("city"), c("biz_country").alias("stateOrCountryDescription")).alias("business"),
                 F.struct(c("mail_city").alias("city"), c("mail_country").alias("stateOrCountryDescription")).alias("mailing"),
                 ).alias("addresses"))
    return identity(shaped).select("cik", "name", c("hq.city").alias("hq_city"), c("hq.country").alias("hq_country"),
                                   F.size("former_names").alias("n_former"))


_AMOUNT_SRC = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 5 THEN 'USD/share' ELSE 'USD' END AS unit,
    (CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice * 31007.0 WHEN 1 THEN l_extendedprice * 97.0
     WHEN 2 THEN l_extendedprice / 128.0 ELSE l_extendedprice * 1.0 END)
    * (CASE WHEN l_partkey % 3 = 0 THEN -1.0 ELSE 1.0 END) AS v FROM lineitem"""


@query("scl04_format_value", src=_AMOUNT_SRC,
       sql=f"SELECT l_orderkey, l_linenumber, l_partkey, {format_sql('v', 'unit')} AS shown FROM src")
def scl04(t, src):
    return src.select("l_orderkey", "l_linenumber", "l_partkey", am.format_value(c("v"), c("unit")).alias("shown"))


@query("scl05_parse_amount", src="""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7
      WHEN 0 THEN '$ ' || CAST(l_partkey AS STRING) || ',125' WHEN 1 THEN '(' || CAST(l_partkey AS STRING) || '.25)'
      WHEN 2 THEN '—' WHEN 3 THEN '-' WHEN 4 THEN CAST(l_partkey AS STRING) || '.5' WHEN 5 THEN 'n/a'
      ELSE '$(' || CAST(l_partkey AS STRING) || ')' END AS cell FROM lineitem""", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE l_linenumber % 7 WHEN 0 THEN l_partkey * 1000 + 125
      WHEN 1 THEN -(l_partkey + 0.25) WHEN 4 THEN l_partkey + 0.5 WHEN 6 THEN -l_partkey END AS DOUBLE) AS amount FROM src""")
def scl05(t, src):
    return src.select("l_orderkey", "l_linenumber", "l_partkey", am.parse_amount(c("cell")).alias("amount"))


@query("scl06_parse_shorthand", src="""
    SELECT l_orderkey, l_linenumber, l_partkey, 'about $' || CAST(l_partkey AS STRING) || '.5' ||
      CASE l_linenumber % 5 WHEN 0 THEN 'B' WHEN 1 THEN ' m' WHEN 2 THEN 'K total' WHEN 3 THEN '' ELSE ' units' END AS txt
    FROM lineitem""", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_partkey + 0.5) * (CASE l_linenumber % 5 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6
      WHEN 2 THEN 1e3 ELSE 1 END) AS DOUBLE) AS amount FROM src""")
def scl06(t, src):
    return src.select("l_orderkey", "l_linenumber", "l_partkey", am.parse_shorthand(c("txt")).alias("amount"))


@query("scl07_member_name", src="""
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'abc:' ELSE '' END || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))
      || upper(substr(p_name, 1, 1)) || 'xProductsMember' AS member FROM part""", sql="""
    SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' ' || upper(substr(p_name, 1, 1)) || 'x Products' AS shown
    FROM part""")
def scl07(t, src):
    return src.select("p_partkey", tx.member_name(c("member")).alias("shown"))


@query("scl08_signed_percent", src="SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice - 30000.0) / 512.0 AS v FROM lineitem",
       sql="""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v < 0 THEN '-' ELSE '+' END || printf('%.1f', abs(v)) || '%' AS shown FROM src""")
def scl08(t, src):
    return src.select("l_orderkey", "l_linenumber", "l_partkey", am.signed_percent(c("v")).alias("shown"))


@query("scl09_period_label", src="""SELECT accession, fy, CASE WHEN part_no % 9 = 0 THEN 'H1' WHEN part_no % 9 = 1 THEN lower(fp) ELSE fp END AS focus,
      back, line_no, part_no, supp_no FROM fact_spans""", views="fact_spans", sql="""
    SELECT accession, back, line_no, part_no, supp_no, CASE WHEN upper(focus) = 'FY' THEN 'FY ' || fy WHEN upper(substr(focus, 1, 1)) = 'Q' THEN upper(focus) || ' ' || fy
        ELSE focus || ' ' || fy END AS label, CASE WHEN upper(focus) = 'FY' THEN 'P1Y' ELSE 'P3M' END AS duration FROM src""")
def scl09(t, src):
    p = pd_.period_of(c("focus"), c("fy"))
    return src.select("accession", "back", "line_no", "part_no", "supp_no", p["label"].alias("label"), p["duration"].alias("duration"))


@query("scl10_concept_metric", views="facts", sql=f"""
    SELECT f.accession, f.concept, d.key, CAST(d.alias_rank AS INTEGER) AS alias_rank, CAST(count(*) AS BIGINT) AS n
    FROM facts f JOIN {ALIASES_SQL} ON d.element = f.namespace || ':' || f.concept GROUP BY ALL""")
def scl10(t):
    from tidemark.operators.facts import with_metric
    return with_metric(t.facts).groupBy("accession", "concept", "key", "alias_rank").agg(F.count("*").alias("n"))


@query("scl11_unit_meaning", src="""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'iso4217:usd' WHEN 1 THEN 'iso4217:ILS' ELSE 'iso4217:USD' END AS measure,
      CASE WHEN l_linenumber >= 5 THEN CASE WHEN l_partkey % 2 = 0 THEN 'xbrli:Shares' ELSE 'xbrli:pure' END END AS denominator FROM lineitem""", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 1 THEN 'other' WHEN denominator IS NULL THEN 'usd'
      WHEN denominator = 'xbrli:Shares' THEN 'usd_per_share' ELSE 'other' END AS kind FROM src""")
def scl11(t, src):
    from tidemark.operators.facts import unit_kind
    none = F.array().cast("array<string>")
    divided = c("denominator").isNotNull()
    return src.select("l_orderkey", "l_linenumber", "l_partkey",
                      unit_kind(F.when(divided, none).otherwise(F.array("measure")),
                                F.when(divided, F.array("measure")).otherwise(none),
                                F.when(divided, F.array("denominator")).otherwise(none), divided).alias("kind"))


@query("scl12_duration_band", views="facts", sql="""
    SELECT days, band, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(coalesce(date_diff('day', start_date, end_date), -1) AS INTEGER) AS days,
      CASE WHEN start_date IS NULL THEN 'instant' WHEN date_diff('day', start_date, end_date) BETWEEN 80 AND 100 THEN 'P3M'
        WHEN date_diff('day', start_date, end_date) BETWEEN 350 AND 380 THEN 'P1Y' ELSE 'none' END AS band FROM facts) GROUP BY ALL""")
def scl12(t):
    days = pd_.span_days(c("start_date"), c("end_date"))
    band = (F.when(days == -1, F.lit("instant")).when(pd_.in_band(days, F.lit("P3M")), F.lit("P3M"))
            .when(pd_.in_band(days, F.lit("P1Y")), F.lit("P1Y")).otherwise(F.lit("none")))
    return t.facts.select(days.alias("days"), band.alias("band")).groupBy("days", "band").agg(F.count("*").alias("n"))


_FYE_SRC = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1231' WHEN 1 THEN '0630' WHEN 2 THEN '0930' WHEN 3 THEN '0231'
      WHEN 4 THEN '1340' ELSE '12' END AS fye, CAST(year(o_orderdate) AS INT) AS fy,
    CASE o_orderkey % 7 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q1' WHEN 2 THEN 'q2' WHEN 3 THEN ' Q3' WHEN 4 THEN 'Q4' WHEN 5 THEN 'H1' ELSE 'Q1' END AS fp
    FROM orders"""
PERIOD_END_SQL = """
    (SELECT *, make_date(fy, CAST(substr(fye, 1, 2) AS INT), 1) + (CAST(substr(fye, 3, 2) AS INT) - 1) AS year_end,
       upper(trim(fp)) AS code FROM {src} WHERE fye IN ('1231', '0630', '0930', '0231') AND upper(trim(fp)) IN ('FY', 'Q1', 'Q2', 'Q3', 'Q4'))"""


@query("scl13_period_end", src=_FYE_SRC, sql=f"""
    SELECT s.o_orderkey, strftime(CAST(date_trunc('month', p.year_end) - CASE p.code WHEN 'Q3' THEN 3 WHEN 'Q2' THEN 6 WHEN 'Q1' THEN 9 ELSE 0 END * INTERVAL 1 MONTH AS DATE)
        + (CAST(day(p.year_end) AS INT) - 1), '%Y-%m-%d') AS period_end,
      CASE p.code WHEN 'FY' THEN 'P1Y' WHEN NULL THEN NULL ELSE CASE WHEN p.code IS NOT NULL THEN 'P3M' END END AS duration
    FROM src s LEFT JOIN {PERIOD_END_SQL.format(src='src')} p ON s.o_orderkey = p.o_orderkey""")
def scl13(t, src):
    p = pd_.derive_period_end(c("fye"), c("fy"), c("fp"))
    return src.select("o_orderkey", p["period_end"].cast("string").alias("period_end"), p["duration"].alias("duration"))


@query("scl14_quarter_label", src="SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber - 1 AS q FROM lineitem",
       sql="SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN q BETWEEN 1 AND 4 THEN 'Q' || q END AS label FROM src")
def scl14(t, src):
    return src.select("l_orderkey", "l_partkey", "l_linenumber", pd_.quarter_label(c("q")).alias("label"))


@query("scl15_category_rules", views="filings", sql=f"""
    SELECT f.accession, coalesce(d.weight, 'minor') AS weight, coalesce(d.is_event, false) AS is_event, coalesce(d.why, '') AS why
    FROM filings f LEFT JOIN {RULES_SQL} ON f.category = d.category""")
def scl15(t):
    k = c("category")
    return t.filings.select("accession", cl.weight_of(k).alias("weight"), cl.is_event(k).alias("is_event"),
                            cl.why_it_matters(k).alias("why"))


@query("scl16_status_steps", views="projects", sql=f"""
    SELECT p.project_id, coalesce(d.label, replace(p.status, '_', ' ')) AS label, CAST(coalesce(d.pct, 5) AS INTEGER) AS pct
    FROM projects p LEFT JOIN {_values(fv.STATUS_STEPS, 'status, label, pct')} ON p.status = d.status""")
def scl16(t):
    return t.projects.select("project_id", cl.status_label(c("status")).alias("label"), cl.status_percent(c("status")).alias("pct"))


@query("scl17_weighted_progress", src="""SELECT event_id, CAST(event_id % 60 AS INT) AS base, CAST(user_id % 70 AS INT) AS span,
      CAST(event_id % 13 AS INT) AS done, CAST(user_id % 12 AS INT) AS total FROM events""", sql="""
    SELECT event_id, CAST(CASE WHEN total <= 0 THEN base ELSE greatest(0, least(100, base + (span * done) // total)) END AS BIGINT) AS pct FROM src""")
def scl17(t, src):
    from tidemark.operators.activity import weighted_progress
    return src.select("event_id", weighted_progress(c("base"), c("span"), c("done"), c("total")).alias("pct"))


_BODY_SRC = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '20-F' WHEN 1 THEN 'SCHEDULE 13G/A' WHEN 2 THEN '3' WHEN 3 THEN '4'
      WHEN 4 THEN '8-K' ELSE '6-k' END AS form,
    CASE o_orderkey % 11 WHEN 0 THEN 'Reports Financial Results' WHEN 1 THEN 'Company to Announce Financial Results' WHEN 2 THEN 'Annual Guidance'
      WHEN 3 THEN 'Dividend notice' WHEN 4 THEN 'Annual General Meeting' WHEN 5 THEN 'FDA approval' WHEN 6 THEN 'Supply Agreement'
      WHEN 7 THEN 'Investor deck' WHEN 8 THEN '' WHEN 9 THEN 'Revenue guidance of $5' ELSE 'Notice' END AS title,
    CASE o_orderkey % 13 WHEN 0 THEN 'payment date has been changed' WHEN 1 THEN 'will announce soon' WHEN 2 THEN 'withholding tax'
      ELSE 'nothing else' END AS body, o_orderkey % 17 = 0 AS is_xbrl FROM orders"""


@query("scl18_classify", src=_BODY_SRC, sql="""
    WITH x AS (SELECT *, replace(upper(form), 'SCHEDULE ', '') AS kind, lower(title) || ' ' || body AS txt FROM src),
    y AS (SELECT *, CASE
        WHEN is_xbrl AND (contains(txt, 'to announce') OR contains(txt, 'will announce')) THEN '3|earnings_preview|'
        WHEN is_xbrl OR (contains(txt, 'financial results') AND NOT contains(txt, 'announce')) THEN '1|quarterly_results|financials'
        WHEN contains(txt, 'financial results') AND contains(txt, 'to announce') THEN '3|earnings_preview|financials'
        WHEN contains(txt, 'guidance') AND (contains(txt, 'annual guidance') OR contains(txt, 'guidance of $') OR contains(txt, 'revenue') OR contains(txt, 'ebitda')) AND NOT contains(txt, 'reports') THEN '1|annual_guidance|guidance'
        WHEN contains(txt, 'dividend') AND (contains(txt, 'withholding tax') OR contains(txt, 'payment date has been changed')) AND contains(txt, 'changed') THEN '2|admin_update|dividend'
        WHEN contains(txt, 'dividend') THEN '2|corporate_action|dividend'
        WHEN contains(txt, 'annual general meeting') OR contains(txt, 'proxy statement') OR contains(txt, 'agm') THEN '2|governance|governance'
        WHEN contains(txt, 'fda approval') OR contains(txt, 'fda approved') THEN '1|regulatory_clinical|regulatory'
        WHEN contains(txt, 'agreement') OR contains(txt, 'supply') OR contains(txt, 'merger') THEN '1|business_deal|business'
        WHEN contains(txt, 'investor') OR contains(txt, 'deck') OR contains(txt, 'conference') THEN '3|investor_relations|'
        ELSE '2|current_report|' END AS by_text FROM x)
    SELECT o_orderkey, CASE kind WHEN '20-F' THEN '1|annual_report|financials,' || CASE WHEN is_xbrl THEN 'xbrl' ELSE 'annual' END
      WHEN '13G/A' THEN '4|ownership_disclosure|ownership' WHEN '3' THEN '3|insider_initial|insider' WHEN '4' THEN '3|insider_trade|insider'
      WHEN '6-K' THEN by_text ELSE '3|unknown|' END AS outcome FROM y""")
def scl18(t, src):
    titles = F.when(c("title") == "", F.array().cast("array<string>")).otherwise(F.array("title"))
    r = cl.classify_filing(c("form"), titles, c("body"), c("is_xbrl"))
    return src.select("o_orderkey", r.alias("r")).select(
        "o_orderkey", F.concat_ws("|", c("r.tier").cast("string"), c("r.category"), F.array_join("r.tags", ",")).alias("outcome"))


@query("scl19_summary", src="""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '20-F' WHEN 1 THEN '13G' WHEN 2 THEN '3' WHEN 3 THEN '4' ELSE '6-K' END AS form,
      CASE o_orderkey % 5 WHEN 0 THEN 'quarterly_results' WHEN 1 THEN 'governance' ELSE 'admin_update' END AS category,
      CASE WHEN o_orderkey % 4 = 0 THEN 'Notice of ' || CAST(o_orderkey AS STRING) ELSE '' END AS title_a,
      CASE WHEN o_orderkey % 8 = 0 THEN 'Q Financial Results' ELSE '' END AS title_b,
      CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Owner ' || CAST(o_custkey AS STRING) END AS person,
      CASE WHEN o_orderkey % 2 = 0 THEN 'CFO' ELSE '' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE '' END AS code,
      CASE WHEN o_orderkey % 7 = 0 THEN 'shareholders approved it' ELSE 'payment date has been changed' END AS body FROM orders""", sql="""
    SELECT o_orderkey, CASE WHEN title_a <> '' AND title_b <> '' AND category = 'quarterly_results' THEN title_b WHEN title_a <> '' THEN title_a WHEN title_b <> '' THEN title_b
      WHEN form = '3' AND person <> '' THEN 'Initial insider ownership report: ' || person || ' (' || CASE WHEN title = '' THEN 'insider' ELSE title END || ')'
      WHEN form = '4' AND person <> '' THEN 'Insider transaction: ' || person || ' (' || CASE WHEN title = '' THEN 'insider' ELSE title END || ') — code ' || CASE WHEN code = '' THEN '?' ELSE code END || ', ? shares'
      WHEN form = '20-F' THEN 'Annual report with audited financials and MD&A'
      WHEN form = '13G' THEN 'Large shareholder ownership update' || CASE WHEN person = '' THEN '' ELSE ': ' || person END
      WHEN category = 'governance' AND contains(body, 'shareholders approved') THEN 'Annual general meeting results — shareholder proposals approved'
      WHEN category = 'admin_update' AND contains(body, 'payment date has been changed') THEN 'Dividend payment date change' ELSE form END AS summary FROM src""")
def scl19(t, src):
    owner = F.struct("person", "title", c("code").alias("transaction_code"), F.lit(None).cast("string").alias("shares"))
    titles = F.filter(F.array("title_a", "title_b"), lambda x: x != "")
    return src.select("o_orderkey", cl.filing_summary(c("form"), c("category"), titles, c("body"), owner).alias("summary"))


@query("scl20_growth_headline", views="filings", sql=r"""
    SELECT accession, CASE filing_no % 5 WHEN 0 THEN 'Growth' WHEN 1 THEN 'Decline' WHEN 4 THEN 'Growth' END AS label,
      CASE filing_no % 5 WHEN 0 THEN regexp_extract(summary, '([0-9]+)%', 1) || '%' WHEN 1 THEN regexp_extract(summary, '([0-9]+)%', 1) || '%'
        WHEN 4 THEN regexp_extract(summary, '([0-9]+)%', 1) || '%' END AS value FROM filings""")
def scl20(t):
    h = tx.growth_highlight(c("summary"))
    return t.filings.select("accession", h["label"].alias("label"), h["value"].alias("value"))


@query("scl22_report_period", src="""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Q2 ' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) END AS label,
      'P3M' AS duration, CAST(CAST(o_orderdate AS DATE) AS STRING) AS end_date, 'Q2' AS focus FROM orders""", sql="""
    SELECT o_orderkey, CASE WHEN label <> '' THEN label || '/' || duration || '/' || end_date || '/' || focus END AS period FROM src""")
def scl22(t, src):
    from tidemark.operators.timeline import report_period
    p = report_period(c("label"), c("duration"), c("end_date"), c("focus"))
    return src.select("o_orderkey", F.when(p.isNotNull(), F.concat_ws("/", p["label"], p["duration"], p["end_date"], p["focus"])).alias("period"))


@query("scl23_redact", src="""SELECT page_id, url || '&api_key=k' || CAST(page_id AS STRING) || '&b=1 header Bearer tok' || CAST(page_id AS STRING) || ' or basic QUJD= end' AS txt FROM pages""", sql=r"""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(txt, '(?i)([?&](?:key|api_key|apikey|access_token|token|secret|password|passwd)=)[^&\s"'']+', '\1[REDACTED]', 'g'),
      '(?i)\bBearer\s+[^\s"'']+', 'Bearer [REDACTED]', 'g'), '(?i)\bBasic\s+[A-Za-z0-9+/=]+', 'Basic [REDACTED]', 'g') AS clean FROM src""")
def scl23(t, src):
    return src.select("page_id", tx.redact_secrets(c("txt")).alias("clean"))


@query("scl24_text_shape", src=r"""SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN '  ```json' || chr(10) || text || chr(10) || '``` ' ELSE ' ' || text || ' ' END AS fenced FROM conversations""", sql=r"""
    SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS squeezed,
      CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '^\s+', '') || chr(10) ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS body FROM src""")
def scl24(t, src):
    return src.select("conv_id", "turn", tx.squeeze_spaces(c("text")).alias("squeezed"), tx.strip_fence(c("fenced")).alias("body"))


@query("scl25_slug", src="SELECT p_partkey, ' --' || p_name || ' / ' || p_brand || '!! ' AS name FROM part", sql="""
    SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 1, 64) AS slug,
      substr(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63) AS dash_slug FROM src""")
def scl25(t, src):
    return src.select("p_partkey", tx.slug(c("name")).alias("slug"), tx.dash_slug(c("name")).alias("dash_slug"))


@query("scl26_field_name", src="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '_id' WHEN 1 THEN upper(event_type) || ' Date' WHEN 2 THEN '!!' ELSE ' ' || event_type END AS name FROM events""", sql="""
    SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'field_' || (event_id % 9 + 1) WHEN 1 THEN lower(replace(name, ' ', '_')) ELSE trim(name) END AS field FROM src""")
def scl26(t, src):
    return src.select("event_id", tx.clean_field_name(c("name"), c("event_id") % 9 + 1).alias("field"))


_SIM_SQL = """(lower(trim({a})) = lower(trim({b})) OR translate(lower(trim({a})), ' _-', '') = translate(lower(trim({b})), ' _-', '')
  OR contains(lower(trim({a})), lower(trim({b}))) OR contains(lower(trim({b})), lower(trim({a})))
  OR (length(translate(lower(trim({a})), ' _-', '')) >= 4 AND length(translate(lower(trim({b})), ' _-', '')) >= 4 AND
      substr(translate(lower(trim({a})), ' _-', ''), 1, least(greatest(least(length(translate(lower(trim({a})), ' _-', '')), length(translate(lower(trim({b})), ' _-', ''))) - 2, 6), least(length(translate(lower(trim({a})), ' _-', '')), length(translate(lower(trim({b})), ' _-', '')))))
    = substr(translate(lower(trim({b})), ' _-', ''), 1, least(greatest(least(length(translate(lower(trim({a})), ' _-', '')), length(translate(lower(trim({b})), ' _-', ''))) - 2, 6), least(length(translate(lower(trim({a})), ' _-', '')), length(translate(lower(trim({b})), ' _-', '')))))))"""


def similar_sql(a: str, b: str) -> str:
    return _SIM_SQL.format(a=a, b=b)


@query("scl27_name_similarity", src="""SELECT event_id, found_name AS a, CASE event_id % 6 WHEN 0 THEN 'Invoice-Number' WHEN 1 THEN 'vendor_names' WHEN 2 THEN 'totalamount_usd'
      WHEN 3 THEN 'due' WHEN 4 THEN 'currencies' ELSE 'PO Number' END AS b FROM (SELECT doc_no AS event_id, found_name FROM doc_fields) AS d""", views="doc_fields",
       sql=f"SELECT event_id, {similar_sql('a', 'b')} AS similar FROM src")
def scl27(t, src):
    return src.select("event_id", tx.names_similar(c("a"), c("b")).alias("similar"))


@query("scl28_hashes", src="SELECT doc_id, text, source || '/My file (' || CAST(doc_id AS STRING) || ').txt' AS name, 'http://x.example/' || CAST(doc_id AS STRING) AS url FROM documents", sql="""
    SELECT doc_id, sha256(text) AS content_hash, '17_' || substr(sha256(url), 1, 8) || '_My_file_' || doc_id || '_.txt' AS file_name FROM src""")
def scl28(t, src):
    return src.select("doc_id", F.sha2("text", 256).alias("content_hash"), tx.safe_file_name(c("name"), c("url"), F.lit(17)).alias("file_name"))


@query("scl29_downgrade", views="schema_fields", sql="""
    SELECT type_id, version, name, CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END AS confidence FROM schema_fields""")
def scl29(t):
    return t.schema_fields.select("type_id", "version", "name", tx.downgrade(c("confidence")).alias("confidence"))


_DOC_SRC = """SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'application/msword' WHEN 3 THEN 'text/plain'
      WHEN 4 THEN 'application/vnd.ms-excel' ELSE 'application/pdf' END AS mime, n_chars * 400 AS size, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS chars,
    doc_id % 6 = 1 AS has_text, CASE WHEN doc_id % 5 < 4 THEN CAST(doc_id % 5 AS INT) END AS passes FROM documents"""
_TOKENS_SQL = """(SELECT doc_id, source, mime, size, chars, (mime LIKE 'image/%' OR (mime = 'application/pdf' AND NOT has_text)) AS img, has_text,
     CAST(greatest(1, coalesce(passes, 1)) * (1000 + CASE WHEN mime LIKE 'image/%' THEN 1000 WHEN mime = 'application/pdf' AND NOT has_text THEN 5000 ELSE (CASE WHEN chars = 0 THEN size ELSE chars END) // 4 END) AS BIGINT) AS tokens FROM src)"""


@query("scl30_strategy", src=_DOC_SRC, sql=f"""
    SELECT doc_id, img AS convert_to_image, (mime = 'application/pdf' AND NOT has_text) AS use_ocr,
      CASE WHEN img AND size > 2097152 THEN 'premium' WHEN img THEN 'standard' ELSE 'budget' END AS cost_tier, tokens,
      tokens > CASE WHEN img AND size > 2097152 THEN 128000 WHEN img THEN 16000 ELSE 4000 END AS over_limit FROM {_TOKENS_SQL}""")
def scl30(t, src):
    s = docs.strategy(c("mime"), c("size"), c("has_text"))
    tokens = docs.token_estimate(c("mime"), c("size"), c("chars"), c("has_text"), c("passes"))
    return src.select("doc_id", s["convert_to_image"].alias("convert_to_image"), s["use_ocr"].alias("use_ocr"), s["cost_tier"].alias("cost_tier"),
                      tokens.alias("tokens"), docs.over_limit(tokens, s["cost_tier"]).alias("over_limit"))


@query("scl31_recommendation", src="SELECT event_id, (event_id % 101) / 100.0 AS score FROM events", sql="""
    SELECT event_id, CASE WHEN score < 0.4 THEN 'needs_more_samples' WHEN score < 0.7 THEN 'continue_with_more_samples' WHEN score < 0.9 THEN 'ready_for_review' ELSE 'ready_for_production' END AS advice FROM src""")
def scl31(t, src):
    return src.select("event_id", docs.recommendation(c("score")).alias("advice"))


@query("scl32_human_text", src="SELECT doc_id, n_chars * n_chars * 1000 AS n, n_chars % 4000 AS sec FROM documents", sql="""
    SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.0f MB', n / 1048576.0::DOUBLE) END AS bytes,
      CASE WHEN sec >= 60 THEN ((sec + 30) // 60) || ' min' ELSE sec || 's' END AS took,
      CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9::DOUBLE) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6::DOUBLE) WHEN n >= 1e3 THEN CAST(floor(n / 1e3 + 0.5) AS BIGINT) || 'K' ELSE n || '' END AS volume,
      '$' || CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9::DOUBLE) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6::DOUBLE) WHEN n >= 1e3 THEN CAST(floor(n / 1e3 + 0.5) AS BIGINT) || 'K' ELSE n || '' END AS money FROM src""")
def scl32(t, src):
    return src.select("doc_id", am.human_bytes(c("n")).alias("bytes"), am.human_duration(c("sec")).alias("took"),
                      am.short_volume(c("n")).alias("volume"), am.short_money(c("n")).alias("money"))


@query("scl33_archive_url", src="""SELECT o_orderkey, lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, lpad(CAST(o_custkey AS STRING), 10, '0') || '-24-' || lpad(CAST(o_orderkey AS STRING), 6, '0') AS accession FROM orders""",
       sql="""SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS BIGINT) || '/' || replace(accession, '-', '') AS url FROM src""")
def scl33(t, src):
    return src.select("o_orderkey", ids.archive_url(c("cik"), c("accession")).alias("url"))


@query("scl34_call_info", views="log_events", sql="""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'model-' || k ELSE 'm' || k END AS model,
      CAST(CASE WHEN event_id % 3 <> 0 THEN k * 10 END AS BIGINT) AS total_prompt_chars FROM log_events""")
def scl34(t):
    from tidemark.operators.activity import call_info
    info = F.to_json(F.struct(F.concat(F.lit("m"), c("k")).alias("model"), (c("k") * 10).alias("total_prompt_chars")))
    snippet = F.when(c("event_id") % 3 == 0, F.concat(F.lit("model-"), c("k"))).otherwise(info)
    r = call_info(snippet)
    return t.log_events.select("event_id", r["model"].alias("model"), r["total_prompt_chars"].alias("total_prompt_chars"))


@query("scl35_lenient_json", src="SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Here: ' || props || ' done' WHEN 2 THEN 'no json' ELSE substr(props, 1, 4) END AS txt FROM events",
       sql="SELECT event_id, CASE WHEN event_id % 4 < 2 THEN props END AS found FROM src")
def scl35(t, src):
    return src.select("event_id", tx.lenient_json(c("txt")).alias("found"))


@query("scl36_primary_ticker", views="companies", sql="SELECT cik, CASE WHEN cik_no % 10 = 0 THEN '' ELSE ticker_a END AS ticker FROM companies")
def scl36(t):
    tickers = F.when(c("cik_no") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("ticker_a", "ticker_b"))
    return t.companies.select("cik", ids.primary_ticker(tickers).alias("ticker"))


@query("scl37_fiscal_year", src="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Q3 20' || lpad(CAST(o_orderkey % 30 AS STRING), 2, '0') WHEN 1 THEN 'FY 1999' WHEN 2 THEN 'q4 2011' ELSE '' END AS label,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS end_date, make_date(2024, 5, 6) AS anchor FROM orders""", sql=r"""
    SELECT o_orderkey, coalesce(nullif(regexp_extract(label, '\b(20\d{2})\b', 1), ''), CAST(year(end_date) AS VARCHAR), CAST(year(anchor) AS VARCHAR)) AS fy, label ILIKE 'q4%' AS q4 FROM src""")
def scl37(t, src):
    return src.select("o_orderkey", pd_.fiscal_year_of(c("label"), c("end_date"), c("anchor")).alias("fy"),
                      pd_.is_q4(F.lit(None).cast("string"), c("label")).alias("q4"))


@query("scl38_exchange_date", src="SELECT event_id, CAST(1700000000 + event_id * 3571 AS BIGINT) AS epoch, CAST(CASE WHEN event_id % 2 = 0 THEN -18000 ELSE 32400 END AS BIGINT) AS off FROM events",
       sql="SELECT event_id, strftime(make_timestamp((epoch + off) * 1000000), '%Y-%m-%d') AS trade_date FROM src")
def scl38(t, src):
    return src.select("event_id", pd_.exchange_date(c("epoch"), c("off")).cast("string").alias("trade_date"))


@query("scl39_yoy_percent", src="SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v, CASE WHEN l_partkey % 5 = 0 THEN -l_quantity ELSE l_quantity * 1000.0 END AS p FROM lineitem",
       sql="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p > 0 THEN round((v / p - 1) * 1000) / 10 END AS yoy FROM src")
def scl39(t, src):
    return src.select("l_orderkey", "l_linenumber", "l_partkey", am.yoy_percent(c("v"), c("p")).alias("yoy"))


@query("scl40_adjusted_series", views="bars", sql="""
    SELECT cik, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN adj_close IS NOT NULL AND adj_close <> 0 THEN adj_close ELSE close END AS series, coalesce(volume, 0) AS volume FROM bars""")
def scl40(t):
    return t.bars.select("cik", c("trade_date").cast("string").alias("trade_date"), am.adjusted_or_raw(c("adj_close"), c("close")).alias("series"),
                         F.coalesce("volume", F.lit(0)).alias("volume"))


_WINDOW_SRC = """SELECT cik, min(filing_date) AS lo, max(filing_date) AS hi,
      CASE cik_no % 5 WHEN 0 THEN make_date(1996, 2, 29) WHEN 1 THEN make_date(2010, 1, 1) ELSE CAST(NULL AS DATE) END AS want_from,
      CASE cik_no % 3 WHEN 0 THEN make_date(2000, 2, 29) ELSE CAST(NULL AS DATE) END AS want_to FROM filings GROUP BY cik, cik_no"""


@query("scl41_clamp_window", src=_WINDOW_SRC, views="filings", sql="""
    WITH w AS (SELECT *, coalesce(want_to, hi) AS t FROM src), v AS (SELECT *, coalesce(want_from, make_date(year(t) - 2, month(t), 1) + (CAST(day(t) AS INT) - 1)) AS f FROM w),
    u AS (SELECT *, (f <= t AND greatest(f, lo) <= least(t, hi)) AS ok FROM v)
    SELECT cik, ok AS window_ok, CASE WHEN ok THEN CAST(greatest(f, lo) AS VARCHAR) END AS date_from, CASE WHEN ok THEN CAST(least(t, hi) AS VARCHAR) END AS date_to FROM u""")
def scl41(t, src):
    w = pd_.clamp_window(c("want_from"), c("want_to"), c("lo"), c("hi"))
    return src.select("cik", w.alias("w")).select("cik", c("w.window_ok").alias("window_ok"), c("w.from").cast("string").alias("date_from"),
                                                  c("w.to").cast("string").alias("date_to"))


@query("scl42_preset_range", src="SELECT cik, min(filing_date) AS lo, max(filing_date) AS hi FROM filings GROUP BY cik", views="filings", sql="""
    SELECT cik, CAST(greatest(lo, make_date(year(hi) - 1, month(hi), 1) + (CAST(day(hi) AS INT) - 1)) AS VARCHAR) AS one_year,
      CAST(greatest(lo, make_date(year(hi) - 5, month(hi), 1) + (CAST(day(hi) AS INT) - 1)) AS VARCHAR) AS five_years FROM src""")
def scl42(t, src):
    return src.select("cik", pd_.preset_start(c("hi"), 1, c("lo")).cast("string").alias("one_year"),
                      pd_.preset_start(c("hi"), 5, c("lo")).cast("string").alias("five_years"))


@query("scl43_normalize_estimate", src="""SELECT event_id, CASE user_id % 3 WHEN 0 THEN '1231' WHEN 1 THEN '0630' ELSE '' END AS fye, 2024 AS fiscal_year,
      CASE event_id % 5 WHEN 0 THEN 'FY' ELSE 'Q' || CAST(event_id % 5 AS STRING) END AS fiscal_period, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS STRING) ELSE '' END AS period_end,
      'P3M' AS duration, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS STRING) ELSE '' END AS consensus_date, CASE WHEN event_id % 4 = 0 THEN 'EUR' ELSE '' END AS currency FROM events""", sql="""
    WITH x AS (SELECT *, CASE WHEN fye = '' THEN NULL ELSE make_date(2024, CAST(substr(fye, 1, 2) AS INT), 1) - CASE fiscal_period WHEN 'Q3' THEN 3 WHEN 'Q2' THEN 6 WHEN 'Q1' THEN 9 ELSE 0 END * INTERVAL 1 MONTH + CAST(CAST(substr(fye, 3, 2) AS INT) - 1 AS INT) * INTERVAL 1 DAY END AS d FROM src),
    y AS (SELECT *, coalesce(strftime(d, '%Y-%m-%d'), nullif(period_end, '')) AS pe FROM x)
    SELECT event_id, pe AS period_end, CASE WHEN d IS NULL THEN 'P3M' WHEN fiscal_period = 'FY' THEN 'P1Y' ELSE 'P3M' END AS duration, coalesce(nullif(consensus_date, ''), pe) AS consensus_date,
      CASE WHEN currency = '' THEN 'USD' ELSE currency END AS currency FROM y""")
def scl43(t, src):
    from tidemark.operators.estimates import normalize_estimates
    return normalize_estimates(src).select("event_id", "period_end", "duration", "consensus_date", "currency")


@query("scl44_call_audit", src="SELECT conv_id, turn, role, text FROM conversations", sql="""
    SELECT conv_id, turn, '{"model":"m-' || role || '","provider":"p","system_chars":4,"user_chars":' || length(text) || ',"total_prompt_chars":' || (length(text) + 4) || ',"image_count":0}' AS audit FROM src""")
def scl44(t, src):
    from tidemark.operators.activity import call_audit
    return src.select("conv_id", "turn", call_audit(F.concat(F.lit("m-"), c("role")), F.lit("p"), F.lit("role"), c("text"), F.lit(0)).alias("audit"))


@query("scl46_mime_type", src="""SELECT doc_id, 'a.b/report' || CASE doc_id % 9 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.md' WHEN 3 THEN '.xlsx' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.csv' WHEN 7 THEN '.txt' ELSE '.json' END AS name,
      CASE WHEN doc_id % 5 = 0 THEN 'text/html; charset=utf-8' ELSE '' END AS declared FROM documents""", sql="""
    SELECT doc_id, CASE WHEN declared <> '' THEN 'text/html' ELSE CASE doc_id % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
      WHEN 6 THEN 'text/csv' WHEN 7 THEN 'text/plain' WHEN 8 THEN 'application/json' ELSE 'application/octet-stream' END END AS mime FROM src""")
def scl46(t, src):
    return src.select("doc_id", docs.mime_of(c("name"), c("declared")).alias("mime"))


@query("scl47_wall_time", src="""SELECT project_id, status, created_at AS uploaded, CASE WHEN status = 'complete' THEN created_at + INTERVAL 1 HOUR + INTERVAL 95 SECOND WHEN project_id % 9 = 0 THEN created_at + INTERVAL 40 SECOND END AS done,
      CAST('2024-02-01 00:00:00' AS TIMESTAMP) AS as_of FROM projects""", views="projects", sql="""
    WITH x AS (SELECT *, CASE WHEN done IS NOT NULL THEN CAST(floor(date_diff('microsecond', uploaded, done) / 1e6 + 0.5) AS BIGINT) WHEN status IN ('uploaded', 'converting', 'llm_pending', 'llm_done', 'post_processing') THEN CAST(floor(date_diff('microsecond', uploaded, as_of) / 1e6 + 0.5) AS BIGINT) END AS s FROM src)
    SELECT project_id, CASE WHEN s IS NULL THEN '—' ELSE CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' m ' || (s % 60) || ' s' ELSE (s // 3600) || ' h ' || ((s // 60) % 60) || ' m' END || CASE WHEN done IS NULL THEN ' …' ELSE '' END END AS took FROM x""")
def scl47(t, src):
    ts = lambda n: c(n).cast("timestamp")
    return src.select("project_id", pd_.wall_time(ts("uploaded"), ts("done"), c("status"), ts("as_of")).alias("took"))
