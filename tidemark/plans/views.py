"""Views that give the operators their inputs from the given tables.

Each view is one SQL text that both Spark and the checking engine run, so a query and its check
start from the same rows. Two tokens differ by engine: GENERATE(...) makes one row per listed
number and HASH256(x) is the SHA-256 hex digest. Views hold only projections, key joins and
grouped aggregates; all operator work is in ``tidemark.operators``.
"""

from __future__ import annotations

import re

_CATEGORY_CASE = """CASE o_orderkey % 16
    WHEN 0 THEN 'quarterly_results' WHEN 1 THEN 'business_deal' WHEN 2 THEN 'annual_report'
    WHEN 3 THEN 'regulatory_clinical' WHEN 4 THEN 'annual_guidance' WHEN 5 THEN 'corporate_action'
    WHEN 6 THEN 'current_report' WHEN 7 THEN 'governance' WHEN 8 THEN 'admin_update'
    WHEN 9 THEN 'earnings_preview' WHEN 10 THEN 'insider_trade' WHEN 11 THEN 'insider_initial'
    WHEN 12 THEN 'investor_relations' WHEN 13 THEN 'ownership_disclosure' WHEN 14 THEN 'press_note'
    ELSE '' END"""

_N = "((cik_no * 7919 + {m} * 104729 + CAST(year(end_date) * 12 + month(end_date) AS BIGINT) * 15485863) % 900000 + 100000)"

# name -> (text, tables or views it reads)
RAW_VIEWS: dict[str, tuple[str, list[str]]] = {}


def _view(name: str, text: str, *needs: str) -> None:
    RAW_VIEWS[name] = (text.strip(), list(needs))


# companies: one row per customer; two ticker columns stand for the ticker list
_view("companies", """
SELECT c_custkey AS cik_no, lpad(CAST(c_custkey AS STRING), 10, '0') AS cik,
       CASE WHEN c_custkey % 5 = 0 THEN upper(c_mktsegment) || ' Holdings ' || CAST(c_custkey AS STRING)
            ELSE c_name END AS name,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE substr(c_mktsegment, 1, 2) || CAST(c_custkey AS STRING) END AS ticker_a,
       CASE WHEN c_custkey % 3 = 0 THEN 'X' || CAST(c_custkey AS STRING) ELSE '' END AS ticker_b,
       CASE WHEN c_custkey % 4 = 0 THEN 'Old ' || c_mktsegment || ' Works' ELSE '' END AS former_a,
       c_mktsegment AS segment, c_nationkey AS nation_no,
       CASE c_custkey % 4 WHEN 0 THEN '1231' WHEN 1 THEN '0630' WHEN 2 THEN '0930' ELSE '' END AS fye
FROM customer
""", "customer")

# filings: one row per order
_view("filings", f"""
SELECT CAST(o_orderkey AS STRING) AS accession, o_orderkey AS filing_no, o_custkey AS cik_no,
       lpad(CAST(o_custkey AS STRING), 10, '0') AS cik,
       CAST(o_orderdate AS DATE) AS filing_date, CAST(year(o_orderdate) AS INT) AS year,
       CASE WHEN o_orderkey % 7 < 3 THEN '6-K' WHEN o_orderkey % 7 = 3 THEN '20-F'
            WHEN o_orderkey % 7 = 4 THEN '4' WHEN o_orderkey % 7 = 5 THEN '3' ELSE 'SC 13G/A' END AS form,
       {_CATEGORY_CASE} AS category,
       CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3
            WHEN '4' THEN 4 ELSE 0 END AS INT) AS tier,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MAJOR' WHEN '2' THEN 'MODERATE'
            WHEN '3' THEN 'MINOR' WHEN '4' THEN 'ROUTINE' ELSE '' END AS tier_label,
       o_orderkey % 4 = 0 AS has_financials,
       CASE o_orderkey % 5
            WHEN 0 THEN 'Quarter shows ' || CAST(o_orderkey % 90 AS STRING) || '% strong revenue growth over the year'
            WHEN 1 THEN 'A decrease of ' || CAST(o_orderkey % 40 AS STRING) || '% in sales'
            WHEN 2 THEN 'No change to report'
            WHEN 3 THEN ''
            ELSE 'Growth of ' || CAST(o_orderkey % 30 AS STRING) || '% and a 5% decrease in cost' END AS summary,
       o_totalprice AS amount
FROM orders
""", "orders")

# fact_lines: one row per line item of a filing, with the filing's own fiscal period
_view("fact_lines", """
SELECT o_custkey AS cik_no, lpad(CAST(o_custkey AS STRING), 10, '0') AS cik,
       CAST(o_orderkey AS STRING) AS accession, o_orderkey AS filing_no,
       CAST(o_orderdate AS DATE) AS filed,
       CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) - INTERVAL 1 DAY AS DATE) AS own_end,
       CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_no, l_suppkey AS supp_no,
       l_extendedprice AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""", "orders", "lineitem")

# fact_spans: each line reports its own period (0), the year before (1) and the year to date (2)
_view("fact_spans", """
SELECT cik_no, cik, accession, filing_no, filed, line_no, part_no, supp_no, back,
       CASE WHEN month(own_end) = 12 AND filing_no % 2 = 0 THEN 'FY'
            ELSE 'Q' || CAST(quarter(own_end) AS STRING) END AS fp,
       CAST(year(own_end) AS INT) AS fy,
       CASE WHEN line_no >= 6 AND back = 1 THEN make_date(year(own_end) - 1, 12, 31)
            WHEN back = 1 THEN make_date(year(own_end) - 1, month(own_end), day(own_end))
            ELSE own_end END AS end_date,
       own_end
FROM (SELECT *, GENERATE(0, 1, 2) AS back FROM fact_lines) AS g
""", "fact_lines")

# facts: Company-Facts shaped rows (namespace, concept, unit, start, end, val)
_view("facts", f"""
SELECT cik_no, cik, accession, filing_no, filed, fp, fy,
       CASE WHEN supp_no % 2 = 0 THEN 'ifrs-full' ELSE 'us-gaap' END AS namespace,
       CASE WHEN supp_no % 2 = 0 THEN
              CASE line_no WHEN 1 THEN 'Revenue' WHEN 2 THEN 'CostOfSales' WHEN 3 THEN 'GrossProfit'
                   WHEN 4 THEN 'ProfitLoss' WHEN 5 THEN 'BasicEarningsLossPerShare'
                   WHEN 6 THEN 'CashAndCashEquivalents' ELSE 'Assets' END
            ELSE
              CASE line_no WHEN 1 THEN 'Revenues' WHEN 2 THEN 'CostOfRevenue' WHEN 3 THEN 'GrossProfit'
                   WHEN 4 THEN 'NetIncomeLoss' WHEN 5 THEN 'EarningsPerShareBasic'
                   WHEN 6 THEN 'CashAndCashEquivalentsAtCarryingValue' ELSE 'OtherNotMapped' END
       END AS concept,
       CASE WHEN part_no % 41 = 0 THEN 'ILS' WHEN line_no = 5 THEN 'USD/shares' ELSE 'USD' END AS unit,
       CASE WHEN line_no >= 6 THEN CAST(NULL AS DATE)
            WHEN fp = 'FY' OR back = 2 THEN make_date(year(end_date), 1, 1)
            ELSE make_date(year(end_date), month(end_date) - 2, 1) END AS start_date,
       end_date,
       CASE WHEN line_no = 5 THEN ({_N.format(m=5)} % 500 - 100) / 100.0E0
            ELSE (CASE line_no WHEN 1 THEN {_N.format(m=1)} * 1000 WHEN 2 THEN {_N.format(m=1)} * 600
                       WHEN 3 THEN {_N.format(m=1)} * 400 + CASE WHEN part_no % 29 = 0 THEN 5000 ELSE 0 END
                       WHEN 4 THEN ({_N.format(m=4)} - 400000) * 100
                       WHEN 6 THEN {_N.format(m=6)} * 500 ELSE {_N.format(m=7)} * 5000 END)
                 * (CASE WHEN part_no % 37 = 0 THEN 1.25E0 ELSE 1.0E0 END)
                 / (CASE WHEN filing_no % 23 = 0 THEN 1000.0E0 ELSE 1.0E0 END) END AS val
FROM (SELECT cik_no, cik, accession, filing_no, filed, line_no, part_no, supp_no, back, fp, fy, end_date
      FROM fact_spans) AS s
""", "fact_spans")

# tagged_lines: XBRL-shaped rows of one filing: a context, a unit, decimals and maybe one dimension
_view("tagged_lines", f"""
SELECT accession, cik, filing_no, fp, fy, own_end, line_no, part_no, supp_no, back, end_date,
       CASE WHEN line_no >= 6 THEN CAST(NULL AS DATE)
            WHEN fp = 'FY' OR back = 2 THEN make_date(year(end_date), 1, 1)
            ELSE make_date(year(end_date), month(end_date) - 2, 1) END AS start_date,
       CASE WHEN supp_no % 5 = 0 THEN 1 WHEN supp_no % 5 = 1 AND line_no = 1 THEN 2 ELSE 0 END AS dim_no,
       CASE line_no WHEN 1 THEN 'ifrs-full:Revenue' WHEN 2 THEN 'ifrs-full:CostOfSales'
            WHEN 3 THEN 'ifrs-full:GrossProfit' WHEN 4 THEN 'ifrs-full:ProfitLoss'
            WHEN 5 THEN 'ifrs-full:BasicEarningsLossPerShare'
            WHEN 6 THEN 'ifrs-full:CashAndCashEquivalents' ELSE 'ifrs-full:Assets' END AS element,
       CASE part_no % 4 WHEN 0 THEN '0' WHEN 1 THEN 'INF' ELSE '-3' END AS decimals,
       CASE WHEN line_no = 5 THEN 'usdPershares' ELSE 'usd' END AS unit_id,
       CASE WHEN line_no = 5 THEN ({_N.format(m=5)} % 500 - 100) / 100.0E0
            ELSE (CASE line_no WHEN 1 THEN {_N.format(m=1)} * 1000 WHEN 2 THEN {_N.format(m=1)} * 600
                       WHEN 3 THEN {_N.format(m=1)} * 400 + CASE WHEN part_no % 29 = 0 THEN 5000 ELSE 0 END
                       WHEN 4 THEN ({_N.format(m=4)} - 400000) * 100
                       WHEN 6 THEN {_N.format(m=6)} * 500 ELSE {_N.format(m=7)} * 5000 END)
                 / (CASE WHEN filing_no % 23 = 0 THEN 1000.0E0 ELSE 1.0E0 END) END AS value
FROM (SELECT accession, cik, cik_no, filing_no, fp, fy, own_end, line_no, part_no, supp_no, back, end_date
      FROM fact_spans) AS s
""", "fact_spans")

# bars: one row per user and day
_view("bars", """
SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, CAST(ts AS DATE) AS trade_date,
       min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close,
       CASE WHEN count(*) % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE max(value) * 0.5 END AS adj_close,
       CASE WHEN count(*) % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(count(*) * 1000 AS BIGINT) END AS volume
FROM events GROUP BY lpad(CAST(user_id AS STRING), 10, '0'), CAST(ts AS DATE)
""", "events")

# market_bars: one row per market (nation) and day of its companies' filings: a series of several years
_view("market_bars", """
SELECT lpad(CAST(c_nationkey AS STRING), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS trade_date,
       avg(CAST(o_totalprice AS DOUBLE)) AS close, CAST(NULL AS DOUBLE) AS adj_close, CAST(count(*) * 1000 AS BIGINT) AS volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY lpad(CAST(c_nationkey AS STRING), 10, '0'), CAST(o_orderdate AS DATE)
""", "orders", "customer")

# estimates: one row per view event
_view("estimates", """
SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, 'vendor' AS source,
       make_date(2024, 3 * CAST(1 + event_id % 4 AS INT), 28) AS period_end,
       CASE WHEN event_id % 5 = 0 THEN 'P1Y' ELSE 'P3M' END AS duration,
       CAST(ts AS DATE) AS consensus_date, value AS eps_estimate, event_id
FROM events WHERE event_type = 'view'
""", "events")

# reports: one row per purchase event (a company reports a period on a day)
_view("reports", """
SELECT lpad(CAST(user_id AS STRING), 10, '0') AS cik, 'vendor' AS source,
       make_date(2024, 3 * CAST(1 + event_id % 4 AS INT), 28) AS period_end,
       CASE WHEN event_id % 5 = 0 THEN 'P1Y' ELSE 'P3M' END AS duration,
       CAST(ts AS DATE) AS report_date, value AS eps_actual, event_id
FROM events WHERE event_type = 'purchase'
""", "events")

# log_events: stage log per project
_view("log_events", """
SELECT event_id, user_id AS project_id, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'llm_request' WHEN 'click' THEN 'llm_call'
            WHEN 'purchase' THEN 'llm_done' WHEN 'error' THEN 'error' ELSE 'complete' END AS stage,
       CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS outcome,
       CASE WHEN event_id % 11 = 0 THEN 'Run cancelled ' ELSE 'Step ' END || CAST(event_id AS STRING) AS message,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, value
FROM events
""", "events")

# projects: one row per user
_view("projects", """
SELECT user_id AS project_id, min(ts) AS created_at, CAST(count(*) AS BIGINT) AS n_events,
       CASE user_id % 8 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'converting' WHEN 2 THEN 'llm_pending'
            WHEN 3 THEN 'llm_done' WHEN 4 THEN 'post_processing' WHEN 5 THEN 'complete'
            WHEN 6 THEN 'error' ELSE 'on_hold' END AS status
FROM events GROUP BY user_id
""", "events")

# doc_fields: which field a document (event) of a type carried, by schema version (day)
_view("doc_fields", """
SELECT user_id % 10 AS type_id, CAST(day(ts) AS INT) AS version, event_id AS doc_no, ts AS seen_at,
       CASE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12
            WHEN 0 THEN 'total_amount' WHEN 1 THEN 'Total Amount' WHEN 2 THEN 'invoice_number'
            WHEN 3 THEN 'invoice_num' WHEN 4 THEN 'vendor' WHEN 5 THEN 'vendor_name' WHEN 6 THEN 'due_date'
            WHEN 7 THEN 'currency' WHEN 8 THEN 'lines' WHEN 9 THEN 'paid' WHEN 10 THEN 'po-number'
            ELSE 'notes' END AS found_name,
       CASE event_type WHEN 'view' THEN 'string' WHEN 'click' THEN 'string' WHEN 'purchase' THEN 'number'
            WHEN 'error' THEN 'string' ELSE 'date' END AS field_type,
       CASE CAST(floor(value) AS INT) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS sample_no
FROM events
""", "events")

# doc_names: documents of several fields (64 events each), eight to a schema version, with two spellings of one name
_view("doc_names", """
SELECT type_id, CAST(floor(doc_no / 64) AS BIGINT) AS doc_no, CAST(floor(doc_no / 512) AS BIGINT) + 1 AS version,
       CASE WHEN found_name = 'vendor' AND confidence = 'high' THEN 'VENDOR' ELSE found_name END AS found_name,
       max_by(field_type, doc_no) AS type, max_by(confidence, doc_no) AS confidence,
       max_by(CASE WHEN sample_no % 5 = 0 THEN ' ' ELSE CAST(sample_no AS STRING) || ' ' END, doc_no) AS sample
FROM doc_fields GROUP BY 1, 2, 3, 4
""", "doc_fields")

# schema_fields: the proposed schema of each type and version, one row per field
_view("schema_fields", """
SELECT type_id, version, found_name AS name, max_by(field_type, doc_no) AS type,
       max_by(confidence, doc_no) AS confidence, CAST(count(*) AS BIGINT) AS n_docs
FROM doc_fields GROUP BY type_id, version, found_name
""", "doc_fields")

# samples: one analysed document each, with its content hash
_view("samples", """
SELECT doc_id, source AS type_id, HASH256(text) AS content_hash, n_chars AS size_bytes,
       CASE WHEN doc_id % 2 = 0 THEN 'Report-' ELSE 'REPORT-' END || CAST(n_chars % 50 AS STRING) || '.txt' AS original_name,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE HASH256(text) END AS known_hash
FROM documents
""", "documents")


def for_spark(text: str) -> str:
    text = re.sub(r"GENERATE\(([^)]*)\)", r"explode(array(\1))", text)
    return re.sub(r"HASH256\(([^)]*)\)", r"sha2(\1, 256)", text)


def for_check(text: str) -> str:
    text = re.sub(r"GENERATE\(([^)]*)\)", r"unnest([\1])", text)
    return re.sub(r"HASH256\(([^)]*)\)", r"sha256(\1)", text)


SPARK_VIEWS = {k: (for_spark(t), n) for k, (t, n) in RAW_VIEWS.items()}
CHECK_VIEWS = {k: for_check(t) for k, (t, _) in RAW_VIEWS.items()}


def view_order(names: tuple[str, ...]) -> list[str]:
    """The named views and the views they read, each after what it reads."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in RAW_VIEWS and n not in out:
            for d in RAW_VIEWS[n][1]:
                visit(d)
            out.append(n)

    for n in names:
        visit(n)
    return out
