"""Values that define the data set: word lists, codes, tolerances and patterns.

Everything here is a fixed value that results depend on. Nothing is computed.
"""

# ---- Fixed values: filing categories, in order (category, weight, is_event, why) ----
CATEGORY_RULES = [
    ("quarterly_results", "major", True, "Reported quarterly financial results"),
    ("business_deal", "major", True, "Announced a commercial agreement or transaction"),
    ("annual_report", "major", True, "Filed its annual report"),
    ("regulatory_clinical", "major", True, "Regulatory or clinical milestone"),
    ("annual_guidance", "major", True, "Issued forward guidance"),
    ("corporate_action", "medium", True, "Dividend or other corporate action"),
    ("current_report", "medium", False, ""),
    ("governance", "medium", False, ""),
    ("admin_update", "medium", False, ""),
    ("earnings_preview", "minor", False, ""),
    ("insider_trade", "minor", False, ""),
    ("insider_initial", "minor", False, ""),
    ("investor_relations", "minor", False, ""),
    ("ownership_disclosure", "minor", False, ""),
    ("unknown", "minor", False, ""),
]
UNKNOWN_CATEGORY = "unknown"
REPORT_CATEGORIES = ["quarterly_results", "annual_report"]

# ---- Fixed values: metric dictionary (key, display, unit, ranked element aliases) ----
USD = "USD"
USD_PER_SHARE = "USD/share"
METRICS = [
    ("total_revenues", "Total revenues", USD, [
        "ifrs-full:Revenue",
        "ifrs-full:RevenueFromContractsWithCustomers",
        "us-gaap:Revenues",
        "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax",
    ]),
    ("cost_of_revenues", "Total cost of revenues", USD, [
        "ifrs-full:CostOfSales",
        "us-gaap:CostOfRevenue",
    ]),
    ("gross_profit", "Gross profit", USD, [
        "ifrs-full:GrossProfit",
        "us-gaap:GrossProfit",
    ]),
    ("operating_income", "Operating income", USD, [
        "ifrs-full:ProfitLossFromOperatingActivities",
        "us-gaap:OperatingIncomeLoss",
    ]),
    ("net_income", "Net income", USD, [
        "ifrs-full:ProfitLoss",
        "ifrs-full:ProfitLossFromContinuingOperations",
        "us-gaap:NetIncomeLoss",
    ]),
    ("eps_basic", "Basic EPS", USD_PER_SHARE, [
        "ifrs-full:BasicEarningsLossPerShare",
        "us-gaap:EarningsPerShareBasic",
    ]),
    ("eps_diluted", "Diluted EPS", USD_PER_SHARE, [
        "ifrs-full:DilutedEarningsLossPerShare",
        "us-gaap:EarningsPerShareDiluted",
    ]),
    ("cash_and_equivalents", "Cash and cash equivalents", USD, [
        "ifrs-full:CashAndCashEquivalents",
        "us-gaap:CashAndCashEquivalentsAtCarryingValue",
    ]),
    ("total_assets", "Total assets", USD, [
        "ifrs-full:Assets",
        "us-gaap:Assets",
    ]),
    ("operating_cash_flow", "Operating cash flow", USD, [
        "ifrs-full:CashFlowsFromUsedInOperatingActivities",
        "us-gaap:NetCashProvidedByUsedInOperatingActivities",
    ]),
]
INCOME_KEYS = ["total_revenues", "cost_of_revenues", "gross_profit", "operating_income",
               "net_income", "eps_basic", "eps_diluted"]
BALANCE_KEYS = ["cash_and_equivalents", "total_assets"]
CASH_FLOW_KEYS = ["operating_cash_flow"]
METRIC_RANK = ["total_revenues", "eps_basic", "net_income", "cash_and_equivalents"]
EVIDENCE_WORDS = {
    "total_revenues": ["total revenues", "revenues", "revenue"],
    "net_income": ["net income", "net loss", "net earnings"],
    "eps_basic": ["per share"],
    "cash_and_equivalents": ["cash and cash equivalents", "cash position"],
}

# ---- Fixed values: confidence, source and detector names ----
VERIFIED, SINGLE_SOURCE, SUSPECT = "verified", "single_source", "suspect"
FROM_INSTANCE, FROM_RENDERED, FROM_BOTH = "xbrl_instance", "rendered_html", "both"
FROM_ADJUDICATED, FROM_COMPANY_FACTS, FROM_NONE = "llm_adjudicated", "sec_companyfacts", "none"
DETECTOR_A = "detector_A_source_disagreement"
DETECTOR_B = "detector_B_implausible_tagging"
DETECTOR_C = "detector_C_calculation_invariant"
DETECTOR_D = "detector_D_chain_break"
DETECTOR_E = "detector_E_ambiguous_fact"
DETECTOR_F = "detector_F_role_unresolved"

# ---- Fixed values: tolerances and day bands ----
MONEY_TOLERANCE = 0.005
PER_SHARE_TOLERANCE = 0.005
IMPLAUSIBLE_BELOW = 1e6
SCALE_TOLERANCE = 0.005
QUARTER_DAYS = (80, 100)
YEAR_DAYS = (350, 380)
CHAIN_DRIFT_DAYS = 14
BASIS_TOLERANCE = 0.05

# ---- Fixed values: search scores ----
SCORE_EXACT_TICKER = 100
SCORE_TICKER_PREFIX = 95
SCORE_NAME_PREFIX = 90
SCORE_TICKER_SUBSTRING = 85
SCORE_NAME_TOKEN_PREFIX = 80
SCORE_NAME_SUBSTRING = 70
SCORE_FORMER_NAME = 60
SCORE_CIK_PREFIX = 50
MAX_SEARCH_RESULTS = 20

# ---- Fixed values: fetch plan factors ----
DISK_EXPANSION = 1.4
FILES_PER_FILING = 12
REQUESTS_PER_SECOND = 8.3

# ---- Fixed values: tiers ----
TIER_LABELS = {1: "MAJOR", 2: "MODERATE", 3: "MINOR", 4: "ROUTINE"}

# ---- Fixed values: processing status (status, label, percent) ----
STATUS_STEPS = [
    ("uploaded", "Queued", 8),
    ("converting", "Extracting text", 28),
    ("llm_pending", "Analyzing with LLM", 45),
    ("llm_done", "LLM complete", 62),
    ("post_processing", "Saving results", 82),
    ("complete", "Complete", 100),
    ("error", "Error", 100),
]
IN_PROGRESS_STATUSES = ["uploaded", "converting", "llm_pending", "llm_done", "post_processing"]
TERMINAL_STATUSES = ["complete", "error"]

# ---- Fixed values: document cost tiers, MIME types, upload limit ----
COST_TIER_LIMITS = {"budget": 4000, "standard": 16000, "premium": 128000}
PDF_MIME = "application/pdf"
EXCEL_MIMES = ["application/vnd.ms-excel",
               "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]
WORD_MIMES = ["application/msword",
              "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
MIME_BY_EXTENSION = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "csv": "text/csv",
    "json": "application/json",
}
DEFAULT_MIME = "application/octet-stream"
MAX_UPLOAD_BYTES = 50 * 1024 * 1024

# ---- Fixed values: field types and confidence levels of document schemas ----
FIELD_TYPES = ["string", "number", "date", "boolean", "array", "object"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]
#: Fixed value: the estimate source that is read where none is asked for and none served the company.
DEFAULT_ESTIMATE_SOURCE = "finnhub"

CONVERGENCE_METRICS = ["field_stability", "confidence_trend", "new_field_rate", "type_consistency"]

# ---- Fixed values: text patterns ----
GROWTH_NUMBER_FIRST = r"(?i)(\d+)%\s+(?:[\w-]+\s+){0,4}?(growth|increase|decrease)"
GROWTH_WORD_FIRST = r"(?i)(growth|increase|decrease)\s+of\s+(\d+)%"
SECRET_QUERY_PARAM = r"(?i)([?&](?:key|api_key|apikey|access_token|token|secret|password|passwd)=)[^&\s\"']+"
SECRET_BEARER = r"(?i)\bBearer\s+[^\s\"']+"
SECRET_BASIC = r"(?i)\bBasic\s+[A-Za-z0-9+/=]+"
EXPLICIT_UNIT = r"(?i)\$\s?[\d.,]+\s*(million|billion)|per share"
BARE_NUMBER_RUN = r"\d[\d,.]*\s+\d[\d,.]*\s+\d[\d,.]*"
SENTENCE_END = r"(?:[.!?])\s+"
EVIDENCE_LIMIT = 4000
ROLE_WORDS = [
    ("balance", ["financial position", "balance sheet"]),
    ("income", ["profit or loss", "operations"]),
    ("cashFlow", ["cash flow"]),
]
CAPTION_SCALES = {"thousands": 1e3, "millions": 1e6, "billions": 1e9}
LINKBASE_SUFFIXES = ["_cal.xml", "_def.xml", "_lab.xml", "_pre.xml"]

# ---- Fixed values: volume axis ----
AXIS_STEPS = [1.0, 2.5, 10.0, 20.0, 50.0]
AXIS_DECADES = 8
AXIS_CEILING = 500e6
AXIS_HEADROOM = 10
VOLUME_TOP_FACTOR = 1.05
VOLUME_BOTTOM_FACTOR = 0.85

# ---- Fixed values: retry and refresh intervals ----
RECENT_SUCCESS_HOURS = 24
RETRY_FLOOR_HOURS = 6
