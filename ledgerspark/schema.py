"""Row contracts and fixed values shared by every operator."""

from pyspark.sql import types as T

# --- fixed values: these must match the published bill-cleaning policy -----------------

CATEGORIES = ["Rent", "Software", "Supplies", "Transport", "Utilities"]
UNCATEGORISED = "Uncategorised"
ALL_CATEGORIES = CATEGORIES + [UNCATEGORISED]

SAMPLE_MERCHANTS = [
    ("Demo Supply 01", "Supplies"),
    ("Demo Utility 02", "Utilities"),
    ("Demo Software 03", "Software"),
    ("Demo Lease 04", "Rent"),
    ("Demo Carrier 05", "Transport"),
    ("Demo Other 06", "Uncategorised"),
]

DEFAULT_HIGH_CENTS = 250_000

FIELDS = ["invoice", "merchant", "date", "amount"]
HEADER_TARGETS = ["invoice", "merchant", "date", "amount_cad"]
HEADER_SCAN_ROWS = 5

# accepted header names per field, compared after lower-casing and dropping punctuation
HEADER_ALIASES = {
    "invoice": ["invoice", "invoiceid", "invoicenumber", "billid", "billnumber", "reference"],
    "merchant": ["vendor", "vendorname", "merchant", "merchantname", "payee"],
    "date": ["date", "invoicedate", "billdate", "billedon", "transactiondate"],
    "amount": ["amount", "amountcad", "total", "totalcad", "totalamount", "grossamount"],
}

# header words of the tolerant mapping: a cell matches when it equals or contains one
HEADER_WORDS = {
    "invoice": ["invoice", "bill id", "reference", "ref", "id", "number", "no"],
    "merchant": ["merchant", "vendor", "payee", "supplier", "name", "description"],
    "date": ["date", "billed on", "invoice date", "posted"],
    "amount": ["amount", "total", "gross", "cad", "value", "sum"],
}

# sheet name -> header row of the fixed layout
FIXED_LAYOUT = [
    ("Export A", ["Invoice", "Vendor", "Date", "Amount"]),
    ("Export B", ["Bill ID", "Merchant name", "Invoice date", "Total CAD"]),
    ("Export C", ["Reference", "Payee", "Billed on", "Gross amount"]),
]
FIXED_HEADER_ROW = 4

# keyword patterns, first match wins; matched without regard to case
KEYWORDS = [
    ("supply|supplies|office|paper|stationer", "Supplies"),
    ("utility|hydro|electric|water|gas|power|energy|telecom|fibre|fiber|internet", "Utilities"),
    ("software|saas|cloud|app|hosting|licen", "Software"),
    ("lease|rent|landlord|property|realty", "Rent"),
    ("carrier|freight|courier|shipping|transport|logistic|delivery|haul", "Transport"),
]

SUGGESTION_BATCH = 12
PROVIDERS = ["anthropic", "openai", "gemini", "openai-compatible", "chatgpt"]

STATUSES = ["clean", "duplicate", "unparseable"]
STATUSES_WITH_REVIEW = STATUSES + ["excluded"]

R_UNMAPPED = "unmapped merchant"
R_MISSING_AMOUNT = "missing amount"
R_INVALID_AMOUNT = "invalid amount or unsupported currency"
R_SIGNS = "conflicting signs"
R_MISSING_DATE = "missing date"
R_AMBIGUOUS_DATE = "ambiguous date: slash order unspecified"
R_INVALID_DATE = "invalid date"
R_EXACT_PREFIX = "exact duplicate of "
R_POSSIBLE_PREFIX = "possible duplicate of "
R_POSSIBLE_SUFFIX = "; retained for review"
R_HIGH_PREFIX = "high amount: absolute CAD >= "
R_EDITED = "category edited by reviewer"
R_EXCLUDED = "excluded by reviewer"

RULE_HEADER = "header alias map"
RULE_INVOICE = "trim surrounding whitespace"
RULE_MERCHANT = "synthetic merchant alias map"
RULE_CATEGORY_REVIEWER = "reviewer alias rule"
RULE_CATEGORY_BUILTIN = "exact merchant rule"
RULE_CATEGORY_NONE = "no rule; manual review"
RULE_AMOUNT = "CAD symbols, grouping and refund sign"
RULE_DATE = "explicit non-ambiguous date format"
RULE_DISPOSITION = "partition; never discard a source row"

# --- own extension: text that is a valid amount but does not fit 16 integer digits -----
R_AMOUNT_RANGE = "amount out of range"

# --- schemas ----------------------------------------------------------------------------

ORD = T.StructType(
    [
        T.StructField("file_ix", T.IntegerType()),
        T.StructField("sheet_ix", T.IntegerType()),
        T.StructField("source_row", T.LongType()),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("sheet_ix", T.IntegerType()),
        T.StructField("source_sheet", T.StringType()),
        T.StructField("source_row", T.LongType()),
        T.StructField("vals", T.ArrayType(T.StringType())),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("problem", T.StringType()),
    ]
)

SOURCE_ROW_COLUMNS = [
    "id", "ord", "source_file", "source_sheet", "source_row", "headers",
    "invoice_raw", "merchant_raw", "date_raw", "amount_raw",
]

RULES = T.StructType(
    [
        T.StructField("norm_key", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("rule_id", T.StringType()),
    ]
)

DECISIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("rule_added", T.StringType()),
        T.StructField("undo_of", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)

SUGGESTION_CACHE = T.StructType(
    [
        T.StructField("norm_key", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("generated", T.DateType()),
    ]
)
