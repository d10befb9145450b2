"""Fixed values of statement reading: patterns, word lists, weights and thresholds.

They must be as they are for right results, so they stand here as plain text, together. Patterns are for Java's engine;
``(?i)`` is added where they are used.
"""

# Dates in tables, in the order in which they are tried.
DATES = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b[A-Z][a-z]{2,8}\.?\s+\d{1,2},?\s*\d{4}\b",
    r"\b\d{4}[.-]\d{2}[.-]\d{2}\b",
    r"(?i:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b)",
)
DATE_FRAGMENT = r"[A-Za-z]{3,9}\.?|\d{1,2},?|\d{4},?|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?,?"
DATE_HINT = r"\b\d{1,2}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# Dates that the snip tool looks for, in the order of its preference.
SNIP_DATES = (
    r"\b\d{4}[-/.]\d{2}[-/.]\d{2}\b",
    r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b",
    r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2}\b",
    r"\b\d{1,2}\s*[-/.]?\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s*[-/.]?\s*\d{2,4}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}\b",
)

# Header words of each canonical column, whole token.
HEADERS = (
    ("date", r"^(?:trans(?:action)?\s*date|posting\s*date|post\s*date|date)$"),
    ("description", r"^(?:description|details|activity|transaction|memo|narrative)$"),
    ("categories", r"^(?:spend\s+)?categor(?:y|ies)$"),
    ("check_number", r"^(?:check#|cheque#|check\s*#|cheque\s*#|check\s*num(?:ber)?|cheque\s*num(?:ber)?|ref(?:erence)?#?|reference)$"),
    ("debit", r"^(?:withdrawals?|debits?|purchases?|charges?|money\s*out)$"),
    ("credit", r"^(?:deposits?|credits?|payments?|money\s*in)$"),
    ("amount", r"^(?:amount|charge)(?:\s*(?:\([^)]{0,24}\)|\[\w{1,3}\]|\$))?$"),
    ("balance", r"^(?:balance|running\s*balance|new\s*balance)$"),
)
MONEY_COLUMNS = ("debit", "credit", "amount", "balance")

# Rows and phrases.
BALANCE_FORWARD = r"balance\s+(?:forward|carried\s+forward|brought\s+forward)|(?:^|\b)b/?f\b"
NOISE_ROW = (
    r"\(continued\)|continued\.|page\s+\d+(\s+of\s+\d+)?|\d+\s+of\s+\d+"
    r"|statement\s+period|routing\s+number|account\s+(?:number|#|no)"
    r"|starting\s+balance|ending\s+balance|beginning\s+balance|opening\s+balance|closing\s+balance"
    r"|total\s+(?:deposits|withdrawals|debits|credits)|previous\s+balance|new\s+balance"
    r"|payments?\s*&\s*credits?|fees?\s+charged|interest\s+charged|payment\s+due"
    r"|tel\s*:|fax\s*:|www\.|https?://|visit\s+us\s+online|moyafinancial|fdic"
    r"|please\s+review|this\s+statement"
)
NOISE_MARKS = r"^\W+$"
DESCRIPTION_CUT = (
    r"total\s+(?:deposits|withdrawals|debits|credits)\b.*|statement\s+period\b.*"
    r"|account\s*(?:#|number|no\.?)\b.*|page\s+\d+\b.*|\(continued\).*"
)
SPLIT_CAPITAL = r"\b([A-Za-z])\s+(?=[A-Z]{2,})"
TOTAL_ROW = r"^\s*total\b"
CREDIT_SECTION = r"(?:your\s+)?payments?(?:\s*(?:&|and)\s*credits?)?|credits?"
DEBIT_SECTION = r"(?:your\s+)?(?:new\s+)?(?:money\s+out\s+)?(?:purchases?|charges?|debits?|transactions?|fees?)(?:\s*(?:&|and|,)\s*(?:credits?|debits?|fees?))?"
DEBIT_WORD = r"\b(?:charges?|purchases?|transactions?|withdrawals?|deposits?|fees?)\b"

# Ledger categories, in the order in which they are tried.
INTEREST = r"\binterest\b"
FEE = r"\bfee\b|\bfees?\b|s/c|service\s+charge"
PAYMENT = r"\bpayment\b|\bcredit\s+memo\b|\brefund\b"

# Summary labels, in the order in which they are tried.
LABELS = (
    ("opening_balance", r"^(?:starting|opening|beginning)\s+balance$"),
    ("closing_balance", r"^(?:ending|closing|new|total)\s+balance$"),
    ("previous_balance", r"^previous\s+balance$"),
    ("new_balance", r"^new\s+balance$"),
    ("total_deposits", r"^total\s+(?:deposits|credits)$"),
    ("total_withdrawals", r"^total\s+(?:withdrawals|debits)$"),
    ("purchases_and_charges", r"^(?:total\s+charges?|purchases?)$"),
    ("payments_and_credits", r"^payments?\s*(?:&|and)\s*credits?$|^payments?$"),
    ("fees_charged", r"^fees?\s+charged?$|^fees?$"),
    ("interest_charged", r"^interest\s+charged?$|^interest$"),
)
LABEL_START = r"^(?:starting|opening|beginning|ending|closing|previous|new|total|payments?|fees?|interest)$"
ACCOUNT = r"account\s*(?:number|#|no\.?)\s*[:\-]?\s*([0-9A-Z*#][0-9A-Z\-*# ]{2,})"
ROUTING = r"(?:routing\s*(?:number|no\.?|#)?|transit\s*(?:number|no\.?|#)?)\s*[:\-]?\s*(\d{5,9})"
PERIOD_DATE = r"(?:[A-Za-z]{3,9}\.?\s+\d{1,2},?\s*\d{4}|\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2})"
PERIOD = rf"(?:statement\s*period|period\s*ending)\s*[:\-]?\s*({PERIOD_DATE}(?:\s*[–—-]\s*(?:[A-Za-z]{{3,9}}\.?\s*)?{PERIOD_DATE})?)"

# Statement type: (type, pattern, weight); a strong signal weighs 2.5.
STRONG = 2.5
FEATURES = (
    ("BANK_ACCOUNT", r"(?:beginning|opening|starting)\s+balance", 1.0),
    ("BANK_ACCOUNT", r"\bdeposits?\b|\bcredits?\b", 0.5),
    ("BANK_ACCOUNT", r"\bwithdrawals?\b|\bdebits?\b", 0.5),
    ("BANK_ACCOUNT", r"\bchecks?\s+paid\b|\bcheques?\s+paid\b|\bcheque#?\b", 1.5),
    ("BANK_ACCOUNT", r"(?:ending|closing)\s+balance", 1.0),
    ("BANK_ACCOUNT", r"\brouting\s+(?:number|no\.?|#)\b|\btransit\s+(?:number|no\.?)\b", 2.0),
    ("BANK_ACCOUNT", r"\bchecking\b|\bchequing\b|\bsavings?\b", STRONG),
    ("BANK_ACCOUNT", r"\brouting\s+number\b", STRONG),
    ("BANK_ACCOUNT", r"\bbank\s+statement\b", STRONG),
    ("CREDIT_CARD", r"previous\s+balance", 1.5),
    ("CREDIT_CARD", r"payments?\s*(?:&|and)\s*credits?", 1.0),
    ("CREDIT_CARD", r"\bpurchases?\b|\bcharges?\b", 0.75),
    ("CREDIT_CARD", r"\bfees?\s+charged?\b", 1.25),
    ("CREDIT_CARD", r"\binterest\s+charged?\b", 1.5),
    ("CREDIT_CARD", r"new\s+balance", 1.5),
    ("CREDIT_CARD", r"payment\s+due(?:\s+date)?\b|\bdue\s+date\b", 1.5),
    ("CREDIT_CARD", r"\bcredit\s+card\b", STRONG),
    ("CREDIT_CARD", r"\bcibc\b\s+dividend|\bvisa\b.*statement|\bmastercard\b", STRONG),
    ("CREDIT_CARD", r"\bpurchases?\s*&\s*cash\s+advances\b", STRONG),
    ("CREDIT_CARD", r"\bminimum\s+payment\b", STRONG),
)

# Thresholds.
MIN_WORDS, FRAGMENT_SHARE, IMAGE_COVER, ALNUM_SHARE = 12, 0.25, 0.85, 0.4
CENT, CHECK_TOLERANCE = "0.01", "0.50"
LOW_CONFIDENCE, AMOUNT_AGREES = 0.60, 0.005
ROW_FACTOR, LANE_TOLERANCE, ATTACH_FACTOR, ATTACH_LEAST = 0.6, 18.0, 2.2, 12.0
AUDIT_FIELDS = ("date", "description", "amount", "balance", "type")
AUDIT_SOURCES = ("auto", "manual_snip")
POINTS_TO_PIXELS = 300 / 72
