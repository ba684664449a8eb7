"""Word lists, patterns, thresholds and labels that decide results.

Everything in this module is plain data. Nothing here depends on Spark.
"""

# ---- fixed values: record layout -------------------------------------------------------------
OUTPUT_COLUMNS = [
    "Date", "Class Year", "Form Type", "Reason Category", "Reason Details", "Month", "Name", "Issuer",
    "Pos/Neg", "CDNA", "Passes", "Demerits", "Tours", "Confinements", "Other",
]
OUTPUT_KEYS = [
    "date", "class_year", "form_type", "reason_category", "reason_details", "month", "recipient", "issuer",
    "pos_neg", "cdna", "passes", "demerits", "tours", "confinements", "other",
]
RECORD_FIELDS = [
    "recipients", "form_type", "pos_neg", "date", "class_year", "squadron", "reason_category",
    "reason_details", "issuer", "cdna", "passes", "demerits", "tours", "confinements", "other",
]
MANUAL_FIELDS = ["cdna", "passes"]
MANUAL_LABELS = {"cdna": "CDNA", "passes": "Passes"}
SANCTION_FIELDS = ["demerits", "tours", "confinements"]

# ---- fixed values: the route ------------------------------------------------------------------
STEPS = ["issuer_signed", "sqccf_processed", "cadet_cc_initialed", "recipient_signed", "aoc_signed"]
STEP_LABELS = {
    "issuer_signed": "Issuer signature",
    "sqccf_processed": "SQ/CCF processing",
    "cadet_cc_initialed": "Cadet Commander initials",
    "recipient_signed": "Recipient signature",
    "aoc_signed": "AOC/AMT signature",
}
STEP_FOLDERS = {
    "issuer_signed": "1 - Needs Issuer signature",
    "sqccf_processed": "2 - Needs SQ-CCF processing",
    "cadet_cc_initialed": "3 - Needs Cadet Commander initials",
    "recipient_signed": "4 - Needs Recipient signature",
    "aoc_signed": "5 - Needs AOC-AMT signature",
    "complete": "6 - Fully complete",
}
STEP_SLOTS = {
    "F10": {
        "issuer_signed": ["sig_awarding"],
        "sqccf_processed": ["sqccf_initials", "login_date"],
        "cadet_cc_initialed": ["cadet_sqcc_initials"],
        "recipient_signed": ["sig_recipient"],
        "aoc_signed": ["sig_aoc"],
    },
    "F174": {
        "issuer_signed": ["sig_counselor"],
        "sqccf_processed": [],
        "cadet_cc_initialed": [],
        "recipient_signed": ["sig_recipient"],
        "aoc_signed": [],
    },
}
F174_COMMANDER_SLOT = "sig_commander"
CORE_SLOTS = {
    "F10": ["recipient_name", "date", "issuer", "narrative", "sig_recipient", "sig_aoc", "sqccf_initials"],
    "F174": ["recipient_name", "reason", "narrative", "issuer", "date", "sig_recipient"],
}
DATE_SLOTS = {
    "F10": ["date", "date_awarded", "date_counseled", "login_date"],
    "other": ["date", "counselee_date", "commander_date"],
}
BULK_STEPS = {
    "sqccf_processed": {"initials": "sqccf_initials", "dates": ["login_date"], "date_setting": "first_shirt_fill_date"},
    "cadet_cc_initialed": {"initials": "cadet_sqcc_initials", "dates": ["cadet_sqcc_date"], "date_setting": None},
}
SCOPES = ["all", "negative", "positive", "outstanding_negative", "in_progress", "rejected"]

# ---- fixed values: patterns ---------------------------------------------------------------------
WHITESPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
POSITIVE_PART = r"(?i)^(pos|positive|\+)$"
NEGATIVE_PART = r"(?i)^(neg|negative|-)$"
FORM_TYPE_PART = r"(?i)^(?:af|afcw)?\s*(?:imt|form|frm|f)?\s*-?\s*(10|174)$"
RANK_TOKEN = r"(?i)^(c[1-4]c|cadet)$"
RANK_SECOND_WORD = r"(?i)^(lt|col|gen|sgt|capt|maj)$"
NAME_SUFFIX = r"^(jr|sr|ii|iii|iv|v)$"
NAME_HONORIFIC = r"^(mr|mrs|ms|miss|dr)$"
DATE_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
DATE_YMD = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
DATE_MDY = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})"
DATE_D_MON_Y = r"(\d{1,2})\s*-?\s*([A-Za-z]{3,9})\.?\s*-?,?\s*(\d{2,4})"
DATE_MON_D_Y = r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{2,4})"
MONTH_NUMBERS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
YEAR_4 = r"\b(20\d{2})\b"
YEAR_MARKED = r"(?:'|’|C\s*)(\d{2})\b"
YEAR_BARE = r"^(\d{2})$"
NOTHING = r"(?i)^(n\.?\s*/?\s*a\.?|none|nil|null|no|-+|—|0)$"
LABEL_WORD = (
    r"(?i)^(\d{1,2}\.|demerits?|demerit\(s\)|confinements?|confinement\(s\)|tours?|loss|of|pass|"
    r"priv(ilege)?s?|revoke|pov|\(s\))$"
)
COUNT_NUMBER = r"(?<![\d.])(\d+(?:\.\d+)?)(?![\d.])"
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
EMAIL = (
    r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"
)
EMAIL_WHOLE = r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
EMAIL_MAX = 254
COPY_WORDS = (
    r"\b(copy|signed|sign|sig|final|updated|update|scan|scanned|new|returned|done|completed?|rev\d*|v\d+)\b"
)
HEADER_WORDS = (
    r"(?i)\b(name|email|e-mail|mail|address|phone|class|year|squadron|flight|rank|grade|title|position|"
    r"notes?|cadet|id|dod)\b"
)
LAST_NAME_HEADER = r"last|sur|family"
FIRST_NAME_HEADER = r"first|given"

# ---- fixed values: thresholds and weights ---------------------------------------------------------
CONTENT_WEIGHTS = [
    ("recipient_name", 3.0), ("narrative", 3.0), ("reason", 2.0), ("date", 2.0),
    ("issuer", 1.5), ("counselee_name", 1.0), ("squadron", 0.5), ("class_year", 0.5),
]
# What a renamed file takes over from the case it was.
INHERITED = [
    "overrides", "reviewed", "reviewed_at", "logged", "logged_at", "archived", "archived_at", "rejected", "rejected_at", "notes", "history",
]
CONTENT_WORDS = {
    "recipient_name": "recipient", "narrative": "narrative", "reason": "reason", "date": "date",
    "issuer": "issuer", "counselee_name": "counselee", "squadron": "squadron", "class_year": "class year",
}
SAME_NAME_FROM, SIMILAR_NAME_FROM, SAME_FIELD_FROM, DIFFERENT_FIELD_BELOW = 0.999, 0.6, 0.9, 0.5
FILENAME_SHARE = 0.45
CONTENT_SHARE = 0.55
FILENAME_ONLY_SHARE = 0.9
MIN_CONTENT_WEIGHT = 2.0
TYPE_MISMATCH_FACTOR = 0.4
SENT_BONUS = 0.15
CANDIDATE_MIN = 0.3
CANDIDATE_TOP = 6
SUGGEST_SURE, SUGGEST_MARGIN, SUGGEST_MAYBE = 0.7, 0.1, 0.4
NAME_MAX_DISTANCE = 2
ATTACH_MAX_FILES = 10
ATTACH_MAX_BYTES = 18 * 1024 * 1024
AUTO_MAX = 20
DEBOUNCE_SECONDS = 8
HISTORY_KEEP, LOG_KEEP, BACKUPS_KEEP, RECENT_KEEP = 60, 200, 10, 40
PACKET_LINES = 41
INK_CHECKBOX, INK_CHECKBOX_PX = 0.12, 10
INK_OTHER, INK_OTHER_PX = 0.004, 30
WIDGET_ACCEPT = 0.075
CUTOFF_PRESETS = [7, 14, 30, 60, 90]

# ---- fixed values: the settlement log ----------------------------------------------------------
SETTLEMENT_HEADINGS = {
    "date": "Date Served", "cadet": "Cadet Name", "type": "Sanction Type", "amount": "Amount Served",
    "supervisor": "Supervisor / Monitor", "notes": "Notes",
}
SETTLEMENT_REQUIRED = ["cadet", "type", "amount"]
TOUR_WORD, CONFINEMENT_WORD = "Tour", "Confinement"
PUSH_COLUMNS = [
    ("Date", "date"), ("Class Year", "class_year"), ("Form Type", "form_type"),
    ("Reason Category", "reason_category"), ("Description", "reason_details"), ("Month", "month"),
    ("Recipient", "recipient"), ("Issuer", "issuer"), ("Pos/Neg", "pos_neg"), ("CDNA", "cdna"),
    ("Passes", "passes"), ("Demerits", "demerits"), ("Tours", "tours"), ("Confinements", "confinements"),
    ("Other", "other"), ("Status", "status"),
]
NUMERIC_SOURCES = ["class_year", "cdna", "passes", "demerits", "tours", "confinements"]
