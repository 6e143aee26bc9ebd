"""Word lists, tables, formats and texts that results depend on.

Everything in this module is data, not logic.
"""

# --- labels, priorities, statuses (fixed values) ---------------------------
DEFAULT_LABELS = ("Useful", "ToDelete", "Ads")
UNKNOWN_LABEL = "Unknown"
PROMPT_LABELS = ("Useful", "ToDelete", "Ads", "Unknown")
PRIORITIES = ("high", "medium", "low")
PRIORITY_TEXT = {"high": "🔴 High", "medium": "🟡 Medium", "low": "🟢 Low"}
PRIORITY_TEXT_NONE = "Unspecified"
SEEN_FLAG = "\\Seen"
ANY_KEYWORD_FLAG = "\\*"
DEFAULT_FOLDERS = ("INBOX",)
SCHEMA_VERSION = 1
MAX_UID = 4294967295

# --- limits (fixed values) -------------------------------------------------
DEFAULT_WINDOW_HOURS = 24
MAX_WINDOW_HOURS = 72
LLM_CALLS_AT_ONCE = 4
LLM_TIMEOUT_SECONDS = 120.0
FETCH_BATCH = 10
TOP_SENDERS = 5
BURST_THRESHOLD = 3
LIST_RUNS_LIMIT = 10
EXCERPT_LIMIT = 500
HIGHLIGHT_ERROR_LIMIT = 80
HIGHLIGHT_ERROR_KEEP = 77

# --- characters trimmed as white space (fixed values) ----------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- HTML tags that break a line (fixed values) -----------------------------
BLOCK_TAGS = (
    "p div br hr h1 h2 h3 h4 h5 h6 blockquote pre table tr th td li ol ul dl dt dd "
    "section article nav header footer aside details summary figure figcaption"
).split()

# --- named HTML entities (fixed values; nbsp decodes to a plain space) -------
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "iexcl": "¡", "cent": "¢", "pound": "£", "curren": "¤", "yen": "¥", "brvbar": "¦",
    "sect": "§", "uml": "¨", "copy": "©", "ordf": "ª", "laquo": "«", "not": "¬",
    "shy": "\u00ad", "reg": "®", "macr": "¯", "deg": "°", "plusmn": "±", "sup2": "²",
    "sup3": "³", "acute": "´", "micro": "µ", "para": "¶", "middot": "·", "cedil": "¸",
    "sup1": "¹", "ordm": "º", "raquo": "»", "frac14": "¼", "frac12": "½", "frac34": "¾",
    "iquest": "¿", "times": "×", "divide": "÷", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„",
    "bull": "•", "hellip": "…", "prime": "′", "Prime": "″", "euro": "€", "trade": "™",
    "larr": "←", "uarr": "↑", "rarr": "→", "darr": "↓",
    "spades": "♠", "clubs": "♣", "hearts": "♥", "diams": "♦",
}

# --- delivery errors worth a retry (fixed values) ----------------------------
RETRYABLE_TEXT = (
    "no such host", "connection refused", "connection reset", "timeout", "Temporary",
    "code 429", "code 500", "code 502", "code 503",
)

# --- older ledger time formats, Spark pattern letters (fixed values) ---------
LEGACY_TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S] xx x",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S] xx z",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S] xx",
    "yyyy-MM-dd HH:mm:ss",
)

# --- classification prompt (fixed values) -------------------------------------
PROMPT_HEAD = """You are an email classifier. Your task is to classify each email below into one of the following labels:

{labels}

For each email, output a JSON object with these fields:
  - "uid": the email's UID (number)
  - "account": the account label (string)
  - "label": the classification label from the list above (string)
  - "confidence": your confidence in this classification, 0.0 to 1.0 (float)
  - "reason": a short justification for the classification (string)
  - "summary": a concise summary of the email (string)
  - "key_points": important facts or details from the email (array of strings)
  - "action_items": follow-up tasks requested by the email, if any (optional array of strings)
  - "priority": one of "high", "medium", or "low" (string)

Assess priority using these signals:
  - high: explicit deadlines or due dates soon, payment or security risk, direct requests to the recipient, calendar/time-sensitive commitments, or important sender context.
  - medium: useful business or personal updates that may need review but have no immediate deadline or risk.
  - low: informational, promotional, automated, or non-actionable messages with little time sensitivity.

"""
PROMPT_TAIL = """

Output ONLY valid JSON in this exact format (no markdown fences, no extra text):

{"schema_version": 1, "classifications": [
  {"uid": ..., "account": "...", "label": "...", "confidence": 0.0, "reason": "...", "summary": "...", "key_points": ["..."], "action_items": ["..."], "priority": "medium"}
]}

If you cannot classify an email, use label "Unknown" with confidence 0.0."""

# --- repair prompt (fixed values) ---------------------------------------------
REPAIR_HEAD = "The following JSON response from an email classifier is invalid:\n\n```\n"
REPAIR_ERROR = "\n```\n\nParse error: "
REPAIR_FORMAT = """

Please fix the JSON and output ONLY valid JSON in this exact format (no markdown fences, no extra text):

{"schema_version": 1, "classifications": [
  {"uid": ..., "account": "...", "label": "...", "confidence": 0.0, "reason": "...", "summary": "...", "key_points": ["..."], "action_items": ["..."], "priority": "medium"}
]}

Valid labels:
"""
REPAIR_RULES = """

Rules:
- Each item must have: uid (number), account (string), label (string from the list above), confidence (0.0–1.0), reason (string), summary (non-empty string), key_points (non-empty array of strings)
- No duplicate (account, uid) pairs
- Confidence must be between 0.0 and 1.0
- action_items are optional
- priority is optional when unavailable; when present it must be one of: high, medium, low
- schema_version must be 1
- Output ONLY the JSON object, nothing else
"""

# --- digest texts (fixed values) ------------------------------------------------
NO_TIME = "0001-01-01 00:00"  # how a missing date is shown
DIGEST_TITLE = "# 📧 Email Digest"
FALLBACK_TITLE = "# ⚠️ Email Digest (Fallback)"
FALLBACK_STATUS = (
    "**Status:** ⚠️ LLM classification was unavailable — messages are listed without labels."
)
NOTHING_NOTABLE = "— Nothing notable this run."
NEEDS_ATTENTION = "## 🚨 Needs Attention"
READ_BADGE = "✅ Read"
UNREAD_BADGE = "🆕 Unread"
OMITTED_AFTER_ERROR = "> [Raw excerpt omitted — enable include_raw_excerpt_fallback to view]"
OMITTED_NO_SUMMARY = (
    "> [Raw excerpt omitted — enable include_raw_excerpt_fallback or include_summaries to view]"
)
