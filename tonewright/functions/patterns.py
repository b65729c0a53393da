"""Patterns, labels, keyword lists and thresholds that decide a result.

Digits are ``\\p{Nd}`` and whitespace is an explicit class, because ``\\d`` and ``\\s`` are
ASCII-only in Java while the rules are meant for any script.
"""

# --- fixed values: character classes --------------------------------------------------
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
TERM = r"[\p{L}\p{N}_]{2,}"
SENTENCE_END = r"[.!?]+"
NOT_MODEL_TEXT = r"[^\p{L}\p{N}_ .,%$+-]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: labels -------------------------------------------------------------
LABELS = ("negative", "neutral", "positive")  # position = class number
EXTERNAL_ORDER = ("positive", "negative", "neutral")  # class order of the pretrained scorer

# --- fixed values: text repair, in order ------------------------------------------------
MOJIBAKE = (("â€™", "'"), ('â€"', "-"), ("â€œ", '"'), ("â€", '"'))
URL = rf"https?://{NOT_WS}+|www\.{NOT_WS}+"
EMAIL = rf"{NOT_WS}+@{NOT_WS}+"

# --- fixed values: amounts and names -----------------------------------------------------
D = r"\p{Nd}"
SCALE = rf"(?:{WS}*(?:million|billion|trillion|[MBTmbt]))?"
AMOUNT = rf"[-+]?{D}+(?:,{D}{{3}})*(?:\.{D}+)?{SCALE}"
PERCENT = rf"[-+]?{D}+(?:\.{D}+)?%"
CURRENCY = rf"(?:USD|EUR|GBP|JPY|CNY|INR|\$|€|£|¥|₹){WS}*{AMOUNT}"
NUMBER = AMOUNT
COMPANY_SUFFIX = (
    "(?:Inc|Corp|Ltd|LLC|Group|Holdings|Co|Company|Industries|Technologies|Systems|Solutions"
    "|Services)"
)
COMPANY = (
    rf"(?:[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{WS}+{COMPANY_SUFFIX}\.?)|(?:[A-Z]{{2,5}})"
)
FISCAL = rf"(?:Q[1-4]|FY{D}{{2,4}}|H[12]|fiscal{WS}+(?:year|quarter))"
DATE = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    rf"{WS}+{D}{{1,2}}(?:,?{WS}+{D}{{4}})?|{D}{{1,2}}/{D}{{1,2}}/{D}{{2,4}}"
)

# placeholder -> pattern, applied in this order
PLACEHOLDERS = (
    (" _PERCENT_ ", PERCENT),
    (" _BILLION_DOLLARS_ ", rf"(?i)\$?{D}+(?:\.{D}+)?{WS}*(?:billion|bn)\b"),
    (" _MILLION_DOLLARS_ ", rf"(?i)\$?{D}+(?:\.{D}+)?{WS}*(?:million|mn|m)\b"),
    (" _TRILLION_DOLLARS_ ", rf"(?i)\$?{D}+(?:\.{D}+)?{WS}*(?:trillion|tn|tr)\b"),
    (" _CURRENCY_ ", rf"\${D}+(?:,{D}{{3}})*(?:\.{D}+)?"),
)

# --- fixed values: lexicon feature rules --------------------------------------------------
NEGATION_WORDS = (
    "not", "no", "never", "neither", "nobody", "nothing", "nowhere", "none", "nor", "cannot",
    "can't", "won't", "wouldn't", "shouldn't", "couldn't", "doesn't", "don't", "didn't", "isn't",
    "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't", "without", "lack", "lacking",
    "fail", "failed", "fails", "unable", "unlikely",
)

# --- fixed values: six-step reasoning -------------------------------------------------------
TOPICS = (
    ("earnings/financial results", ("earnings", "revenue", "profit", "loss", "quarter", "fiscal")),
    ("M&A activity", ("acquire", "merger", "acquisition", "deal", "buyout")),
    ("market/stock commentary", ("stock", "shares", "price", "trading", "market")),
    ("forward-looking guidance", ("forecast", "outlook", "guidance", "expect")),
    ("legal/regulatory", ("lawsuit", "litigation", "court", "regulatory")),
)
OTHER_TOPIC = "general financial news"
STEP_CURRENCY = rf"(?i)\${D}+(?:\.{D}+)?(?:{WS}*(?:million|billion|trillion|[MBT]))?\b"
STEP_COMPANY_SUFFIX = r"(?:Inc|Corp|Ltd|LLC|Co)\.?\b"
STEP_COMPANY = rf"\b[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{WS}+{STEP_COMPANY_SUFFIX}"
STEP_NEGATIONS = (
    "not", "no", "never", "neither", "cannot", "can't", "won't", "don't", "didn't", "without", "fail",
)
STEP_COMPARISONS = (
    "better than", "worse than", "compared to", "versus", "vs", "higher than", "lower than",
)
STEP_FUTURE = (
    "will", "expect", "anticipate", "forecast", "plan", "future", "upcoming", "next",
)
# word lists used by the reasoning steps when no lexicon is supplied
FALLBACK_WORDS = {
    "positive": (
        "growth", "strong", "profit", "gain", "increase", "beat", "success", "improve",
        "positive", "rise", "record", "exceed",
    ),
    "negative": (
        "loss", "decline", "fall", "weak", "miss", "fail", "drop", "negative", "concern",
        "down", "risk", "cut",
    ),
    "uncertainty": (
        "may", "might", "could", "expect", "forecast", "uncertain", "potential", "possible",
    ),
}

# --- fixed values: highlighting --------------------------------------------------------------
HIGHLIGHT_COLOURS = {
    "positive": "rgba(40, 167, 69, 0.2)",
    "negative": "rgba(220, 53, 69, 0.2)",
    "neutral": "rgba(0, 123, 255, 0.2)",
}


# Java's regex engine recurses on repeated groups and rescans on failure: a long text could
# overflow the stack or take quadratic time. The forms below match exactly what the plain ones
# match, in linear time: quantifiers that never need to give back are possessive, a run is only
# entered at its start, and the cheapest test comes first. The JAVA_ forms that name a plain
# space are for text whose whitespace has been squashed to single spaces.
JAVA_WS = r"(?U)[\s\x1c-\x1f]"  # the same characters as WS
JAVA_URL = r"https?://[^ ]+|www\.[^ ]+"
JAVA_EMAIL = r"[^ ](?<![^ ]{2})[^ ]*@[^ ]++"
JAVA_NEEDS_REPAIR = r"@|://|www\.|â€"
JAVA_QUANTITY = rf"{D}(?<!{D}{D}){D}*+(?:\.{D}++)?+"
JAVA_PERCENT = rf"[-+]?+{JAVA_QUANTITY}%"
JAVA_PLACEHOLDERS = (
    (" _PERCENT_ ", JAVA_PERCENT),
    (" _BILLION_DOLLARS_ ", rf"(?i)\$?+{JAVA_QUANTITY} ?+(?:billion|bn)(?![\p{{L}}\p{{N}}_])"),
    (" _MILLION_DOLLARS_ ", rf"(?i)\$?+{JAVA_QUANTITY} ?+(?:million|mn|m)(?![\p{{L}}\p{{N}}_])"),
    (" _TRILLION_DOLLARS_ ", rf"(?i)\$?+{JAVA_QUANTITY} ?+(?:trillion|tn|tr)(?![\p{{L}}\p{{N}}_])"),
    (" _CURRENCY_ ", rf"\${D}+(?:,{D}{{3}})*(?:\.{D}+)?"),
)
JAVA_CURRENCY = rf"(?:[$€£¥₹]|(?=[UEGJCI])(?:USD|EUR|GBP|JPY|CNY|INR)){WS}*{AMOUNT}"


def name_runs(suffix: str) -> str:
    """Runs of capitalised words: up to the last suffix word if there is one (group 1), else the
    whole run."""
    word = "[A-Z][a-z]++"
    plain = rf"(?:{WS}++(?!{suffix}){word})*+"
    inner = rf"(?:{plain}{WS}++(?={suffix}){word}(?={plain}{WS}++{suffix}))*+"
    return rf"({word}{inner}{plain}{WS}++{suffix})|{word}{plain}"


def word_boundary_aware(pattern: str) -> str:
    """Make ``\\b`` see letters of every script in Java's regex engine."""
    if r"\b" not in pattern:
        return pattern
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern
