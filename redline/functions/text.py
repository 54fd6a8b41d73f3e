"""Column -> Column text functions (all JVM-side, codegen friendly).

Regex notes: Java's ``\\w`` / ``\\s`` are ASCII unless ``(?U)`` is set, Python's are Unicode, so the
classes are spelled with ``\\p{L}\\p{N}`` here; the same spelling works in DuckDB's RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, spelled so Java regex and RE2 read it identically.
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same set as literal characters (for btrim).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

# Fixed values that must equal the reference: characters kept by the cleaner besides word
# characters and whitespace.
CLEAN_KEEP_PUNCT = ".,!?;:()\\-'\""
CLEAN_MIN_CHARS = 10


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Collapse whitespace, drop runs of disallowed characters, then keep the (single-line)
    result only when it is longer than 10 characters after trimming, else ''."""
    s = F.regexp_replace(_c(col), WS + "+", " ")
    s = F.regexp_replace(s, "[^\\p{L}\\p{N}_ " + CLEAN_KEEP_PUNCT + "]+", "")
    t = F.trim(s)
    return F.when(F.length(t) > CLEAN_MIN_CHARS, t).otherwise(F.lit(""))


def parse_keywords(col) -> Column:
    """'a, b,,c ' -> ['a','b','c']."""
    return F.filter(F.transform(F.split(_c(col), ","), lambda x: F.trim(x)), lambda x: x != "")


def firm_slug(col, prefix: str = "") -> Column:
    """Firm id from its name: lower-case, spaces -> '_', '&' -> 'and', optional prefix."""
    s = F.replace(F.replace(F.lower(_c(col)), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return F.concat(F.lit(prefix), s) if prefix else s


def default_keywords(col) -> Column:
    """Default keyword list of a firm: [name, first word of name]."""
    return F.array(_c(col), F.split(_c(col), " ").getItem(0))


# Fixed values that must equal the reference: filename rules for template typing, in order.
# Rule set A (seeding script): first hit wins, default main_contract.
TEMPLATE_RULES_A = [
    (["purchase agreement", "purchase_agreement", "agreement"], "purchase_agreement"),
    (["rider"], "rider"),
    (["comments", "comment", "legal comments", "legal_comments"], "legal_comments"),
]
# Rule set B (top-level seeding): first hit wins, default main_contract.
TEMPLATE_RULES_B = [
    (["purchase", "agreement", "sale"], "purchase_agreement"),
    (["rider", "addendum", "amendment"], "rider"),
    (["comment", "review", "note"], "legal_comments"),
    (["contract", "main", "base"], "main_contract"),
]


def template_type(col, rules=TEMPLATE_RULES_B, default: str = "main_contract") -> Column:
    """Ordered substring rules on the lower-cased file name; first hit wins."""
    low = F.lower(_c(col))
    out = F.lit(default)
    for needles, label in reversed(rules):
        hit = None
        for n in needles:
            h = low.contains(n)
            hit = h if hit is None else (hit | h)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


# Fixed values that must equal the reference: contract-type regexes, tested in this order on the
# lower-cased text.
CONTRACT_TYPE_PATTERNS = [
    ("purchase_agreement", [r"purchase\s+agreement", r"sales?\s+agreement", r"buy.*sell", r"purchase\s+order"]),
    ("service_agreement", [r"service\s+agreement", r"consulting\s+agreement", r"professional\s+services",
                           r"statement\s+of\s+work"]),
    ("employment_contract", [r"employment\s+agreement", r"employment\s+contract", r"offer\s+letter",
                             r"job\s+agreement"]),
    ("nda", [r"non.?disclosure\s+agreement", r"confidentiality\s+agreement", r"nda",
             r"secrecy\s+agreement"]),
]


def portable_regex(p: str) -> str:
    """Spell a Python pattern so Java and RE2 match it like Python does: ``\\s`` becomes the
    explicit Unicode whitespace class and ``.`` excludes only ``\\n``."""
    out, i = [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            out.append(WS if p[i + 1] == "s" else p[i:i + 2])
            i += 2
            continue
        out.append("[^\\n]" if ch == "." else ch)
        i += 1
    return "".join(out)


def contract_type_regexes(patterns=CONTRACT_TYPE_PATTERNS):
    return [(label, "|".join(f"(?:{portable_regex(p)})" for p in pats)) for label, pats in patterns]


def contract_type(col, patterns=CONTRACT_TYPE_PATTERNS) -> Column:
    """First rule whose regex is found in lower(text); '.' does not cross newlines."""
    low = F.lower(_c(col))
    out = F.lit("default")
    for label, rx in reversed(contract_type_regexes(patterns)):
        out = F.when(low.rlike(rx), F.lit(label)).otherwise(out)
    return out


def human_size(col) -> Column:
    """Bytes -> '1.5 KB' style: up to 2 decimals, trailing zeros dropped; 0 -> '0 Bytes'."""
    b = _c(col).cast("double")
    i = F.least(F.floor(F.log(1024.0, b)), F.lit(3)).cast("int")
    v = b / F.pow(F.lit(1024.0), i)
    num = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), r"0+$", ""), r"\.$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in ["Bytes", "KB", "MB", "GB"]]), i + 1)
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(F.concat(num, F.lit(" "), unit))


def human_duration(col) -> Column:
    """Whole seconds -> 'Hh Mm Ss'."""
    s = _c(col).cast("bigint")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600).cast("bigint"),
                           F.floor((s % 3600) / 60).cast("bigint"), s % 60)


def processing_time_label(col) -> Column:
    """'12.35s'; null or 0 -> 'N/A'."""
    c = _c(col)
    return F.when(c.isNull() | (c == 0), F.lit("N/A")).otherwise(F.format_string("%.2fs", c.cast("double")))


# Fixed values that must equal the reference: status -> display bucket.
# Review history (case-insensitive): missing -> default, anything unlisted -> warning.
REVIEW_STATUS_BUCKETS = [(["completed"], "success"), (["failed", "error"], "error")]
# Training jobs (exact match): anything unlisted -> default.
JOB_STATUS_BUCKETS = [(["running"], "primary"), (["completed"], "success"), (["failed"], "error"),
                      (["stopped"], "warning")]


def status_bucket(col, rules=REVIEW_STATUS_BUCKETS, other: str = "warning", lower: bool = True) -> Column:
    s = F.lower(_c(col)) if lower else _c(col)
    out = F.lit(other)
    for names, label in reversed(rules):
        out = F.when(s.isin(*names), F.lit(label)).otherwise(out)
    return F.when(_c(col).isNull(), F.lit("default")).otherwise(out)


def word_tokens(col) -> Column:
    """Whitespace tokens with empties removed (Python ``str.split()``)."""
    return F.filter(F.split(_c(col), WS + "+"), lambda x: x != "")


def token_estimate_ws(col) -> Column:
    return F.size(word_tokens(col)).cast("bigint")


def token_estimate_chars(col) -> Column:
    return F.floor(F.length(_c(col)) / 4).cast("bigint")
