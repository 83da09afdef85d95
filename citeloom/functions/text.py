"""Column functions on strings: normalisation, matching, labels, redaction. Regular expressions are Unicode-aware."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(c: Column, kind: str = "string") -> Column:
    """Null, '' or 0, and [] for arrays: never null itself."""
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == (F.lit("") if kind == "string" else F.lit(0)))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_text(c: Column) -> Column:
    """Lower case, everything but word characters to spaces, spaces collapsed, stripped; accents stay."""
    return F.trim(squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_\s]", " ")))


def normalize_title(c: Column) -> Column:
    """Lower case ASCII letters and digits; spaces collapsed but not stripped, as edge spaces count in comparisons."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " ")


def tokens(c: Column) -> Column:
    """White-space tokens; [] for empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def strict_match(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def soft_match(a: Column, b: Column) -> Column:
    return F.coalesce((normalize_text(a) == normalize_text(b)) & (a != "") & (b != ""), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def last_names(authors: Column) -> Column:
    """The lower-case last white-space token of each name that has one."""
    last = F.transform(F.filter(authors, lambda a: F.trim(a) != ""), lambda a: F.lower(F.element_at(F.split(F.trim(squeeze(a)), " "), -1)))
    return F.array_distinct(last)


def author_match(a: Column, b: Column, least: float = 0.75) -> Column:
    return F.coalesce(jaccard(last_names(a), last_names(b)) >= least, F.lit(False))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"\b(19|20)\d{2}\b", 0), F.lit(""))


def year_match(a: Column, b: Column) -> Column:
    return F.coalesce(first_year(a) == first_year(b), F.lit(False))


def bare_identifier(c: Column) -> Column:
    """An identifier in lower case without resolver prefix and version."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://)?(dx\.)?(doi\.org/|arxiv\.org/(abs|pdf)/)|^(doi|arxiv):\s*", "")
    return F.regexp_replace(s, r"v\d+$", "")


def identifier_match(a: Column, b: Column) -> Column:
    return F.coalesce((bare_identifier(a) == bare_identifier(b)) & (bare_identifier(a) != ""), F.lit(False))


ARXIV_ID = r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"


def arxiv_id(*columns: Column) -> Column:
    """The first arXiv id in the columns, in their order."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, ARXIV_ID, 1), F.lit("")) for c in columns])


def without_version(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


@F.udf(T.DoubleType(), useArrow=True)
def sequence_ratio(a: str, b: str) -> float:
    """Ratio of matching blocks of two lower-case texts (Ratcliff and Obershelp); null if one is null or empty."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else None


def ratio_match(a: Column, b: Column, least: float) -> Column:
    """At least `least` in sequence_ratio; 0.80 for the lenient match, 0.95 for the strict one."""
    return F.coalesce(sequence_ratio(a, b) >= least, F.lit(False))


#: Canonical label names of the four-level scheme, by code.
LABELS = ["SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "UNCERTAIN"]
#: Other names of the labels.
LABEL_ALIASES = {"PARTIALLY": "PARTIALLY_SUPPORTED", "REFUTED": "UNSUPPORTED", "NEI": "UNCERTAIN", "NOT_ENOUGH_INFO": "UNCERTAIN", "UNSURE": "UNCERTAIN"}


def label_name(c: Column) -> Column:
    """The canonical name of a label given as code, digit string, name or alias; unknown labels are UNCERTAIN."""
    s = F.upper(F.trim(c.cast("string")))
    by_code = F.create_map(*[F.lit(x) for i, n in enumerate(LABELS) for x in (str(i), n)])
    aliases = F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])
    return F.coalesce(by_code[s], F.when(s.isin(LABELS), s), aliases[s], F.lit("UNCERTAIN"))


def label_code(c: Column) -> Column:
    """0 to 3, or null for a label that is none."""
    s = F.upper(F.trim(c.cast("string")))
    codes = {**{str(i): i for i in range(4)}, **{n: i for i, n in enumerate(LABELS)}, **{a: LABELS.index(n) for a, n in LABEL_ALIASES.items()}}
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[s]


#: Patterns of secrets and what replaces them, in the order of application: names of keys, bearers and tokens, well-known forms, addresses.
SECRETS = [
    (r"(?i)\b(\w*api[_-]?key['\"\s:=]+)[a-z0-9_\-]{8,}", "$1[REDACTED]"),
    (r"(?i)\b(bearer\s+)[a-z0-9._\-]{8,}", "$1[REDACTED]"),
    (r"(?i)\b(authorization['\"\s:=]+)(?!bearer)[^\s'\"]+", "$1[REDACTED]"),
    (r"(?i)\bsk-[a-z0-9_\-]{16,}", "[REDACTED]"),
    (r"\bAIza[A-Za-z0-9_\-]{35}", "[REDACTED]"),
    (r"(?i)\bgh[pousr]_[a-z0-9]{20,}", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"(?i)\b((?:access[_-]?)?token['\"\s:=]+)[a-z0-9._\-]{8,}", "$1[REDACTED]"),
    (r"(?i)\b(secret['\"\s:=]+)[a-z0-9_\-]{8,}", "$1[REDACTED]"),
    (r"(?i)\b(password['\"\s:=]+)[^\s'\"]+", "$1[REDACTED]"),
    (r"(?i)\b(https?://[^\s/@:]+:)[^\s/@]+(@)", "$1[REDACTED]$2"),
]


def redact(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), SECRETS, c)


def error_category(c: Column) -> Column:
    """A plain category for a message, by its first matching marker."""
    low = F.lower(c)
    rules = [
        ("rate limit", ["rate limit", "429", "too many requests"]), ("authentication", ["401", "403", "unauthorized", "api key", "forbidden"]),
        ("timeout", ["timeout", "timed out"]), ("network", ["connection", "network", "unreachable"]), ("not found", ["404", "not found"]),
        ("parsing", ["json", "parse", "decode"]),
    ]
    out = F.lit("other")
    for name, markers in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(m) for m in markers]), name).otherwise(out)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit("none")).otherwise(out)


RETRYABLE = r"(?i)(429|rate limit|timeout|timed out|temporarily|unavailable|502|503|504|connection reset|overloaded|try again)"


def is_retryable(c: Column) -> Column:
    return F.coalesce(c.rlike(RETRYABLE), F.lit(False))


def claim_text(c: Column) -> Column:
    """A claim without citation marks, its spaces collapsed and its edges freed from punctuation."""
    s = F.regexp_replace(c, r"(?i)\[CITATION\]|<cit[^>]*>|\(cit[^)]*\)", " ")
    return F.regexp_replace(F.trim(squeeze(s)), r"^[\s,;:.\-]+|[\s,;:.\-]+$", "")


def safe_filename(c: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._\-]+", "_"), r"^_+|_+$", ""), 1, most)


def enforce_marker(c: Column, marker: str = "[CITATION]") -> Column:
    """The claim without enclosing quotes; the marker is appended if it is missing."""
    s = F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    return F.when(s.contains(marker), s).otherwise(F.concat(F.rtrim(F.regexp_replace(s, r"[.\s]+$", "")), F.lit(f" {marker}.")))


def replace_first(text: Column, part: Column, by: Column) -> Column:
    """text with the first occurrence of part replaced; null where part does not occur."""
    at = F.position(part, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), by, F.substr(text, at + F.length(part))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))


def ligatures(c: Column) -> Column:
    """Ligatures spelled out, words joined that a line end had parted, control characters removed."""
    s = c
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"([a-z])-\r?\n([a-z])", "$1$2")
    return F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def isbn13(isbn10: Column) -> Column:
    """ISBN-10 to ISBN-13 with its check digit; null if it has not nine digits and a check character."""
    d = F.regexp_replace(isbn10, r"[\s\-]", "")
    body = F.concat(F.lit("978"), F.substring(d, 1, 9))
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substr(body, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda s, x: s + x)
    return F.when(d.rlike(r"^\d{9}[\dXx]$"), F.concat(body, ((10 - total % 10) % 10).cast("string")))


def seeded(n: Column | int, *parts: Column) -> Column:
    """A number from 0 to n - 1 by the MD5 of the parts: the same in every engine and run."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n)).cast("int")
