"""Scalar functions: Columns in, Columns out, all inside whole-stage code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Validation patterns by name (fixed values); addresses of hosts are checked by ``is_ip``.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[0-9\s()-]+$",
    "url": r"^https?://\S+$",
    "card": r"^[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}$",
    "postal": r"^[0-9]{5}([\s-][0-9]{4})?$",
}
TOKEN = r"[\p{L}\p{N}]+"


def is_ip(text: Column) -> Column:
    """Four groups of one to three digits between dots, none above 255; null for null."""
    parts = F.split(text, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda x: x.rlike("^[0-9]{1,3}$") & (x.try_cast("int") <= 255))


def is_valid(kind: str, text: Column) -> Column:
    """Whether a text is a valid email, phone, url, ip, card or postal code."""
    return is_ip(text) if kind == "ip" else text.rlike(PATTERNS[kind])


def normalise(text: Column) -> Column:
    """Small letters, no punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Texts between ends of sentences; empty ones go."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    # not F.trim itself: transform would hand it the index as the characters to trim
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def fill_template(template: Column, values: Column) -> Column:
    """Replace {{key}} by the values of a map."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def short_hash(value: Column, size: int = 16) -> Column:
    """The first hex digits of a value's sha256."""
    return F.substring(F.sha2(value, 256), 1, size)


def parse_date(text: Column) -> Column:
    """The first that fits of 2024-01-31, 31.01.2024 and 01/31/2024 anywhere in a text."""
    found = [(r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"), (r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", "dd.MM.yyyy"),
        (r"([0-9]{2}/[0-9]{2}/[0-9]{4})", "MM/dd/yyyy")]
    return F.coalesce(*[F.try_to_timestamp(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(f)) for p, f in found]).cast("date")


def time_slot(ts: Column) -> Column:
    """morning 6-11, afternoon 12-17, evening 18-22, else night."""
    h = F.hour(ts)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 22), "evening").otherwise("night")


def recency(days: Column) -> Column:
    """1, .8, .6, .4 for under 7, 30, 90, 365 days, else .2; the future too is .2."""
    return F.when(days < 0, 0.2).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).when(days < 365, 0.4).otherwise(0.2)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def severity(confidence: Column) -> Column:
    """critical, high, medium from .95, .9, .75; else low."""
    return F.when(confidence >= 0.95, "critical").when(confidence >= 0.9, "high").when(confidence >= 0.75, "medium").otherwise("low")


#: What follows from a severity (fixed values): level of escalation, hours to respond, action.
ESCALATION = {"critical": ("executive", 1, "block and investigate"), "high": ("management", 4, "review by an expert"),
    "medium": ("team", 24, "manual check"), "low": ("log", 168, "watch")}


def escalation(level: Column, field: int) -> Column:
    """A field of ESCALATION by severity: 0 level, 1 hours, 2 action."""
    return F.create_map(*[F.lit(x) for k, v in ESCALATION.items() for x in (k, v[field])])[level]


def pseudo_embedding(text: Column, size: int = 32) -> Column:
    """Bytes of the sha256 of a text, divided by 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def resource_cost(cpu: Column, memory: Column, gpu: Column) -> Column:
    """0.05 per CPU, 0.01 per GB of memory and 0.5 per GPU."""
    return cpu * 0.05 + memory * 0.01 + gpu * 0.5


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness as an aggregate."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis as an aggregate."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))
