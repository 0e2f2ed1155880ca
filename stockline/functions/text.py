"""Cleaning rules for free text, and the job that applies them to whole tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.functions.quality import strip

# Markup removed by the basic rule, in this order.
BASIC_MARKUP = ["<script", "javascript:", "onerror=", "onload="]

# Markup removed by the full rule, in this order (dot matches all, any case).
FULL_MARKUP = [
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on[\p{L}\p{N}_]+[\s\x1c-\x1f\x{85}\p{Z}]*=",
    r"vbscript:",
    r"data:text/html",
]

# Patterns that look like an attempt at SQL injection.
SQL_PATTERNS = [
    r"';?\s*(DROP|DELETE|UPDATE|INSERT|ALTER|CREATE|EXEC|EXECUTE)",
    r"UNION\s+SELECT",
    r"--",
    r"/\*",
    r"\*/",
]


def _cut(text: Column, max_length: int | None) -> Column:
    return F.substring(text, 1, max_length) if max_length else text


def scrub_text(text: Column, max_length: int | None = None) -> Column:
    """Trim (blank is null), cut, then remove basic markup in one pass."""
    trimmed = strip(text)
    start = _cut(F.when(trimmed != "", trimmed), max_length)
    lower = F.lower(start)
    result = start
    for pattern in BASIC_MARKUP:
        result = F.when(F.contains(lower, F.lit(pattern)),
                        F.regexp_replace(result, f"(?iu){pattern}", "")).otherwise(result)
    return result


def scrub_markup(text: Column, max_length: int | None = None) -> Column:
    """Trim (blank is null), remove NULs and markup, then cut. The result may be empty."""
    trimmed = strip(text)
    result = F.regexp_replace(F.when(trimmed != "", trimmed), r"\x00", "")
    for pattern in FULL_MARKUP:
        result = F.regexp_replace(result, f"(?isu){pattern}", "")
    return _cut(result, max_length)


def path_error(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("..")) | F.startswith(path, F.lit("/")), "Path traversal detected")


def clean_path(path: Column) -> Column:
    """Normalised relative path, or null where ``path_error`` has a message."""
    slashed = F.replace(F.regexp_replace(path, r"\x00", ""), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda part: (part != "") & (part != "."))
    return F.when(path_error(path).isNull(), F.array_join(parts, "/"))


def flag_sql_patterns(text: Column) -> Column:
    """Whether any of the suspicious patterns occurs."""
    upper = F.upper(text)
    found = F.lit(False)
    for pattern in SQL_PATTERNS:
        found = found | upper.rlike(f"(?iu){pattern}")
    return found


def percent_encode(text: Column) -> Column:
    """RFC 3986 quoting in which only letters, digits and ``_.-~`` stay."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """Undo ``percent_encode``; a percent sign that starts no escape stays as it is."""
    escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))), text)


TEXT_RULES = {
    "scrub_text": scrub_text,
    "scrub_markup": scrub_markup,
    "clean_path": clean_path,
    "percent_encode": percent_encode,
    "percent_decode": percent_decode,
}


def clean_text_columns(rows: DataFrame, rules: Mapping[str, str | tuple[str, int]]) -> DataFrame:
    """Apply a rule per column, e.g. ``{"html": "scrub_markup", "title": ("scrub_text", 200)}``."""
    cleaned = {}
    for column, rule in rules.items():
        name, *limit = (rule,) if isinstance(rule, str) else rule
        cleaned[column] = TEXT_RULES[name](F.col(column), *limit)
    return rows.withColumns(cleaned)
