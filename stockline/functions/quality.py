"""Row quality rules and the job that splits good rows from bad ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters the rules count as white space.
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
         "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def canonical_uuid(text: Column) -> Column:
    """Hyphenated lower-case form, or null. Braces, ``urn:uuid:`` and missing hyphens are accepted."""
    # Most ids are in this form already, which one look tells.
    done = text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z")
    bare = F.regexp_replace(F.regexp_replace(text, "urn:", ""), "uuid:", "")
    digits = F.lower(F.regexp_replace(F.regexp_replace(bare, r"^[{}]+|[{}]+$", ""), "-", ""))
    hyphenated = F.regexp_replace(
        digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(done, text).when(digits.rlike("^[0-9a-f]{32}$"), hyphenated)


def same_owner(left: Column, right: Column) -> Column:
    """Equal as UUIDs if both are UUIDs, else equal as text."""
    a, b = canonical_uuid(left), canonical_uuid(right)
    return F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(F.coalesce(left == right, F.lit(False)))


# The texts of the errors below.
def _uuid_error(name: str) -> Column:
    return F.when(canonical_uuid(F.col(name)).isNull(), f"Invalid {name} format: must be a valid UUID")


def _blueprint_error(name: str) -> Column:
    return (F.when(F.col(name).isNull(), f"{name} must be an integer")
            .when(F.col(name) <= 0, f"{name} must be positive"))


def stock_id(text: Column) -> Column:
    """Trimmed stock id; blank is null."""
    trimmed = strip(text)
    return F.when(trimmed != "", trimmed)


def _stock_id_error(name: str) -> Column:
    value = stock_id(F.col(name))
    return F.when(value.isNotNull() & ~value.rlike(r"^\p{Nd}+$"), f"{name} must be numeric")


def _not_negative_error(name: str) -> Column:
    return F.when(F.col(name) < 0, f"{name} must be >= 0")


RULES = {
    "uuid": _uuid_error,
    "blueprint_id": _blueprint_error,
    "stock_id": _stock_id_error,
    "quantity": _not_negative_error,
    "price": _not_negative_error,
}


# What a rule makes of a good value; the other rules leave it as it is.
NORMAL_FORMS = {"uuid": canonical_uuid, "stock_id": stock_id}


def with_errors(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Add ``errors``, an array of (field, message, value), from column -> rule name."""
    checks = []
    for name, rule in rules.items():
        message = RULES[rule](name)
        checks.append(F.when(message.isNotNull(), F.struct(
            F.lit(name).alias("field"), message.alias("message"), F.col(name).cast("string").alias("value"))))
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def validate_rows(rows: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows in normal form, quarantined rows as they came with their errors)."""
    checked = with_errors(rows, rules)
    bad = F.size("errors") > 0
    normal = {name: NORMAL_FORMS[rule](F.col(name)) for name, rule in rules.items() if rule in NORMAL_FORMS}
    return checked.where(~bad).drop("errors").withColumns(normal), checked.where(bad)
