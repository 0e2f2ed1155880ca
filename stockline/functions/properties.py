"""Rules for the free-form ``properties`` of an item.

Properties are JSON text at rest. ``true`` and ``"true"`` mean different things to the rules, so a
rule parses the text to map<string, variant>, where each value keeps its type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockline.functions.quality import strip

# Conditions the marketplace accepts.
VALID_CONDITIONS = [
    "Mint",
    "Near Mint",
    "Slightly Played",
    "Moderately Played",
    "Played",
    "Heavily Played",
    "Poor",
]

# Other spellings and the condition they stand for (matched exactly).
CONDITION_ALIASES = {
    "Lightly Played": "Slightly Played",
    "Damaged": "Poor",
    "NM": "Near Mint",
    "SP": "Slightly Played",
    "MP": "Moderately Played",
    "HP": "Heavily Played",
    "PL": "Played",
    "PO": "Poor",
}

# Properties that only the marketplace may set.
READ_ONLY_PROPERTIES = ["mtg_card_colors", "collector_number", "tournament_legal", "cmc", "mtg_rarity"]

# Fields of the item itself, which do not belong among its properties.
TOP_LEVEL_PROPERTIES = ["price", "quantity", "id", "graded", "description", "user_data_field"]

# Properties that hold a flag, and texts that count as true or false.
FLAG_PROPERTIES = ["mtg_foil", "signed", "altered"]
TRUE_TEXTS = ["true", "1", "yes", "on"]
FALSE_TEXTS = ["false", "0", "no", "off", ""]


def parse(properties: Column) -> Column:
    """The members of a JSON object; of a repeated key the last one counts (a session setting). Null if it is
    none."""
    return F.map_from_entries(F.map_entries(F.from_json(properties, "map<string,variant>")))


def is_broken(properties: Column) -> Column:
    """Whether a text is there that is no JSON object."""
    return (~F.coalesce(F.trim(properties), F.lit("")).isin("", "null")) & parse(properties).isNull()


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return _type(value) == "STRING"


def as_text(value: Column) -> Column:
    """The text of a string value; null for every other type."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def _variant(value: Column) -> Column:
    return value.cast("variant")


def canonical_json(properties: Column) -> Column:
    """JSON text with sorted keys, comparable as text."""
    by_key = F.array_sort(
        F.map_entries(parse(properties)),
        lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
    return F.to_json(F.map_from_entries(by_key))


def normalize_condition(text: Column) -> Column:
    """One of the seven conditions, or null."""
    trimmed = strip(text)
    aliases = F.create_map(*[F.lit(x) for pair in CONDITION_ALIASES.items() for x in pair])
    any_case = F.create_map(*[F.lit(x) for c in VALID_CONDITIONS for x in (c.lower(), c)])
    # Valid names and their lower-case aliases are covered by the match that ignores case.
    return F.coalesce(F.element_at(aliases, trimmed), F.element_at(any_case, F.lower(trimmed)))


def _truthy(value: Column) -> Column:
    """Truth of a value that is neither a flag nor text: zero, null and empty are false."""
    kind = _type(value)
    number = F.try_variant_get(value, "$", "double")
    shown = F.to_json(value)
    return (F.when(kind == "VOID", F.lit(False))
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~shown.isin("{}", "[]"))
            .otherwise(F.coalesce(number != 0, F.lit(True))))


def parse_flag(value: Column) -> Column:
    """Boolean of a variant; text that is neither true nor false counts as false."""
    text = F.lower(as_text(value))
    return (F.when(_type(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(text.isNotNull(), text.isin(TRUE_TEXTS)).otherwise(_truthy(value)))


def flag_error(value: Column) -> Column:
    """Whether text holds neither a true nor a false word."""
    return F.coalesce(~F.lower(as_text(value)).isin(TRUE_TEXTS + FALSE_TEXTS), F.lit(False))


def parse_language(text: Column) -> Column:
    """First two letters in lower case; null if there are fewer."""
    trimmed = strip(text)
    return F.when(F.length(trimmed) >= 2, F.lower(F.substring(trimmed, 1, 2)))


def clean_map(values: Column) -> Column:
    """Normalised properties: top-level and read-only keys dropped, invalid conditions and
    languages dropped, flags made boolean, everything else as it is."""
    kept = F.map_filter(values, lambda key, value: (
        ~key.isin(TOP_LEVEL_PROPERTIES + READ_ONLY_PROPERTIES)
        & F.when(key == "condition", normalize_condition(as_text(value)).isNotNull())
        .when(key == "mtg_language", parse_language(as_text(value)).isNotNull())
        .otherwise(F.lit(True))))
    return F.transform_values(kept, lambda key, value: (
        F.when(key == "condition", _variant(normalize_condition(as_text(value))))
        .when(key.isin(FLAG_PROPERTIES), _variant(parse_flag(value)))
        .when(key == "mtg_language", _variant(parse_language(as_text(value))))
        .otherwise(value)))


def clean_properties(properties: Column) -> Column:
    """``clean_map`` on JSON text; absent properties give an empty object."""
    return F.coalesce(F.to_json(clean_map(parse(properties))), F.lit("{}"))


def _shown(value: Column) -> Column:
    """A value as the messages show it."""
    kind = _type(value)
    return (F.when(kind == "VOID", "None")
            .when(kind == "BOOLEAN", F.initcap(F.to_json(value)))
            .when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value)))


def property_errors(properties: Column) -> Column:
    """Messages of the strict check joined by '; ', or null if all is well."""
    conditions = "[" + ", ".join(f"'{c}'" for c in VALID_CONDITIONS) + "]"

    def message(entry: Column) -> Column:
        key, value = entry.key, entry.value
        quoted = F.concat(F.lit("'"), _shown(value), F.lit("'"))
        return (F.when((key == "condition") & normalize_condition(as_text(value)).isNull(),
                       F.concat(F.lit("Invalid condition value: "), quoted,
                                F.lit(f". Valid values: {conditions}")))
                .when(key.isin(FLAG_PROPERTIES) & flag_error(value),
                      F.concat(F.lit("Invalid boolean value for '"), key, F.lit("': "), quoted))
                .when((key == "mtg_language") & parse_language(as_text(value)).isNull(),
                      F.concat(F.lit("Invalid language value: "), quoted,
                               F.lit(". Should be 2-letter code (e.g., 'en', 'it', 'fr')"))))

    found = F.array_compact(F.transform(F.map_entries(parse(properties)), message))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def editable_map(values: Column, include_read_only: bool = False) -> Column:
    """Drop top-level keys, read-only keys and nulls; false flags and empty texts stay."""
    dropped = TOP_LEVEL_PROPERTIES + ([] if include_read_only else READ_ONLY_PROPERTIES)
    return F.map_filter(values, lambda key, value: ~key.isin(dropped) & ~F.is_variant_null(value))


def editable_properties(properties: Column, include_read_only: bool = False) -> Column:
    return F.coalesce(F.to_json(editable_map(parse(properties), include_read_only)), F.lit("{}"))


def outbound_map(values: Column) -> Column:
    """Properties as they are sent out.

    On top of the clean, editable ones: signed and altered are always boolean, and text that is no
    true word is false; a foil flag is sent only if true; a language is cut to two letters even if
    it has only one.
    """
    def key_value(key: Column, value: Column) -> Column:
        language = strip(as_text(value))
        return (F.when(key == "condition", _variant(normalize_condition(as_text(value))))
                .when(key.isin(FLAG_PROPERTIES), _variant(parse_flag(value)))
                .when(key == "mtg_language", _variant(F.lower(F.substring(language, 1, 2))))
                .otherwise(value))

    def sent(key: Column, value: Column) -> Column:
        return (~key.isin(TOP_LEVEL_PROPERTIES + READ_ONLY_PROPERTIES)
                & F.when(key == "condition", normalize_condition(as_text(value)).isNotNull())
                .when(key == "mtg_language", F.coalesce(strip(as_text(value)) != "", F.lit(False)))
                .when(key == "mtg_foil", parse_flag(value))
                .when(key.isin(FLAG_PROPERTIES), F.lit(True))
                .otherwise(~F.is_variant_null(value)))

    return F.transform_values(F.map_filter(values, sent), key_value)


def merge_properties(old: Column, patch: Column) -> Column:
    """Key-wise merge of two JSON texts: values of the patch win unless they are null. An old text that
    is no JSON object stays as it is."""
    merged = F.map_zip_with(
        F.coalesce(parse(old), parse(F.lit("{}"))), parse(patch),
        lambda key, before, after: F.when(after.isNull() | F.is_variant_null(after), before).otherwise(after))
    return F.when(is_broken(old), old).otherwise(F.to_json(F.map_filter(merged, lambda key, value: value.isNotNull())))
