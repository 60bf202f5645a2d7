"""Guards that keep missing apart from zero, and small numeric helpers.

Native values are VARIANT columns (``try_parse_json``), since neither casts nor
``from_json`` tell 5 from "5" and true from 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def native(raw: str | Column, path: str) -> Column:
    """The value at ``path`` of a JSON text, as VARIANT; null where the text isn't JSON."""
    return F.try_variant_get(F.try_parse_json(raw), path, "variant")


def counter(value: Column) -> Column:
    """A counter: integers and whole floats of at least 0; strings, booleans and fractions are null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = (kind == "BIGINT") | ((kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & (number == F.floor(number)))
    return F.when(whole & (number >= 0), F.try_variant_get(value, "$", "bigint"))


def amount(value: Column) -> Column:
    """A cost: any number of at least 0."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when((kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")) & (number >= 0), number)


def label(value: Column) -> Column:
    """A string without white space at its ends; empty ones and other types are null."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.nullif(stripped(text), F.lit(""))


def stripped(text: Column) -> Column:
    """Without any white space at the ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def finite(number: Column, least: float = 0.0, strict: bool = False) -> Column:
    """The number if it is finite and at least (``strict``: more than) ``least``."""
    low = number > least if strict else number >= least
    return F.when(low & ~F.isnan(number) & (number < float("inf")), number)


def duration_ms(number: Column) -> Column:
    return finite(number, strict=True)


def token_rate(tokens: Column, ms: Column) -> Column:
    """Tokens a second; null without a valid duration."""
    held = duration_ms(ms.cast("double"))
    return finite(tokens * 1000 / held)


def sum_present(*values: Column) -> Column:
    """Sum of the values that are there; null only if none is."""
    total = sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0))
    return F.when(F.coalesce(*values).isNotNull(), total)


def effective_time(event_s: Column, file_s: Column) -> Column:
    """The event's own time if the file was touched over an hour later."""
    return F.when(event_s.isNull() | (file_s - event_s <= 3600), file_s).otherwise(event_s)
