"""Free-form JSON as variants: parsed once, stored as it is, read by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col


def parsed(text: Column | str) -> Column:
    """The text as a variant; null where it is null or no JSON."""
    return F.try_parse_json(_col(text))


def at(variant: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``a.b[0].c`` as ``kind``; null where a level is missing or JSON's null, or the
    value can't be read so."""
    return F.try_variant_get(_col(variant), f"$.{path}", kind)


def kind(variant: Column | str) -> Column:
    """OBJECT, ARRAY, or the kind of a scalar as Spark names it; null for none."""
    return F.regexp_extract(F.schema_of_variant(_col(variant)), r"^[A-Z]+", 0)


def lookup(configs: DataFrame, column: str, defaults: dict[str, tuple[str, str]]) -> DataFrame:
    """``configs`` with a column for each of ``defaults``: name -> (path, value if there is none), as strings.

    ``column`` holds JSON text or a variant."""
    held = configs.schema[column].dataType.simpleString()
    v = F.col(column) if held == "variant" else parsed(column)
    made = {name: F.coalesce(at(v, path), F.lit(value)) for name, (path, value) in defaults.items()}
    return configs.withColumns(made)
