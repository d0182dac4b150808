"""Dynamic values, kept as VARIANT: typed reads along a path, names of types and tests by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of types in predicates, by the name that a variant's schema has; fixed values.
NAMES = {
    "bool": {"BOOLEAN"},
    "boolean": {"BOOLEAN"},
    "int": {"BIGINT"},
    "integer": {"BIGINT"},
    "string": {"STRING"},
    "binary": {"BINARY"},
    "date": {"TIMESTAMP", "TIMESTAMP_NTZ", "DATE"},
    "timestamp": {"TIMESTAMP", "TIMESTAMP_NTZ", "DATE"},
    "float": {"FLOAT"},
    "double": {"DOUBLE", "DECIMAL"},
    "decimal": {"DECIMAL"},
    "uuid": {"UUID"},
    "null": {"VOID"},
    "numeric": {"BIGINT", "DOUBLE", "FLOAT", "DECIMAL"},
    "collection": {"ARRAY", "OBJECT"},
    "array": {"ARRAY"},
    "list": {"ARRAY"},
    "object": {"OBJECT"},
    "dictionary": {"OBJECT"},
}


def json_path(steps: list) -> str:
    out = "$"
    for s in steps:
        if isinstance(s, tuple):
            out += f"[{s[1]}]" if s[0] == "index" else "['" + s[1].replace("'", "\\'") + "']"
        else:
            out += "['" + s.replace("'", "\\'") + "']"
    return out


def read(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def type_name(v: Column) -> Column:
    """Upper-case name of a variant's type without its arguments; null values are VOID and missing ones null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z_]+)", 1)


def has_type(v: Column, name: str) -> Column:
    return F.coalesce(type_name(v).isin(*sorted(NAMES[name.lower()])), F.lit(False))
