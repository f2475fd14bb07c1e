"""JSON attributes as VARIANT columns: storage classes, projection and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"


def kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def is_container(t: Column) -> Column:
    return F.startswith(t, F.lit("ARRAY")) | F.startswith(t, F.lit("OBJECT"))


# The storage classes of a variant as SQL text; ``x`` names a column or lambda variable.


def field_sql(attributes: str, name: str) -> str:
    """Value of one top-level key, dots and dashes included; null where it is missing. ``name`` must be checked."""
    return f"variant_get({attributes}, '$[\"{name}\"]', 'variant')"


def number_sql(x: str) -> str:
    """Numeric storage class: numbers, and booleans as 1 and 0; null for everything else."""
    return (
        f"case when schema_of_variant({x}) = 'BOOLEAN' then if(try_variant_get({x}, '$', 'boolean'), 1.0D, 0.0D)"
        f" when {_is_number(x)} then try_variant_get({x}, '$', 'double') end"
    )


def _is_number(x: str) -> str:
    return f"(schema_of_variant({x}) in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith(schema_of_variant({x}), 'DECIMAL'))"


def text_sql(x: str) -> str:
    """Text storage class: strings, and arrays and objects as minified JSON; null for everything else."""
    kind = f"schema_of_variant({x})"
    return (
        f"case when {kind} = 'STRING' then try_variant_get({x}, '$', 'string')"
        f" when startswith({kind}, 'ARRAY') or startswith({kind}, 'OBJECT') then to_json({x}) end"
    )


def as_text_sql(x: str) -> str:
    """What pattern matching sees: text, 1 or 0 for booleans, the digits of numbers."""
    return (
        f"coalesce({text_sql(x)}, case when schema_of_variant({x}) = 'BOOLEAN' then if(try_variant_get({x}, '$', 'boolean'), '1', '0')"
        f" when {_is_number(x)} then to_json({x}) end)"
    )


def elements_sql(x: str) -> str:
    """Elements of an array, values of an object, a scalar itself; empty for null and missing."""
    kind = f"schema_of_variant({x})"
    return (
        f"case when startswith({kind}, 'ARRAY') then try_variant_get({x}, '$', 'array<variant>')"
        f" when startswith({kind}, 'OBJECT') then map_values(try_variant_get({x}, '$', '{MAP}'))"
        f" when {kind} is null or {kind} = 'VOID' then cast(array() as array<variant>) else array({x}) end"
    )


def as_map(attrs: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(attrs), "$", MAP), F.from_json(F.lit("{}"), MAP))


def pick(attrs: str, names: list[str]) -> Column:
    """JSON object of the named keys that are there, JSON nulls included."""
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.to_json(F.map_filter(as_map(F.col(attrs)), lambda k, v: F.array_contains(wanted, k)))


def merged(attrs: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects: keys of ``patch`` win, keys that it sets to null go; other stored nulls stay."""
    old, new = as_map(attrs), as_map(patch)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    # A key maps to a variant null, not to SQL NULL.
    given = F.map_filter(new, lambda k, v: ~F.is_variant_null(v))
    return F.to_json(F.map_concat(kept, given))


def scalar_keys(attrs: str) -> Column:
    """Keys whose values are strings, numbers or booleans."""
    scalars = F.map_filter(as_map(F.col(attrs)), lambda k, v: ~F.coalesce(is_container(kind(v)) | (kind(v) == "VOID"), F.lit(True)))
    return F.map_keys(scalars)
