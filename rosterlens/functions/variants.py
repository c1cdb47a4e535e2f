"""Loosely typed JSON as VARIANT: parsed once, then read as text, list or object, whichever it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import STRINGS, let, strings


def outermost_object(raw: Column) -> Column:
    """The text from the first brace to the last, code fences removed; null if there is none."""
    bare = F.regexp_replace(raw, "```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def parse(raw: Column) -> Column:
    """The outermost object of a text as a variant; null for broken or other text, and for more than one object."""
    # As the only item of a list, so that what stands behind the object is an error.
    only = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    return let(F.try_parse_json(F.concat(F.lit("["), outermost_object(raw), F.lit("]"))), only)


def kind(value: Column, path: str = "$") -> Column:
    """"list", "object" or "scalar"; null where there is nothing or a null."""
    at = F.try_variant_get(value, path, "variant")
    name = F.schema_of_variant(at)
    return F.when(at.isNull() | F.is_variant_null(at), None).when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object").otherwise("scalar")


def text(value: Column, path: str) -> Column:
    """A scalar as text, the first item of a list, the ``name`` of an object or else its JSON; null for nothing."""
    first = F.try_variant_get(value, f"{path}[0]", "string")
    named = F.coalesce(F.try_variant_get(value, f"{path}.name", "string"), F.try_variant_get(value, path, "string"))
    return let(kind(value, path), lambda k: F.when(k == "list", first).when(k == "object", named).otherwise(F.try_variant_get(value, path, "string")))


def items(value: Column, path: str) -> Column:
    """A list's items as texts, without nulls; a scalar or an object is a list of one; empty for nothing."""
    one = text(value, path)
    listed = F.filter(F.try_variant_get(value, path, "array<variant>"), lambda v: v.isNotNull() & ~F.is_variant_null(v))
    of_item = lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"))
    return let(kind(value, path), lambda k: F.when(k == "list", F.transform(listed, of_item)).when(k.isNull(), strings(())).otherwise(F.array(one))).cast(STRINGS)


def schema(df: DataFrame, value: Column) -> DataFrame:
    """One row: the schema that all rows' values fit."""
    return df.agg(F.schema_of_variant_agg(value).alias("schema"))
