"""Values of JSON documents however deep they lie, as VARIANT columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text

#: Where a portal's job says its place, what names a part of it, and the parts in order where no name is given.
PLACE_KEYS = ("locations", "location", "workLocation", "workplace", "workPlace", "city", "address", "place")
NAME_KEYS = ("name", "label")
PART_KEYS = ("country", "province", "city", "district")


def members_of(v: Column) -> Column:
    """The members of a list, null for what is none."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields_of(v: Column) -> Column:
    """The fields of an object, null for what is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))


def shown(v: Column) -> Column:
    """A value's text, empty for null, false, zero and lists or objects without members; a text that reads like one of these stays."""
    said = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    none = F.coalesce(said, F.lit("null")).isin("null", "false", "0", "0.0", "[]", "{}") & (F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "STRING")
    return F.when(none, F.lit("")).otherwise(text.clean(said))


def value_at(v: Column, path: str) -> Column:
    """The value at a dotted path, keys taken as they are; null where a part is missing or no object, and for JSON's null."""
    for key in path.split("."):
        v = F.try_element_at(fields_of(v), F.lit(key))
    return F.when(~F.is_variant_null(v), v)


def _opened(v: Column, names: Sequence[str], parts: Sequence[str]) -> Column:
    """One level: a list's members, an object's name or else its parts, a text itself; of other values nothing."""
    fields = fields_of(v)
    named = F.array_compact(F.array(*[F.nullif(shown(F.try_element_at(fields, F.lit(n))), F.lit("")) for n in names]))
    inside = F.array_compact(F.array(*[F.try_element_at(fields, F.lit(p)) for p in parts]))
    none = F.array().cast("array<variant>")
    return (
        F.when(members_of(v).isNotNull(), F.filter(members_of(v), lambda x: x.isNotNull()))
        .when(fields.isNotNull(), F.when(F.size(named) > 0, F.array(F.get(named, 0).cast("variant"))).otherwise(inside))
        .when(_string(v).isNotNull(), F.array(v)).otherwise(none)
    )


def names_in(values: Column, depth: Column | int, names: Sequence[str] = NAME_KEYS, parts: Sequence[str] = PART_KEYS) -> Column:
    """The texts in an array of variants in their order, each once: lists and objects are opened in place, one level a step, `depth` times."""
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(depth) if isinstance(depth, int) else depth))
    flat = F.aggregate(levels, values, lambda done, _: F.flatten(F.transform(done, lambda v: _opened(v, names, parts))))
    return F.array_distinct(F.filter(F.transform(flat, lambda v: text.clean(_string(v))), lambda x: x != ""))


def place_of(document: Column, keys: Sequence[str] = PLACE_KEYS, between: str = "、") -> Column:
    """All places that a job's JSON text names, joined; null if it names none or is no JSON object.

    A value lies no deeper than its text has opening brackets, so that many levels are opened: none is left out, and
    each takes one pass over the values.
    """
    job = F.try_parse_json(document)
    values = F.array_compact(F.array(*[F.try_element_at(fields_of(job), F.lit(k)) for k in keys]))
    brackets = lambda v: F.length(F.regexp_replace(F.to_json(v), r"[^\[{]", ""))
    deepest = F.array_max(F.transform(values, brackets)) + 1
    return F.nullif(F.array_join(names_in(values, F.coalesce(deepest, F.lit(1))), between), F.lit(""))


def items(df: DataFrame, col: str, path: str, fields: dict[str, str], out_position: str = "item") -> DataFrame:
    """One row an item of the list at a dotted path of a JSON text, from 1, with the texts at dotted paths in it; what is missing is null.

    A document that is no JSON, or has no list there, has no row.
    """
    listed = members_of(value_at(F.try_parse_json(F.col(col)), path) if path else F.try_parse_json(F.col(col)))
    rows = df.select("*", F.posexplode(listed).alias(out_position, "__item")).withColumn(out_position, F.col(out_position).cast("long") + 1)
    # an item is opened once for all of its fields, and each value found once for both of its forms
    rows = rows.withColumn("__fields", fields_of(F.col("__item")))

    def at(p: str) -> Column:
        first, _, rest = p.partition(".")
        v = F.try_element_at("__fields", F.lit(first))
        return value_at(v, rest) if rest else F.when(~F.is_variant_null(v), v)

    found = rows.select(*df.columns, out_position, *[at(p).alias(f"__value_{k}") for k, p in fields.items()])
    said = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return found.select(*df.columns, out_position, *[said(F.col(f"__value_{k}")).alias(k) for k in fields])
