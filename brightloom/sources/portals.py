"""Captured portal responses as rows: nested lists and details, encrypted envelopes, embedded articles."""

from __future__ import annotations

import base64
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def with_details(listed: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Details win over the list where they have a value; a listed row without details stays."""
    d = details.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = listed.join(d, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in listed.columns])


def positions(notices: DataFrame, col: str, schema: str) -> DataFrame:
    """One row per position of a notice, or one with null position if it has none."""
    items = F.from_json(col, f"array<struct<{schema}>>")
    return notices.withColumn("position", F.explode_outer(items))


def unique_candidates(found: DataFrame, key: str, position: str) -> DataFrame:
    """The first of the results with one key over all queries."""
    return found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), position).alias("r")).select(key, "r.*")


def flattened_names(values: Column) -> Column:
    """Nested arrays of names as one ordered list without repeats, joined."""
    return F.array_join(F.array_distinct(F.filter(F.flatten(values), lambda x: F.trim(x) != "")), "、")


def decrypted(payload: Column, key: Column, iv: Column) -> Column:
    """AES-CBC with PKCS padding of a base64 payload; null where it can't be read. Spark takes the vector in front."""
    return F.try_aes_decrypt(F.concat(iv.cast("binary"), F.try_to_binary(payload, F.lit("base64"))), key.cast("binary"), F.lit("CBC"), F.lit("PKCS")).cast("string")


#: Where a page hands its packed article to the script that unpacks it, and the mark before the article.
VIEW_MARK = r"^view\d+d\s*"
PACKED = r"""Base64\.decode\s*\(\s*unzip\s*\(\s*["']([^"']+)["']"""


@pandas_udf(T.StringType())
def embedded_article(packed: pd.Series) -> pd.Series:
    """base64 of zlib of a word and base64 of text; a view marker before the text is dropped.

    Null for anything else. zlib has no built-in function.
    """

    def read(x: str | None) -> str | None:
        try:
            _, inner = zlib.decompress(base64.b64decode(x, validate=True)).decode().split(None, 1)
            article = base64.b64decode(inner, validate=True).decode()
            return re.sub(VIEW_MARK, "", article).strip() or None
        except (ValueError, TypeError, IndexError, zlib.error):
            return None

    return packed.map(read)


#: Places that name none.
NO_PLACES = ("multi-location", "multiple locations")


def location_evidenced(location: Column, body: Column) -> Column:
    """Any comma-separated token of the location stands in the text, whatever the case; a location of no place needs no evidence."""
    named = F.filter(F.transform(F.split(F.lower(location), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin(*NO_PLACES))
    return F.coalesce((F.size(named) == 0) | F.exists(named, lambda p: F.contains(F.lower(body), p)), F.lit(False))
