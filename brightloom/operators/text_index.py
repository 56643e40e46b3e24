"""Keyword search by an index of trigrams: which rows can hold a needle is looked up, and only those are read and tested.

The index has a row for each row and distinct trigram of its lower-cased texts, in folders by a hash of the trigram and sorted by it, so
a look-up reads the row groups of a few trigrams. Trigrams never cross from one text into the next. A needle is asked for by its rarest
trigrams, and the rows that have all of them are tested exactly: the answer is the scan's. A needle with a wildcard, or of under three
characters, has no trigram to ask for, and is a scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text

FOLDERS = 64
#: So many trigrams of a needle are asked for, the rarest.
ASKED = 4


def trigrams(value: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text; none for null. The text is cut once, so long ones take time in proportion."""
    chars = F.filter(F.split(F.lower(value), ""), lambda c: c != "")
    three = F.transform(F.array(chars), lambda cs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - 2, F.lit(1))), lambda i: F.concat(F.get(cs, i - 1), F.get(cs, i), F.get(cs, i + 1))))
    return F.array_distinct(F.filter(F.coalesce(F.get(three, 0), F.array().cast("array<string>")), lambda g: g.isNotNull()))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Writes the index of the columns' texts by a key of the rows. Frequent trigrams go to as many tasks as there are salts."""
    every = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in columns])))
    rows = df.select(F.col(key).alias("key"), F.explode(every).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    salt = F.pmod(F.xxhash64("key"), F.lit(8))
    rows.repartition("folder", salt).sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(path)


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """The keys of the rows that have the needle's rarest trigrams; None where the needle has none to ask for."""
    if len(needle) < 3 or re.search(r"[%_\\]", needle):
        return None
    # the needle is cut by the same function as the texts, so that both are folded alike
    grams = [r[0] for r in spark.range(1).select(F.explode(trigrams(F.lit(needle)))).collect()]
    if not grams:
        return None
    index = spark.read.schema("key " + spark.read.parquet(path).schema["key"].dataType.simpleString() + ", gram string, folder int").parquet(path)
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    rows = index.filter(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    found = {r.gram: r.n for r in rows.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rarest = sorted(grams, key=lambda g: (found.get(g, 0), g))[:ASKED]
    held = rows.filter(F.col("gram").isin(rarest)).groupBy("key").agg(F.count_distinct("gram").alias("n"))
    return held.filter(F.col("n") == len(rarest)).select("key")


def search(df: DataFrame, key: str, columns: list[str], path: str, needle: str) -> DataFrame:
    """The rows of which some column holds the needle, as text.keyword_search finds them; the key names a row and is not null."""
    keys = candidates(df.sparkSession, path, needle)
    few = df if keys is None else df.join(keys.withColumnRenamed("key", key), key, "left_semi")
    return few.filter(text.keyword_search([F.col(c) for c in columns], needle))
