"""Faceted listing, latest rows, top shares, completeness and dense grids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brightloom import storage


def facet(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """The rows for which all predicates given hold; None stands for an absent one."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(and_, given)) if given else df


def page(df: DataFrame, order: Iterable[Column], number: int, size: int) -> DataFrame:
    """The page of that number, from 1; lower numbers count as 1. The order should end in a unique key."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_and_total(df: DataFrame, predicates: Iterable[Column | None], order: Iterable[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The page, and one row with the number of all rows that match and of the pages they fill."""
    found = facet(df, predicates)
    total = found.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return page(found, order, number, size), total


def display_order(bands: Iterable[str], band: str = "relevance_band", deadline: str = "deadline_date", updated: str = "updated_at", key: str = "id") -> list[Column]:
    """Best band first, then the nearest deadline with undated rows last, then the newest update; the key parts ties."""
    rank = None
    for i, name in enumerate(bands):
        rank = F.when(F.col(band) == name, i) if rank is None else rank.when(F.col(band) == name, i)
    return [rank.otherwise(len(list(bands))), F.col(deadline).asc_nulls_last(), F.desc(updated), F.col(key)]


def has(values: str, one: str | None) -> Column | None:
    """An array column holds the value; no value is no predicate."""
    return None if one is None else F.coalesce(F.array_contains(values, one), F.lit(False))


def cards(jobs: DataFrame, texts: Iterable[str], lists: Iterable[str] = ()) -> DataFrame:
    """The columns of a card: missing texts empty, missing lists empty, the others as they are."""
    texts, lists = set(texts), set(lists)
    empty = F.array().cast("array<string>")
    return jobs.select(*[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.coalesce(c, empty).alias(c) if c in lists else F.col(c) for c in jobs.columns])


def counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(out)).orderBy(F.desc(out), key)


def latest(df: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`; null is a key. Before the shuffle each task keeps one row of a key (a group limit)."""
    return _first(df, keys, F.desc_nulls_last(order))


def first_seen(df: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """The row of each key with the smallest `order`."""
    return _first(df, keys, F.asc_nulls_last(order))


def _first(df: DataFrame, keys: Iterable[str], order: Column) -> DataFrame:
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter("__rank = 1").drop("__rank")


def concentration(df: DataFrame, groups: list[str], key: str, missing: str = "unknown", weight: str | None = None) -> DataFrame:
    """Per group the largest key, its count, the total, the share to four places and its risk. Ties go to the smaller key. weight: a column of how many a row stands for."""
    n = df.groupBy(*groups, F.coalesce(key, F.lit(missing)).alias("top_key")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    top = n.groupBy(*groups).agg(F.max(F.struct("n")).alias("m"), F.sum("n").alias("total"), F.min_by("top_key", F.struct((-F.col("n")).alias("n"), "top_key")).alias("top_key"))
    share = F.round(F.try_divide(F.col("m.n"), F.col("total")), 4)
    risk = F.when(F.col("total") == 0, "no_data").when(share >= 0.5, "high").when(share >= 0.3, "watch").otherwise("balanced")
    return top.select(*groups, "top_key", F.col("m.n").alias("top_count"), "total", share.alias("share"), risk.alias("risk"))


def completeness(df: DataFrame, groups: list[str], fields: Mapping[str, Column]) -> DataFrame:
    """Per group and field: rows where the condition holds, all rows, and the share to four places."""
    sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in fields.items()]
    one = df.groupBy(*groups).agg(F.count("*").alias("total"), *sums)
    parts = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"n_{k}").alias("complete")) for k in fields])
    return one.select(*groups, "total", F.inline(parts)).withColumn("share", F.round(F.try_divide("complete", "total"), 4))


def dense_grid(left: DataFrame, right: DataFrame, facts: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """Every combination of two small dimensions with the facts' columns, null where there are none.

    A grid is the feature here; its size is checked before it is made.
    """
    size = left.count() * right.count()
    if size > most:
        raise ValueError(f"a grid of {size} cells; at most {most}")
    return left.crossJoin(right).join(facts, keys, "left")


#: What goes to the tasks at once of a dictionary of aliases: entries, and characters.
ALIAS_BLOCK, ALIAS_CHARS = 500_000, 16_000_000


def longest_containing(texts: DataFrame, text_col: str, aliases: DataFrame, alias_col: str, keys: list[str], order: str, block: int = ALIAS_BLOCK) -> DataFrame:
    """For each text the longest alias it contains (ties: lowest `order`), as keys and the alias's columns; empty aliases match nothing.

    Every task runs an automaton of all aliases once over each text, so the work is the texts' length, whatever
    the number of aliases. Larger dictionaries go in blocks of about so many aliases and ALIAS_CHARS characters, one at a time on the driver.
    """
    columns = aliases.columns
    named = aliases.filter(F.length(alias_col) > 0)
    n, chars = named.agg(F.count("*"), F.coalesce(F.sum(F.length(alias_col)), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-chars // ALIAS_CHARS))
    rows = texts.select(*keys, F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__alias", aliases.schema[alias_col].dataType), T.StructField("__ord", aliases.schema[order].dataType)])
    every = None
    for b in range(blocks):
        part = named if blocks == 1 else named.filter(F.pmod(F.xxhash64(alias_col), F.lit(blocks)) == b)
        best = part.groupBy(alias_col).agg(F.min(order)).collect()
        hits = rows.mapInArrow(_automaton_search([tuple(r) for r in best], schema), schema)
        hits = hits if blocks == 1 else storage.stored(hits)
        every = hits if every is None else every.unionByName(hits)
    if blocks > 1:
        top = F.max_by(F.struct("__alias", "__ord"), F.struct(F.length("__alias"), -F.col("__ord")))
        every = every.groupBy(*keys).agg(top.alias("t")).select(*keys, "t.*")
    known = aliases.groupBy(F.col(alias_col).alias("__alias"), F.col(order).alias("__ord")).agg(F.first(F.struct(*columns)).alias("__a"))
    return every.join(known, ["__alias", "__ord"]).select(*keys, "__a.*")


def _automaton_search(aliases: list[tuple], schema: T.StructType):
    """aliases: (alias, order), distinct."""
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for alias, order in aliases:
            automaton.add_word(alias, (len(alias), -order, alias))
        automaton.make_automaton()
        for batch in batches:
            found = [max((hit for _, hit in automaton.iter(t)), default=None) if aliases else None for t in batch.column(batch.num_columns - 1).to_pylist()]
            keep = pa.array([f is not None for f in found], pa.bool_())
            hits = [f for f in found if f is not None]
            columns = [batch.column(i).filter(keep) for i in range(batch.num_columns - 1)]
            columns += [pa.array([f[2] for f in hits], arrow.field("__alias").type), pa.array([-f[1] for f in hits], arrow.field("__ord").type)]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return search
