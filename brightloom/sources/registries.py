"""Registries and dimensions from JSON files, checked on loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("id", "name", "publisher", "homepage_url", "source_type", "category", "source_tier")
SCHEMA = ", ".join(f"{c} string" for c in REQUIRED) + ", enabled boolean, config string"


def duplicates(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that the union of the tables has more than once."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def load_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The concatenation of JSON lists; a missing required key or a repeated id is an error."""
    rows = reduce(DataFrame.unionByName, [spark.read.schema(SCHEMA).json(p, multiLine=True) for p in paths])
    rows = rows.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "config": F.coalesce("config", F.lit("{}"))})
    missing = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED]).first()
    if lacking := [c for c in REQUIRED if missing[c]]:
        raise ValueError(f"a source has no {', '.join(lacking)}")
    if again := duplicates([rows], "id").limit(5).collect():
        raise ValueError(f"repeated ids: {[r[0] for r in again]}")
    return rows


def load_targets(spark: SparkSession, path: str, states: tuple[str, ...] = ("verified", "candidate", "unlocated", "blocked")) -> DataFrame:
    """(province, role, state, source_id) of a map of maps; verified entries need a source."""
    raw = spark.read.schema("provinces map<string,map<string,struct<state:string,source_id:string>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("provinces").alias("province", "roles")).select("province", F.explode("roles").alias("role", "t")).select("province", "role", "t.*")
    bad = rows.filter(~F.col("state").isin(*states) | ((F.col("state") == "verified") & F.col("source_id").isNull()))
    if found := bad.limit(5).collect():
        raise ValueError(f"invalid targets: {found}")
    return rows


def json_value(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text as text; null where a part is missing."""
    return F.get_json_object(document, "$." + path)


def verified_jobs(spark: SparkSession, path: str, required: tuple[str, ...] = ("source_id", "title", "source_url")) -> DataFrame:
    """Jobs of a JSON file, a list or one object; a job without a required field is an error."""
    rows = spark.read.json(path, multiLine=True)
    if lacking := [c for c in required if c not in rows.columns]:
        raise ValueError(f"no field {', '.join(lacking)}")
    missing = rows.agg(*[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in required]).first()
    if lacking := [c for c in required if missing[c]]:
        raise ValueError(f"a job has no {', '.join(lacking)}")
    return rows


def landscape(spark: SparkSession, path: str) -> DataFrame:
    """(group, unit) rows of an employer map; groups without units stay."""
    raw = spark.read.schema("groups array<struct<name:string,units:array<string>>>").json(path, multiLine=True)
    if raw.filter(F.col("groups").isNull()).limit(1).count():
        raise ValueError("no list of groups")
    return raw.select(F.explode("groups").alias("g")).select(F.col("g.name").alias("group"), F.explode_outer("g.units").alias("unit"))


def json_items(df: DataFrame, col: str, items_path: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of a JSON document, by dotted paths; missing values are null."""
    items = F.from_json(F.get_json_object(col, "$." + items_path), "array<string>")
    out = df.withColumn("__item", F.explode(items))
    return out.select(*df.columns, *[F.get_json_object("__item", "$." + p).alias(k) for k, p in fields.items()])


def feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """RSS items (or Atom entries with row_tag='entry') by Spark's XML reader."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("title string, link string, description string, summary string, pubDate string, updated string, guid string").load(path)


#: What an employer of the registry must state, be it null.
EMPLOYER_KEYS = ("id", "canonical_name", "parent_id", "parent_name", "category", "employer_type", "affiliation", "aliases")


def load_employers(spark: SparkSession, path: str) -> DataFrame:
    """(alias, ord, canonical_employer_id, canonical_employer_name, parent_employer_name, category, employer_type, affiliation), a row for each alias in the file's order.

    A file that is no list, or has an entry without one of the EMPLOYER_KEYS, is an error. Aliases are cleaned and lower-cased, as the names are that they
    are sought in; blank ones name nobody.
    """
    from brightloom.functions import text

    whole = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("items"))
    if whole.filter("items IS NULL").limit(1).count():
        raise ValueError("no list of employers")
    item = F.try_variant_get(F.col("v"), "$", "map<string,variant>")
    rows = whole.select(F.posexplode("items").alias("place", "v")).select("place", item.alias("e"))
    keys = F.array(*[F.lit(k) for k in EMPLOYER_KEYS])
    if bad := rows.filter(F.col("e").isNull() | (F.size(F.array_except(keys, F.map_keys("e"))) > 0)).limit(5).collect():
        raise ValueError(f"invalid employers at {[r.place for r in bad]}")
    said = lambda k: F.try_variant_get(F.try_element_at("e", F.lit(k)), "$", "string")
    named = {"canonical_employer_id": "id", "canonical_employer_name": "canonical_name", "parent_employer_name": "parent_name", "category": "category", "employer_type": "employer_type", "affiliation": "affiliation"}
    aliases = F.try_variant_get(F.try_element_at("e", F.lit("aliases")), "$", "array<string>")
    each = rows.select("place", *[said(k).alias(c) for c, k in named.items()], F.posexplode(aliases).alias("n", "alias"))
    each = each.select(F.lower(text.clean(F.col("alias"))).alias("alias"), (F.col("place").cast("long") * 1_000_000 + F.col("n")).alias("ord"), *named)
    return each.filter("alias <> ''")


def decoded(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of JSON text as values: {column: (new name, type)} in place of each; a text that is no JSON of the type is an error, null stays."""
    return df.select(*[F.from_json(c, columns[c][1], {"mode": "FAILFAST"}).alias(columns[c][0]) if c in columns else F.col(c) for c in df.columns])
