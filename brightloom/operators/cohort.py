"""Synthetic cohorts and their coverage by profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def members(spark: SparkSession, sizes: Mapping[str, int], prefix: str = "GS") -> DataFrame:
    """(member_id, profile): numbered through all profiles in their order."""
    starts, at = [], 0
    for name, n in sizes.items():
        starts.append((name, at + 1, at + n))
        at += n
    ranges = spark.createDataFrame(starts, "profile string, first int, last int")
    rows = ranges.select("profile", F.explode(F.sequence("first", "last")).alias("i"))
    return rows.select(F.format_string(f"{prefix}-%03d", "i").alias("member_id"), "profile")


def simulate(records: DataFrame, sizes: Mapping[str, int], explicit: Mapping[str, Column], review: Column, category: str | None = None) -> DataFrame:
    """Per profile: explicit and review counts, and explicit weighted by members; with `category` also the distinct categories of both, sorted.

    Profiles are few and fixed, so each is a few conditional aggregates in one pass; records are not multiplied. Categories are a dimension's names.
    """
    sums = [c for k, hit in explicit.items() for c in (F.count_if(hit).alias(f"e_{k}"), F.count_if(~hit & review).alias(f"r_{k}"))]
    named = lambda k: F.array_sort(F.array_remove(F.coalesce(F.col(f"c_{k}"), F.array().cast("array<string>")), "")).alias("categories")
    if category:
        sums += [F.collect_set(F.when(hit | review, F.col(category))).alias(f"c_{k}") for k, hit in explicit.items()]
    fields = lambda k, n: [F.lit(k).alias("profile"), F.lit(n).cast("long").alias("members"), F.col(f"e_{k}").alias("explicit"), F.col(f"r_{k}").alias("review"), *([named(k)] if category else [])]
    parts = F.array(*[F.struct(*fields(k, n)) for k, n in sizes.items()])
    return records.agg(*sums).select(F.inline(parts)).withColumn("weighted", F.col("members") * F.col("explicit"))


def summary(simulated: DataFrame) -> DataFrame:
    """One row over simulate(): members with an explicit match, with matches to review only and with none, the matches of both kinds, and explicit ones weighted by members."""
    some, only = F.col("explicit") > 0, (F.col("explicit") == 0) & (F.col("review") > 0)
    people = lambda test: F.coalesce(F.sum(F.when(test, F.col("members"))), F.lit(0))
    return simulated.agg(
        F.coalesce(F.sum("members"), F.lit(0)).alias("cohort_size"), people(some).alias("with_explicit"), people(only).alias("with_review_only"), people(~some & ~only).alias("without_recommendation"),
        F.coalesce(F.sum("explicit"), F.lit(0)).alias("explicit_matches"), F.coalesce(F.sum("review"), F.lit(0)).alias("review_matches"), F.coalesce(F.sum("weighted"), F.lit(0)).alias("weighted_explicit"),
    )


def by_member(cohort: DataFrame, simulated: DataFrame) -> DataFrame:
    """Each member with the matches of its profile and whether there is any."""
    of_profile = simulated.drop("members", "weighted").withColumn("has_recommendation", F.col("explicit") + F.col("review") > 0)
    return cohort.join(of_profile, "profile", "left").select("member_id", "profile", *[c for c in of_profile.columns if c != "profile"])
