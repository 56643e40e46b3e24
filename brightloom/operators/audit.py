"""Audit rules: each is a named condition; all rules of a table are tested in one pass over it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def rule(code: str, broken: Column) -> Rule:
    return code, broken


def table_issues(df: DataFrame, rules: Iterable[Rule], key: str) -> DataFrame:
    """(code, key) for every rule that a row breaks; a condition that is null is not broken."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]))
    return df.select(F.explode(codes).alias("code"), key)


def issues(tables: Iterable[tuple[DataFrame, list[Rule], str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_issues(df, rules, key) for df, rules, key in tables])


def shared_urls(jobs: DataFrame, url: str, allowed: str) -> DataFrame:
    """URLs of more than one job unless all their sources allow that; counts only, no lists."""
    found = jobs.groupBy(url).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(allowed, F.lit(False))).alias("ok"))
    return found.filter("n > 1 AND NOT ok").select(url, "n")


def job_rules(today: Column, minimum: Column, hosts: Column, forbidden: list[str], process_titles: list[str]) -> list[Rule]:
    """The per-record rules. hosts: array of a source's allowed hosts; later rules need a known source (source_type not null)."""
    from brightloom.functions import text, urls

    known, manual = F.col("source_type").isNotNull(), F.col("source_type") == "manual"
    titled = F.concat_ws(" ", "title", "summary")
    valid = urls.is_http(F.col("source_url"))
    deadline = F.try_to_date(F.col("deadline_date").cast("string"))
    found = [
        ("unpublished_job_record", F.col("verification_status") != "published_official"),
        ("missing_official_evidence_url", ~urls.is_http(F.col("official_evidence_url"))),
        ("invalid_source_url", ~valid),
        ("source_host_mismatch", valid & ~manual & ~urls.host_allowed(F.col("source_url"), hosts)),
        ("forbidden_notice_text", text.contains_any(titled, forbidden)),
        ("non_vacancy_process_notice", F.col("title").rlike("|".join(process_titles)) if process_titles else F.lit(False)),
        ("invalid_source_threshold", F.col("minimum_relevance").isNotNull() & minimum.isNull()),
        ("below_source_threshold", F.col("relevance_score") < F.coalesce(minimum, F.lit(0))),
        ("disabled_source_job", ~manual & ~F.col("enabled") & (F.col("status") == "open")),
        ("empty_title", F.coalesce(F.trim("title") == "", F.lit(True))),
        ("empty_description", F.coalesce(F.trim("description") == "", F.lit(True))),
        ("invalid_deadline", F.col("deadline_date").isNotNull() & deadline.isNull()),
        ("stale_open_job", (F.col("status") == "open") & (deadline < today)),
    ]
    return [("unknown_source", ~known), *((code, known & c) for code, c in found)]


def own_hosts(allowed: Column, homepage: Column) -> Column:
    """The hosts of a source: those it allows and its homepage's."""
    from brightloom.functions import urls

    return F.array_compact(F.array_union(F.coalesce(allowed, F.array().cast("array<string>")), F.array(urls.host(homepage))))


#: What an issue says by its code; {names} are columns of the row.
MESSAGES = {
    "unknown_source": "the job names a source that is not registered", "unpublished_job_record": "a record that is not verified stands among the published ones", "missing_official_evidence_url": "no official address that can be opened",
    "invalid_source_url": "the source address is no http address", "source_host_mismatch": "the host {host} is none of the source's", "forbidden_notice_text": "title or summary has {word}", "non_vacancy_process_notice": "the title announces a step of a procedure, not a vacancy",
    "invalid_source_threshold": "the source's minimum relevance is no number", "below_source_threshold": "a relevance of {relevance_score} is below the source's minimum", "disabled_source_job": "an open job of a source that is switched off", "empty_title": "no title",
    "empty_description": "no description", "invalid_deadline": "the deadline {deadline_date} is no date", "stale_open_job": "open after its deadline {deadline_date}", "duplicate_source_url": "{n} jobs have the address {source_url}", "stale_crawl_run": "a run that never ended, {run_id}",
}


def _message(code: str, known: dict[str, Column]) -> Column:
    """The text of a code with its columns put in; what is null reads as nothing."""
    parts = []
    for i, part in enumerate(MESSAGES[code].replace("}", "{").split("{")):
        parts.append(F.coalesce(known[part].cast("string"), F.lit("")) if i % 2 else F.lit(part))
    return F.concat(*parts)


def audit(jobs: DataFrame, sources: DataFrame, runs: DataFrame, today: Column, cutoff: Column, forbidden: list[str], process_titles: list[str]) -> DataFrame:
    """(code, job_id, source_id, source_url, message) for every broken rule; no row means that all is well.

    jobs: id, source_id and the fields of job_rules; sources: id, source_type, enabled, homepage_url, allowed_hosts, minimum_relevance
    (text), allow_shared_urls; runs: id, source_id, status, started_at, of which those running since the cutoff on enabled sources are stale. An address
    of several jobs is one issue, whose jobs duplicate_jobs() gives.
    """
    from brightloom.functions import urls

    j = _with_sources(jobs, sources)
    rules = job_rules(today, F.try_to_number("minimum_relevance", F.lit("S999999999")).cast("int"), F.col("__hosts"), forbidden, process_titles)
    titled = F.concat_ws(" ", "title", "summary")
    word = F.coalesce(*[F.when(F.contains(titled, F.lit(w)), F.lit(w)) for w in forbidden]) if forbidden else F.lit(None)
    known = {"host": urls.host(F.col("source_url")), "word": word, "relevance_score": F.col("relevance_score"), "deadline_date": F.col("deadline_date")}
    told = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), _message(code, known).alias("message"))) for code, c in rules]
    found = j.select(F.inline(F.array_compact(F.array(*told))), F.col("id").alias("job_id"), "source_id", "source_url")
    twice = _twice(j)
    on = sources.filter("enabled").select(F.col("id").alias("source_id"))
    stale = runs.filter((F.col("status") == "running") & (F.col("started_at") <= cutoff)).join(on, "source_id", "left_semi")
    none = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    of_url = _message("duplicate_source_url", {"n": F.col("n"), "source_url": F.col("source_url")})
    of_run = _message("stale_crawl_run", {"run_id": F.col("id")})
    return (
        found.select("code", "job_id", "source_id", "source_url", "message")
        .unionByName(twice.select(F.lit("duplicate_source_url").alias("code"), none("id").alias("job_id"), none("source_id").alias("source_id"), "source_url", of_url.alias("message")))
        .unionByName(stale.select(F.lit("stale_crawl_run").alias("code"), none("id").alias("job_id"), "source_id", none("source_url").alias("source_url"), of_run.alias("message")))
    )


def _with_sources(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), "source_type", "enabled", own_hosts(F.col("allowed_hosts"), F.col("homepage_url")).alias("__hosts"), "minimum_relevance", F.col("allow_shared_urls").alias("__shared"))
    return jobs.join(s, "source_id", "left")


def _twice(j: DataFrame) -> DataFrame:
    return shared_urls(j.filter((F.coalesce("source_url", F.lit("")) != "") & F.col("source_type").isNotNull()), "source_url", "__shared")


def duplicate_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_url, n, job_id, source_id): the jobs of every address that is an issue, one row each, as an address may have very many."""
    j = _with_sources(jobs, sources)
    return j.filter(F.col("source_type").isNotNull()).join(_twice(j), "source_url").select("source_url", "n", F.col("id").alias("job_id"), "source_id")


def overview(issues: DataFrame, jobs: DataFrame, sources: DataFrame, today: Column) -> DataFrame:
    """One row: ok, the jobs checked and open, the sources registered and enabled, the issues, and the day of the audit."""
    j = jobs.agg(F.count("*").alias("checked_jobs"), F.count_if(F.col("status") == "open").alias("open_jobs"))
    s = sources.agg(F.count("*").alias("registered_sources"), F.count_if("enabled").alias("enabled_sources"))
    i = issues.agg(F.count("*").alias("issues"))
    return j.join(s, F.lit(True)).join(i, F.lit(True)).select((F.col("issues") == 0).alias("ok"), "*", today.alias("audited_date"))  # one row each
