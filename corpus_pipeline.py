"""A corpus from raw documents: quality, lines, near copies, benchmark leaks, then the mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as
Parquet in the shared folder and reads it back as the next one's documents. All stages but the last
return the columns of documents; n_chars follows the text. The last adds the pass over the document
and the words taken in it.

In every stage a null text counts as empty (and fails the quality rules), texts of any length are read whole,
an empty table gives an empty one, and other columns may have any names. Rows that agree in id and text are judged alike; near copies keep one of them, and ties between
documents go to the smaller id (null last), then text hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from brightloom.llm.common import WORD_CHAR_RE, exact, filtered, forget_tables, stored, table, tables_made


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null, empty and short texts go."""
    return quality.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated from earlier ones; those left without a word go, those that came without one stay."""
    rows = line_dedup.remove_repeats(docs)
    changed = exact(rows.columns[-1]) > 0
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return filtered(rows, ~changed | F.col("text").rlike(WORD_CHAR_RE)).select(*map(exact, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of the smallest id; documents without words are one group."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; items without words match nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, at most twice; those without words are never taken."""
    return _counted(mixing.mixed_documents(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("source_mixing", source_mix),
]

#: SQL has no SimHash votes over XXH64; the stages are tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        since = tables_made()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            forget_tables(spark, since, but_last=True)  # what the stage made on its way
    return docs
