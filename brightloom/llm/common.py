"""Pieces shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space code points that part words, as a regex class and as characters.
SPACE_RE = "[\\x20\\x09-\\x0D]"
WORD_CHAR_RE = "[^\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def exact(name: str) -> Column:
    """The column of exactly this name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space."""
    for c in SPACE_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; where that is unset, one beside the warehouse, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where.rstrip("/")


#: Paths of the tables that stored() made in this process, in order.
_MADE: list[str] = []


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    files.delete(where, True) if now else files.deleteOnExit(where)


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there, and it is small on disk.

    The table goes when the session's process ends, or with forget_tables() before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    _delete(spark, path, now=False)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    return len(_MADE)


def forget_tables(spark: SparkSession, since: int, but_last: bool = False) -> None:
    """Deletes the tables stored since tables_made() gave that number, all or all but the last; nothing may read them any more."""
    keep = _MADE[-1:] if but_last and len(_MADE) > since else []
    for path in _MADE[since : len(_MADE) - len(keep)]:
        _delete(spark, path, now=True)
    _MADE[since:] = keep


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table has not got, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that the optimizer leaves above the projections before it.

    Pushed down, a condition over arrays made step by step would carry all the steps with it and
    compute them again for every element. The outer explode of one boolean stops that; it adds no rows.
    """
    keep = free_name(df, "__keep")
    return df.withColumn(keep, F.explode_outer(F.array(F.coalesce(condition, F.lit(False))))).filter(keep).drop(keep)
