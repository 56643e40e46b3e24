"""The folder that the driver and all executors see, tables kept there, and single files written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder beside the warehouse, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's process ends."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and its lineage ends there."""
    path = fresh_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    where, files = _path(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place of the one at path by one rename, so a reader finds the old text or the new."""
    jvm = spark.sparkContext._jvm
    target, files = _path(spark, path)
    files.mkdirs(target.getParent())
    new, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = files.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(new), files.makeQualified(target), options)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none where there is no folder."""
    where, files = _path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
