"""Collection of all sources as one read, where what fails in a source is a row and not an error.

`SourceReader` is a Python data source: a partition for each source of the registry, read by one task. A task yields the
source's documents, and one row with the reason where its reader stops: `skipped` if the site refuses, else failed. Other sources
don't notice. What a source gave before it failed is in the table too; `split` leaves it out, as a run that failed keeps nothing.

Network access is not part of this library: `CapturedSources` reads what a capture has written, as JSON lines in a folder for
each source; a caller's own subclass may fetch instead. Documents become postings by plain column expressions: `postings`
gives each type of source to its reader, and documents that can't be read are failures of their source as well.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brightloom import storage

SCHEMA = "source_id string, source_type string, position long, url string, document string, skipped boolean, error string"
#: A registry is small by nature; its rows become partitions on the driver.
MOST_SOURCES = 100_000
MOST_ERROR = 1_500


class SourceSkipped(Exception):
    """The source is not to be read now, by its own rules."""


class SourceFailed(Exception):
    """The source can't be read."""


class _Source(InputPartition):
    def __init__(self, row: dict):
        super().__init__(row["source_id"])
        self.row = row


class SourceReader(DataSource):
    """Subclasses give documents(source): (url, text) pairs in order; option `sources` is the registry as a JSON list of objects with source_id and source_type."""

    @classmethod
    def name(cls) -> str:
        return "sources"

    def schema(self) -> str:
        return SCHEMA

    def documents(self, source: dict) -> Iterator[tuple[str | None, str]]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, owner: SourceReader):
        self.owner = owner

    def partitions(self) -> list[InputPartition]:
        return [_Source(row) for row in json.loads(self.owner.options["sources"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "row"):
            return
        source = partition.row
        key, kind, n = source["source_id"], source.get("source_type"), 0
        try:
            for url, text in self.owner.documents(source):
                n += 1
                yield key, kind, n, url, text, None, None
        except SourceSkipped as error:
            yield key, kind, n + 1, None, None, True, (str(error) or "skipped")[:MOST_ERROR]
        except Exception as error:  # noqa: BLE001, whatever a reader raises is the source's failure
            yield key, kind, n + 1, None, None, False, (str(error) or type(error).__name__)[:MOST_ERROR]


class CapturedSources(SourceReader):
    """Documents that Spark wrote as JSON lines (url, document) below `path`/source_id=<id>, in the order of the files and lines.

    The folder is one that all executors can open, as the shared folder is. A line that is no object with a document fails the source; a file named
    _refused makes it skipped, with the file's text as the reason. A source without a folder has no documents.
    """

    @classmethod
    def name(cls) -> str:
        return "captured_sources"

    def documents(self, source: dict) -> Iterator[tuple[str | None, str]]:
        import os
        from urllib.parse import quote, unquote, urlparse

        root = self.options["path"]
        root = unquote(urlparse(root).path) if root.startswith("file:") else root
        # partition folders escape some characters of a value as %XX
        named = [f"{root}/source_id={x}" for x in (source["source_id"], quote(source["source_id"], safe=" ,;()&@+$!~"))]
        folder = next((x for x in named if os.path.isdir(x)), None)
        if folder is None:
            return
        if os.path.exists(f"{folder}/_refused"):
            with open(f"{folder}/_refused", encoding="utf-8") as refusal:
                raise SourceSkipped(refusal.read().strip())
        for name in sorted(os.listdir(folder)):
            if not re.match(r"[._]", name):
                with open(f"{folder}/{name}", encoding="utf-8") as lines:
                    for line in lines:
                        row = json.loads(line)
                        if not isinstance(row, dict) or not isinstance(row.get("document"), str):
                            raise SourceFailed("a line without a document")
                        yield row.get("url"), row["document"]


def capture(documents: DataFrame, path: str) -> None:
    """Writes documents (source_id, url, document) as CapturedSources reads them."""
    documents.select("source_id", "url", "document").repartition("source_id").write.partitionBy("source_id").json(path)


def collect(spark: SparkSession, sources: DataFrame, kind: type[SourceReader], **options: str) -> DataFrame:
    """The documents and failures of all enabled sources but manual ones; sources: source_id, source_type, enabled and whatever its reader asks for."""
    on = sources.filter(F.coalesce("enabled", F.lit(True)) & (F.col("source_type") != "manual"))
    rows = [json.loads(r[0]) for r in on.orderBy("source_id").select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c == "source_id" else F.col(c) for c in on.columns]))).limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(sources=json.dumps(rows), **options).load()


def split(collected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of the sources that were read to their end, failures (source_id, skipped, error))."""
    failures = collected.filter(F.col("error").isNotNull()).select("source_id", "skipped", "error")
    whole = collected.filter(F.col("error").isNull()).drop("skipped", "error").join(failures.select("source_id"), "source_id", "left_anti")
    return whole, failures


Reader = Callable[[DataFrame], DataFrame]


def postings(documents: DataFrame, readers: Mapping[str, Reader], schema: str) -> tuple[DataFrame, DataFrame]:
    """(postings, failures) of documents, each type of source by its reader.

    A reader takes (source_id, position, url, document, ...) and gives the columns of schema with `error`, null for a posting; a row with an error, or of
    a type that has no reader, makes its source a failure, and the source's postings go.
    """
    spark = documents.sparkSession
    out = spark.createDataFrame([], f"{schema}, error string")
    for kind, reader in readers.items():
        out = out.unionByName(reader(documents.filter(F.col("source_type") == kind)).select(*out.columns))
    # read for failures and for postings: parsed once
    out = storage.stored(out)
    wrong = out.filter(F.col("error").isNotNull()).select("source_id", "error")
    unknown = documents.filter(~F.coalesce(F.col("source_type").isin(*readers), F.lit(False))).select("source_id", F.concat(F.lit("no reader for "), F.coalesce("source_type", F.lit("null"))).alias("error"))
    failures = wrong.unionByName(unknown).groupBy("source_id").agg(F.min("error").alias("error")).select("source_id", F.lit(False).alias("skipped"), F.substring("error", 1, MOST_ERROR).alias("error"))
    return out.filter(F.col("error").isNull()).drop("error").join(failures.select("source_id"), "source_id", "left_anti"), failures
