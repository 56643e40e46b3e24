"""Change detection over micro-batches: each batch of a stream makes new versions of the parts of a state table that it touches, and tells its events.

An extension: batch ids make the writes idempotent, so a batch that runs again writes the same version; with `seen`, a
timestamp column of the stream, it writes the same rows too. The state is parted by a hash of the key. A batch reads and
writes the parts its keys are in; the others stay as they are, so the work follows the batch and not the state. A small file of each
batch says which version every part has, so no batch lists what the ones before it wrote; versions that none of the last KEPT
batches names are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brightloom import storage
from brightloom.operators import changes

#: Of so many batches the versions stay, for readers of an older state and for a batch that runs again.
KEPT = 3


@dataclass(frozen=True)
class VersionedTable:
    """Directories v<n>/state_part=<p> below a path that all executors see; of each part the largest version is the state.

    A batch counts from when its manifest is written, so all versions that are named are whole.
    The number of parts is fixed for the life of a table.
    """

    path: str
    parts: int = 64

    def part_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.parts)).cast("int")

    def batches(self, spark: SparkSession) -> list[int]:
        """The batches whose versions are still there, in order."""
        return sorted(int(name.removesuffix(".json")) for name in storage.names(spark, f"{self.path}/manifest") if name.endswith(".json"))

    def latest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The newest version of each part, at most one entry per part; of the batches below `before` if that is given."""
        made = [b for b in self.batches(spark) if before is None or b < before]
        text = storage.read_text(spark, f"{self.path}/manifest/{made[-1]}.json") if made else None
        return {int(p): v for p, v in json.loads(text or "{}").items()}

    def commit(self, spark: SparkSession, batch: int, versions: dict[int, int]) -> None:
        """Names a batch's versions, and deletes those that only older batches than the last KEPT name."""
        storage.replace_text(spark, f"{self.path}/manifest/{batch}.json", json.dumps(versions))
        made = self.batches(spark)
        stay = {v for b in made[-KEPT:] for v in json.loads(storage.read_text(spark, f"{self.path}/manifest/{b}.json") or "{}").values()}
        for old in made[:-KEPT]:
            gone = set(json.loads(storage.read_text(spark, f"{self.path}/manifest/{old}.json") or "{}").values()) - stay
            for version in gone:
                storage.delete(spark, f"{self.path}/v{version}")
            storage.delete(spark, f"{self.path}/manifest/{old}.json")

    def at(self, spark: SparkSession, schema: str, versions: dict[int, int]) -> DataFrame:
        """The rows of these parts in these versions."""
        paths = [f"{self.path}/v{version}/state_part={part}" for part, version in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        return self.at(spark, schema, self.latest(spark))

    def write(self, rows: DataFrame, key: str, version: int) -> None:
        parted = rows.withColumn("state_part", self.part_of(key)).repartition("state_part")
        parted.write.mode("overwrite").partitionBy("state_part").parquet(f"{self.path}/v{version}")


def start(stream: DataFrame, target: VersionedTable, schema: str, key: str, content: str, derived: list[str], checkpoint: str, seen: str | None = None) -> StreamingQuery:
    """Runs over what is available and stops. A batch's time is the largest of its `seen`, or the present where none is given.

    Of rows with one key in a batch the last by `seen` counts, or where none is given that of the largest content.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            touched = {r.part for r in batch.select(target.part_of(key).alias("part")).distinct().collect()}
            now = F.lit(batch.agg(F.max(seen)).first()[0]).cast("timestamp") if seen else F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
            versions = target.latest(spark, batch_id)
            old = target.at(spark, schema, {p: v for p, v in versions.items() if p in touched})
            state, _ = changes.detect(old, batch, key, content, derived, now, seen or content)
            state = storage.stored(state)
            target.write(state.drop("outcome"), key, batch_id)
            changes.told(state, key).write.mode("overwrite").parquet(f"{target.path}/events/batch={batch_id}")
            target.commit(spark, batch_id, versions | dict.fromkeys(touched, batch_id))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(spark: SparkSession, target: VersionedTable, key: str) -> DataFrame:
    """(key, event_type, occurred_at, batch) of all batches; a batch that ran again has told its events once."""
    if not storage.names(spark, f"{target.path}/events"):
        return spark.createDataFrame([], f"{key} string, event_type string, occurred_at timestamp, batch long")
    found = spark.read.parquet(f"{target.path}/events")
    return found.select(key, "event_type", "occurred_at", F.col("batch").cast("long").alias("batch"))
