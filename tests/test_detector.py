"""Stateful change detection through restarts."""

import datetime as dt

import pytest
from brightloom.streaming import detector
from pyspark.sql import functions as F

SCHEMA = "k string, content string, at timestamp, deadline timestamp"


def at(day, hour=0):
    return dt.datetime(2026, 9, day, hour)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(detector.STORE[0])
    spark.conf.set(*detector.STORE)
    yield spark
    spark.conf.set(detector.STORE[0], before)


def test_events_are_told_once_through_restarts(rocks, tmp_path):
    feed, out, told = tmp_path / "in", tmp_path / "out", []

    def step(*rows):
        """Writes rows as one file, runs what is there to its end and gives the events that are new."""
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(feed), mode="append")
        found = detector.events(rocks.readStream.schema(SCHEMA).parquet(str(feed)), "k", "content", "at", "1 hour", F.col("deadline"))
        found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        rows = [(r.k, r.event_type, r.occurred_at.day, r.content, r.first_seen_at.day, r.updated_at.day) for r in rocks.read.parquet(str(out)).collect()]
        new = sorted(set(rows) - set(told), key=repr)
        assert len(rows) == len(set(rows)) == len(told) + len(new)
        told.extend(new)
        return new

    assert step(("a", "1", at(1), None), ("a", "2", at(2), None), ("a", "0", at(1, 5), None), ("b", "x", at(2), at(5)), (None, None, at(2), None)) == [
        ("a", "created", 2, "2", 2, 2), ("b", "created", 2, "x", 2, 2), (None, "created", 2, None, 2, 2),
    ]
    assert step(("a", "2", at(3), None), (None, None, at(3), None)) == []
    assert step(("a", "3", at(4), None), ("b", "x", at(4), at(6)), (None, "n", at(4), None)) == [("a", "updated", 4, "3", 2, 4), (None, "updated", 4, "n", 2, 4)]
    assert step(("a", "old", at(3), None), ("c", "new", at(8), None)) in ([("c", "created", 8, "new", 8, 8)], [("b", "expired", 6, "x", 2, 2), ("c", "created", 8, "new", 8, 8)])
    step(("c", "new", at(9), None))
    assert [e for e in told if e[1] == "expired"] == [("b", "expired", 6, "x", 2, 2)]
    assert step(("b", "x", at(10), at(12)), ("c", "new", at(14), None)) in ([], [("b", "expired", 12, "x", 2, 2)])
    step(("c", "new", at(15), None))
    assert [e[2] for e in told if e[1] == "expired"] == [6, 12]


def test_the_store_is_asked_for(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("k").alias("k"), F.lit("c").alias("c"), "timestamp")
    with pytest.raises(ValueError, match="RocksDB"):
        detector.events(stream, "k", "c", "timestamp")
