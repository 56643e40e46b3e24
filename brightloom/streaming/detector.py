"""Change detection as a stateful operator of a stream: the state of each key lives in the stream's state store, events are the output.

A micro-batch's rows of a key count as its last one by time (of equal times that of the largest content), so a key has at most one of created and updated
a batch. Rows older than what the state has seen change nothing. Where a deadline is given, a timer of event time ends a record when the watermark passes it:
`expired` is told once, and a later row with another deadline opens the record again without an event, as its content decides.

State and timers are kept and checkpointed by Spark for each key on its own; no part of the state is read that a batch doesn't touch, and a stream
that starts again from its checkpoint tells no event twice. Null keys are a key. Null contents are contents. The store must be RocksDB (STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The setting that keyed state of this kind needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CREATED, UPDATED, EXPIRED = "created", "updated", "expired"
_STATE = "content string, first_seen long, last_seen long, updated long, deadline long"


class _Detector(StatefulProcessor):
    """Times are microseconds, deadlines milliseconds; output rows are key, event_type, occurred, content, first_seen, updated."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803, Spark's names
        last = max(((r.at, r.content is not None, r.content or "", r.deadline) for r in rows), key=lambda x: x[:3])
        at, known, content, deadline = last
        content = content if known else None
        old = self.state.get() if self.state.exists() else None
        if old is not None and at < old[2]:
            return
        kind = CREATED if old is None else UPDATED if old[0] != content else None
        first, updated = (at if old is None else old[1]), (at if kind else old[3])
        # a timer in the past would end the record at once; one that is told already is null in the state
        due = deadline if deadline is not None and deadline > timerValues.getCurrentWatermarkInMs() else None
        if old is None or old[4] != due:
            if old is not None and old[4] is not None:
                self.handle.deleteTimer(old[4])
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((content, first, at, updated, due))
        if kind:
            yield Row(key=key[0], event_type=kind, occurred=at, content=content, first_seen=first, updated=updated)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get() if self.state.exists() else None
        if old is None or old[4] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.update((old[0], old[1], old[2], old[3], None))
        yield Row(key=key[0], event_type=EXPIRED, occurred=old[4] * 1000, content=old[0], first_seen=old[1], updated=old[3])

    def close(self) -> None:
        pass


def events(stream: DataFrame, key: str, content: str, at: str, late: str = "1 hour", deadline: Column | None = None) -> DataFrame:
    """The stream of events (key, event_type, occurred_at, content, first_seen_at, updated_at) of a stream of rows.

    at: the rows' timestamp; late: how far behind the newest time the watermark is; deadline: a timestamp after which the record has expired.
    """
    spark = stream.sparkSession
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    due = F.lit(None).cast("long") if deadline is None else F.unix_millis(deadline.cast("timestamp"))
    rows = stream.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content"), F.col(at).cast("timestamp").alias("time"), due.alias("deadline")).filter(F.col("time").isNotNull())
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    kind = rows.schema["key"].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("event_type", T.StringType()), T.StructField("occurred", T.LongType()), T.StructField("content", T.StringType()), T.StructField("first_seen", T.LongType()), T.StructField("updated", T.LongType())])
    found = rows.groupBy("key").transformWithState(_Detector(), out, "append", "eventtime")
    when = lambda c, name: F.timestamp_micros(c).alias(name)
    return found.select(F.col("key").alias(key), "event_type", when("occurred", "occurred_at"), "content", when("first_seen", "first_seen_at"), when("updated", "updated_at"))
