"""Pages of a large ordered listing: the order is made once, and a page is a range of it.

`build` deals the rows by sampled ranges of the order, sorts each range in its task and writes it with the rows' places in it, one folder
a range. The ranges' sizes are counted in the same pass, from what was written, so the total and every page's bounds are known
without another look at the rows. A page reads the ranges it touches, and of those only the row groups with its places; OFFSET
would sort everything for each page.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import storage

#: Ranges are named on the driver, one number each.
MOST_RANGES = 100_000


def build(df: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
    """Writes the listing; the order should end in a unique key, or equal rows have any order among them."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > MOST_RANGES:
        raise ValueError(f"over {MOST_RANGES} ranges")
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the low 33 bits of the id are the row's place in its task, the rest the task's number
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt.withColumns({"__place": place, "__range": F.spark_partition_id()}).write.partitionBy("__range").parquet(f"{path}/rows")
    sizes = {r[0]: r[1] for r in spark.read.parquet(f"{path}/rows").groupBy("__range").agg(F.count("*")).collect()} if _any(spark, f"{path}/rows") else {}
    storage.replace_text(spark, f"{path}/bounds.json", json.dumps({"sizes": [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)], "schema": df.schema.json()}))


def _any(spark: SparkSession, path: str) -> bool:
    where, files = storage._path(spark, path)
    return any(s.isDirectory() for s in files.listStatus(where))


class Pages:
    """A built listing: its total, and any page of any size."""

    def __init__(self, spark: SparkSession, path: str):
        from pyspark.sql.types import StructType

        about = json.loads(storage.read_text(spark, f"{path}/bounds.json"))
        self.spark, self.path, self.schema = spark, path, StructType.fromJson(json.loads(about["schema"]))
        self.starts = [0, *accumulate(about["sizes"])]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def count(self, size: int) -> int:
        return -(-self.total // size)

    def page(self, number: int, size: int) -> DataFrame:
        """The page of that number, from 1; lower numbers count as 1, and beyond the last page there is nothing. Rows are in order."""
        first = (max(1, number) - 1) * size
        last = min(first + size, self.total)
        if first >= last:
            return self.spark.createDataFrame([], self.schema)
        low, high = bisect_right(self.starts, first) - 1, bisect_right(self.starts, last - 1) - 1
        rows = self.spark.read.parquet(f"{self.path}/rows")
        within = F.col("__range").between(low, high) & ((F.col("__range") > low) | (F.col("__place") >= first - self.starts[low])) & ((F.col("__range") < high) | (F.col("__place") < last - self.starts[high]))
        return rows.filter(within).orderBy("__range", "__place").select(*[F.col(f"`{f.name}`") for f in self.schema.fields])
