"""State of iterative jobs, written to the shared checkpoint folder between rounds.

Writing and reading back a table cuts the lineage with a single computation of the round (a dataset checkpoint would
compute it twice), and a lost executor costs a re-read only. Two folders take turns, so a job keeps two copies of its
state at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import ensure_checkpoint_dir


class RoundState:
    def __init__(self, spark: SparkSession, name: str) -> None:
        self._spark = spark
        self._base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._round = 0

    def save(self, frame: DataFrame) -> DataFrame:
        """Write a frame and return it as read back; the frame saved before the last one is overwritten."""
        path = f"{self._base}/{self._round % 2}"
        self._round += 1
        frame.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(frame.schema).parquet(path)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write a frame that later rounds do not replace."""
        path = f"{self._base}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(frame.schema).parquet(path)

    def append(self, frame: DataFrame, name: str, number: int, kind: str) -> DataFrame:
        """Write a round's rows beside those of the rounds before, by kind, and return all with their round."""
        path = f"{self._base}/{name}"
        frame.write.mode("overwrite").partitionBy(kind).parquet(f"{path}/round={number}")
        return self._spark.read.schema(frame.withColumn("round", F.lit(0)).schema).parquet(path)


@contextmanager
def ends_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: Spark removes them when the write is done, not when the
    driver happens to collect its garbage. The session's setting is put back at the end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a table that one task sorts or groups at a time.
ROWS_PER_TASK = 250_000


def dealt(frame: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A frame dealt by keys over as many tasks as its rows ask for, so that a task's share does not grow with the table.

    Windows, groups and joins by these keys then need no further shuffle. The rows are counted first, so the frame
    should be a table or a plain view of one.
    """
    return frame.repartition(max(stage_width(frame.sparkSession), frame.count() // rows + 1), *keys)


def stage_width(spark: SparkSession) -> int:
    """Partition count for stages that compute much on few bytes, which adaptive coalescing by size would starve."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
