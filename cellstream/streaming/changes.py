"""Change feeds: the commit log of a dataset as a Structured Streaming source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellstream.sources.store import Dataset

SCHEMA = "key string, type string"


def commit_stream(dataset: Dataset, most_files: int = 1000) -> DataFrame:
    """(version, changes) of every commit: its number, and the folder of its change rows, null where it has none.

    `most_files` bounds what one micro-batch takes of a backlog.
    """
    log = dataset.spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).load(f"{dataset.path}/log")
    return log.select(F.get_json_object("value", "$.version").cast("bigint").alias("version"), F.get_json_object("value", "$.changes").alias("changes"))


def register_listener(
    dataset: Dataset, listener: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, missed: Callable[[list[int]], None] | None = None
) -> StreamingQuery:
    """Call `listener(rows, batch)` with (key, type, version) of the commits of each micro-batch, in order.

    Every committed change is seen, those of transactions too. `missed(versions)` is called with commits whose change rows
    were dropped (by `retain`) before they could be read. With `once`, what is there, then stop.
    """

    def batch(commits: DataFrame, n: int) -> None:
        told = sorted((r["version"], r["changes"]) for r in commits.where(F.col("changes").isNotNull()).collect())  # a row a commit
        there = [(v, c) for v, c in told if dataset.files.exists(f"{dataset.path}/{c}")]
        gone = [v for v, c in told if (v, c) not in there]
        if gone and missed is not None:
            missed(gone)
        if there:
            rows = [commits.sparkSession.read.schema(SCHEMA).parquet(f"{dataset.path}/{c}").withColumn("version", F.lit(v).cast("bigint")) for v, c in there]
            listener(reduce(DataFrame.union, rows), n)

    writer = commit_stream(dataset).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
