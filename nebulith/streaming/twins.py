"""Streaming twins of step operators: on a finite input they end with the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nebulith.runtime import Scratch, ship


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table (file or folder) as a file stream with the table's schema."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(path.rpartition("/")[0])  # a stream reads folders
    return reader.parquet(path)


def run_to_end(result: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream until its input is used up. Complete results replace each other, appended ones add up; the state's checkpoint is in the shared folder."""
    spark = result.sparkSession
    scratch = Scratch(spark, f"stream-{label}")
    parts: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        written = scratch.write(batch)
        if mode == "complete" and parts:
            scratch.drop(parts.pop())
        parts.append(written)

    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not parts:
        return spark.createDataFrame([], result.schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def windowed_activity(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and sums per tumbling window and type, with a watermark so that state is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    per = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def reconcile_stream(candidates: DataFrame) -> DataFrame:
    """The smallest candidate bin per element, kept as state."""
    return candidates.groupBy("element").agg(F.min("bin").alias("bin"), F.count("*").alias("n_candidates"))


def transition_stream(requests: DataFrame) -> DataFrame:
    """(element, tick, old_bin, new_bin): requests(element, tick, wanted) applied in order of tick with the bin as state.

    Refining is at once; coarsening only at a tick that the longer period divides, else it waits and is tried again at
    the element's next tick. Every element begins in bin 0.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, pending = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["tick", "wanted"], kind="stable")  # an element's requests within one batch
        out = []
        for tick, wanted in zip(rows["tick"], rows["wanted"]):
            pending = int(wanted)
            if pending < current or pending > current and tick % (1 << pending) == 0:
                out.append((key[0], int(tick), current, pending))
                current, pending = pending, -1
            elif pending == current:
                pending = -1
        state.update((current, pending))
        yield pd.DataFrame(out, columns=["element", "tick", "old_bin", "new_bin"])

    ship(requests.sparkSession)
    return requests.groupBy("element").applyInPandasWithState(
        step, "element long, tick long, old_bin int, new_bin int", "bin int, pending int", "append", GroupStateTimeout.NoTimeout
    )
