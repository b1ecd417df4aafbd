"""Structured Streaming: incremental ingest, windowed metrics, sessions, deduplication, circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.sources import sinks


def read(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def windowed(events: DataFrame, by: str, at: str = "ts", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their value in tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "value")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    g = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, key: str) -> DataFrame:
    return events.dropDuplicatesWithinWatermark([key])


def upsert_into(path: str, key: str, order: str):
    """foreachBatch function: versioned upsert of each batch into a table; a batch that runs again gives the same version."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        known = [int(s.getPath().getName()[8:]) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*"))] if fs.exists(hadoop) else []
        before = max((v for v in known if v < batch_id), default=None)
        new = batch.dropDuplicates()
        old = spark.read.schema(new.schema).parquet(f"{path}/version={before}") if before is not None else new.limit(0)
        sinks.upsert(old, new, key, order).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return apply


def breaker(events: DataFrame, key: str, failed: str, threshold: int = 5, timeout: float = 300.0) -> DataFrame:
    """(key, failures, state, refused) after each batch.

    ``threshold`` failures in a row open the breaker. While it is open, calls within ``timeout`` seconds of the last failure are refused and count for
    nothing; a later one is tried half open: a success closes the breaker, a failure opens it again. state is closed, open, or half_open where the
    newest event of the watermark lies beyond the timeout and no call was tried since.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, last, opened, refused = state.get if state.exists else (0, 0.0, False, 0)
        # a micro-batch is bounded by the files a trigger takes
        every = pd.concat(list(batches)).sort_values("ts", kind="stable")
        now = last
        for at, bad in zip(every["ts"].map(lambda t: t.timestamp()), every[failed]):
            now = max(now, at)
            if opened and at - last <= timeout:
                refused += 1
            elif bad:
                run, last = run + 1, at
                opened = run >= threshold
            else:
                run, opened = 0, False
        state.update((run, last, opened, refused))
        shown = "closed" if not opened else "half_open" if now - last > timeout else "open"
        yield pd.DataFrame({key: [k[0]], "failures": [run], "state": [shown], "refused": [refused]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, failures long, state string, refused long", "run long, last double, opened boolean, refused long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything there is now, as a table below the checkpoint's folder; no row passes through the driver.

    In complete mode each batch replaces the result, else its rows are added under the batch's number, so that a batch that runs again writes the same.
    """
    schema, place = stream.schema, f"{checkpoint}/{name}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result" if mode == "complete" else f"{place}/result/batch={batch_id}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(schema).option("basePath", f"{place}/result").parquet(f"{place}/result" if mode == "complete" else f"{place}/result/*")
