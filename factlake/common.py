"""Table access and lineage helpers used throughout the package."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a session on one machine, as in tests, has its own; on a cluster that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _local()


@lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="factlake")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Scans of few large files give few partitions; CPU-bound Python stages need at least one a core.

    Only a plan without exchange is looked at and spread: to count the partitions behind one would run it.
    """
    n = at_least or cores(df.sparkSession)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.repartition(n) if "Exchange" not in plan and df.rdd.getNumPartitions() < n else df


def each(df: DataFrame, array: str, value: str, position: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per element of a computed array, with the columns to keep.

    A plain explode() makes the optimiser put a size filter with a copy of the array's expression below it, which evaluates
    costly arrays twice; the outer form with a filter behind it does not.
    """
    cols = keep if keep is not None else [c for c in df.columns if c != array]
    out = df.select(*cols, F.posexplode_outer(array).alias("_pos", value)).where("_pos is not null")
    return out.withColumnRenamed("_pos", position) if position else out.drop("_pos")
