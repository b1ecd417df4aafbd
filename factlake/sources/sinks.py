"""Sinks: stage outputs, keyed upserts, versioned registry, audit log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, by: str | None = None, form: str = "parquet") -> None:
    w = df.write.mode("overwrite").format(form)
    (w.partitionBy(by) if by else w).save(path)


def write_chunks(built: DataFrame, path: str) -> int:
    """chunks/ as JSONL and, where there are any, discarded/ with the sentences left out. built has chunk columns and ``discarded``; returns the number of files' worth of discards."""
    built.drop("discarded").write.mode("overwrite").json(f"{path}/chunks")
    left = built.select("doc_id", F.explode("discarded").alias("sentence")).dropDuplicates()
    n = left.count()
    if n:
        left.write.mode("overwrite").json(f"{path}/discarded")
    return n


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of new in place of those with the same key; of several new ones the last by ``order``."""
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_documents(existing: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All rows of the documents that new has give way to new's rows."""
    return existing.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def new_only(new: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of new whose key, of one or more columns, existing does not have."""
    keys = [key] if isinstance(key, str) else key
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def latest(cache: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    cols = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("r")).select(key, "r.*")


def audit_name(run_id: Column) -> Column:
    return F.translate(run_id, ":+", "-_")


def swap(registry: DataFrame | None, run: DataFrame) -> DataFrame:
    """The run log with one more run. The active run is its newest row (active_run); no file is changed in place."""
    return run if registry is None else registry.join(run, "run_id", "left_anti").unionByName(run)


def active_run(registry: DataFrame) -> DataFrame:
    """(run_id, previous_run_id, activated_at, embeddings_hash) of each run with the run before it, newest first by ``age`` 1."""
    # the run log has a row per activation, a bounded table
    w = Window.orderBy("activated_at", "run_id")
    return registry.withColumn("previous_run_id", F.lag("run_id").over(w)).withColumn("age", F.row_number().over(Window.orderBy(F.desc("activated_at"), F.desc("run_id"))))


def retained(backups: DataFrame, at: str, now: str, days: int = 7) -> DataFrame:
    return backups.where(F.to_timestamp(at) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))


def safe_path(name: str) -> str:
    return re.sub(r"[:+]", lambda m: {":": "-", "+": "_"}[m[0]], name)
