"""Manifests, coverage and integrity checks; counters are conditional aggregates, nothing stops at the first fault."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions import vectors


def stage_manifest(df: DataFrame, status: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows in all and by status."""
    counters = [F.count("*").alias("total")] + [F.count_if(F.col(status) == v).alias(v) for v in values]
    return (df.groupBy(*by) if by else df).agg(*counters)


def missing(expected: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def coverage(docs: DataFrame, chunks: DataFrame, facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunks, facts, complete) over all documents that any of the three tables has."""
    parts = [
        docs.select(key).distinct().withColumn("d", F.lit(1)).withColumn("c", F.lit(0)).withColumn("f", F.lit(0)),
        chunks.groupBy(key).agg(F.count("*").alias("c")).withColumn("d", F.lit(0)).withColumn("f", F.lit(0)),
        facts.groupBy(key).agg(F.count("*").alias("f")).withColumn("d", F.lit(0)).withColumn("c", F.lit(0)),
    ]
    all_ = functools.reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg(F.max("d").alias("listed"), F.sum("c").alias("chunks"), F.sum("f").alias("facts"))
    return all_.withColumn("complete", (F.col("listed") == 1) & (F.col("chunks") > 0) & (F.col("facts") > 0))


def integrity(vecs: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """One row: vectors in all, and how many have each fault."""
    bad = vecs.select(vectors.validity(F.col(vec), dim).alias("bad"))
    return bad.agg(F.count("*").alias("total"), *[F.count_if(F.col("bad") == k).alias(f"{k}_bad") for k in ("dimension", "nan", "inf", "zero", "norm")])


def digest(df: DataFrame, *cols: str) -> DataFrame:
    """(rows, digest): the same for every order of the rows; hashes are summed, so nothing is gathered in one place."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    s = df.select(h.alias("h"), *cols).agg(F.count("*").alias("rows"), *parts)
    return s.select("rows", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def columns_missing(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def report(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(name, passed, failures): each check is a condition that every row must meet."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("failures")) for n in checks])
    return counts.select(F.explode(pairs).alias("c")).select("c.name", (F.col("c.failures") == 0).alias("passed"), "c.failures")


def evaluation(answers: DataFrame, category: str, expected: str, answer: str) -> DataFrame:
    """Answers that hold the expected text, by category."""
    hit = F.coalesce(F.lower(F.col(answer)).contains(F.lower(F.col(expected))), F.lit(False))
    return answers.groupBy(category).agg(F.count("*").alias("total"), F.count_if(hit).alias("passed"))


# --- the audit of a run: every check is one row (name, passed, message), so a run's checks are a table ---------------------------------


def _check(df: DataFrame, name: str, passed: Column, message: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"))


def embed_totals(chunks: DataFrame, vecs: DataFrame, facts: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """One row: chunks in all, those with a valid vector, the others, and the facts stored. vecs has chunk_id and the vector; a chunk delivered twice counts once."""
    bad = vecs.groupBy("chunk_id").agg(F.max(vectors.validity(F.col(vec), dim).isNull()).alias("good"))
    n = chunks.select("chunk_id").distinct().join(bad, "chunk_id", "left").agg(F.count("*").alias("total_chunks"), F.count_if(F.coalesce("good", F.lit(False))).alias("embedded"))
    stored = facts.agg(F.count("*")).scalar()
    return n.select("total_chunks", "embedded", (F.col("total_chunks") - F.col("embedded")).alias("rejected"), stored.alias("facts_stored"))


def facts_of_chunks(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, chunks, facts, types): the chunks of each document and its facts, none where it has none; both sides are aggregated before they meet."""
    c = chunks.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    f = facts.where("value is not null").groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_distinct("fact_type").alias("types"))
    return c.join(f, "doc_id", "left").select("doc_id", "chunks", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("types", F.lit(0)).alias("types"))


def manifest_check(manifest: DataFrame, models: list[str], dims: list[int], documents: int | Column) -> DataFrame:
    """The one row of an embedding manifest: required columns, listed model and dimension, nothing rejected, enough documents."""
    lost = columns_missing(manifest, ["run_id", "model", "expected_dim", "total_chunks", "embedded", "rejected", "stored", "documents"])
    if lost:
        return _check(manifest, "manifest", F.lit(False), F.lit("missing columns: " + ", ".join(lost)))
    faults = {
        "model not listed": ~F.col("model").isin(models), "dimension not listed": ~F.col("expected_dim").isin(dims), "rejected chunks": F.col("rejected") != 0,
        "documents missing": F.col("documents") < (documents if isinstance(documents, Column) else F.lit(documents)),
    }
    said = F.concat_ws("; ", *[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for text, bad in faults.items()])
    return _check(manifest, "manifest", said == "", F.when(said == "", "valid").otherwise(said))


def columns_check(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """Whether a table has the required columns and any row; its rows are counted, not compared."""
    lost = columns_missing(df, required)
    n = df.agg(F.count("*").alias("n"))
    text = F.lit("missing columns: " + ", ".join(lost)) if lost else F.when(F.col("n") == 0, "no rows").otherwise(F.concat(F.col("n").cast("string"), F.lit(" rows")))
    return _check(n, name, F.lit(not lost) & (F.col("n") > 0), text)


def count_check(df: DataFrame, name: str, expected: Column) -> DataFrame:
    """Whether a store holds as many rows as its manifest says. expected is a literal or a scalar subquery."""
    n = df.agg(F.count("*").alias("n")).withColumn("e", expected)
    return _check(n, name, F.col("n") == F.col("e"), F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("e").cast("string")))


def coverage_check(docs: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether every listed document has a chunk and a fact."""
    n = coverage(docs, chunks, facts).where("listed = 1").agg(F.count("*").alias("all"), F.count_if(~F.col("complete")).alias("bad"))
    return _check(n, "coverage", (F.col("bad") == 0) & (F.col("all") > 0), F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(" documents incomplete")))


def integrity_check(vecs: DataFrame, dim: int) -> DataFrame:
    """Whether every vector is valid."""
    n = integrity(vecs, dim)
    bad = functools.reduce(lambda a, b: a + b, [F.col(c) for c in n.columns if c != "total"])
    return _check(n, "integrity", (bad == 0) & (F.col("total") > 0), F.concat(bad.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" vectors invalid")))


def subset_check(have: DataFrame, name: str, required: list[str], column: str) -> DataFrame:
    """Whether a bounded list of values all occur in a column."""
    found = have.where(F.col(column).isin(required)).agg(F.collect_set(column).alias("h"))
    lost = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("h")))
    return _check(found, name, F.size(lost) == 0, F.when(F.size(lost) == 0, "all").otherwise(F.concat(F.lit("missing: "), F.array_join(lost, ", "))))


def checks_of(*checks: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), checks)


def summary(checks: DataFrame, run_id: str) -> DataFrame:
    """One row: checks passed and failed, whether the run may go live, and the names of the failed ones."""
    one = checks.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("f"))
    return one.select(F.lit(run_id).alias("run_id"), "passed", "failed", ((F.col("failed") == 0) & (F.col("passed") > 0)).alias("live"), F.array_join("f", ", ").alias("failures"))


def swapped(registry: DataFrame, run: DataFrame, checks: DataFrame) -> DataFrame:
    """The run log with the new run if all its checks passed, else as it was. run has the columns of registry."""
    good = checks.agg((F.count_if(~F.col("passed")) == 0) & (F.count("*") > 0)).scalar()
    new = run.where(good)
    return registry.join(new, "run_id", "left_anti").unionByName(new)
