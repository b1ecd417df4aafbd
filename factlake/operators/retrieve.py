"""Dense search, structured lookup, rank fusion, threshold and choice of one source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
QUERY_BLOCK = 512


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): exact cosine search of unit vectors.

    within names a column of the vectors and an array of the queries: a query whose array is not empty searches only rows that it lists.

    The stated queries are taken in blocks of QUERY_BLOCK; each block is one matrix that goes over all rows, every batch
    keeps its k best a query (ties at the edge too), and a final rank decides. Equal similarities go by key.
    """
    out = None
    block: list[tuple] = []
    kinds = [("string" if dict(df.dtypes)[key] == "string" else "long") for df in (queries, vectors)]
    listed = F.col(within) if within else F.lit(None)

    def scan(block: list) -> DataFrame:
        ids, q = np.array([i for i, _, _ in block]), np.array([v for _, v, _ in block], dtype=np.float64)
        only = [(i, list(w)) for i, (_, _, w) in enumerate(block) if w]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["v"].map(len) == q.shape[1]] if len(q) else pdf[:0]
                if not len(pdf):
                    continue
                s = np.round(q @ np.stack(pdf["v"].to_numpy()).astype(np.float64).T, 9)
                for i, w in only:
                    s[i, ~pdf["w"].isin(w).to_numpy()] = -np.inf
                edge = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else np.full((len(q), 1), -np.inf)
                r, c = np.nonzero((s >= edge) & (s > -np.inf))
                yield pd.DataFrame({"query_id": ids[r], key: pdf[key].to_numpy()[c], "similarity": s[r, c]})

        return vectors.where(F.col(vec).isNotNull()).select(F.col(key).cast(kinds[1]).alias(key), F.col(vec).alias("v"), listed.cast("string").alias("w")).mapInPandas(run, f"query_id {kinds[0]}, {key} {kinds[1]}, similarity double")

    for r in queries.select(F.col(key).alias("i"), F.col(vec).alias("v"), listed.alias("w")).where("v is not null").toLocalIterator():
        block.append((r["i"], r["v"], r["w"]))
        if len(block) == QUERY_BLOCK:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block = []
    if block or out is None:
        out = scan(block) if out is None else out.unionByName(scan(block))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc(key))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame, structured: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rrf, similarity, retriever, rank) by reciprocal ranks.

    dense and sparse have (query_id, id, rank, score); structured has (query_id, id) and counts as rank 1 with
    similarity 1. A document of the dense list keeps its cosine; one of the sparse list alone gets 0.75 to 0.90 by its share of the best score.
    """
    top = F.max("score").over(Window.partitionBy("query_id"))
    best = sparse.withColumn("similarity", F.when(top > 0, F.least(0.75 + 0.15 * F.col("score") / top, F.lit(0.90))).otherwise(0.75))
    parts = [
        dense.select("query_id", "id", "rank", F.col("score").alias("dense"), F.lit(None).cast("double").alias("sparse"), F.lit(0).alias("structured")),
        best.select("query_id", "id", "rank", F.lit(None).cast("double").alias("dense"), F.col("similarity").alias("sparse"), F.lit(0).alias("structured")),
    ]
    if structured is not None:
        parts.append(structured.select("query_id", "id", F.lit(1).alias("rank"), F.lit(None).cast("double").alias("dense"), F.lit(None).cast("double").alias("sparse"), F.lit(1).alias("structured")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    one = both.groupBy("query_id", "id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("rrf"), F.max("dense").alias("dense"), F.max("sparse").alias("sparse"), F.max("structured").alias("structured"))
    similarity = F.when(F.col("structured") == 1, 1.0).otherwise(F.coalesce("dense", "sparse"))
    label = F.when(F.col("structured") == 1, "structured").when(F.col("dense").isNotNull() & F.col("sparse").isNotNull(), "dense+bm25").when(F.col("dense").isNotNull(), "dense").otherwise("bm25")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), F.asc("id"))
    return one.select("query_id", "id", "rrf", F.round(similarity, 4).alias("similarity"), label.alias("retriever"), F.row_number().over(w).alias("rank"))


def relevant(fused: DataFrame, least: float = 0.75) -> DataFrame:
    """Candidates of enough similarity, ranked anew by it; equal ones keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("rank"))
    return fused.where(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w))


def single_source(candidates: DataFrame, source: str) -> DataFrame:
    """Only the candidates from the source of each query's first one."""
    first = F.first(source).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return candidates.withColumn("_first", first).where(F.col(source).eqNullSafe(F.col("_first"))).drop("_first")


def structured_lookup(asked: DataFrame, facts: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, doc_id, fact_type, value, source_url, sentence): the fact of the first named fund that has it.

    asked has (query_id, doc_ids array in order, fact_type) and may have confidence, of which ``least`` is needed; facts has (id, doc_id, fact_type, value, source_url).
    """
    asked = asked.where(F.col("confidence") >= least) if "confidence" in asked.columns else asked
    wanted = asked.select("query_id", "fact_type", F.posexplode("doc_ids").alias("pos", "doc_id"))
    one = facts.where("value is not null").groupBy("doc_id", "fact_type").agg(F.min_by("value", "id").alias("value"), F.min_by("source_url", "id").alias("source_url"))
    hit = wanted.join(one, ["doc_id", "fact_type"])
    first = hit.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where("n = 1")
    name = F.initcap(F.replace(F.element_at(F.split("source_url", "/"), -1), F.lit("-"), F.lit(" ")))
    sentence = F.concat(F.lit("The "), F.replace("fact_type", F.lit("_"), F.lit(" ")), F.lit(" for "), name, F.lit(" is "), F.col("value"), F.lit("."))
    return first.select("query_id", "doc_id", "fact_type", "value", "source_url", sentence.alias("sentence"))
