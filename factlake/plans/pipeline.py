"""Whole plans: pages to index, questions to checked answers. Questions are a table; every step is set-at-a-time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.common import written
from factlake.operators import answer, bm25, ingest, query, retrieve


def ingestion(pages: DataFrame) -> dict[str, DataFrame]:
    """extract, typed facts, chunks and embeddings of landed pages (doc_id, source_url, html)."""
    extracted = ingest.extract(pages)
    facts = ingest.typed_facts(extracted.select("doc_id", "source_url", F.explode("facts").alias("f")).select("doc_id", "source_url", "f.*"))
    chunks = ingest.chunked(extracted.select("doc_id", F.col("raw_text").alias("text")))
    return {"extracted": extracted, "facts": facts, "chunks": chunks, "embeddings": ingest.embedded(chunks)}


Embed = Callable[[Column], Column]
Model = Callable[[Column, Column], Column]


def funds_of(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, doc_ids): the funds that each question names, in its own words or with synonyms replaced."""
    terms = questions.select("query_id", F.concat_ws(" . ", "query", query.normalize_terms(F.col("query"))).alias("query"))
    return query.find_funds(terms, query.aliases(facts))


def hybrid(questions: DataFrame, chunks: DataFrame, facts: DataFrame, k: int = 10, embed: Embed | None = None, named: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, source_url, text, similarity, retriever) by cosine, BM25 and fact lookup, fused and filtered.

    A question that names funds takes chunks of these only. chunks has one row a chunk_id. embed is the text embedding, the same for questions and chunks.
    """
    named = funds_of(questions, facts) if named is None else named
    q = questions.join(named, "query_id", "left")
    asked = ingest.embedded(q.select("query_id", F.col("query").alias("text"), F.col("doc_ids").alias("doc_id")), embed=embed)
    vectors = ingest.embedded(chunks.select("chunk_id", "doc_id", "text"), embed=embed)
    near = retrieve.dense_top_k(vectors, asked.withColumnRenamed("query_id", "chunk_id"), k, "chunk_id", within="doc_id")
    dense = near.select("query_id", F.col("chunk_id").alias("id"), "rank", F.col("similarity").alias("score"))
    scored = bm25.scores(chunks, "chunk_id", "text", questions, "query_id", "query").join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(named, "query_id", "left")
    scored = scored.where(F.col("doc_ids").isNull() | (F.size("doc_ids") == 0) | F.array_contains("doc_ids", F.col("doc_id"))).select("query_id", "chunk_id", "score")
    sparse = bm25.top_k(scored, "query_id", "chunk_id", k).select("query_id", F.col("chunk_id").alias("id"), "rank", "score")
    typed = q.where("doc_ids is not null").withColumn("fact_type", query.fact_type(F.col("query"))).withColumn("confidence", query.fact_confidence(F.col("query")))
    looked = retrieve.structured_lookup(typed.select("query_id", "doc_ids", "fact_type", "confidence"), facts).withColumn("id", F.concat_ws("_", F.lit("structured"), "doc_id", "fact_type"))
    fused = written(retrieve.relevant(retrieve.fuse(dense, sparse, looked)))  # read twice; few candidates a question
    texts = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "source_url", "text")
    cols = ["query_id", "rank", "doc_id", "source_url", "text", "similarity", "retriever"]
    facts_found = fused.where("retriever = 'structured'").join(looked.select("query_id", "doc_id", "source_url", F.col("sentence").alias("text")), "query_id")
    return fused.where("retriever <> 'structured'").join(texts, "id").select(cols).unionByName(facts_found.select(cols))


def answers(
    questions: DataFrame, chunks: DataFrame, facts: DataFrame, as_of: str, k: int = 10, embed: Embed | None = None, models: list[Model] | None = None, allowed: DataFrame | None = None
) -> DataFrame:
    """(query_id, intent, source_url, response, status) for every question.

    questions has (query_id, query); chunks (chunk_id, doc_id, source_url, text); facts as schemas.STRUCTURED_FACT.
    Questions with personal data, advice, a comparison of several funds, or no subject leave before retrieval. embed and models take the place of
    the stand-ins; models are tried in their order. allowed lists the addresses (url) whose passages may be read.
    """
    q = questions.select("query_id", query.sanitize(F.col("query")).alias("query"))
    q = q.withColumn("personal", query.personal_data(F.col("query"))).withColumn("intent", query.intent(F.col("query"))["classification"])
    factual = q.where((F.size("personal") == 0) & (F.col("intent") == "FACTUAL"))
    named = written(funds_of(factual, facts))  # a few funds a question, read several times
    compared = factual.join(named, "query_id").where(query.compares(F.col("query"), F.col("doc_ids"))).select("query_id", F.lit("ADVISORY").alias("_compared"))
    q = q.join(compared, "query_id", "left").withColumn("intent", F.coalesce("_compared", "intent")).drop("_compared")
    go = factual.join(compared, "query_id", "left_anti")
    one = chunks.dropDuplicates(["chunk_id"])
    found = hybrid(go, one, facts, k, embed, named)
    found = found if allowed is None else answer.whitelisted(found, allowed)
    # candidates are few (k of each list a question) and read twice
    kept = written(retrieve.single_source(found, "doc_id"))
    ctx = answer.context(kept, F.coalesce("doc_id", F.lit("this fund")))
    url = kept.groupBy("query_id").agg(F.min_by("source_url", "rank").alias("source_url"))
    got = q.join(ctx, "query_id", "left").join(url, "query_id", "left")
    check = answer.checked(answer.inferred(F.col("context"), F.col("query"), models), F.col("context"))
    got = got.withColumn("c", F.when(F.col("context").isNotNull(), check))
    status = F.when(F.size("personal") > 0, "PERSONAL_DATA").when(F.col("intent") != "FACTUAL", F.col("intent")).when(F.col("c.response").isNull() & F.coalesce(F.col("c.status") == "APPROVED", F.lit(True)), "UNKNOWN").otherwise(F.col("c.status"))
    text = F.when(F.col("c.response").isNotNull(), answer.cited(F.col("c.response"), F.col("source_url"), as_of))
    return got.select("query_id", "intent", "source_url", text.alias("response"), status.alias("status"))
