"""From landed pages to indexed chunks and facts; every stage is DataFrame -> DataFrame and a row's error stays in its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.common import each
from factlake.functions import text, vectors


def url_allowed(df: DataFrame, allowed: DataFrame, url: str = "url") -> DataFrame:
    """Listed addresses with https."""
    return df.where(F.try_parse_url(F.col(url), F.lit("PROTOCOL")) == "https").join(allowed.select(F.col("url").alias(url)).distinct(), url, "left_semi")


def trusted(url: Column, hosts: list[str]) -> Column:
    """Whether an address is at one of the hosts; a port counts as part of it, user and case do not."""
    place = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/?#]*)", 1))
    return place.isin([h.lower() for h in hosts])


def with_doc_id(df: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Adds the doc_id of a listed address, else DOC-UNKNOWN."""
    return df.join(sources.select(F.col("url").alias(url), "doc_id").dropDuplicates([url]), url, "left").withColumn("doc_id", F.coalesce("doc_id", F.lit("DOC-UNKNOWN")))


def external_links(page: Column, domain: str) -> Column:
    return F.exists(F.regexp_extract_all(page, F.lit(r'href="([^"]*)"'), F.lit(1)), lambda x: x.startswith("http") & ~x.contains(domain))


def extract(pages: DataFrame) -> DataFrame:
    """Facts of each page; success takes two of high confidence, else the raw text stands in. pages has (doc_id, source_url, html)."""
    t = pages.withColumn("raw_text", text.visible_text(F.col("html"))).withColumn("facts", text.extract_facts(F.col("raw_text")))
    high = F.size(F.filter("facts", lambda f: f["confidence"] == "HIGH"))
    ok = F.coalesce(high >= 2, F.lit(False))
    error = F.when(F.col("html").isNull(), "no page")
    return t.select("doc_id", "source_url", ok.alias("extraction_success"), (~ok).alias("fallback_to_raw"), error.alias("error"), "facts", F.coalesce("raw_text", F.lit("")).alias("raw_text"))


def typed_facts(facts: DataFrame) -> DataFrame:
    """Flat facts with cleaned, typed value and the reason of a rejection."""
    cleaned = text.plain_numbers(text.rupee_sign(text.collapse(F.col("value"))))
    t = facts.withColumn("normalized_value", text.typed_value(F.col("fact_type"), cleaned))
    reason = F.when(F.col("normalized_value").isNull() & F.col("value").isNotNull() & (F.col("fact_type") == "inception_date"), "Date enforcement failed: not YYYY-MM-DD").otherwise(text.rejection(F.col("fact_type"), F.col("normalized_value")))
    return t.withColumn("rejection_reason", reason)


def chunked(docs: DataFrame, key: str = "doc_id", body: str = "text", most: int = 250) -> DataFrame:
    """One row per chunk: (key, idx, chunk_id, text, chunk_type, token_count, overlap). Ids hash the content, so the same text gives the same ids."""
    s = text.tokenize(F.col(body))
    kept = F.filter(s, lambda x: ~text.is_noise(x))
    typed = F.transform(kept, lambda x: F.struct(x.alias("s"), text.chunk_type(x).alias("t"), text.word_count(x).alias("n")))
    t = docs.where(F.col(body).isNotNull()).select(F.col(key).alias(key), typed.alias("s")).select(key, text.build_chunks(F.col("s"), most).alias("c"))
    one = each(t, "c", "x", "idx").select(key, "idx", "x.*")
    return one.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("idx").cast("string"), "text"), 256))


def chunk_manifest(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, sentences, discarded, error): CORPUS_EMPTY where nothing is left."""
    s = text.tokenize(F.coalesce(F.col(body), F.lit("")))
    left = F.size(F.filter(s, lambda x: ~text.is_noise(x)))
    return docs.select(F.col(key).alias(key), F.size(s).alias("sentences"), (F.size(s) - left).alias("discarded"), F.when(left == 0, "CORPUS_EMPTY").alias("error"))


def embedded(chunks: DataFrame, dim: int = 64, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks with the embedding of their text and its length. embed is a model as Column -> Column, such as a pandas UDF; its vectors are cut or filled to dim and made unit vectors."""
    v = vectors.l2_normalize(vectors.align(embed(F.col("text")), dim)) if embed else vectors.hashed_embedding(text.tokens(F.col("text")), dim)
    e = chunks.withColumn("embedding", v)
    return e.withColumn("l2_norm", vectors.norm(F.col("embedding")))


def backoff(attempt: Column, base: float = 5.0, most: float = 60.0) -> Column:
    """Seconds to wait before a further attempt."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def failure_runs(log: DataFrame, key: str, at: str, failed: Column, threshold: int = 5) -> DataFrame:
    """Runs of consecutive failures of each key: (key, started, ended, failures, opens) where ``opens`` says that a circuit breaker would open."""
    w = Window.partitionBy(key).orderBy(at, "_id")
    t = log.withColumn("_id", F.monotonically_increasing_id() if "_id" not in log.columns else F.col("_id")).withColumn("_f", F.coalesce(failed, F.lit(False)))
    t = t.withColumn("_g", F.sum(F.when(~F.col("_f"), 1).otherwise(0)).over(w))
    runs = t.where("_f").groupBy(key, "_g").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("failures"))
    return runs.drop("_g").withColumn("opens", F.col("failures") >= threshold)
