"""BM25 over a postings table: only documents that share a term with a query are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.common import each, written
from factlake.functions import text

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf, length): one row per document and term, pre-aggregated before the shuffle."""
    t = docs.select(F.col(key).alias(key), text.tokens(F.col(body)).alias("w")).select(key, "w", F.size("w").alias("length"))
    return each(t, "w", "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def statistics(docs: DataFrame, key: str, body: str) -> DataFrame:
    """One row: number of documents with words and their mean length."""
    n = F.size(text.tokens(F.col(body)))
    return docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("avg_length"))


def idf(posts: DataFrame, docs: Column) -> DataFrame:
    """(term, df, idf): terms in more than half of the documents get EPSILON times the mean idf."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.ln(docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, times): a term that a query repeats counts as often."""
    t = queries.select(F.col(key).alias(key), F.explode(text.tokens(F.col(body))).alias("term"))
    return t.groupBy(key, "term").agg(F.count("*").alias("times"))


def index(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf, length, df, idf, avg_length): the postings with their weights, tokenised once and written, for any number of queries."""
    posts = written(postings(docs, key, body))
    stats = posts.groupBy(key).agg(F.first("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length"))
    weights = idf(posts, stats.select("docs").scalar())
    return posts.join(weights, "term").withColumn("avg_length", stats.select("avg_length").scalar())


def scores(docs: DataFrame, doc_key: str, doc_body: str, queries: DataFrame, query_key: str, query_body: str) -> DataFrame:
    """(query_key, doc_key, score) of the documents that share a term with the query. The statistics always cover all documents."""
    return score(index(docs, doc_key, doc_body), doc_key, queries, query_key, query_body)


def score(indexed: DataFrame, doc_key: str, queries: DataFrame, query_key: str, query_body: str) -> DataFrame:
    asked = query_terms(queries, query_key, query_body)
    # terms no query holds leave before the postings are joined
    hit = indexed.join(asked.select("term").distinct(), "term", "left_semi")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    weighed = hit.select("term", doc_key, part.alias("part")).join(asked, "term")
    return weighed.groupBy(query_key, doc_key).agg(F.sum(F.col("times") * F.col("part")).alias("score"))


def top_k(scored: DataFrame, query_key: str, doc_key: str, k: int = 10, score: str = "score") -> DataFrame:
    """The k best documents of each query with their rank; equal scores (to six places) go by document key."""
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round(score, 6)), F.asc(doc_key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
