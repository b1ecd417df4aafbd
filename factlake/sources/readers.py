"""Sources: address lists, landed pages, JSON, JSONL and text files, phrase files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake import schemas


def address_list(spark: SparkSession, path: str, bare: bool = True) -> DataFrame:
    """(pos, url, doc_id) of the addresses in a Markdown list, in the order of the file; with bare=False bullets only."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "l"))
    bullet = F.regexp_extract("l", r"^\s*-\s*(https?://\S+)", 1)
    plain = F.regexp_extract("l", r"^\s*(https?://\S+)", 1) if bare else F.lit("")
    found = lines.select("line", F.coalesce(F.nullif(bullet, F.lit("")), F.nullif(plain, F.lit(""))).alias("url")).where("url is not null")
    return numbered(found, "line")


def address_setting(spark: SparkSession, value: str) -> DataFrame:
    """The same from a comma-separated setting."""
    urls = [u.strip() for u in value.split(",") if u.strip()]
    return numbered(spark.createDataFrame(list(enumerate(urls)), "line int, url string"), "line")


def numbered(found: DataFrame, order: str) -> DataFrame:
    """Positions from 1 for a bounded list of sources (one whole file), as an array: no window over one partition."""
    all_ = found.agg(F.array_sort(F.collect_list(F.struct(order, "url"))).alias("u"))
    each = all_.select(F.posexplode("u.url").alias("n", "url"))
    return each.select((F.col("n") + 1).alias("pos"), "url", F.format_string("DOC-%03d", F.col("n") + 1).alias("doc_id"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, html) of landed HTML files; doc_id is the file's name."""
    t = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return t.select("path", F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("doc_id"), F.col("value").alias("html"))


def facts_with_text(spark: SparkSession, facts: str, texts: str) -> DataFrame:
    """Extract results with the raw text of their page; '' where there is none."""
    f = spark.read.schema(schemas.EXTRACT).json(facts, multiLine=True)
    t = spark.read.text(texts, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)_raw\.txt$", 1).alias("doc_id"), F.col("value").alias("raw_text"))
    return f.join(t, "doc_id", "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSONL; blank lines are skipped."""
    return spark.read.schema(schemas.CHUNK).json(path).where("chunk_id is not null")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """(category, phrase) of a JSON file that maps categories to lists, in small letters."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return m.select(F.explode("m").alias("category", "ps")).select("category", F.explode("ps").alias("phrase")).select("category", F.lower("phrase").alias("phrase"))
