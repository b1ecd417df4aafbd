"""The named queries of the core; catalog_sql.py has the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.catalog_sql import SQL
from factlake.common import each, shared_folder, spread, table, written
from factlake import schemas
from factlake.functions import sqlfunctions, text, vectors
from factlake.operators import answer, audit, bm25, ingest, query, retrieve, units
from factlake.plans import pipeline
from factlake.sources import sinks
from factlake.streaming import streams

FLAGSHIP = "bm25_topk"
QUERIES: dict = {}
AS_OF = "2026-06-01"


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark, sf_dir) -> DataFrame:
    """The documents over all cores; a table of few small files would keep CPU-bound expressions on one."""
    return spread(table(spark, sf_dir, "documents"))


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- quantities ---------------------------------------------------------------------------------


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose value is in another unit than the common one of its type."""
    return units.found(table(spark, sf_dir, "extracted_facts"), table(spark, sf_dir, "structured_fact"), table(spark, sf_dir, "common_units"))


@_query
def p5_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity in the common unit, with the unit that the identities propose."""
    return units.convert(table(spark, sf_dir, "extracted_facts"), table(spark, sf_dir, "structured_fact"), table(spark, sf_dir, "common_units"))


# --- fact table, keys, manifests -----------------------------------------------------------------


@_query
def fact_sources(spark, sf_dir):
    return table(spark, sf_dir, "structured_fact").select("source_url").distinct()


@_query
def facts_per_document(spark, sf_dir):
    return table(spark, sf_dir, "structured_fact").groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_distinct("fact_type").alias("types"))


@_query
def fact_types_of_document(spark, sf_dir):
    return table(spark, sf_dir, "structured_fact").where("doc_id = 'DOC-002'").select("fact_type").distinct()


@_query
def fact_count(spark, sf_dir):
    return table(spark, sf_dir, "structured_fact").agg(F.count("*").alias("facts"))


@_query
def fact_sample(spark, sf_dir):
    return table(spark, sf_dir, "structured_fact").select("id", "doc_id", "fact_type").dropDuplicates().orderBy("id").limit(1)


@_query
def fact_lookup(spark, sf_dir):
    f = table(spark, sf_dir, "structured_fact").where("value is not null")
    return f.groupBy("doc_id", "fact_type").agg(F.min_by("value", "id").alias("value"))


@_query
def facts_replaced_by_document(spark, sf_dir):
    old = table(spark, sf_dir, "structured_fact").select("id", "doc_id", "fact_type", "value")
    new = table(spark, sf_dir, "extracted_facts").where("confidence = 'HIGH'").select((F.col("fact_id") + 1_000_000_000).alias("id"), "doc_id", "fact_type", "value")
    return sinks.replace_documents(old, new)


@_query
def vectors_upserted(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    """Every third vector again with two labels, of which the greater counts, and as many new ones."""
    again = v.where("vec_id % 3 = 0")
    new = again.select("vec_id", (F.col("label") + 100).alias("label")).unionByName(again.select("vec_id", (F.col("label") + 50).alias("label")))
    return sinks.upsert(v, new.unionByName(again.select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label")), "vec_id", "label")


@_query
def new_facts_only(spark, sf_dir):
    """Facts whose value the index of earlier runs does not have for their document and type."""
    f = table(spark, sf_dir, "extracted_facts").where("value is not null").select("fact_id", "doc_id", "fact_type", "value").distinct()
    return sinks.new_only(f, table(spark, sf_dir, "structured_fact").where("value is not null"), ["doc_id", "fact_type", "value"])


@_query
def documents_without_facts(spark, sf_dir):
    """Documents with chunks whose index holds no price."""
    return audit.missing(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "structured_fact").where("fact_type = 'nav' and value is not null"), "doc_id")


@_query
def documents_in_both(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("doc_id").intersect(table(spark, sf_dir, "structured_fact").select("doc_id"))


@_query
def latest_fetch(spark, sf_dir):
    f = table(spark, sf_dir, "fetch_result").select("url", "status", "fetched_at")
    return sinks.latest(f.withColumn("at", F.struct(F.col("fetched_at").cast("timestamp"), "status")), "url", "at").select("url", "status", "fetched_at")


@_query
def fetch_manifest(spark, sf_dir):
    return audit.stage_manifest(table(spark, sf_dir, "fetch_result").dropDuplicates(), "status", ["success", "not_modified", "failed"])


@_query
def fact_manifest(spark, sf_dir):
    return audit.stage_manifest(table(spark, sf_dir, "extracted_facts").dropDuplicates(), "confidence", ["HIGH", "MEDIUM", "LOW"], ["doc_id"])


@_query
def coverage_report(spark, sf_dir):
    return audit.coverage(table(spark, sf_dir, "fetch_result"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "structured_fact"))


@_query
def chunk_checks(spark, sf_dir):
    return audit.report(table(spark, sf_dir, "chunks"), {"has_text": "length(text) > 0", "has_url": "source_url is not null", "small": "token_count <= 250", "typed": "chunk_type is not null"})


@_query
def run_registry(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).distinct().withColumn("activated_at", F.col("run_id"))
    return _long(sinks.active_run(runs), "age")


@_query
def breaker_runs(spark, sf_dir):
    f = table(spark, sf_dir, "fetch_result").select("doc_id", "fetched_at", "status").distinct().withColumn("_id", F.col("status"))
    f = f.withColumn("at", F.struct(F.col("fetched_at").cast("timestamp").alias("t"), F.col("fetched_at").alias("s")))
    return ingest.failure_runs(f, "doc_id", "at", F.col("status") == "failed", 2).withColumn("started", F.col("started.s")).withColumn("ended", F.col("ended.s")).select("doc_id", "started", "ended", "failures", "opens")


@_query
def backoff_schedule(spark, sf_dir):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), ingest.backoff(F.col("id")).alias("seconds"))


EMBEDDING_DIM = 64


def _manifest(spark, sf_dir):
    c, f = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "structured_fact")
    n = audit.embed_totals(c, ingest.embedded(c.dropDuplicates(["chunk_id"]).select("chunk_id", "text")), f, EMBEDDING_DIM)
    documents = c.agg(F.count_distinct("doc_id")).scalar()
    return n.select(F.lit("run-1").alias("run_id"), F.lit("hashed").alias("model"), F.lit(EMBEDDING_DIM).alias("expected_dim"), "*", documents.alias("documents"), F.col("facts_stored").alias("stored"))


@_query
def embed_totals(spark, sf_dir):
    return _manifest(spark, sf_dir).select("total_chunks", "embedded", "rejected", "facts_stored", "documents")


@_query
def chunks_with_facts(spark, sf_dir):
    return audit.facts_of_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "structured_fact").where("confidence = 'HIGH'"))


def _checks(spark, sf_dir):
    m = written(_manifest(spark, sf_dir))
    c, f, v, log = (table(spark, sf_dir, t) for t in ("chunks", "structured_fact", "embeddings", "fetch_result"))
    return audit.checks_of(
        audit.manifest_check(m, ["hashed"], [EMBEDDING_DIM], log.where("status = 'success'").agg(F.count_distinct("doc_id")).scalar()),
        audit.columns_check(f, "fact_store", [c.split()[0] for c in schemas.STRUCTURED_FACT.split(", ")]),
        audit.columns_check(c, "chunk_table", ["chunk_id", "doc_id", "embedding"]),
        audit.count_check(c.select("chunk_id").distinct(), "store_count", m.select("embedded").scalar()),
        audit.count_check(f, "fact_count", m.select("stored").scalar()),
        audit.coverage_check(log, c, f),
        audit.integrity_check(v, EMBEDDING_DIM),
        audit.subset_check(f, "fact_types", ["nav", "aum", "exit_load"], "fact_type"),
    )


@_query
def audit_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@_query
def audit_summary(spark, sf_dir):
    return _long(audit.summary(_checks(spark, sf_dir), "run-1"), "passed", "failed")


@_query
def registry_after_audit(spark, sf_dir):
    """The run log after a run whose checks failed (it stays out) and one whose checks passed."""
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).distinct().withColumn("activated_at", F.col("run_id"))
    bad, good = _checks(spark, sf_dir), audit.subset_check(table(spark, sf_dir, "structured_fact"), "fact_types", ["nav"], "fact_type")
    run = lambda name: spark.range(1).select(F.lit(name).alias("run_id"), F.lit(AS_OF).alias("activated_at"))
    return audit.swapped(audit.swapped(days, run("run-bad"), bad), run("run-good"), good)


@_query
def trusted_sources(spark, sf_dir):
    u = table(spark, sf_dir, "chunks").select("source_url").distinct()
    return u.select("source_url", ingest.trusted(F.col("source_url"), ["gavranefunds.example", "www.gavranefunds.example"]).alias("trusted"))


@_query
def vector_digest(spark, sf_dir):
    return audit.digest(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


# --- addresses -----------------------------------------------------------------------------------


def _allowed(spark, sf_dir):
    return table(spark, sf_dir, "fetch_result").where("status = 'success'").select("url")


@_query
def whitelisted_chunks(spark, sf_dir):
    return ingest.url_allowed(table(spark, sf_dir, "chunks").select("chunk_id", "source_url"), _allowed(spark, sf_dir), "source_url").select("chunk_id", "source_url")


@_query
def security_events(spark, sf_dir):
    return answer.whitelisted(table(spark, sf_dir, "chunks").select("chunk_id", "source_url"), _allowed(spark, sf_dir), keep=False).select("chunk_id", "source_url")


@_query
def address_parts(spark, sf_dir):
    u = table(spark, sf_dir, "fetch_result").select("url").distinct()
    slug = F.element_at(F.split("url", "/"), -1)
    return u.select("url", F.try_parse_url("url", F.lit("PROTOCOL")).alias("protocol"), F.try_parse_url("url", F.lit("HOST")).alias("host"), slug.alias("slug"), F.replace(slug, F.lit("-"), F.lit(" ")).alias("name"))


@_query
def document_ids(spark, sf_dir):
    sources = table(spark, sf_dir, "fetch_result").groupBy("url").agg(F.min("doc_id").alias("doc_id"))
    asked = table(spark, sf_dir, "chunks").select(F.col("chunk_id"), F.col("source_url").alias("url")).dropDuplicates()
    return ingest.with_doc_id(asked, sources).select("chunk_id", "url", "doc_id")


@_query
def fund_aliases(spark, sf_dir):
    return query.aliases(table(spark, sf_dir, "fetch_result").select("doc_id", F.col("url").alias("source_url")))


# --- text ----------------------------------------------------------------------------------------


def _page(spark, sf_dir):
    c = spread(table(spark, sf_dir, "chunks")).dropDuplicates(["chunk_id"])
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p>\n<p>"))
    html = F.concat(F.lit("<html><head><title>Page</title><style>p {}</style></head><body><!-- top --><nav>Menu</nav><article><p>"), body, F.lit("</p></article><footer>Terms</footer></body></html>"))
    return c.select("chunk_id", "doc_id", "source_url", html.alias("html"))


@_query
def visible_text(spark, sf_dir):
    return _page(spark, sf_dir).select("chunk_id", text.visible_text(F.col("html")).alias("text"))


@_query
def external_links(spark, sf_dir):
    h = table(spark, sf_dir, "fetch_result").select("url").distinct().withColumn("html", F.concat(F.lit('<a href="'), "url", F.lit('">x</a><a href="/help">y</a>')))
    return h.select("url", ingest.external_links(F.col("html"), "gavranefunds.example").alias("external"))


@_query
def unescaped_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "extracted_facts").select("fact_id", text.clean(F.col("raw_snippet")).alias("clean")).distinct()


@_query
def white_space_collapsed(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("digest"))


@_query
def rupee_signs(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.sha2(text.rupee_sign(F.col("text")), 256).alias("digest"))


@_query
def plain_numbers(spark, sf_dir):
    return table(spark, sf_dir, "extracted_facts").where("value is not null").select("value").distinct().select("value", text.plain_numbers(F.col("value")).alias("plain"))


@_query
def iso_dates(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.iso_date(F.col("text")).alias("date"))


@_query
def percentages(spark, sf_dir):
    return table(spark, sf_dir, "extracted_facts").where("value is not null").select("value").distinct().select("value", text.percent(F.col("value")).alias("percent"))


@_query
def extracted_from_text(spark, sf_dir):
    f = each(_documents(spark, sf_dir).select("doc_id", text.extract_facts(F.col("text")).alias("a")), "a", "f")
    return f.select("doc_id", "f.fact_type", "f.confidence", F.length("f.raw_snippet").cast("long").alias("length"))


@_query
def extracted_values(spark, sf_dir):
    f = each(_documents(spark, sf_dir).select("doc_id", text.extract_facts(F.col("text")).alias("a")), "a", "f").where("f.fact_type in ('expense_ratio', 'nav', 'min_sip', 'min_lumpsum', 'inception_date', 'fund_manager')")
    return f.select("doc_id", "f.fact_type", "f.value")


@_query
def extraction_results(spark, sf_dir):
    e = ingest.extract(_page(spark, sf_dir))
    return e.select("doc_id", "extraction_success", "fallback_to_raw", F.size("facts").alias("facts")).groupBy("doc_id", "extraction_success").agg(F.count("*").alias("pages"), F.sum("facts").alias("facts"))


@_query
def typed_facts(spark, sf_dir):
    t = ingest.typed_facts(table(spark, sf_dir, "extracted_facts").select("fact_id", "fact_type", "value").distinct())
    return t.select("fact_id", "fact_type", "normalized_value", "rejection_reason")


@_query
def rejections(spark, sf_dir):
    t = ingest.typed_facts(table(spark, sf_dir, "extracted_facts").select("fact_id", "fact_type", "value").distinct())
    return t.groupBy("fact_type", F.coalesce("rejection_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("facts"))


@_query
def word_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"), F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"))


@_query
def sentence_tokens(spark, sf_dir):
    s = each(_documents(spark, sf_dir).select("doc_id", text.tokenize(F.col("text")).alias("a")), "a", "sentence", "n")
    return s.select("doc_id", "n", "sentence", text.is_noise(F.col("sentence")).alias("noise"), text.self_contained(F.col("sentence")).alias("self_contained"))


@_query
def chunk_types(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.chunk_type(F.col("text")).alias("chunk_type"), text.is_noise(F.col("text")).alias("noise"))


@_query
def long_texts_split(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.posexplode(text.split_long(F.col("text"))).alias("piece", "t"))
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), F.sha2("t", 256).alias("digest"))


@_query
def chunk_table_function(spark, sf_dir):
    """The pieces of every document by the SQL table function chunk_text."""
    sqlfunctions.register(spark)
    _documents(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("factlake_documents")
    t = spark.sql("select doc_id, c.piece, c.words, c.text from factlake_documents, lateral chunk_text(text, 250) c")
    return t.select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("words").cast("long").alias("words"), F.sha2("text", 256).alias("digest"))


@_query
def semantic_chunks(spark, sf_dir):
    return ingest.chunked(_documents(spark, sf_dir)).select("doc_id", "idx", "chunk_id", "chunk_type", "token_count", "overlap", "text")


@_query
def chunking_manifest(spark, sf_dir):
    return ingest.chunk_manifest(_documents(spark, sf_dir))


# --- vectors and retrieval ------------------------------------------------------------------------


@_query
def vector_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.round(vectors.norm(vectors.l2_normalize(F.col("embedding"))), 4).alias("unit"))


@_query
def vector_integrity(spark, sf_dir):
    return audit.integrity(table(spark, sf_dir, "embeddings"), 64)


@_query
def vectors_aligned(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.align(F.col("embedding"), 32).alias("a"), vectors.align(F.col("embedding"), 96).alias("b"))
    return v.select("vec_id", F.size("a").cast("long").alias("cut"), F.size("b").cast("long").alias("padded"), F.round(vectors.norm(F.col("a")), 4).alias("cut_norm"))


@_query
def chunk_embeddings(spark, sf_dir):
    c = ingest.embedded(table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "text"))
    return c.select("chunk_id", F.round("l2_norm", 4).alias("norm"), "embedding")


def _dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieve.dense_top_k(e, e.where("vec_id % 100 = 0"))


@_query
def dense_topk(spark, sf_dir):
    return _long(_dense(spark, sf_dir).withColumn("similarity", F.round("similarity", 4)), "rank")


def _bm25(spark, sf_dir, body, indexed=None):
    q = table(spark, sf_dir, "golden_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col(body).alias("q"))
    indexed = indexed or bm25.index(_documents(spark, sf_dir), "doc_id", "text")
    return bm25.top_k(bm25.score(indexed, "doc_id", q, "query_id", "q"), "query_id", "doc_id")


@_query
def bm25_idf(spark, sf_dir):
    d = _documents(spark, sf_dir)
    w = bm25.idf(written(bm25.postings(d, "doc_id", "text")), bm25.statistics(d, "doc_id", "text").select("docs").scalar())
    return w.select("term", "df", F.round("idf", 4).alias("idf"))


@_query
def bm25_topk(spark, sf_dir):
    return _long(_bm25(spark, sf_dir, "query").withColumn("score", F.round("score", 4)), "rank")


def _fused(spark, sf_dir):
    top = F.max("score").over(Window.partitionBy("query_id"))
    indexed = bm25.index(_documents(spark, sf_dir), "doc_id", "text")
    dense = _bm25(spark, sf_dir, "expected", indexed).withColumn("score", F.col("score") / top).select("query_id", F.col("doc_id").alias("id"), "rank", "score")
    sparse = _bm25(spark, sf_dir, "query", indexed).select("query_id", F.col("doc_id").alias("id"), "rank", "score")
    return retrieve.fuse(dense, sparse)


@_query
def rank_fusion(spark, sf_dir):
    return _long(_fused(spark, sf_dir).withColumn("rrf", F.round("rrf", 6)).withColumn("similarity", F.round("similarity", 3)), "rank")


@_query
def relevance_filter(spark, sf_dir):
    return _long(retrieve.relevant(_fused(spark, sf_dir)).select("query_id", "id", "rank"), "rank")


@_query
def single_source(spark, sf_dir):
    c = retrieve.relevant(_fused(spark, sf_dir)).join(_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), "id")
    return _long(retrieve.single_source(c, "source").select("query_id", "id", "source", "rank"), "rank")


@_query
def context_budget(spark, sf_dir):
    d = _documents(spark, sf_dir).where("source is not null").select("source", "doc_id", "text")
    first = d.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).withColumnRenamed("source", "query_id")
    return answer.context(first, F.col("query_id"))


@_query
def fact_lookup_answers(spark, sf_dir):
    q = table(spark, sf_dir, "structured_fact").groupBy("doc_id").agg(F.min("id").alias("query_id")).select("query_id", F.array("doc_id").alias("doc_ids"), F.lit("expense_ratio").alias("fact_type"))
    return retrieve.structured_lookup(q, table(spark, sf_dir, "structured_fact")).select("query_id", "doc_id", "value")


@_query
def fact_sentences(spark, sf_dir):
    """The sentences for questions that ask for the fund assets of two documents, of which the first that has them counts, with the confidence that a named fact type gives."""
    q = table(spark, sf_dir, "structured_fact").groupBy("doc_id").agg(F.min("id").alias("query_id"))
    q = q.select("query_id", F.array("doc_id", F.lit("DOC-001")).alias("doc_ids"), query.fact_type(F.lit("Fund size?")).alias("fact_type"), query.fact_confidence(F.lit("Fund size?")).alias("confidence"))
    return retrieve.structured_lookup(q, table(spark, sf_dir, "structured_fact").where("source_url is not null")).select("query_id", "doc_id", "sentence")


@_query
def hybrid_fusion(spark, sf_dir):
    """Cosine, BM25 and looked-up documents fused: query vector, golden question and corpus row share their number; the row with the query's own number counts as looked up."""
    dense = _dense(spark, sf_dir).select("query_id", F.col("vec_id").alias("id"), "rank", F.col("similarity").alias("score"))
    sparse = _bm25(spark, sf_dir, "query").select("query_id", F.col("doc_id").alias("id"), "rank", "score")
    looked = table(spark, sf_dir, "golden_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("id"))
    f = retrieve.fuse(dense, sparse, looked)
    return _long(f.withColumn("rrf", F.round("rrf", 6)).withColumn("similarity", F.round("similarity", 3)), "rank")


# --- questions and answers ------------------------------------------------------------------------


@_query
def personal_data_scan(spark, sf_dir):
    t = _documents(spark, sf_dir).select("doc_id", query.personal_data(F.col("text")).alias("p"))
    return t.select("doc_id", F.array_join("p", ",").alias("kinds"))


@_query
def questions_sanitized(spark, sf_dir):
    return table(spark, sf_dir, "golden_items").select("item_id", query.sanitize(F.col("query")).alias("query"))


@_query
def question_intents(spark, sf_dir):
    g = table(spark, sf_dir, "golden_items").select("item_id", query.intent(F.col("query")).alias("i"))
    return g.select("item_id", "i.classification", "i.advisory_score", F.col("i.advisory_hits").cast("long").alias("advisory_hits"), F.col("i.factual_hits").cast("long").alias("factual_hits"))


@_query
def document_intents(spark, sf_dir):
    g = _documents(spark, sf_dir).select("doc_id", query.intent(F.col("text")).alias("i"))
    return g.groupBy("i.classification").agg(F.count("*").alias("documents"), F.sum("i.advisory_hits").alias("advisory_hits"), F.sum("i.factual_hits").alias("factual_hits"))


@_query
def question_terms(spark, sf_dir):
    return table(spark, sf_dir, "golden_items").select("item_id", query.normalize_terms(F.col("query")).alias("terms"))


@_query
def question_fact_types(spark, sf_dir):
    return table(spark, sf_dir, "golden_items").select("item_id", query.fact_type(F.col("query")).alias("fact_type"))


@_query
def question_funds(spark, sf_dir):
    named = query.aliases(table(spark, sf_dir, "fetch_result").select("doc_id", F.col("url").alias("source_url")))
    return query.find_funds(_documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), named)


@_query
def banned_phrases(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(answer.banned(F.col("text")), ",").alias("phrases"))


@_query
def number_traceability(spark, sf_dir):
    return table(spark, sf_dir, "golden_items").select("item_id", F.array_join(answer.untraceable_numbers(F.col("expected"), F.col("query")), ",").alias("numbers"))


@_query
def answer_checks(spark, sf_dir):
    """The expected answers, checked against their question as context."""
    return table(spark, sf_dir, "golden_items").select("item_id", answer.checked(F.col("expected"), F.col("query")).alias("c")).select("item_id", "c.*")


@_query
def answer_verdicts(spark, sf_dir):
    """The verdicts of the same checks by category."""
    c = table(spark, sf_dir, "golden_items").select("category", answer.checked(F.col("expected"), F.col("query")).alias("c"))
    return c.groupBy("category", "c.status").agg(F.count("*").alias("answers"))


@_query
def prompt_hashes(spark, sf_dir):
    return table(spark, sf_dir, "golden_items").select("item_id", answer.prompt_hash(F.lit("Answer from the context only.\n"), F.col("query")).alias("hash"))


@_query
def formatted_answers(spark, sf_dir):
    t = F.concat("expected", F.lit(" See https://nav.example/list?a=1&b=2."))
    return table(spark, sf_dir, "golden_items").select("item_id", answer.linked(answer.escaped(t)).alias("html"), answer.cited(F.col("expected"), F.lit(None).cast("string"), AS_OF).alias("cited"))


@_query
def golden_report(spark, sf_dir):
    """Golden questions of which one of the ten best documents by BM25 holds the expected answer, by category."""
    g, d = table(spark, sf_dir, "golden_items"), _documents(spark, sf_dir)
    asked = g.select(F.col("item_id").alias("query_id"), F.col("query").alias("q"))
    top = bm25.top_k(bm25.score(bm25.index(d, "doc_id", "text"), "doc_id", asked, "query_id", "q"), "query_id", "doc_id")
    read = top.join(d.select("doc_id", "text"), "doc_id").join(g.select(F.col("item_id").alias("query_id"), "expected"), "query_id")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    hit = read.groupBy("query_id").agg(F.max(F.coalesce(plain("text").contains(plain("expected")), F.lit(False))).alias("hit"))
    told = g.join(hit, F.col("item_id") == F.col("query_id"), "left")
    return audit.evaluation(told.select("category", F.lit("yes").alias("want"), F.when(F.col("hit"), "yes").alias("got")), "category", "want", "got")


@_query
def answered_questions(spark, sf_dir):
    q = table(spark, sf_dir, "golden_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "query")
    return pipeline.answers(q, table(spark, sf_dir, "chunks"), table(spark, sf_dir, "structured_fact"), AS_OF)


# --- streams ---------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return streams.timed(streams.read(spark, f"{sf_dir}/events.parquet*", schema))


def _once(stream, name, mode="complete"):
    place = f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    return streams.run_once(stream, f"stream_{name}", place, mode)


@_query
def stream_event_windows(spark, sf_dir):
    w = _once(streams.windowed(_stream(spark, sf_dir), "event_type"), "windows")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


@_query
def stream_sliding_windows(spark, sf_dir):
    w = _once(streams.windowed(_stream(spark, sf_dir), "event_type", size="2 days", slide="1 day"), "sliding")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@_query
def stream_deduplicated(spark, sf_dir):
    """Events delivered twice, counted once."""
    e = _stream(spark, sf_dir)
    d = _once(streams.deduplicated(e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "event_id"), "deduplicated", "append")
    return d.groupBy("event_type").agg(F.count("*").alias("events"))


@_query
def stream_sessions(spark, sf_dir):
    w = _once(streams.sessions(_stream(spark, sf_dir), "user_id"), "sessions")
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


# --- relational surface beyond the reference ----------------------------------------------------------


@_query
def fact_rollup(spark, sf_dir):
    f = table(spark, sf_dir, "extracted_facts").dropDuplicates()
    return f.rollup("fact_type", "confidence").agg(F.count("*").alias("facts"), F.count_distinct("doc_id").alias("documents"))


@_query
def event_cube(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.cube("event_type", "day").agg(F.count("*").alias("n"))


@_query
def approximate_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_orderkey").alias("orders"))


@_query
def facts_as_of(spark, sf_dir):
    """For each extracted fact the value indexed last before it, by one sort of both tables' rows."""
    new = table(spark, sf_dir, "extracted_facts").select("doc_id", "fact_type", F.col("extracted_at").cast("timestamp").alias("at"), F.col("fact_id")).distinct()
    old = table(spark, sf_dir, "structured_fact").where("value is not null").groupBy("doc_id", "fact_type", F.col("indexed_at").cast("timestamp").alias("at")).agg(F.min("value").alias("v"))
    both = new.withColumn("v", F.lit(None).cast("string")).withColumn("side", F.lit(1)).unionByName(old.withColumn("fact_id", F.lit(None).cast("long")).withColumn("side", F.lit(0)))
    w = Window.partitionBy("doc_id", "fact_type").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("earlier", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("fact_id", "doc_id", "fact_type", "earlier")


@_query
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n"))


@_query
def revenue_by_nation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))


@_query
def orders_without_items(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")
