"""Problem 2: lines repeated across the documents of one site.

Within each site, the number of documents that hold a line is compared with its
rate outside the site by the log-likelihood ratio; the Benjamini-Hochberg
procedure controls the share of false discoveries. The excess lines leave the
documents by an anti-join, and each text is put together again by position.

A line that is repeated on every site would excuse itself, so its outside rate counts
at most as the mean rate of all lines.

Defined results: null and empty texts have no lines and stay as they are; lines without
letters are never repeated lines; a row without URL takes the site of its document's
other rows, and has none if they have none either; rows delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.common import written

FALSE_DISCOVERIES = 0.05
BINS_A_UNIT, LAST_BIN = 20, 40_000


def host(url: Column) -> Column:
    """Host of a URL without letter case, user, port and a leading www. or m.; null if there is none."""
    h = F.lower(F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(h, r"^(?:www|m)\.", ""), F.lit(""))


def line_key(line: Column) -> Column:
    """The letters of a line, without case; null if it has none."""
    return F.nullif(F.replace(F.lower(F.regexp_replace(line, r"[^\p{L}]+", "")), F.lit("ß"), F.lit("ss")), F.lit(""))


def with_site(df: DataFrame, url: str = "source_url", doc: str = "doc_id") -> DataFrame:
    """Adds ``site``. Only the rows without a URL are joined with their document's site."""
    own = df.withColumn("site", host(F.col(url)))
    of_doc = own.where("site is not null").groupBy(doc).agg(F.min("site").alias("doc_site"))
    rest = own.where("site is null").drop("site").join(of_doc, doc, "left").withColumnRenamed("doc_site", "site")
    return own.where("site is not null").unionByName(rest)


def lines_of(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per piece between line feeds: (keep..., line_no from 1, line)."""
    split = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    return split.select(*keep, (F.col("n") + 1).alias("line_no"), "line")


def _keyed(lines: DataFrame) -> DataFrame:
    k = lines.withColumn("key", line_key(F.col("line"))).where("key is not null and site is not null")
    return k.withColumn("k1", F.xxhash64("key")).withColumn("k2", F.hash("key")).drop("key")


def chance(g: Column) -> Column:
    """Upper bound of the chance that chi-square with one degree of freedom exceeds g; tight where g is large."""
    return F.exp(-g / 2) * F.least(F.lit(1.0), F.sqrt(2 / (F.lit(3.141592653589793) * F.greatest(g, F.lit(1e-9)))))


def excess_lines(df: DataFrame, lines: DataFrame | None = None, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """(site, k1, k2, docs, site_docs): lines whose document frequency in the site is significantly above the outside rate.

    df needs (doc_id, site, text); lines may hold its lines with their hashes. Counts cover all rows; only line hashes are shuffled, pre-aggregated.
    """
    sited = df.where("site is not null")
    if lines is None:
        lines = _keyed(lines_of(sited, "site", "doc_id"))
    site_docs = written(sited.select("site", "doc_id").distinct().groupBy("site").agg(F.count("*").alias("n1")))
    seen = lines.select("site", "doc_id", "k1", "k2").distinct()
    per_site = seen.groupBy("site", "k1", "k2").agg(F.count("*").alias("a"))
    per_site = written(per_site)
    # a line that every site carries has a row a site: totals are aggregated in two steps and joined back, no window holds them all
    per_site = written(per_site.join(per_site.groupBy("k1", "k2").agg(F.sum("a").alias("all")), ["k1", "k2"]))
    # single figures over all rows; as scalar subqueries they would repeat their branches in every plan that follows
    rate = per_site.agg(F.sum("a") / F.sum(F.col("a") / F.col("all"))).first()[0]
    docs = site_docs.agg(F.sum("n1")).first()[0]
    t = per_site.join(site_docs, "site").withColumn("n", F.lit(docs).cast("long")).withColumn("ordinary", F.least(F.lit(rate).cast("double") / F.col("n"), F.lit(0.5)))
    t = t.withColumn("n0", F.greatest(F.col("n") - F.col("n1"), F.lit(1)).cast("double"))
    # the outside rate of the line itself, smoothed, or that of an ordinary line where it is smaller
    t = t.withColumn("rate", F.least((F.col("all") - F.col("a") + 0.5) / (F.col("n0") + 1), F.col("ordinary")))
    a, n1, r = F.col("a").cast("double"), F.col("n1").cast("double"), F.col("rate")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    g = 2 * (part(a, n1 * r) + part(n1 - a, n1 * (1 - r)))
    t = t.withColumn("g", F.when(a > n1 * r, F.greatest(g, F.lit(0.0))).otherwise(0.0))
    t = t.withColumn("bin", F.least(F.floor(F.col("g") * BINS_A_UNIT), F.lit(LAST_BIN)).cast("int"))
    # Benjamini-Hochberg on at most LAST_BIN + 1 rows: all of a bin counts with its largest chance.
    bins = t.groupBy("bin").agg(F.count("*").alias("c"))
    down = bins.withColumn("rank", F.sum("c").over(Window.orderBy(F.desc("bin")))).withColumn("m", F.sum("c").over(Window.partitionBy()))
    cut = down.where(chance(F.col("bin") / BINS_A_UNIT) * F.col("m") <= false_discoveries * F.col("rank")).agg(F.min("bin")).first()[0]
    return t.where(F.col("bin") >= F.lit(LAST_BIN + 1 if cut is None else cut)).where("g > 0").select("site", "k1", "k2", F.col("a").alias("docs"), F.col("n1").alias("site_docs"))


def repeated(df: DataFrame, least_docs: int = 5, least_share: float = 0.04, **options) -> DataFrame:
    """Excess lines that are also in least_docs documents and a share of least_share of the site's documents (the exact check)."""
    return excess_lines(df, **options).where((F.col("docs") >= least_docs) & (F.col("docs") >= F.lit(least_share) * F.col("site_docs")))


def repeated_occurrences(df: DataFrame, **options) -> DataFrame:
    """(chunk_id, line_no) of every occurrence of a repeated line; df has (chunk_id, doc_id, source_url, text)."""
    sited = with_site(df.select("chunk_id", "doc_id", "source_url", "text"))
    lines = written(_keyed(lines_of(sited, "chunk_id", "doc_id", "site")).drop("line"))
    return lines.join(repeated(sited, lines=lines, **options), ["site", "k1", "k2"], "left_semi").select("chunk_id", F.col("line_no").cast("int")).distinct()


def without_repeated_lines(df: DataFrame, **options) -> DataFrame:
    """(chunk_id, text, removed): each distinct text of a chunk without its repeated lines, by anti-join and reassembly by position.

    Only hashes of lines are counted; the numbers of a text's repeated lines, few, come back to it and leave it in place.
    """
    sited = with_site(df.select("chunk_id", "doc_id", "source_url", "text").withColumn("h", F.xxhash64("text")))
    lines = written(_keyed(lines_of(sited, "chunk_id", "h", "doc_id", "site")).drop("line"))
    gone = lines.join(repeated(sited, lines=lines, **options), ["site", "k1", "k2"], "left_semi").groupBy("chunk_id", "h").agg(F.collect_set("line_no").alias("gone"))
    # written, so that its size is known: small enough it is broadcast, else the join shuffles each text once
    t = df.select("chunk_id", "text").withColumn("h", F.xxhash64("text")).join(written(gone), ["chunk_id", "h"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i + 1)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return t.select("chunk_id", "h", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed")).distinct().drop("h")
