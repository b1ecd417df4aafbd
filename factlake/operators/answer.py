"""From ranked candidates to checked answers: context in a budget, prompt, extractive default, checks, citation, formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import dictionaries as D
from factlake.functions import text


def whitelisted(rows: DataFrame, allowed: DataFrame, url: str = "source_url", keep: bool = True) -> DataFrame:
    """Rows whose URL is listed, or with keep=False the others (security events)."""
    return rows.join(allowed.select(F.col("url").alias(url)).distinct(), url, "left_semi" if keep else "left_anti")


def context(candidates: DataFrame, name: Column, budget: int = 2000) -> DataFrame:
    """(query_id, context, words): header and texts in rank order within a budget of words.

    The first text over the budget is cut to what is left, then to its last sentence end if it has one; later ones are left out.
    """
    head = F.concat(F.lit("Information for "), name, F.lit(":\n"))
    c = candidates.where("text is not null").withColumn("head", F.first(head).over(Window.partitionBy("query_id").orderBy("rank")))
    n = text.word_count(F.col("text"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("n", n).withColumn("used", text.word_count(F.col("head")) + F.coalesce(F.sum("n").over(w), F.lit(0)))
    left = F.lit(budget) - F.col("used")
    cut = F.array_join(F.slice(text.words(F.col("text")), 1, F.greatest(left, F.lit(1)).cast("int")), " ")
    ended = F.nullif(F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1), F.lit(""))
    part = F.when(F.col("used") + F.col("n") <= budget, F.col("text")).when(left > 0, F.coalesce(ended, cut))
    c = c.where(F.col("used") < budget).withColumn("part", part).where("part is not null")
    g = c.groupBy("query_id").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("p"))
    out = F.trim(F.concat("head", F.array_join(F.col("p.part"), " ")))
    return g.select("query_id", out.alias("context"), text.word_count(out).alias("words"))


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(system, user), 256)


def extractive(ctx: Column) -> Column:
    """Deterministic stand-in for a language model: the first sentence behind the header. Any model can take its place as a pandas UDF."""
    body = F.regexp_replace(ctx, r"^Information for [^\n]*:\n", "")
    return F.element_at(text.answer_sentences(body), 1)


def inferred(ctx: Column, question: Column, models: list[Callable[[Column, Column], Column]] | None = None) -> Column:
    """The answer of the first model that gives one, in their order, else the extractive one. A model is (context, question) -> Column and gives null where it fails."""
    return F.coalesce(*[F.nullif(F.trim(m(ctx, question)), F.lit("")) for m in models or []], extractive(ctx))


def banned(t: Column, phrases=D.BANNED) -> Column:
    """All listed phrases in a text, in their order."""
    low = F.lower(t)
    return F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for _, ps in phrases for p in ps]), lambda x: x.isNotNull())


def untraceable_numbers(t: Column, ctx: Column) -> Column:
    """Numbers of a text that its context does not hold, sorted."""
    return F.array_sort(F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))), lambda n: ~F.coalesce(ctx, F.lit("")).contains(n)))


def first_sentences(t: Column, most: int = 3) -> Column:
    s = text.answer_sentences(t)
    return F.when(F.size(s) > most, F.array_join(F.slice(s, 1, most), " ")).otherwise(t)


def checked(t: Column, ctx: Column, most: int = 3) -> Column:
    """struct<status, response, violations>: banned phrases refuse, then untraceable numbers, then the length is cut."""
    b, n = banned(t), untraceable_numbers(t, ctx)
    cut = first_sentences(t, most)
    status = F.when(F.size(b) > 0, "REJECTED_PHRASE").when(F.size(n) > 0, "REJECTED_NUMBER").otherwise("APPROVED")
    violations = F.when(F.size(b) > 0, b).when(F.size(n) > 0, n).when(cut != t, F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    return F.struct(status.alias("status"), F.when(status == "APPROVED", cut).alias("response"), violations.alias("violations"))


def cited(t: Column, url: Column, as_of: str) -> Column:
    return F.concat(t, F.lit("\n\nSource: "), F.coalesce(url, F.lit("N/A")), F.lit(f"\nLast updated from sources: {as_of}"))


def escaped(t: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(c), F.lit(e))
    return t


def linked(t: Column) -> Column:
    """Addresses as links; a last full stop or comma stays outside."""
    return F.regexp_replace(t, r"(https?://\S*?[^\s])([.,]?)(?=\s|$)", "[$1]($1)$2")


def with_disclaimer(t: Column, disclaimer: str) -> Column:
    return F.when(t.isNotNull(), F.concat(t, F.lit("\n\n" + disclaimer)))


def failed(status: Column, t: Column) -> Column:
    return (status != 200) | F.lower(t).rlike("cannot process|unable to|no relevant information")
