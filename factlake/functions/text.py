"""Column -> Column functions on text: HTML, cleaning, normalising, sentences, chunks. Built-in expressions only, but for html.unescape and NFKC."""

from __future__ import annotations

import calendar
import functools
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions import dictionaries as D

STRIPPED = ("script", "style", "nav", "footer", "header", "aside")


def quoted(words: list[str] | tuple[str, ...]) -> str:
    """Alternation of literal phrases."""
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


# --- HTML and cleaning -------------------------------------------------------------------------


def visible_text(page: Column) -> Column:
    """Text outside markup, scripts, styles and page chrome: one line a text node, no blank lines."""
    t = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    for tag in STRIPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    lines = F.transform(F.split(unescape_basic(F.regexp_replace(t, r"<[^>]*>", "\n")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def unescape_basic(t: Column) -> Column:
    """The entities that markup itself needs, amp last; see unescape for all of them."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return t


@F.pandas_udf(T.StringType())
def unescape(t: pd.Series) -> pd.Series:
    return t.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def remove_all(t: Column, patterns: list[str]) -> Column:
    """A configurable list of passages to take out."""
    for p in patterns:
        t = F.regexp_replace(t, p, "")
    return t


def collapse(t: Column) -> Column:
    """All white space, Unicode spaces too, to single blanks; none at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def rupee_sign(t: Column) -> Column:
    return F.regexp_replace(t, D.CURRENCY_SIGNS, "₹")


def plain_numbers(t: Column) -> Column:
    """Digit groups without commas: first groups of three, then of two."""
    return F.regexp_replace(F.regexp_replace(t, r"(?<=\d),(?=\d{3})", ""), r"(?<=\d),(?=\d{2})", "")


def clean(t: Column) -> Column:
    return plain_numbers(rupee_sign(collapse(nfkc(unescape(t)))))


def iso_date(t: Column) -> Column:
    """The first '18 Jul 2025' or ISO date of a text as YYYY-MM-DD, without a range check; null if there is none or the month is unknown."""
    months = {n.lower(): i for table in (calendar.month_abbr, calendar.month_name) for i, n in enumerate(table) if n}
    pairs = [F.lit(x) for n, i in sorted(months.items()) for x in (n, f"{i:02d}")]
    day, name, year = (F.regexp_extract(t, r"(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})", i) for i in (1, 2, 3))
    month = F.try_element_at(F.create_map(*pairs), F.lower(name))
    spoken = F.concat_ws("-", year, month, F.lpad(day, 2, "0"))
    return F.when(day != "", F.when(month.isNotNull(), spoken)).otherwise(F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def percent(t: Column) -> Column:
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.concat(t, F.lit("%"))).otherwise(t)


def typed_value(fact_type: Column, value: Column) -> Column:
    """A cleaned value as its fact type wants it; null if a date cannot be read."""
    money = F.when(value.startswith("₹"), value).otherwise(F.regexp_replace(value, r"(^|\s)([0-9])", "$1₹$2"))
    return (
        F.when(fact_type == "inception_date", iso_date(value))
        .when(fact_type.isin("expense_ratio", "exit_load"), percent(value))
        .when(fact_type.isin(*D.MONEY_FACTS), money)
        .otherwise(value)
    )


def rejection(fact_type: Column, value: Column) -> Column:
    """Why a typed value is refused; null if it is not."""
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "Empty value after normalization")
        .when((fact_type == "expense_ratio") & ~value.contains("%"), "Percentage enforcement failed: missing %")
        .when((fact_type == "expense_ratio") & ~value.rlike("[0-9]"), "No numeric value found")
        .when(fact_type.isin(*D.MONEY_FACTS) & ~value.contains("₹"), "Currency enforcement failed: missing ₹")
        .when((fact_type == "inception_date") & ~value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "Date enforcement failed: not YYYY-MM-DD")
    )


def tidy_value(fact_type: Column, value: Column, second: Column) -> Column:
    """What a pattern caught, as it is stored: sign and unit added, trailing marks and page text cut. second is the second group, if any."""
    v, g = F.trim(F.replace(value, F.lit("?"), F.lit(""))), F.rtrim(F.trim(F.replace(second, F.lit("?"), F.lit(""))), F.lit(".,; "))
    bare = F.rtrim(v, F.lit(".,; "))
    rupees = F.when(bare.startswith("₹"), bare).otherwise(F.concat(F.lit("₹"), bare))
    cut = v
    for stop in ("Scheme Information", "Fund house", "Rank"):
        cut = F.trim(F.substring_index(cut, stop, 1))
    load = F.concat(F.lit("Exit load of "), v)
    return (
        F.when(fact_type.isin("nav", "min_sip", "min_lumpsum"), rupees)
        .when(fact_type == "aum", F.when(rupees.contains("Cr"), rupees).otherwise(F.concat(rupees, F.lit(" Cr"))))
        .when(fact_type == "expense_ratio", F.when(v.endswith("%"), v).otherwise(F.concat(v, F.lit("%"))))
        .when(fact_type == "exit_load", F.when(second != "", F.concat(load, F.lit(", if redeemed within "), g)).otherwise(load))
        .when(fact_type == "benchmark", cut)
        .otherwise(v)
    )


def extract_facts(t: Column, patterns=D.FACT_PATTERNS) -> Column:
    """array<struct<fact_type, value, confidence, source, raw_snippet>>: the first match of each pattern."""
    # each pattern runs over the text once; the groups come from the short passage it caught
    caught = F.array(*[F.struct(F.lit(n).alias("fact_type"), F.lit(c).alias("confidence"), F.regexp_extract(t, p, 0).alias("raw_snippet")) for n, p, c in patterns])
    hits = F.filter(caught, lambda x: x["raw_snippet"] != "")

    def fact(x: Column) -> Column:
        first, second = F.lit(""), F.lit("")
        for n, p, _ in patterns:
            mine = x["fact_type"] == n
            first = F.when(mine, F.trim(F.regexp_extract(x["raw_snippet"], p, 1))).otherwise(first)
            if re.compile(p).groups > 1:
                second = F.when(mine, F.trim(F.regexp_extract(x["raw_snippet"], p, 2))).otherwise(second)
        return F.struct(x["fact_type"].alias("fact_type"), tidy_value(x["fact_type"], first, second).alias("value"), x["confidence"].alias("confidence"), F.lit("regex").alias("source"), x["raw_snippet"].alias("raw_snippet"))

    return F.transform(hits, fact)


# --- words, sentences, chunks ------------------------------------------------------------------


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def tokens(t: Column) -> Column:
    """Words in small letters, as the index knows them."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokenize(t: Column, abbreviations=tuple(D.ABBREVIATIONS)) -> Column:
    """Sentences: cut after . ! ? and white space before a capital, but not behind an abbreviation (which becomes small)."""
    hidden = F.lit("\x00")
    listed = rf"(?<!\w)(?:{'|'.join(sorted(abbreviations, key=len, reverse=True))})\."
    pieces = F.regexp_extract_all(t, F.lit(rf"(?isU){listed}|.+?(?={listed}|\z)"), F.lit(0))

    def keep(p: Column) -> Column:
        return F.when(p.rlike(rf"(?iU)^{listed}$") & (F.length(p) <= 1 + max(map(len, abbreviations))), F.concat(F.lower(F.rtrim(p, F.lit("."))), hidden)).otherwise(p)

    cut = F.split(F.array_join(F.transform(pieces, keep), ""), r"(?<=[.!?])(?U:\s)+(?=[A-Z])")
    back = F.transform(cut, lambda s: F.regexp_replace(F.replace(s, hidden, F.lit(".")), r"^(?U:\s)+|(?U:\s)+$", ""))
    return F.filter(back, lambda s: s != "")


def answer_sentences(t: Column) -> Column:
    """Sentences of an answer: cut at white space after . ? ! unless that looks like an abbreviation or a title."""
    return F.filter(F.transform(F.split(t, r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s|\n"), lambda s: F.trim(s)), lambda s: s != "")


def chunk_type(t: Column, groups=D.CHUNK_TYPES) -> Column:
    return _first_kind(F.lower(t), groups)


def _holds(low: Column, phrases) -> Column:
    return functools.reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def _first_kind(low: Column, groups) -> Column:
    out = F.lit("overview")
    for name, phrases in reversed(groups):
        out = F.when(_holds(low, phrases), name).otherwise(out)
    return out


def is_noise(t: Column) -> Column:
    low = F.lower(t)
    return ~low.rlike(quoted(D.PROTECTED)) & low.rlike(quoted(D.NOISE))


def self_contained(t: Column) -> Column:
    return ~F.lower(t).rlike(f"^(?:{quoted(D.DEPENDENT)})")


def split_long(t: Column, most: int = 250) -> Column:
    """Pieces of at most ``most`` words."""
    w = words(t)
    n = F.greatest(F.floor((F.size(w) - 1) / most), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(w, i * most + 1, most), " "))


def build_chunks(sentences: Column, most: int = 250) -> Column:
    """array<struct<text, chunk_type, token_count, overlap>> from array<struct<s, t, n>>, by one ordered fold.

    A sentence over the limit closes the chunk and comes out in pieces of its own type. One that
    does not fit closes the chunk and opens the next one with the last sentence as overlap, or alone
    where those two exceed the limit. Otherwise it joins, and gives its type to a chunk that has none.
    """
    chunk = "struct<text:string,chunk_type:string,token_count:int>"
    start = F.struct(
        F.array().cast(f"array<{chunk}>").alias("out"), F.array().cast("array<string>").alias("cur"), F.array().cast("array<int>").alias("ns"), F.lit("overview").alias("type")
    )

    def made(text: Column, kind: Column, n: Column) -> Column:
        return F.array(F.struct(text.alias("text"), kind.alias("chunk_type"), n.cast("int").alias("token_count")))

    def total(ns: Column) -> Column:
        return F.aggregate(ns, F.lit(0), lambda a, b: a + b)

    def step(acc: Column, x: Column) -> Column:
        empty = F.size(acc["cur"]) == 0
        flushed = F.when(empty, acc["out"]).otherwise(F.concat(acc["out"], made(F.array_join(acc["cur"], " "), acc["type"], total(acc["ns"]))))
        pieces = F.transform(split_long(x["s"], most), lambda p: F.struct(p.alias("text"), x["t"].alias("chunk_type"), word_count(p).cast("int").alias("token_count")))
        long_ = F.struct(F.concat(flushed, pieces).alias("out"), F.array().cast("array<string>").alias("cur"), F.array().cast("array<int>").alias("ns"), x["t"].alias("type"))
        last, n_last = F.element_at(acc["cur"], -1), F.element_at(acc["ns"], -1)
        fits = n_last + x["n"] <= most
        alone = F.concat(flushed, made(last, acc["type"], n_last))
        over = F.struct(
            F.when(fits, flushed).otherwise(alone).alias("out"), F.when(fits, F.array(last, x["s"])).otherwise(F.array(x["s"])).alias("cur"), F.when(fits, F.array(n_last, x["n"])).otherwise(F.array(x["n"])).alias("ns"), x["t"].alias("type")
        )
        kind = F.when(x["t"] != "overview", x["t"]).otherwise(acc["type"])
        join = F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.array(x["s"])).alias("cur"), F.concat(acc["ns"], F.array(x["n"])).alias("ns"), kind.alias("type"))
        return F.when(x["n"] > most, long_).when(~empty & (total(acc["ns"]) + x["n"] > most), over).otherwise(join)

    def finish(acc: Column) -> Column:
        out = F.when(F.size(acc["cur"]) == 0, acc["out"]).otherwise(F.concat(acc["out"], made(F.array_join(acc["cur"], " "), acc["type"], total(acc["ns"]))))
        return F.transform(out, lambda c, i: F.struct(c["text"].alias("text"), c["chunk_type"].alias("chunk_type"), c["token_count"].alias("token_count"), (i > 0).alias("overlap")))

    return F.aggregate(sentences, start, step, finish)
