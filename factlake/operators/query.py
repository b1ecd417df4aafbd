"""Reading questions: cleaning, personal data, intent, terms, funds and fact types."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from factlake.common import written
from factlake.functions import dictionaries as D

# The bits that tell which word runs may be names: so many a name, least and most as powers of two, in pages of bitmap_construct_agg's size.
_BITS, _LEAST, _MOST, _PAGE = 128, 15, 28, 15
# Bytes of text that a worker splits at once.
_PART = 4_000_000
_STEP, _MIX = np.uint64(0xD6E8FEB86659FD93), {"begins": np.uint64(0x9E3779B97F4A7C15), "whole": np.uint64(0xC2B2AE3D27D4EB4F)}


def sanitize(q: Column, most: int = 200) -> Column:
    return F.substring(F.trim(q), 1, most)


def personal_data(t: Column) -> Column:
    """Names of the kinds of personal data in a text, in their fixed order."""
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in D.PERSONAL_DATA]), lambda x: x.isNotNull())


def _hits(t: Column, patterns) -> Column:
    return functools.reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in patterns])


def intent(t: Column) -> Column:
    """struct<classification, advisory_score, advisory_hits, factual_hits, url>."""
    low = F.lower(t)
    url = F.nullif(F.regexp_extract(low, D.URL, 0), F.lit(""))
    adv, fact = _hits(low, D.ADVISORY), _hits(low, D.FACTUAL)
    score = F.when(url.isNotNull() | (adv + fact == 0), 0.0).otherwise(F.round(adv / (adv + fact), 3))
    kind = F.when(url.isNotNull(), "URL_ADDITION").when(adv + fact == 0, "UNCLEAR").when(adv / (adv + fact) >= 0.5, "ADVISORY").otherwise("FACTUAL")
    return F.struct(kind.alias("classification"), score.alias("advisory_score"), adv.alias("advisory_hits"), fact.alias("factual_hits"), url.alias("url"))


def by_length(pairs) -> list:
    """Longest name first, equal lengths in their order."""
    return sorted(pairs, key=lambda kv: -len(kv[0]))


def normalize_terms(q: Column, synonyms=D.SYNONYMS) -> Column:
    """Small letters without punctuation, each synonym replaced in turn, longest first; later ones see what earlier ones wrote."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(q), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+", " "))
    for name, stands_for in by_length(synonyms):
        t = F.replace(t, F.lit(name), F.lit(stands_for)) if " " in name else F.regexp_replace(t, rf"\b{re.escape(name)}\b", stands_for)
    t = F.regexp_replace(t, r"\b(fund|scheme) \1\b", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def aliases(docs: DataFrame, shorthands: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(alias, doc_id) of each page by its address; of equal aliases the last page's counts. docs has (doc_id, source_url).

    shorthands are (issuer's name, short form) in small letters: a fund whose name begins with the one can also be called by the other.
    """
    slug = F.lower(F.element_at(F.split(F.regexp_replace("source_url", "/+$", ""), "/"), -1))
    for s in ("-direct-growth", "-direct", "-growth"):
        slug = F.replace(slug, F.lit(s), F.lit(""))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.replace(slug, F.lit("-"), F.lit(" ")), r"[()]", ""), r"\s+", " "))
    short = F.regexp_replace(name, " fund$", "")
    called = [F.when(n.startswith(issuer + " "), F.concat(F.lit(brief), F.substring(n, F.lit(len(issuer) + 1), F.length(n)))) for issuer, brief in shorthands for n in (name, short)]
    each = docs.where("source_url is not null").select("doc_id", F.explode(F.array_distinct(F.array_compact(F.array(name, short, *called)))).alias("alias")).where("alias <> ''")
    return each.groupBy("alias").agg(F.max("doc_id").alias("doc_id"))


class _Words:
    """The words of some texts in one row: each as a number (code), with the hash of each number; text i has those from at[i] to before at[i + 1]."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        self.at, self.code, self.words = lists.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary
        self.hash = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)

    def longer(self, at: np.ndarray, end: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of n words from at, with hash h, in texts up to end: those with a word behind them, with that word."""
        more = at + n < end
        at, end, h = at[more], end[more], h[more]
        return at, end, h * _STEP + self.hash[self.code[at + n]]


def _slots(h: np.ndarray, size: int, kind: str) -> np.ndarray:
    """The places of hashes among 2 ** size bits."""
    return ((h ^ (h >> np.uint64(32))) * _MIX[kind]) >> np.uint64(64 - size)


def _marks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bits of names: one for each run of words that one begins with, one for the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _Words(batch.column(0))
            at, end, n, slots = w.at[:-1], w.at[1:], 1, []
            h = w.hash[w.code[at]]
            while at.size:
                slots += [_slots(h, size, "begins"), _slots(h[at + n == end], size, "whole")]
                at, end, h = w.longer(at, end, h, n)
                n += 1
            if slots:
                each = np.unique(np.concatenate(slots)).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(each >> _PAGE), pa.array(each & (1 << _PAGE) - 1)], names=["page", "place"])

    return run


def _name_bits(names: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, size): 2 ** size bits that are set for the names. Where names crowd them, more runs pass that are none."""
    size = min(_MOST, max(_LEAST, (_BITS * names.count()).bit_length()))
    pages = names.select("alias").mapInArrow(_marks(size), "page long, place long").groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits"))
    bits = np.zeros(1 << size - 3, "uint8")
    for page, part in pages.collect():
        bits[page << _PAGE - 3 : page + 1 << _PAGE - 3] = np.frombuffer(part, "uint8")
    return bits, size


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about _PART bytes of text."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype="int64") // _PART
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _runs(bits, size: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, at, n, alias): of (key, text), the runs of words that may be names, each at its first place in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = bits.value

        def marked(h: np.ndarray, kind: str) -> np.ndarray:
            slots = _slots(h, size, kind)
            return (set_[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype("uint8") & 1).astype(bool)

        for batch in batches:
            for part in _parts(batch):
                w = _Words(part.column(1))
                at = np.flatnonzero(marked(w.hash, "begins")[w.code])
                end, h, n = w.at[np.searchsorted(w.at, at, side="right")], w.hash[w.code[at]], 1
                found = []
                while at.size:
                    whole = marked(h, "whole")
                    found.append((at[whole], np.full(int(whole.sum()), n), h[whole]))
                    at, end, h = w.longer(at, end, h, n)
                    n += 1
                    goes_on = marked(h, "begins")
                    at, end, h = at[goes_on], end[goes_on], h[goes_on]
                if not sum(f[0].size for f in found):
                    continue
                at, n, h = (np.concatenate(x) for x in zip(*found))
                row = np.searchsorted(w.at, at, side="right") - 1
                order = np.lexsort((at, h, row))
                at, n, h, row = at[order], n[order], h[order], row[order]
                first = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
                lead = np.flatnonzero(first)[np.cumsum(first) - 1]
                # equal hashes of other words are no repetition
                first |= n != n[lead]
                for j in range(int(n.max())):
                    k = np.flatnonzero((n > j) & ~first)
                    first[k] = w.code[at[k] + j] != w.code[at[lead[k]] + j]
                at, n, row = at[first], n[first], row[first]
                word = w.words.to_pylist()
                alias = [" ".join([word[c] for c in w.code[a : a + k].tolist()]) for a, k in zip(at.tolist(), n.tolist())]
                columns = [part.column(0).take(pa.array(row)), pa.array(at - w.at[row], pa.int32()), pa.array(n, pa.int32()), pa.array(alias, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "at", "n", "alias"])

    return run


def find_funds(queries: DataFrame, named: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, doc_ids): the funds that each question names, longest alias first, none inside another's words.

    Instead of comparing every question with every alias, word runs of a question are looked up by equality. A run is followed word
    by word as long as bits of bounded size, sent to all, say that a name may begin so; the join then drops what is no name.
    """
    named = written(named.where("alias is not null"))
    bits, size = _name_bits(named)
    words = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}_]+", " "))
    base = queries.where(F.col(text).isNotNull()).select(F.col(key).alias(key), words.alias("words"))
    schema = StructType([base.schema[key]]).add("at", IntegerType()).add("n", IntegerType()).add("alias", StringType())
    run = base.mapInArrow(_runs(queries.sparkSession.sparkContext.broadcast(bits), size, key), schema)
    # by question only: that serves both groupings, and lets the join split an alias that many questions name
    hit = run.join(named, "alias").repartition(key).groupBy(key, "alias").agg(F.min("at").alias("at"), F.min("n").alias("n"), F.max("doc_id").alias("doc_id"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("l"), "at", "n", "doc_id")))
    got = hit.groupBy(key).agg(ordered.alias("h"))
    empty = F.array().cast("array<struct<l:int,at:int,n:int,doc_id:string>>")

    def take(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda k: (k["at"] <= x["at"]) & (x["at"] + x["n"] <= k["at"] + k["n"]))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("h", empty, take)
    return got.select(key, F.array_distinct(F.transform(kept, lambda k: k["doc_id"])).alias("doc_ids"))


def fact_type(t: Column, names=D.FACT_NAMES) -> Column:
    """The fact type with the longest name in the text; null if none is named."""
    low = F.lower(t)
    return F.coalesce(*[F.when(low.contains(n), F.lit(k)) for n, k in by_length(names)])


def fact_confidence(t: Column, names=D.FACT_NAMES) -> Column:
    """1 where a fact type is named, else 0."""
    return F.when(fact_type(t, names).isNotNull(), 1.0).otherwise(0.0)


def compares(t: Column, funds: Column) -> Column:
    low = F.lower(t)
    return (F.size(funds) > 1) & functools.reduce(lambda a, b: a | b, [low.contains(w) for w in D.COMPARISONS])
