"""Problem 8: the language of each document and of each of its sentences.

Multilingual mixture inference. Sentences are scored by the likelihood of their character
n-grams in every language. Expectation-maximisation estimates the proportions of the languages in
a document, until the likelihood grows no more; languages are added to its set one by one, the most gainful first, as long as the likelihood,
less a penalty a language, grows. Each sentence gets the likeliest language of the set, with its
posterior as confidence.

The n-gram profiles are fitted on a bounded sample of labelled rows: at most SAMPLE
documents a language, those of up to SAMPLE_CHARS characters first, of longer ones a window of that size at a place given by a hash, in the order of a
hash of their id. Labels may be wrong, so the profiles are fitted again on the sentences as the first
profiles class them. Everything else covers all rows.

Names (capitalised words behind the first of a Latin sentence), quotations inside a sentence and numbers do not count.

Defined results: null, empty and wordless texts have a null language; equal documents get equal results; labels are
read without case, space and region, by code, other code or name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.common import spread, written
from factlake.llm import sentences

SAMPLE, SAMPLE_CHARS, REFITS = 120, 4000, 2
PENALTY = 12.0  # nats that one more language must gain
MIN_LETTERS = 6

_WORD = re.compile(r"[A-Za-zÀ-ɏ]+|(?:[^\W\d_A-Za-zÀ-ɏ]|[ऀ-৿ัิ-ฺ็-๎ً-ْ])+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”“]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")
_QUOTE = re.compile("[\"“„«「]")


def words(sentence: str) -> list[str]:
    """The words that tell a sentence's language."""
    tokens = _WORD.findall(_QUOTED.sub(" ", sentence) if _QUOTE.search(sentence) else sentence)
    if sum(map(len, tokens)) < MIN_LETTERS:
        tokens = _WORD.findall(sentence)
    if len(tokens) > 2:
        for t in tokens:
            if t[0] <= "ɏ" and not t.isupper():
                break
        else:
            return [t.lower() for t in tokens]
    first = [tokens[0].lower()] if tokens and tokens[0][0].isupper() and not tokens[0].isupper() else []
    return first + [t for t in tokens if not t[0].isupper() and not (len(t) > 1 and t[1].isupper())]


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


class Profiles:
    """Log-probabilities of n-grams in each language. The vectors of words seen are kept in one matrix, of at most WORDS words at a time."""

    WORDS = 100_000

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        every = sorted(set().union(*counts.values())) if counts else []
        self.of = {g: i for i, g in enumerate(every)}
        self.p = np.empty((len(every) + 1, len(self.langs)))
        for j, k in enumerate(self.langs):
            total = sum(counts[k].values()) + 0.1 * (len(every) + 1)
            self.p[:, j] = math.log(0.1 / total)
            for g, n in counts[k].items():
                self.p[self.of[g], j] = math.log((n + 0.1) / total)
        self._row: dict[str, int] = {}
        self._words = np.empty((1024, len(self.langs)))

    def _index(self, bags: list[list[str]]) -> np.ndarray:
        """Rows of the word matrix of all words of the bags."""
        if len(self._row) > self.WORDS:
            self._row.clear()
        row = self._row
        new = [w for w in {w for bag in bags for w in bag} if w not in row]
        if new:
            at = len(row)
            if at + len(new) > len(self._words):
                more = np.empty((2 * (at + len(new)), len(self.langs)))
                more[:at] = self._words[:at]
                self._words = more
            other = len(self.of)
            for i, w in enumerate(new, at):
                self._words[i] = self.p[[self.of.get(g, other) for g in grams(w)]].sum(axis=0)
                row[w] = i
        return np.array([row[w] for bag in bags for w in bag], np.int64)

    def scores(self, bags: list[list[str]]) -> np.ndarray:
        """Log-likelihoods of bags of words, none of them empty, in every language."""
        rows = self._index(bags)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return np.add.reduceat(self._words[rows], starts, axis=0) if len(bags) else np.empty((0, len(self.langs)))


def enough(bag: list[str]) -> bool:
    return sum(map(len, bag)) >= MIN_LETTERS


def fit(labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles from (label, sentence) pairs, fitted again REFITS times without trust in single labels."""
    bags = [(k, w) for k, s in labelled if enough(w := words(s))]

    def count(pairs) -> dict[str, Counter]:
        out: dict[str, Counter] = defaultdict(Counter)
        for k, bag in pairs:
            for w in bag:
                out[k].update(grams(w))
        return out

    p = Profiles(count(bags))
    for _ in range(REFITS if len(p.langs) > 1 else 0):
        best = p.scores([bag for _, bag in bags]).argmax(axis=1)
        again = count((p.langs[int(k)], bag) for k, (_, bag) in zip(best, bags))
        p = Profiles({k: again.get(k) or Counter() for k in p.langs})
    return p


def mixture(scores: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(language set, proportions, posteriors) of a document from the sentences' log-likelihoods."""

    def em(chosen: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        x = scores[:, chosen]
        if len(chosen) == 1:
            return float(x.sum()), np.ones(1), np.ones((len(x), 1))
        top = x.max(axis=1, keepdims=True)
        e = np.exp(x - top)
        pi, before = np.full(len(chosen), 1 / len(chosen)), -np.inf
        while True:
            r = e * pi
            total = r.sum(axis=1, keepdims=True)
            like = float((np.log(total) + top).sum())
            if like - before <= 1e-3:  # the likelihood never falls and is bounded
                return like, pi, r / total
            before = like
            pi = np.maximum((r / total).mean(axis=0), 1e-12)

    chosen = [int(scores.sum(axis=0).argmax())]
    like, pi, post = em(chosen)
    while len(chosen) < scores.shape[1]:
        gain = np.maximum(scores - scores[:, chosen].max(axis=1, keepdims=True), 0).sum(axis=0)
        k = int(gain.argmax())
        if gain[k] <= penalty:
            break
        trial = em([*chosen, k])
        if trial[0] - like <= penalty:
            break
        chosen.append(k)
        like, pi, post = trial
    return chosen, pi, post


def label_code(label: Column, codes: DataFrame) -> Column:
    """The code that a label means, however it is written; null if it names no language. codes is the small fixed table."""
    of: dict[str, str] = {}
    for r in codes.collect():
        for name in (r["lang_name"], r["alt_code"], r["lang_code"]):
            if name:
                of[name.strip().lower()] = r["lang_code"]
    pairs = [F.lit(x) for kv in sorted(of.items()) for x in kv]
    clean = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    return F.try_element_at(F.create_map(*pairs), clean) if pairs else F.lit(None).cast("string")


def sample(docs: DataFrame, code: str) -> DataFrame:
    """At most SAMPLE documents a language, those of up to SAMPLE_CHARS characters first, by the order of a hash; ranks are limited before the shuffle.

    Longer ones, which often mix languages, fill up what is left with a window.
    """
    at = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int")
    fit_for = docs.where(F.col(code).isNotNull() & (F.length("text") > 0)).withColumn("long", F.length("text") > SAMPLE_CHARS).withColumn("text", F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)))
    rank = F.row_number().over(Window.partitionBy(code).orderBy("long", F.xxhash64("doc_id"), "doc_id"))
    return fit_for.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select(code, "text")


def fit_profiles(docs: DataFrame, codes: DataFrame) -> Profiles:
    labelled = docs.select("doc_id", "text", label_code(F.col("lang"), codes).alias("code"))
    rows = sample(labelled, "code").collect()
    return fit([(r["code"], s) for r in rows for s in cut(r["text"], {})[1]])


def cut(text: str, classes: dict[str, str]) -> tuple[list[tuple[int, int]], list[str]]:
    spans, parts, at = [], [], 0
    for e in sentences.units(text, classes):
        part = text[at:e]
        start = at + len(part) - len(part.lstrip())
        spans.append((start, e))
        parts.append(text[start:e])
        at = e
    return spans, parts


_ENDED = re.compile(r"[.!?…。！？।॥؟۔][\"”»›)\]）」』“’']*$")


def whole(sentence: str, bag: list[str]) -> bool:
    """Whether a unit is a sentence and no heading or scrap: it has words and ends as one, or is Thai, which has no end mark."""
    if len(bag) < 2 and sum(map(len, bag)) < 2 * MIN_LETTERS:
        return False
    return bool(_ENDED.search(sentence, max(0, len(sentence) - 12))) or "฀" < max(sentence) and sum("ก" <= c <= "๎" for c in sentence) >= MIN_LETTERS


FIELDS = ("start_pos", "end_pos", "lang", "confidence", "whole")
SEGMENT = "start_pos array<int>, end_pos array<int>, lang array<string>, confidence array<double>, whole array<boolean>"


def segments_of(texts: list[str | None], p: Profiles, classes: list[str | None] | None = None) -> list[tuple[list, list, list, list, list]]:
    """For each text the lists start_pos, end_pos, lang, confidence, whole sentence of its units; classes are the abbreviations of each text.

    Units too short to be told take no part in the mixture; they get the language that leads in the document with its proportion
    as confidence if they hold a letter, and none if they hold no letter or the document has no unit that can be told.
    """
    docs, bags = [], []
    for k, text in enumerate(texts):
        spans, parts = cut(text, sentences._parse(classes[k] if classes else None)) if text else ([], [])
        units = []
        for span, part in zip(spans, parts):
            if part.strip():
                bag = words(part)
                told = bool(p.langs) and enough(bag)
                units.append((span, part, bag, told))
                if told:
                    bags.append(bag)
        docs.append(units)
    scores = p.scores(bags)
    first = scores.argmax(axis=1) if len(scores) else []
    out, at = [], 0
    for units in docs:
        n = sum(u[3] for u in units)
        known, best = scores[at : at + n], first[at : at + n]
        at += n
        if n and (best == best[0]).all():  # no other language can gain
            chosen, pi, post, best = [int(best[0])], np.ones(1), np.ones((n, 1)), np.zeros(n, int)
        elif n:
            chosen, pi, post = mixture(known)
            best = post.argmax(axis=1)
        lead = int(pi.argmax()) if n else 0
        lists: tuple[list, list, list, list, list] = ([], [], [], [], [])
        i = 0
        for (a, b), part, bag, told in units:
            if told:
                row = a + 1, b, p.langs[chosen[best[i]]], float(post[i, best[i]]), whole(part, bag)
                i += 1
            elif n and any(c.isalpha() for c in part):
                row = a + 1, b, p.langs[chosen[lead]], float(pi[lead]), False
            else:
                row = a + 1, b, None, None, False
            for col, x in zip(lists, row):
                col.append(x)
        out.append(lists)
    return out


def segments(docs: DataFrame, codes: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(doc_id, label, segments): label is the code that the given label means, segments has the language of each unit."""
    p = profiles or fit_profiles(docs, codes)

    @F.pandas_udf(SEGMENT)
    def tell(texts: pd.Series, classes: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(texts), 500):
            out += segments_of(texts.iloc[i : i + 500].tolist(), p, classes.iloc[i : i + 500].tolist())
        return pd.DataFrame(out, columns=list(FIELDS))

    # else the optimiser copies the function into the filters behind it and it runs twice
    tell = tell.asNondeterministic()
    rows = spread(docs.select(F.col("doc_id"), "text", label_code(F.col("lang"), codes).alias("label")))
    # written, so that its size is known: small enough it is broadcast, else the join shuffles
    known = written(sentences.abbreviations(rows.select("doc_id", "text"))).withColumnRenamed("doc_id", "k")
    told = rows.withColumn("k", F.col("doc_id").cast("string")).join(known, "k", "left").select("doc_id", "label", tell("text", "classes").alias("s"))
    return told.select("doc_id", "label", F.arrays_zip(*[F.col(f"s.{f}").alias(f) for f in FIELDS]).alias("segments"))


def listed(found: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, lang, confidence): one row per unit; lang is null where a unit has no letters or nothing can be told."""
    s = found.select("doc_id", F.explode("segments").alias("s"))
    return s.select("doc_id", "s.start_pos", "s.end_pos", "s.lang", "s.confidence")


def languages(found: DataFrame) -> DataFrame:
    """(doc_id, label, lang, share, confidence, sentences): one row per document and language of at least one whole sentence.

    A document without a whole sentence has the languages of its other units, with 0 sentences; one without any has one row with null.
    """
    told = F.filter("segments", lambda s: s["lang"].isNotNull())
    full = F.filter(told, lambda s: s["whole"])
    s = found.select("doc_id", "label", F.explode_outer(F.when(F.size(full) > 0, full).otherwise(told)).alias("s"))
    n = F.sum(F.col("s.end_pos") - F.col("s.start_pos") + 1)
    each = s.groupBy("doc_id", "label", "s.lang").agg(n.alias("chars"), F.avg("s.confidence").alias("confidence"), F.count_if(F.col("s.whole")).alias("sentences"))
    total = F.sum("chars").over(Window.partitionBy("doc_id"))
    return each.select("doc_id", "label", "lang", (F.col("chars") / total).alias("share"), "confidence", "sentences")


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, lang) for documents without label, with a label none of whose sentences bear out, or with several languages."""
    have = F.array_distinct(F.transform(F.filter("segments", lambda s: s["whole"]), lambda s: s["lang"]))
    case = F.col("label").isNull() | ~F.array_contains("have", F.col("label")) | (F.size("have") > 1)
    return found.select("doc_id", "label", have.alias("have")).where(case).select("doc_id", F.explode("have").alias("lang")).distinct()
