"""Problem 7: evaluation texts that leaked into the corpus.

Pigeonhole edit matching. A text that may differ in k words, cut into k + 1
pieces, has at least one piece unharmed. So every part of an item is cut into budget + 1 pieces, budget being a share of its
words (``edits``, in reports EDITS; 0 where only shared runs are asked for), all pieces go into one Aho-Corasick automaton, and each exact piece hit
is verified: by Myers' bit-parallel distance over words of the whole part to the passage around the hit, and by the
run of equal words around it.

A leak is (a) a part that stands in the document with at most its budget of edits, or (b) a shared run of ``least`` equal words.
Long pieces would miss runs, so none is longer than half the shared length: every run of ``least``
words holds a whole piece. Letter case, punctuation, spacing and invisible characters do not count.

Items are the stated query set: they are matched in blocks of BLOCK items, each block against all documents.

Defined results: null and empty texts match nothing; parts under ``least`` words match nothing; items with equal texts
are all reported; repeated documents are each reported; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.common import spread

LEAST, BLOCK, EDITS = 12, 20_000, 0.2
# Characters that show nothing.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]+")
_WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, part string, run int, distance int, part_words int"


def words(text: str | None) -> list[str]:
    return _WORD.findall(_INVISIBLE.sub("", text).casefold()) if text else []


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of the pattern to any stretch of the text, over words, one machine step a word of text."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) & full) ^ plus) | eq
        h_plus = minus | (full & ~(d | plus))
        h_minus = plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = h_plus << 1 & full
        h_minus = h_minus << 1 & full
        plus = h_minus | (full & ~(x | h_plus))
        minus = h_plus & x
        best = min(best, score)
    return best


def budget(words_: int, edits: float = EDITS) -> int:
    """How many words of a part of so many words may be changed, left out or put in."""
    return int(edits * words_)


class Matcher:
    """The pieces of a block of items: (item_id, part, text)."""

    def __init__(self, parts: list[tuple[int, str, str]], least: int = LEAST, edits: float = 0.0):
        import ahocorasick

        self.least = least
        self.parts = [(i, name, w) for i, name, text in parts if len(w := words(text)) >= least]
        self.words = [frozenset(w) for _, _, w in self.parts]
        self.budget = [budget(len(w), edits) for _, _, w in self.parts]
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, _, w) in enumerate(self.parts):
            # budget + 1 pieces or more: edits below their number leave one whole, and so does a shared run
            k = max(self.budget[n] + 1, math.ceil(len(w) / max(1, least // 2)))
            ends = [len(w) * i // k for i in range(k + 1)]
            for o, e in zip(ends, ends[1:]):
                if e > o:
                    pieces.setdefault(f" {' '.join(w[o:e])} ", []).append((n, o, e - o))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def match(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Part number -> (longest shared run of words, least distance of the whole part) of the parts that leaked.

        A part with a shared run beyond its budget has the distance of the best place that was verified.
        """
        if self.empty or not (doc := words(text)):
            return {}
        flat = f" {' '.join(doc)} "
        starts: list[int] = []
        runs: dict[int, int] = {}
        near: dict[int, int] = {}
        covered: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (n, where) in self.automaton.iter(flat):
            if not starts:
                at = 1
                for w in doc:
                    starts.append(at)
                    at += len(w) + 1
            j = bisect_left(starts, end - n + 2)
            for part, o, size in where:
                w, k = self.parts[part][2], self.budget[part]
                if j >= covered.get((part, j - o), 0):  # not inside a run that was measured
                    lo, hi = 0, size
                    while lo < o and lo < j and w[o - lo - 1] == doc[j - lo - 1]:
                        lo += 1
                    while o + hi < len(w) and j + hi < len(doc) and w[o + hi] == doc[j + hi]:
                        hi += 1
                    covered[part, j - o] = j + hi
                    runs[part] = max(runs.get(part, 0), lo + hi)
                # the passage that the part would fill, widened by the budget on both sides; hits of one place are verified once
                step = (j - o) // (k + 1)
                if (k or runs[part] >= self.least) and (part, step) not in tried:
                    tried.add((part, step))
                    at = step * (k + 1)
                    passage = doc[max(0, at - k) : max(0, at + len(w) + 3 * k)]
                    # each edit spoils at most one word, so a passage within the budget holds the others
                    if runs[part] >= self.least or sum(map(self.words[part].__contains__, passage)) >= len(w) - k:
                        near[part] = min(near.get(part, len(w)), myers(w, passage))
        return {p: (r, near.get(p, len(self.parts[p][2]))) for p, r in runs.items() if r >= self.least or near.get(p, len(self.parts[p][2])) <= self.budget[p]}


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, edits: float = 0.0) -> DataFrame:
    """(doc_id, item_id, part, run, distance, part_words) of every document and item part that leaked into it: at least ``least`` words in a row, or the
    whole part with at most a share ``edits`` of its words edited.

    docs has (doc_id, text); items has item_id and one text column a part.
    """
    names = [c for c, t in items.dtypes if c != "item_id" and t == "string"]
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
    out = None
    parts: list[tuple[int, str, str]] = []

    def scan(block: list) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(block, least, edits)
            for pdf in batches:
                got = [(d, *m.parts[p][:2], *x, len(m.parts[p][2])) for d, t in zip(pdf["doc_id"], pdf["text"]) for p, x in m.match(t).items()]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "part", "run", "distance", "part_words"])

        return rows.mapInPandas(run, FOUND)

    for r in items.select("item_id", *names).toLocalIterator():
        parts += [(r["item_id"], n, r[n]) for n in names if r[n]]
        if len(parts) >= BLOCK:
            out = scan(parts) if out is None else out.unionByName(scan(parts))
            parts = []
    if parts or out is None:
        out = scan(parts) if out is None else out.unionByName(scan(parts))
    return out
