"""Problem 4: page furniture mixed with the main content of web pages.

The text of a page still shows its tree: page (its URL), block (chunk), line, and the parts that
menu separators make of a line. Every line is a node with binary features: tokens that stand for
attributes, density (length, words, sentence ends, digits), depth (separators, indents, list
marks), whether it names the page's subject (the last part of the URL), position among its siblings, what the
siblings beside it look like, and the densities of its ancestor, the block. Gradient-boosted
trees turn them into a log-odds of being main content. Decoding is hierarchical: a block
is main content, furniture, or mixed, and its lines follow; a mixed block pays for every
change between neighbours, so no line contradicts its block for a trifle.

A page is not put together from its blocks: they carry no order, and one page may hold a third of all rows.

The trees are trained here (train_main_content.py) and lie beside this module as JSON.

Defined results: null and empty texts have no lines; blank lines are neither; a row without URL takes that of its document's
other rows, and has no subject without one; repeated
rows count once; other columns play no part.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.common import spread

MODEL = Path(__file__).with_name("main_content_model.json")
CHANGE = 0.4  # log-odds that a change between neighbouring lines must be worth
MIXED = 1.0  # log-odds that a mixed block must be worth

_ASCII = re.compile(r"[a-z]+|[%&?!|>:;/]|, ")
_TOKEN = re.compile(r"[a-zà-ɏ]+|[ऀ-৿]+|[؀-ۿ]+|[฀-๿]{1,8}|[぀-ヿ]+|[㐀-鿿]{1,12}|[%₹©&?!|>:;•·»–]|/|, ")
_SEPARATOR = re.compile(r" [|·/>•] |\s{2,}(?=\S)")
_SENTENCE_END = re.compile(r"[.!?。！？।؟][\"”»)」]*$")

STRUCTURE = (
    "chars>=12", "chars>=24", "chars>=40", "chars>=70", "chars>=110", "chars>=180", "chars>=300",
    "words>=3", "words>=6", "words>=10", "words>=16", "words>=30",
    "parts>=2", "parts>=3", "parts>=5", "short_parts", "digits", "digit_share>=0.1", "percent_end", "ends", "stops>=1", "stops>=2", "stops>=4",
    "upper", "lower", "mark_first", "indent", "capital_share>=0.5", "capital_share>=0.8", "colon_inside", "latin", "other_script", "mixed_script",
)
SIBLINGS = ("first", "last", "before_ends", "before_short", "before_parts", "after_ends", "after_short", "after_parts", "few_lines", "many_lines")
ANCESTORS = ("subject", "subject_alone", "no_subject_known", "block_ends>=0.5", "block_short>=0.5", "block_parts>=0.3", "block_digits>=0.5", "block_subject>=0.3")


def tokens(line: str) -> list[str]:
    """Words, signs and, where words have no spaces, pairs of characters."""
    return _tokens(line.lower())


def _tokens(low: str) -> list[str]:
    if low.isascii():
        return _ASCII.findall(low)
    out = []
    for t in _TOKEN.findall(low):
        if "㐀" <= t[0] <= "鿿":
            out += [t[i : i + 2] for i in range(max(1, len(t) - 1))]
        else:
            out.append(t)
    return out


_DIGIT, _CAPITAL = re.compile(r"\d"), re.compile(r"(?<!\S)[A-ZÀ-Þ]")
_LATIN, _OTHER = re.compile("[A-Za-z]"), re.compile("[\u0370-\u1fff\u3040-\uffef]")
_SEPARATORS = ("  ", " |", " ·", " /", " >", " •", "\xa0")
_SIZES, _COUNTS = (12, 24, 40, 70, 110, 180, 300), (3, 6, 10, 16, 30)
_STOPS = (". ", "? ", "! ", "।", "。")


def structure(line: str, words: int | None = None) -> list[int]:
    """Which of STRUCTURE hold, as numbers. words is the number of its words, if known."""
    s = line.strip()
    n = len(s)
    words = len(s.split()) if words is None else words
    parts = 1
    for c in _SEPARATORS:
        if c in s:
            parts = len(_SEPARATOR.findall(s)) + 1
            break
    ascii_ = s.isascii()
    digits = sum(map(s.count, "0123456789")) if ascii_ else len(_DIGIT.findall(s))
    capital = len(_CAPITAL.findall(s)) / max(1, words)
    ends = _SENTENCE_END.search(s, max(0, n - 12)) is not None
    stops = ends + sum(map(s.count, _STOPS))
    if ascii_:
        latin, other = _LATIN.search(s) is not None, False
    else:
        latin, other = _LATIN.search(s) is not None, _OTHER.search(s) is not None
    out = [*range(bisect_right(_SIZES, n)), *range(7, 7 + bisect_right(_COUNTS, words))]
    hold = (
        parts >= 2, parts >= 3, parts >= 5, parts >= 3 and n / parts < 16, digits > 0, digits >= 0.1 * n, s[-1:] == "%", ends, stops >= 1, stops >= 2, stops >= 4,
        s.isupper(), s.islower(), not s[:1].isalnum(), line[:1].isspace(), capital >= 0.5, capital >= 0.8, ":" in s[:-1], latin, other, latin and other,
    )
    out += [i for i, h in enumerate(hold, 12) if h]
    return out


class Trees:
    """Boosted trees over binary features, each tree complete to its depth: features, then leaf values."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, np.ndarray]]):
        self.base, self.trees = base, trees

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        flat, width = x.ravel(), x.shape[1]
        at0 = np.arange(len(x)) * width
        for feature, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while node[0] < len(feature) if len(node) else False:
                node = 2 * node + 1 + flat[at0 + feature[node]]
            out += value[node - len(feature)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n: int = 100, depth: int = 4, rate: float = 0.3, l2: float = 1.0) -> Trees:
        """Newton boosting for the logistic loss. x is 0/1, y is 0/1."""
        base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        model, score, xf = cls(base, []), np.full(len(y), base), x.astype(np.float32)
        for _ in range(n):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
            feature, node = np.zeros(2**depth - 1, np.int64), np.zeros(len(y), np.int64)
            for k in range(2**depth - 1):
                rows = np.flatnonzero(node == k)
                if len(rows):
                    part, gg, hh = xf[rows], g[rows], h[rows]
                    g1, h1 = gg @ part, hh @ part
                    g0, h0 = gg.sum() - g1, np.maximum(hh.sum() - h1, 0)
                    feature[k] = int((g1**2 / (h1 + l2) + g0**2 / (h0 + l2)).argmax())
                    node[rows] = 2 * k + 1 + x[rows, feature[k]]
            leaf = node - len(feature)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
            model.trees.append((feature, value))
            score += value[leaf]
        return model


def subject(url: str | None) -> str:
    """What a page is about, by the last part of its URL: words in small letters, empty if there are fewer than two."""
    path = (url or "").split("://", 1)[-1].split("?", 1)[0].split("#", 1)[0].rstrip("/")
    name = _SLUG.sub(" ", path.rsplit("/", 1)[-1].lower() if "/" in path else "").strip()
    return name if " " in name else ""


_SLUG = re.compile(r"[-_+.%]+|\b(?:html?|php|aspx?)$")


class Model:
    def __init__(self, vocabulary: list[str], trees: Trees):
        self.of = {t: i for i, t in enumerate(vocabulary)}
        self.vocabulary, self.trees = vocabulary, trees
        self.width = len(vocabulary) + len(STRUCTURE) + len(SIBLINGS) + len(ANCESTORS)
        self._lines: dict[str, tuple] = {}

    def line(self, line: str) -> tuple[list[int], bool, bool, bool, bool, str]:
        """(features of the line alone, ends like a sentence, is short, has parts, has digits, small letters with single blanks)."""
        got = self._lines.get(line)
        if got is None:
            v = len(self.vocabulary)
            low = line.lower()
            words = low.split()
            s = structure(line, len(words))
            of = self.of
            own = [of[t] for t in _tokens(low) if t in of] + [v + i for i in s]
            got = own, _ENDS in s, _CHARS40 not in s, _PARTS2 in s, _DIGITS in s, " ".join(words)
            if len(self._lines) < 20_000:
                self._lines[line] = got
        return got

    def rows(self, blocks: list[list[str]], subjects: list[str] | None = None) -> np.ndarray:
        """Feature matrix of all lines of all blocks."""
        at, sizes, c = 0, array("i"), array("i")
        s0 = len(self.vocabulary) + len(STRUCTURE)
        a0 = s0 + len(SIBLINGS)
        for k, lines in enumerate(blocks):
            known = [self.line(x) for x in lines]
            n = len(lines)
            about = subjects[k] if subjects else ""
            size = [s0 + 8] if n <= 4 else [s0 + 9] if n >= 12 else []
            named = [about in x[5] for x in known] if about else [False] * n
            if not about:
                size.append(a0 + 2)
            size += [a0 + 3 + i for i, (f, share) in enumerate(((1, 0.5), (2, 0.5), (3, 0.3), (4, 0.5))) if sum(x[f] for x in known) >= share * n]
            if sum(named) >= 0.3 * n > 0 and about:
                size.append(a0 + 7)
            for i, x in enumerate(known):
                f = x[0] + size
                if named[i]:
                    f.append(a0)
                    if len(x[5]) <= len(about) + 3:
                        f.append(a0 + 1)
                if i == 0:
                    f.append(s0)
                else:
                    _, ends, short, parts, _, _ = known[i - 1]
                    if ends:
                        f.append(s0 + 2)
                    if short:
                        f.append(s0 + 3)
                    if parts:
                        f.append(s0 + 4)
                if i == n - 1:
                    f.append(s0 + 1)
                else:
                    _, ends, short, parts, _, _ = known[i + 1]
                    if ends:
                        f.append(s0 + 5)
                    if short:
                        f.append(s0 + 6)
                    if parts:
                        f.append(s0 + 7)
                sizes.append(len(f))
                c.extend(f)
            at += n
        x = np.zeros((at, self.width), np.uint8)
        x.ravel()[np.repeat(np.arange(at) * self.width, sizes) + np.array(c)] = 1
        return x

    def save(self, path: Path = MODEL) -> None:
        trees = [[f.tolist(), [round(float(x), 5) for x in v]] for f, v in self.trees.trees]
        path.write_text(json.dumps({"vocabulary": self.vocabulary, "base": self.trees.base, "trees": trees}, ensure_ascii=False))

    @classmethod
    def load(cls, path: Path = MODEL) -> Model:
        d = json.loads(path.read_text())
        return cls(d["vocabulary"], Trees(d["base"], [(np.array(f), np.array(v)) for f, v in d["trees"]]))


_ENDS, _CHARS40, _PARTS2, _DIGITS = (STRUCTURE.index(x) for x in ("ends", "chars>=40", "parts>=2", "digits"))


def decode(odds: np.ndarray) -> np.ndarray:
    """Which lines of a block are main content: the best of all, none, and a mixed labelling that pays for its changes."""
    o = np.clip(odds, -12, 12)
    n = len(o)
    total = o.sum()
    stay = [(max(0.0, 0.0), float(o[0]))]  # best score with this line as furniture, as content; content scores its log-odds
    back = []
    for k in range(1, n):
        f, c = stay[-1]
        back.append((f < c - CHANGE, c < f - CHANGE))
        stay.append((max(f, c - CHANGE), max(c, f - CHANGE) + float(o[k])))
    f, c = stay[-1]
    mixed = max(f, c) - MIXED
    if max(total, 0.0) >= mixed:
        return np.full(n, total > 0)
    out = np.empty(n, bool)
    here = c > f
    for k in range(n - 1, -1, -1):
        out[k] = here
        if k:
            here = here ^ back[k - 1][1 if here else 0]
    return out


@lru_cache(maxsize=1)
def _model() -> Model:
    return Model.load()


def label_lines(texts: list[str | None], model: Model | None = None, urls: list[str | None] | None = None) -> list[tuple[list[int], list[int]]]:
    """For each text the numbers (from 1) of its lines of main content and of furniture."""
    m = model or _model()
    blocks, numbers = [], []
    for t in texts:
        have = [(i, x) for i, x in enumerate((t or "").split("\n"), 1) if x.strip()]
        numbers.append([i for i, _ in have])
        blocks.append([x for _, x in have])
    odds = m.trees.log_odds(m.rows(blocks, [subject(u) for u in urls] if urls else None)) if any(blocks) else np.empty(0)
    out, at = [], 0
    for ns in numbers:
        keep = decode(odds[at : at + len(ns)]) if ns else np.empty(0, bool)
        at += len(ns)
        out.append(([i for i, k in zip(ns, keep) if k], [i for i, k in zip(ns, keep) if not k]))
    return out


def classify(df: DataFrame, key: str = "chunk_id", text: str = "text", url: str | None = "source_url", doc: str | None = "doc_id") -> DataFrame:
    """(key, text, main, furniture): line numbers of each kind.

    No shuffle but the spreading of few large files; only rows without URL are joined with the URL of their document's other rows.
    """
    have = [c if c and c in df.columns else None for c in (url, doc)]
    about, of = [F.col(c) if c else F.lit(None).cast("string") for c in have]
    rows = spread(df.select(F.col(key).alias(key), F.col(text).alias("text"), about.alias("_url"), of.cast("string").alias("_doc")).where("text is not null"))
    if all(have):
        known = df.where(about.isNotNull()).groupBy(of.cast("string").alias("_doc")).agg(F.min(about).alias("_url"))
        bare = rows.where("_url is null").drop("_url").join(known, "_doc", "left").select(*rows.columns)
        rows = rows.where("_url is not null").unionByName(bare)

    @F.pandas_udf("main array<int>, furniture array<int>")
    def tell(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, urls in batches:
            out = []
            for i in range(0, len(texts), 2000):
                out += label_lines(texts.iloc[i : i + 2000].tolist(), urls=urls.iloc[i : i + 2000].tolist())
            yield pd.DataFrame(out, columns=["main", "furniture"])

    # else the optimiser copies the function into a filter ahead of explode() and it runs twice
    tell = tell.asNondeterministic()
    return rows.withColumn("l", tell("text", "_url")).select(key, "text", "l.main", "l.furniture")


def furniture(df: DataFrame, key: str = "chunk_id", text: str = "text", **columns: str | None) -> DataFrame:
    """(key, line_no) of the lines that are not main body."""
    return classify(df, key, text, **columns).select(key, F.explode("furniture").alias("line_no")).distinct()


def main_body(df: DataFrame, key: str = "chunk_id", text: str = "text", **columns: str | None) -> DataFrame:
    """(key, text): each text with its main lines only, in their order."""
    lines = F.split("text", "\n")
    return classify(df, key, text, **columns).select(key, F.array_join(F.transform("main", lambda i: F.get(lines, i - 1)), "\n").alias("text")).distinct()
