"""Problem 3: sentence boundaries across languages and scripts.

Document-centred disambiguation. A first pass over all texts counts, for every short
token, how often it stands before a period that clearly goes on (a comma or a small
letter follows), before a period that clearly ends (a line ends), before other periods, and
without one. Tokens that the counts show to be abbreviations are classed
``never`` or ``may`` end a sentence: by the document's own clear occurrences where it has any,
else by the corpus. Proper names are determined in the same way: a capitalised word that its line, or mostly the corpus, also writes
small is none. A second pass decides each terminator by the class before it, by what follows, by
open quotations and brackets, and by the rules of the script. A single letter ends a sentence only before a word that is no name
("Plan B. The fund", not "A. Roe"); behind a ``may`` abbreviation a name leaves both readings open, and the unit ends there as it does
before other capitals.

Defined results: null, empty and blank texts have no units; a line without a sentence end
inside is one unit; repeated rows give the units of one; other columns play no part; tokens of over LONGEST characters are no abbreviations.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.common import spread, written

# Sentence terminators, opening and closing marks.
TERMINATORS = ".!?…。！？।॥؟۔"
FULL = "。！？।॥؟۔"
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》"}
CLOSERS = "\"”»›)]）」』】》“’'"
OPENERS = "\"“„«‹([（「『【《¿¡‘"

_END = re.compile(rf"[{TERMINATORS}]+")
_MARKS = re.compile(r"[\"“”„«»‹›()\[\]（）「」『』【】《》]")
_THAI = re.compile(r"(?<=[ก-๎])[^\S\n]+(?=[ก-๎])")
_THAI_LETTER = re.compile(r"[ก-๎]")
_DATE = re.compile(r"[^\W\d_]+ \d{4}")
_HIRAGANA = re.compile(r"[ぁ-ゟ]")


def _spans(line: str) -> list[tuple[int, int]]:
    """Positions of the pairs of quotation marks and brackets; marks without a partner count for nothing."""
    pairs, open_ = [], []
    for m in _MARKS.finditer(line):
        c, at = m[0], m.start()
        for k in range(len(open_) - 1, -1, -1):
            want, start = open_[k]
            if c == want or want == "“" and c == "”":
                pairs.append((start, at))
                del open_[k:]
                break
        else:
            if c == '"':
                open_.append(('"', at))
            elif c in PAIRS:
                open_.append((PAIRS[c], at))
    return pairs


def _starts(line: str, k: int) -> int:
    """What stands at k: 2 a capital or what opens a sentence, 1 a letter without case, 0 a small letter, -1 another sign."""
    c = line[k]
    if c.isalpha():
        if c.islower():
            return 2 if k + 1 < len(line) and line[k + 1].isupper() else 0
        return 2 if c.isupper() or c.istitle() else 1
    if c.isdigit() or c in OPENERS:
        return 2
    return 2 if unicodedata.category(c) in ("Sc", "So") else -1


def _common(line: str, j: int, classes: dict[str, str]) -> bool:
    """Whether the capitalised word at j is no proper name: the line itself writes it small elsewhere, or the corpus does."""
    w = _WORD.match(line, j)
    if not w or len(w[0]) < 2 or not w[0][1:].islower():
        return False
    return classes.get(w[0]) == "s" or w[0].lower() in _WORD.findall(line)


def ends(line: str, classes: dict[str, str]) -> list[int]:
    """Positions behind each sentence unit of a line, closing marks included, spaces not."""
    line_end = len(line.rstrip())
    if not line_end:
        return []
    out: list[int] = []
    pairs = None
    terminal = None
    for m in _END.finditer(line, 0, line_end):
        s, e = m.span()
        if e >= line_end:
            break
        sign = m[0]
        c = line[e]
        if sign == "." and (c.isdigit() or c.islower() and not line[e + 1 : e + 2].isupper() or c in ",;:-/"):
            continue  # numbers, file names, abbreviations that go on
        if pairs is None:
            pairs = _spans(line) if _MARKS.search(line) else []
        k, inside, quoted = e, False, -1
        if pairs:
            while k < line_end:
                c = line[k]
                close = next((a for a, b in pairs if b == k), None)
                if close is not None:
                    quoted = max(quoted, close)
                elif c.isspace() and any(b == k + 1 and a < s for a, b in pairs) and line[k + 1] in "»›":
                    pass
                elif c in CLOSERS and c not in OPENERS and not any(a == k for a, b in pairs):
                    pass
                else:
                    break
                k += 1
            inside = any(a < k - 1 and k <= b for a, b in pairs)
        else:
            while k < line_end and line[k] in CLOSERS and not (line[k] in OPENERS and k + 1 < line_end and line[k + 1].isalnum()):
                k += 1
        if inside or k >= line_end:
            continue
        j = k
        while j < line_end and line[j].isspace():
            j += 1
        kind = _starts(line, j)
        if sign[0] in FULL:
            if k > e and (_HIRAGANA.match(line, j) or kind == 1 and "㐀" <= line[j] <= "鿿" and not (quoted > 0 and line[quoted - 1] in ":：")):
                continue
            if kind >= 0:
                out.append(k)
            continue
        if kind <= 0:
            continue
        if sign[0] in "!?":
            out.append(k)
            continue
        if len(sign) > 1 or sign == "…":
            if kind == 2 and j > k and not line[j].isdigit():
                out.append(k)
            continue
        if k > e and j > k:  # closing marks between the period and the next sentence
            if k - e == 1 and line[e] in ")]）" and kind != 2:
                continue
        i = s
        while i > 0 and not line[i - 1].isspace() and line[i - 1] not in "\"“„«‹([（「/–—":
            i -= 1
        token = line[i:s]
        klass = classes.get(_type(token))
        if klass == "n" and k == e:
            continue
        if len(token) == 1 and token.isalpha() and k == e and not (j > k and kind == 2 and _common(line, j, classes)):
            continue
        if kind == 1 and klass == "b" and k == e:
            continue
        if j == k == e:  # nothing between: sentences may touch
            if not token or len(token) < 3 and token.isalpha() or "." in token and not token[0].isdigit() or line[j].isdigit() or kind == 1 and token.isascii():
                continue
        elif token.isdigit() and len(token) <= 2 and k == e and (i == 0 or _DATE.match(line, j)):
            continue
        if klass == "b" and k == e:
            if terminal is None:
                t = line[:line_end].rstrip(CLOSERS + " \xa0")
                terminal = bool(t) and t[-1] in TERMINATORS
            if not terminal:
                continue
        out.append(k)
    if _THAI_LETTER.search(line):
        if pairs is None:
            pairs = _spans(line)
        out += [m.start() for m in _THAI.finditer(line) if not any(a < m.start() < b for a, b in pairs)]
        out = sorted(set(out))
    # what holds no letter or digit belongs to the unit before
    kept, at = [], 0
    for p in out:
        if any(c.isalnum() for c in line[at:p]):
            kept.append(p)
            at = p
    if any(c.isalnum() for c in line[at:line_end]) or not kept:
        kept.append(line_end)
    else:
        kept[-1] = line_end
    return kept


def units(text: str | None, classes: dict[str, str], cache: dict | None = None) -> list[int]:
    """end_pos of each sentence unit of a text."""
    out: list[int] = []
    if not text:
        return out
    at = 0
    for line in text.split("\n"):
        if line:
            if cache is None:
                found = ends(line, classes)
            else:
                found = cache.get(line)
                if found is None:
                    found = ends(line, classes)
                    if len(cache) < 50_000:
                        cache[line] = found
            for p in found:
                out.append(at + p)
        at += len(line) + 1
    return out


_WORD = re.compile(r"[^\W\d_]+")
_PERIOD = re.compile(r"\.(?![.!?])")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-෿]|\.(?=[^\W\d_]))*")
_BEFORE = "\"“„«([/–—"
LONGEST = 64  # characters of the longest token that counts as an abbreviation


def _token(text: str, s: int) -> str:
    """The token of letters, vowel signs and inner periods that ends before position s, behind the last space or opening mark; empty if there is none."""
    at = text.rfind(" ", max(0, s - LONGEST - 1), s)
    t = text[at + 1 if at >= 0 else max(0, s - LONGEST - 1) : s]
    if t.isalpha():
        return t if len(t) <= LONGEST else ""
    parts = t.split()
    if not parts or t[-1:].isspace():
        return ""
    t = parts[-1]
    for c in _BEFORE:
        if c in t:
            t = t.rsplit(c, 1)[1]
    return t if len(t) <= LONGEST and _TOKEN.fullmatch(t) else ""


def _behind(text: str, e: int) -> tuple[bool, bool, int]:
    """(closing marks follow, a gap follows, position behind both) of what stands at e."""
    n, k = len(text), e
    while k < n and text[k] in "\"”»)]":
        k += 1
    g = k
    while g < n and text[g] != "\n" and text[g].isspace():
        g += 1
    return k > e, g > k, g


def _type(token: str) -> str:
    """Words in capitals throughout count as small ones; else case tells abbreviations such as No from words."""
    return token.lower() if len(token) > 2 and "." not in token and token.isupper() else token


def _count(batches: Iterator) -> Iterator:
    """Per batch: (doc_id, token, went_on, ended, open, number, bare). Rows without doc_id carry the counts of words without period.

    A row whose token begins with a blank tells that the capitalised word behind it follows a period in the document.
    """
    for pdf in batches:
        rows: list[tuple] = []
        raw: Counter = Counter()
        dotted: Counter = Counter()
        for doc, texts in pdf.groupby("doc_id", dropna=False)["text"]:
            found: dict[str, list[int]] = {}
            follows: set[str] = set()
            for text in texts:
                if not text:
                    continue
                raw.update(text.split())
                for m in _PERIOD.finditer(text):
                    at = m.start()
                    last, following = text[at - 1 : at], text[at + 1 : at + 2]
                    if following.isalpha() or not (last.isalpha() or "ऀ" <= last <= "෿") or not (token := _token(text, at)):
                        continue
                    close, gap, behind = _behind(text, at + 1)
                    after = "" if text[behind : behind + 1].isspace() else text[behind : behind + 2]
                    x = found.setdefault(_type(token), [0, 0, 0, 0])
                    if not after:
                        x[1] += 1
                    elif not close and (after[0] in ",;:" or gap and after[0].islower() and not after[1:].isupper()):
                        x[0] += 1
                    else:
                        x[2] += 1
                        x[3] += after[0].isdigit()
                        if len(token) == 1 and gap and after[0].isupper():
                            w = _WORD.match(text, behind)
                            if w and w[0][1:].islower():
                                follows.add(w[0])
            rows += [(doc, t, *x, 0) for t, x in found.items()]
            rows += [(doc, f" {w}", 0, 0, 0, 0, 0) for w in follows]
            for t, x in found.items():
                if "." not in t:
                    dotted[t] += sum(x[:3])
        words: Counter = Counter()
        for piece, n in raw.items():
            for t in _WORD.findall(piece):
                words[_type(t)] += n
        words.subtract(dotted)
        rows += [(None, t, 0, 0, 0, 0, n) for t, n in words.items() if n > 0]
        yield pd.DataFrame(rows, columns=["doc_id", "token", "went_on", "ended", "open", "number", "bare"])


def abbreviations(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, classes): for each document its abbreviations, as 'token=n' (never ends) or 'token=b' (may end), and the words behind single letters
    that are no proper names, as 'word=s', blank between."""
    rows = spread(df.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text")))
    counts = rows.mapInPandas(_count, "doc_id string, token string, went_on long, ended long, open long, number long, bare long")
    sums = [F.sum(c).alias(c) for c in ("went_on", "ended", "open", "number", "bare")]
    counts = written(counts.groupBy("doc_id", "token").agg(*sums))
    counts = counts.where("token <> ''")
    own = counts.where("doc_id is not null and went_on + ended + open > 0")
    # The corpus has one row a token; tokens that never stand before a period are no candidates.
    total = counts.groupBy("token").agg(*[F.sum(c).alias("all_" + c) for c in ("went_on", "ended", "open", "number", "bare")])
    total = total.where("all_went_on + all_ended + all_open > 0").withColumn("n", F.expr("all_went_on + all_ended + all_open"))
    total = total.withColumn("dotted", F.expr("n / (n + all_bare)"))
    corpus = F.expr(
        "case when all_ended <= 0.004 * n and (all_went_on >= 0.02 * n and dotted >= 0.8 or n >= 3 and dotted >= 0.95 and length(token) <= 5) then 'n'"
        " when all_ended <= 0.02 * n and n >= 3 and all_number >= 0.5 * n and length(token) <= 8 then 'n'"
        " when all_went_on >= 2 and all_went_on >= 0.02 * n and dotted >= 0.8 then 'b' end"
    )
    both = own.join(total.withColumn("corpus", corpus), "token")
    # The document's clear occurrences come before the corpus.
    klass = F.expr(
        "case when corpus = 'n' and ended > 0 and went_on = 0 and all_ended > 1 then 'b'"
        " when corpus is null and went_on >= 2 and ended = 0 and dotted >= 0.8 then 'n'"
        " else corpus end"
    )
    named = both.withColumn("class", klass).where("class is not null").select("doc_id", F.concat_ws("=", "token", "class").alias("c"))
    # Words behind single letters: one that the corpus also writes small is no proper name.
    follows = counts.where("doc_id is not null and token like ' %'").select("doc_id", F.ltrim("token").alias("word"))
    seen = counts.where("doc_id is null").select(F.col("token").alias("small"), F.col("bare").alias("small_bare"))
    common = follows.join(seen, F.lower("word") == F.col("small")).where((F.col("small_bare") >= LEAST_SMALL) & (F.col("small") != F.col("word")))
    common = common.join(seen.select(F.col("small").alias("word"), F.col("small_bare").alias("capital_bare")), "word", "left")
    common = common.where(F.col("small_bare") >= SMALL_SHARE * F.coalesce("capital_bare", F.lit(0)))
    return named.unionByName(common.select("doc_id", F.concat("word", F.lit("=s")).alias("c"))).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("c")), " ").alias("classes"))


LEAST_SMALL, SMALL_SHARE = 2, 0.5  # small occurrences in the corpus, and how many of them a capital one needs, to be no name


@lru_cache(maxsize=4096)
def _parse(classes: str | None) -> dict[str, str]:
    return dict(x.rsplit("=", 1) for x in classes.split(" ")) if classes else {}


def _ends_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with the array ``e`` of the positions behind their units. rows has doc_id and text; known has the classes of each document."""

    @F.pandas_udf("array<int>")
    def cut(texts: pd.Series, classes: pd.Series) -> pd.Series:
        caches: dict = {}
        return pd.Series([units(t, _parse(c), caches.setdefault(c, {})) for t, c in zip(texts, classes)])

    # else the optimiser may copy the function into a filter and it runs twice
    cut = cut.asNondeterministic()
    joined = spread(rows.where("text is not null")).join(known, "doc_id", "left")
    return joined.withColumn("e", cut("text", "classes")).drop("classes")


def _rows(df: DataFrame, key: str, doc: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias(key), F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text"))


def sentence_ends(df: DataFrame, key: str = "chunk_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, end_pos): one row per sentence unit of every text."""
    rows = _rows(df, key, doc, text)
    # written, so that its size is known: small enough it is broadcast, else the join shuffles
    return _ends_of(rows, written(abbreviations(rows))).select(key, F.explode("e").alias("end_pos")).distinct()


def sentences(df: DataFrame, key: str = "chunk_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, start_pos, end_pos, sentence): the units of every distinct text of a key; start_pos counts from 1."""
    rows = _rows(df, key, doc, text)
    cut = _ends_of(spread(rows).dropDuplicates([key, "text"]), written(abbreviations(rows)))
    each = cut.select(key, "text", "e", F.posexplode("e").alias("unit", "end_pos"))
    before = F.when(F.col("unit") > 0, F.get("e", F.col("unit") - 1)).otherwise(0)
    raw = F.substring(F.col("text"), before + 1, F.col("end_pos") - before)
    lead = F.length(raw) - F.length(F.regexp_replace(raw, r"^[\s\u00a0]+", ""))
    return each.select(key, (F.col("unit") + 1).alias("unit"), (before + lead + 1).alias("start_pos"), "end_pos", F.regexp_replace(raw, r"^[\s\u00a0]+", "").alias("sentence"))
