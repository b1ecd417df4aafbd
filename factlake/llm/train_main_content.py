"""Trains the trees of main_content.py: python -m factlake.llm.train_main_content TABLES_FOLDER [--fit-only].

No row comes labelled, so lines are labelled by their place and by how they recur (weak supervision):

* furniture: a line that at least REPEATED documents of its site hold letter for letter; a row of many short parts without digits or
  sentence end, or of parts of which the page's subject is the last; a line that opens or closes with one of the PROMPTS that web pages of any kind use;
* main content: any other line that names the page's subject (the last part of its URL), and a row of words that ends with a number;
* furniture by its parent: the lines that are left in a block (a page's head or foot) of which at least a share PARENT is furniture.

Lines that no rule tells train nothing. At most LINES lines are used, in the order of a hash of their block. Words that
occur on few sites, or mostly on one (brands and other names), or on both sides alike, are left out of the vocabulary, and shares DROPPED of the lines
are repeated without their words, without the subject, and without both, so that form and place decide on pages where these are unknown.

Prose from elsewhere is main content too: at most PROSE lines of the documents table, and the paragraphs of the Python language reference that comes
with every interpreter. Its pages have no subject, or one that no line names.

Agreement with the weak labels is measured on whole sites and on whole languages that took no part in the training.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from factlake.llm.main_content import STRUCTURE, Model, Trees, subject, tokens

LINES, VOCABULARY, REPEATED, DROPPED, PARENT, PROSE, TREES, HELD_OUT_TREES = 60_000, 640, 5, 0.2, 0.75, 15_000, 220, 100
NOWHERE = "\0"  # a subject that no line names
LEAST_SITES, MOST_ON_ONE, ONE_SIDED = 4, 0.6, 4.0
CONTENT = ("digits", "digit_share>=0.1", "percent_end", "upper", "lower", "capital_share>=0.5", "capital_share>=0.8", "colon_inside", "latin", "other_script", "mixed_script")

# Prompts of web pages in general, small letters, one blank between words; ^ stands for the beginning of a line.
PROMPTS = """
^home > ~ ^you are here ~ ^skip to ~ ^search ~ log in ~ sign up ~ sign in ~ create an account ~ ^share ~ share this page ~ ^follow us ~ ^rate this ~ was this page helpful ~ with a friend
^related: ~ ^read next ~ ^read more ~ ^see also ~ ^read how ~ you may also like ~ also viewed ~ ^trending ~ ^top searches ~ ^most read ~ ^add to ~ to watchlist ~ ^compare ~ ^take the quiz ~ our podcast ~ our newsletter ~ weekend letter ~ subscribers only
^advertisement ~ ^sponsored ~ learn more ~ ^download the app ~ ^get alerts ~ in your inbox ~ ^© ~ all rights reserved ~ uses cookies ~ use cookies ~ ^cookies help ~ cookie policy ~ accept all ~ reject all ~ your consent ~ your privacy matters ~ you agree to ~ privacy policy ~ terms of use ~ ^registered office ~ ^registrar ~ files on your device ~ ^printed from ~ help line ~ help desk for ~ grievance desk
^mehr zum thema ~ ^teilen ~ ^à lire aussi ~ ^partager ~ ^también le puede interesar ~ ^compartir ~ ^leia também ~ ^partilhar ~ ^यह भी पढ़ें ~ ^साझा करें ~ ^हे पण वाचा ~ ^আরও পড়ুন ~ ^相关 ~ ^分享 ~ ^関連 ~ ^シェア ~ ^อ่านต่อ ~ ^แชร์ ~ ^اقرأ أيضا ~ ^شارك
speichert cookies ~ garde des cookies ~ acepta las cookies ~ usa cookies ~ 使用cookie ~ कुकी का उपयोग
"""


def _prompts() -> re.Pattern:
    """Any of the prompts; one that begins or ends with a Latin letter must do so at the border of a word."""
    out = []
    for p in (x for line in PROMPTS.strip().split("\n") for x in line.split(" ~ ")):
        word, first = p.lstrip("^"), p.startswith("^")
        out.append(("^" if first else r"(?<![a-zà-ÿ])" if word[0].isascii() else "") + re.escape(word) + (r"(?![a-zà-ÿ])" if word[-1].isascii() and word[-1].isalpha() else ""))
    return re.compile("|".join(out))


_PROMPT = _prompts()
_PARTS = re.compile(r" [|·/>•] |\s{2,}")
_NUMBER_ROW = re.compile(r"^[^.!?]*[^\W\d_][^!?]* [^\w]*\d[\d.,]*\s*%?$")


def site(url: str | None) -> str:
    return re.sub(r"^(?:www|m)\.", "", (url or "").lower().split("://", 1)[-1].split("/", 1)[0])


def weak_labels(blocks: list[list[str]], urls: list[str | None], docs: list[str]) -> list[list[int | None]]:
    """1 main content, 0 furniture, None if no rule tells, for each line of each block."""
    url_of = {d: u for d, u in zip(docs, urls) if u}
    sites = [site(url_of.get(d)) for d in docs]
    letters = [[re.sub(r"[\W\d_]+", "", x.lower()) for x in lines] for lines in blocks]
    holders: dict[tuple[str, str], set[str]] = defaultdict(set)
    for s, d, keys in zip(sites, docs, letters):
        for k in keys:
            holders[s, k].add(d)
    out = []
    for s, doc, lines, keys in zip(sites, docs, blocks, letters):
        about = subject(url_of.get(doc))
        ys: list[int | None] = []
        for x, k in zip(lines, keys):
            low = " ".join(x.lower().split()).strip("»•-!. ")
            parts = [p for p in _PARTS.split(x.strip()) if p]
            crumb = len(parts) >= 2 and not re.search(r"\d", low) and about and parts[-1].lower().strip(" »•-!.") == about
            menu = crumb or len(parts) >= 4 and not re.search(r"\d|[.!?।。]$", low) and np.median([len(p) for p in parts]) <= 14
            ys.append(0 if k and len(holders[s, k]) >= REPEATED or menu or _PROMPT.search(low) else None)
        share = sum(y == 0 for y in ys) / max(1, len(ys))
        for i, x in enumerate(lines):
            low = " ".join(x.lower().split())
            if ys[i] is None and (about and about in low or _NUMBER_ROW.match(low)):
                ys[i] = 1
            elif ys[i] is None and share >= PARENT and len(ys) >= 4:
                ys[i] = 0
        out.append(ys)
    return out


def script(lines: list[str]) -> str:
    """A coarse language of a block, for the held-out measure: its commonest script, Latin ones by their accents."""
    c: Counter = Counter()
    for ch in "".join(lines):
        if ch.isalpha():
            n = ord(ch)
            c["latin" if n < 0x250 else "arabic" if 0x600 <= n < 0x700 else "devanagari" if 0x900 <= n < 0x980 else "bengali" if 0x980 <= n < 0xA00 else "thai" if 0xE00 <= n < 0xE80 else "kana" if 0x3040 <= n < 0x3100 else "han"] += 1
    other = {k: v for k, v in c.items() if k != "latin" and v >= 0.1 * sum(c.values())}
    return "kana" if "kana" in other else max(other, key=lambda k: other[k]) if other else "latin"


def vocabulary_of(blocks: list, labels: list, sites: list[str]) -> list[str]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    places: dict[str, Counter] = defaultdict(Counter)
    for lines, ys, s in zip(blocks, labels, sites):
        for x, y in zip(lines, ys):
            if y is not None:
                for t in set(tokens(x)):
                    counts[y][t] += 1
                    places[t][s] += 1
    size = {y: max(1, sum(v is not None and v == y for ys in labels for v in ys)) for y in (0, 1)}
    wide = [t for t, p in places.items() if sum(p.values()) >= 20 and len(p) >= LEAST_SITES and max(p.values()) <= MOST_ON_ONE * sum(p.values())]
    def one_sided(t: str) -> bool:
        a, b = counts[0][t] / size[0], counts[1][t] / size[1]
        return max(a, b) >= ONE_SIDED * min(a, b)

    gap = {t: abs(counts[0][t] / size[0] - counts[1][t] / size[1]) for t in wide if one_sided(t)}
    return sorted(sorted(gap, key=lambda t: (-gap[t], t))[:VOCABULARY])


def prose(texts: list[str]) -> list[list[str]]:
    """Blocks of up to nine lines of main content: of the texts, in the order of a hash, and of the language reference, whole and by sentences."""
    from pydoc_data import topics

    out: list[list[str]] = []
    n = 0
    for t in sorted(set(texts), key=lambda t: zlib.crc32(t.encode())):
        lines = [x for x in t.split("\n") if x.strip()]
        out += [lines[i : i + 1 + n % 9] for i in range(0, len(lines), 1 + n % 9)]
        n += len(lines)
        if n >= PROSE:
            break
    whole = "\n\n".join(topics.topics[k] for k in sorted(topics.topics))
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", whole)]
    paragraphs = [p for p in paragraphs if len(p) > 60 and re.match(r"[A-Z][a-z]", p) and p.endswith(".") and not re.search(r"[{}<>=*`|\\\[\]_]|::", p)]
    return out + [paragraphs[i : i + 3] for i in range(0, len(paragraphs), 3)] + [re.split(r"(?<=[.:]) (?=[A-Z])", p) for p in paragraphs]


def fit(blocks: list, labels: list, abouts: list[str], sites: list[str], more: list[list[str]], trees: int = TREES) -> Model:
    m = Model(vocabulary_of(blocks, labels, sites), Trees(0.0, []))
    x = m.rows(blocks, abouts)
    y = np.array([-1 if v is None else v for ys in labels for v in ys])
    rng = np.random.default_rng(7)
    known = np.flatnonzero(y >= 0)
    nameless, other = m.rows(blocks, [""] * len(blocks)), m.rows(blocks, [NOWHERE] * len(blocks))
    xs, ys = [x[known]], [y[known]]
    # what a page looks like whose URL tells nothing or something else, whose words are unknown, or both; the last one shows only the form of its lines
    v = len(m.vocabulary)
    content = list(range(v)) + [v + STRUCTURE.index(f) for f in CONTENT]
    for features, gone in ((nameless, []), (other, []), (x, list(range(v))), (nameless, list(range(v))), (nameless, content)):
        some = rng.choice(known, int(DROPPED * len(known)), replace=False)
        part = features[some].copy()
        part[:, gone] = 0
        xs.append(part)
        ys.append(y[some])
    p = m.rows(more, ["" if i % 2 else NOWHERE for i in range(len(more))])
    m.trees = Trees.fit(np.vstack([*xs, p]), np.concatenate([*ys, np.ones(len(p))]).astype(float), trees)
    return m


def agreement(m: Model, blocks: list, labels: list, abouts: list[str]) -> float:
    y = np.array([-1 if v is None else v for ys in labels for v in ys])
    return float(((m.trees.log_odds(m.rows(blocks, abouts)) > 0) == (y == 1))[y >= 0].mean())


def train(rows: pd.DataFrame, texts: list[str], hold_out: bool = True) -> tuple[Model, dict]:
    """rows has text, source_url and doc_id; texts are main content."""
    more = prose(texts)
    rows = rows.dropna(subset=["text"]).drop_duplicates(["text", "doc_id"])
    rows = rows.assign(h=rows["text"].map(lambda t: zlib.crc32(t.encode()))).sort_values(["h", "text"])
    blocks = [[x for x in t.split("\n") if x.strip()] for t in rows["text"]]
    urls, docs = rows["source_url"].where(rows["source_url"].notna(), None).tolist(), rows["doc_id"].tolist()
    labels = weak_labels(blocks, urls, docs)
    cut = int(np.searchsorted(np.cumsum([len(b) for b in blocks]), LINES)) + 1
    of_doc = {d: site(u) for d, u in zip(docs, urls) if u}
    blocks, labels, urls, sites = blocks[:cut], labels[:cut], urls[:cut], [of_doc.get(d, "") for d in docs[:cut]]
    abouts, scripts = [subject(u) for u in urls], [script(b) for b in blocks]

    def part(keep: list[bool]) -> tuple:
        return tuple([x for x, k in zip(col, keep) if k] for col in (blocks, labels, abouts, sites))

    report: dict = {"lines": sum(map(len, blocks)), "labelled": sum(y is not None for ys in labels for y in ys)}
    names = sorted(set(sites) - {""})
    for held, group in [(names[:2], sites), (names[2:4], sites), (["devanagari"], scripts), (["han", "kana"], scripts), (["arabic", "thai", "bengali"], scripts)] if hold_out else []:
        out = [g in held for g in group]
        m = fit(*part([not o for o in out]), [b for b in more if group is sites or script(b) not in held], HELD_OUT_TREES)
        report["held out " + ", ".join(held)] = round(agreement(m, *part(out)[:3]), 4)
    model = fit(blocks, labels, abouts, sites, more)
    report |= {"features": model.width, "structure": len(STRUCTURE), "fitted": round(agreement(model, blocks, labels, abouts), 4)}
    return model, report


if __name__ == "__main__":
    folder = sys.argv[1]
    model, told = train(pd.read_parquet(folder + "/chunks.parquet", columns=["text", "source_url", "doc_id"]), pd.read_parquet(folder + "/documents.parquet", columns=["text"])["text"].dropna().tolist(), "--fit-only" not in sys.argv)
    print(told)
    model.save()
