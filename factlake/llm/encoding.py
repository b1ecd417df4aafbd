"""Problem 1: text that was decoded with the wrong character encoding.

For every pair (UTF-8 read as X of READINGS) the garbled form of each plausible character
is precomputed and put into one Aho-Corasick automaton. Only matched spans
are rewritten, so correct text around them stays as it is. Text that was
damaged more than once is repaired by running the automata until nothing matches.

Double-byte readings (UTF-8 read as GBK) cross character borders, so there the
automaton only finds trigger characters and the whole double-byte run is turned
back. Words of Cyrillic or Greek code pages read as cp1252 have no sign of their own in them; they are told by standing
wholly beyond ASCII and turning into small letters of one alphabet. Characters that were lost (U+FFFD, cut sequences) are reported, not guessed.

Defined results: a null or empty text is undamaged and stays as it is; repeated rows give
one row per key in ``p1_found`` and one per distinct (key, text) in the repair;
columns other than the key and the text play no part.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Single-byte readings; those in one group can occur in one damaged span, and the group that explains most of a text goes first.
READINGS = (("cp1252", "latin-1"), ("cp1251",), ("mac_roman",), ("cp437",), ("cp850",), ("cp1250",), ("koi8_r",), ("cp1254",), ("cp866",), ("iso8859_2",), ("iso8859_15",))
# Scripts that a text of this kind may hold: (first, last, must touch another garbled character).
# A lone Han or kana character is no proof: an accented letter before two signs looks the same.
SCRIPTS = (
    (0x80, 0x17F, False), (0x192, 0x192, False), (0x2C6, 0x2DC, False), (0x386, 0x3CE, False), (0x401, 0x45F, False), (0x60C, 0x6D4, False),
    (0x901, 0x97F, False), (0x981, 0x9FB, False), (0xE01, 0xE5B, False), (0x2010, 0x2044, False),
    (0x20A0, 0x20BF, False), (0x2116, 0x2122, False), (0x2190, 0x21FF, False), (0x2212, 0x2265, False),
    (0x25A0, 0x2605, False), (0x3001, 0x303F, True), (0x3041, 0x30FF, True), (0x4E00, 0x9FFF, True), (0xFF01, 0xFF5E, True),
)
# Further ones that single-byte readings are undone for: Hebrew, other Indic, stars and dingbats, Hangul, variation selector, byte order mark, a lost character, emoji.
MORE = (
    (0x5D0, 0x5EA, True), (0xA01, 0xDFF, False), (0x2606, 0x27BF, False), (0xAC00, 0xD7A3, True), (0xFE0F, 0xFE0F, False),
    (0xFEFF, 0xFEFF, False), (0xFFFD, 0xFFFD, False), (0x1F300, 0x1FAFF, False),
)
# Readings in which two garbled characters may be genuine, and signs that do not follow a letter in genuine text.
RARE = ("koi8_r", "cp850", "cp1250", "cp1254", "cp866", "iso8859_2", "iso8859_15")
NO_FOLLOWER = "©¨¬¦¤"
# Alphabets whose own code page was read as cp1252: code page, first and last letter. A word of letters beyond ASCII alone does not occur in Latin script.
ALPHABETS = (("cp1251", "Ё", "ё"), ("koi8_r", "Ё", "ё"), ("cp1253", "Ά", "ώ"))
WORD, BESIDE = 5, 2  # letters of a word that tells such a reading, and of further words beside it
LOST = "�"


def _read(raw: bytes, codec: str) -> str | None:
    """The bytes as a lenient reader shows them: bytes that the code page leaves open become C1 controls."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _impossible(g: str) -> bool:
    """Whether two characters cannot stand together in genuine text: one of them draws boxes and the other not, or a sign that follows no letter does."""
    boxes = ["─" <= c <= "▟" for c in g]
    return boxes[0] != boxes[1] or g[0].isalpha() and g[1] in NO_FOLLOWER


@lru_cache(maxsize=1)
def automata() -> list:
    """One automaton a group: garbled form -> (length, original, strength). Strength 0: enough alone, 1: only beside another, 2: original lost."""
    import ahocorasick

    out = []
    for group in READINGS:
        found: dict[str, tuple[str, int]] = {}
        for codec in group:
            for first, last, touching in SCRIPTS + MORE:
                for cp in range(first, last + 1):
                    c = chr(cp)
                    g = _read(c.encode(), codec)
                    rare = codec in RARE and len(g) == 2 and not _impossible(g) or codec == "cp1251" and 0x401 <= cp <= 0x45F
                    if g not in found and g != c:
                        found[g] = (c, int(touching or rare))
            if codec in ("cp1252", "cp1251", "cp437"):  # quotes, dashes and currency signs whose last byte is gone
                for head in (b"\xe2\x80", b"\xe2\x82"):
                    found.setdefault(_read(head, codec), ("", 2))
        a = ahocorasick.Automaton()
        for g, (c, k) in found.items():
            a.add_word(g, (len(g), c, k))
        a.make_automaton()
        out.append(a)
    return out


@lru_cache(maxsize=1)
def _double_triggers() -> re.Pattern:
    """Han characters that start a double-byte misreading of punctuation, currency, Indic, Thai or kana."""
    heads = {bytes(b).decode("gb18030") for b in ((0xE2, x) for x in (0x80, 0x82, 0x84))}
    heads |= {bytes((0xE0, x)).decode("gb18030") for x in (0xA4, 0xA5, 0xA6, 0xA7, 0xB8, 0xB9)}
    heads |= {bytes((0xE3, x)).decode("gb18030") for x in (0x81, 0x82, 0x83)}
    latin = {chr(cp).encode().decode("gb18030", "ignore") for cp in range(0xC0, 0x180)} - {""}
    return re.compile(f"[{''.join(sorted(heads))}]|(?<=[A-Za-z])[{''.join(sorted(latin))}]|[{''.join(sorted(latin))}](?=[a-z])")


_RUN = re.compile(r"[‐-�Ͱ-ӿ¤-÷]+[\x20-\x7e]?")


def _undo_double(text: str) -> tuple[str, int, bool]:
    """(text, spans, lost) after turning runs read as GBK back."""
    spans, lost, out, at = 0, False, [], 0
    trigger = _double_triggers()
    for m in _RUN.finditer(text):
        run = m[0]
        core = run[:-1] if run[-1] < "\x7f" else run
        if not core or not (trigger.search(text, max(0, m.start() - 1), min(len(text), m.end() + 1)) or len(core) >= 3):
            continue
        gone = LOST in run
        try:
            raw = b"".join(b"\xff" if c == LOST else c.encode("gb18030") for c in run)
        except UnicodeEncodeError:
            continue
        back = raw.decode("utf-8", "replace")
        ok = sum(c != LOST for c in back if c > "\x7f")
        bad = back.count(LOST)
        triggered = bool(trigger.search(core)) or trigger.search(text, max(0, m.start() - 1), min(len(text), m.end() + 1)) is not None
        if bad and not gone or ok == 0 and not (gone and triggered) or not triggered and (ok < 2 or bad):
            continue
        if not all(any(a <= ord(c) <= b for a, b, _ in SCRIPTS) for c in back if c > "\x7f" and c != LOST):
            continue
        out += [text[at : m.start()], back]
        at = m.end()
        spans += 1
        lost |= gone
    return ("".join(out) + text[at:] if spans else text), spans, lost


def _hits(a, text: str) -> list[tuple[int, int, str, int]]:
    hits = [(end - n + 1, end + 1, c, k) for end, (n, c, k) in a.iter_long(text)]
    return [
        h for i, h in enumerate(hits)
        if h[3] != 1 or i and hits[i - 1][1] == h[0] and hits[i - 1][3] < 2 or i + 1 < len(hits) and hits[i + 1][0] == h[1] and hits[i + 1][3] < 2
    ]


def _undo_single(text: str) -> tuple[str, int, bool]:
    hits = max((_hits(a, text) for a in automata()), key=lambda h: sum(e - s for s, e, _, k in h if k < 2) + 0.1 * len(h))
    out, at = [], 0
    for s, e, c, k in hits:
        if k < 2:  # where the sign cannot be told it stays as it is
            out += [text[at:s], c]
            at = e
    return "".join(out) + text[at:], len(hits), any(h[3] == 2 for h in hits)


_ALIEN = re.compile(r"(?<![A-Za-z\u00c0-\u024f])[\u00c0-\u00ff]+(?![A-Za-z\u00c0-\u024f])")


def _undo_alphabet(text: str) -> tuple[str, int]:
    """(text, spans) after words of one alphabet that were read as cp1252 are turned back: all their letters must be of the alphabet, small behind the first."""
    words = [m for m in _ALIEN.finditer(text) if len(m[0]) >= BESIDE]
    if not any(len(m[0]) >= WORD for m in words):
        return text, 0

    def back(word: str, codec: str, first: str, last: str) -> str | None:
        read = word.encode("cp1252").decode(codec, "replace")
        return read if all(first <= c <= last and c.isalpha() for c in read) and (read[1:].islower() or len(read) == 1) else None

    every = [[(m, b) for m in words if (b := back(m[0], *alphabet))] for alphabet in ALPHABETS]
    found = max(every, key=lambda f: sum(len(b) for _, b in f))  # the alphabet that explains most
    if not any(len(b) >= WORD for _, b in found):
        return text, 0
    out, at = [], 0
    for m, b in found:
        out += [text[at : m.start()], b]
        at = m.end()
    return "".join(out) + text[at:], len(found)


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """(restored text, number of damaged spans, whether part of the original is lost)."""
    if not text or text.isascii():
        return text, 0, False
    lost, spans = LOST in text, len(re.findall(LOST + "+", text))
    turn = 0
    while True:  # ends, as what is turned back has fewer bytes
        new, n, gone = _undo_single(text)
        if new == text:
            new, m, more = _undo_double(text)
            n, gone = n + m, gone or more
        if turn == 0 or new != text:
            spans += n
        lost |= gone
        if new == text:
            break
        shorter = len(new.encode("utf-8", "surrogatepass")) < len(text.encode("utf-8", "surrogatepass"))
        text, turn = new, turn + 1
        if not shorter:  # only where part of the original is lost
            break
    text, n = _undo_alphabet(text)
    spans += n
    return text, spans, lost or LOST in text


def repair_encoding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, damaged, restored, spans, lost) for every row; only rows with non-ASCII text reach Python."""
    @F.pandas_udf("restored string, spans int, lost boolean")
    def fix(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t) for t in col], columns=["restored", "spans", "lost"])

    rows = df.select(F.col(key).alias(key), F.col(text).alias("text"))
    odd = F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = rows.where(~odd).select(key, "text", F.lit(False).alias("damaged"), F.col("text").alias("restored"), F.lit(0).alias("spans"), F.lit(False).alias("lost"))
    fixed = rows.where(odd).withColumn("r", fix("text")).select(key, "text", (F.col("r.spans") > 0).alias("damaged"), "r.restored", "r.spans", "r.lost")
    return plain.unionByName(fixed)


def damaged_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return repair_encoding(df, key, text).where("damaged")
