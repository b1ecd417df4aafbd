from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from factlake.llm import encoding, language, leakage, main_content, packing, repeated_lines, sentences

CHUNK = "chunk_id string, doc_id string, source_url string, chunk_type string, text string, token_count int, overlap boolean, site string, spans int"


def chunks(spark, rows):
    """Rows of (chunk_id, doc_id, source_url, text), with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(c, d, u, None, t, None, None, "x", 1) for c, d, u, t in rows], CHUNK)


# --- problem 1 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", ["Coût à l’entrée – née", "जोखिम: बहुत अधिक", "₹1,000", "Größe des Fonds – Übersicht", "ファンドの純資産"])
def test_encoding_round_trip(codec, text):
    bad = "".join(encoding._read(bytes([b]), codec) for b in text.encode())
    fixed, spans, lost = encoding.repair(f"Menu\n{bad}\nDone")
    assert spans and not lost
    assert fixed == f"Menu\n{text}\nDone"


def test_encoding_twice_and_partly():
    bad = "Risk’s grade".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(f"{bad} – déjà vu")[0] == "Risk’s grade – déjà vu"
    assert encoding.repair("Risk鈥檚 grade")[0] == "Risk’s grade"


@pytest.mark.parametrize(
    "text", ["SÃO JOÃO – INFORMAÇÃO", "Nãthdor’s view", "Cholmoraã\xa0… très bien", "Grupo Thórvexã\xa0® señal", "Фонд облигаций – обзор", "Δείκτης Γ – ετήσια", "基金规模概览", "我没有钱", "₹ 12", "Łącznie: 3 • Żyto", "“Yavmereã” & Söhne", "ファンドの純資産", "", "plain"]
)
def test_encoding_leaves_genuine_letters(text):
    assert encoding.repair(text) == (text, 0, False)


@pytest.mark.parametrize(("codec", "text"), [("cp1251", "Привет, мир – обзор фонда"), ("koi8_r", "Привет мир фонда"), ("cp1253", "Ετήσια απόδοση του")])
def test_encoding_of_other_alphabets(codec, text):
    """Texts of a code page of another alphabet, read as cp1252."""
    bad = text.encode(codec, "replace").decode("cp1252", "replace") if "–" not in text else text.replace("–", "-").encode(codec).decode("cp1252")
    fixed, spans, _ = encoding.repair(f"NAV 5: {bad}")
    assert spans and fixed == f"NAV 5: {text.replace('–', '-')}"


def test_encoding_many_rounds():
    """Damage done many times over is undone as often."""
    bad = text = "Größe – é"
    for _ in range(11):
        bad = encoding._read(bad.encode(), "cp1252")
    assert encoding.repair(bad)[0] == text


def test_encoding_lost_is_reported():
    assert encoding.repair("Fund � note")[1:] == (1, True)
    assert encoding.repair(None) == (None, 0, False)


@pytest.mark.parametrize("codec", [c for group in encoding.READINGS for c in group])
@pytest.mark.parametrize("text", ["\ufeffNAV 12", "good 😀 day", "❤ it", "தமிழ் நிதி", "café au lait", "très bien"])
def test_encoding_isolated_and_further_scripts(codec, text):
    if (codec, text) == ("iso8859_2", "café au lait"):
        pytest.skip("two letters that may be genuine")
    fixed, spans, _ = encoding.repair(encoding._read(text.encode(), codec))
    assert spans == sum(len(c.encode()) > 1 for c in text)
    if codec != "iso8859_15":  # eight of its signs stand for other bytes in cp1252
        assert fixed == text


def test_encoding_garbled_replacement_character():
    for codec in ("cp1252", "latin-1", "cp1251", "cp866"):
        assert encoding.repair("Fund " + encoding._read("\ufffd".encode(), codec) + " note") == ("Fund \ufffd note", 1, True)
    for text in ("├── école", "ROMÂNĂ® «ŢARĂ»", "Brand © 2026", "5 × 3"):
        assert encoding.repair(text) == (text, 0, False)


def test_encoding_table(spark):
    rows = [(1, "Riskâ€™s"), (1, "Riskâ€™s"), (2, None), (3, ""), (4, "x" * 200_000 + "Ã©"), (5, "né")]
    df = spark.createDataFrame(rows, "fact_id long, raw_snippet string").withColumn("restored", F.lit("clash"))
    got = encoding.damaged_rows(df, "fact_id", "raw_snippet").select("fact_id").distinct().collect()
    assert sorted(r[0] for r in got) == [1, 4]
    assert encoding.repair_encoding(df.where("false"), "fact_id", "raw_snippet").count() == 0


# --- problem 2 -----------------------------------------------------------------------------------


def brute_repeated(rows):
    site = {}
    for c, d, u, t in rows:
        if u:
            site.setdefault(d, re.sub(r"^(www|m)\.", "", re.match(r"\w+://([^/]+)", u)[1].lower()))
    docs, seen, at = {}, {}, {}
    for c, d, u, t in rows:
        docs.setdefault(site.get(d), set()).add(d)
        for n, line in enumerate((t or "").split("\n") if t is not None else [], 1):
            k = "".join(x for x in line if x.isalpha()).casefold()
            if k and d in site:
                seen.setdefault((site[d], k), set()).add(d)
                at.setdefault((site[d], k), set()).add((c, n))
    return {o for k, v in seen.items() if len(v) >= 5 and len(v) >= 0.04 * len(docs[k[0]]) for o in at[k]}


def test_repeated_lines(spark):
    rnd = random.Random(3)
    rows = []
    for s, share in (("a.example", 0.5), ("b.test", 0.05)):
        for d in range(120):
            lines = [f"{w} {rnd.choice('abcdefgh') * 3} {rnd.randrange(10**6):b} words{chr(97 + d % 26)}{chr(97 + d // 26)}{s[0]}" for w in ("Net", "Gross")]
            if rnd.random() < share:
                lines.append(f"Follow us, {d}!")
            if d % 3 == 0:
                lines.append("ALL  RIGHTS kept.")
            rnd.shuffle(lines)
            rows.append((f"{s}{d}", f"{s}-{d}", None if d % 7 == 1 else f"https://{'www.' if d % 2 else ''}{s.upper()}/x/{d}", "\n".join(lines)))
            if d % 7 == 1:
                rows.append((f"{s}{d}u", f"{s}-{d}", f"https://m.{s}/x/{d}", "12 34\n--"))
    rows += [rows[0], ("n", "nowhere", None, "Follow us"), ("e", "a.example-0", None, ""), ("z", "a.example-0", None, None)]
    df = chunks(spark, rows)
    got = {(r[0], r[1]) for r in repeated_lines.repeated_occurrences(df).collect()}
    want = brute_repeated(rows)
    assert got == want and want
    clean = {r["chunk_id"]: r for r in repeated_lines.without_repeated_lines(df).collect()}
    for c, _, _, t in rows:
        if t is not None:
            keep = [x for n, x in enumerate(t.split("\n"), 1) if (c, n) not in want]
            assert clean[c]["text"] == "\n".join(keep)
    assert repeated_lines.repeated_occurrences(df.where("false")).count() == 0


# --- problem 3 -----------------------------------------------------------------------------------

CLASSES = {"Ltd": "b", "Inc": "b", "p.m": "b", "Dr": "n", "Mr": "n", "No": "n", "e.g": "n", "approx": "n", "डॉ": "n", "Sept": "n", "Mio": "n", "Pvt": "n"}


@pytest.mark.parametrize(
    ("line", "units"),
    [
        ("Costs fell. Returns rose by 1.5%. Done", ["Costs fell.", "Returns rose by 1.5%.", "Done"]),
        ("Dr. A. K. Roe and Mr. Poe met in Sept. 2019. Good!", ["Dr. A. K. Roe and Mr. Poe met in Sept. 2019.", "Good!"]),
        ('The note reads: "Costs fell. Returns did not." In May it rose.', ['The note reads: "Costs fell. Returns did not."', "In May it rose."]),
        ('"Keep it for 2 years!" says the note. (See table 5 in the report.) Yes.', ['"Keep it for 2 years!" says the note.', "(See table 5 in the report.)", "Yes."]),
        ("The trustee is Acme Pvt. Ltd. Holdings in e.g. Zed Ltd., fell.", ["The trustee is Acme Pvt. Ltd.", "Holdings in e.g. Zed Ltd., fell."]),
        ("Acme Ltd. Utilities Equity 1.93%", ["Acme Ltd. Utilities Equity 1.93%"]),
        ("Cut-off is 2 p.m. on Monday. eNAV feeds stopped?Yes, they did.", ["Cut-off is 2 p.m. on Monday.", "eNAV feeds stopped?", "Yes, they did."]),
        ("See nav.4.html for v1.2. Then stop", ["See nav.4.html for v1.2.", "Then stop"]),
        ("Seit dem 24. Juli 2024 ist er da. Gut!", ["Seit dem 24. Juli 2024 ist er da.", "Gut!"]),
        ("公司写道：“成本下降了。收益没有。”下一句。", ["公司写道：“成本下降了。收益没有。”", "下一句。"]),
        ("会社は「下がりました。いません。」と述べました。次です。", ["会社は「下がりました。いません。」と述べました。", "次です。"]),
        ("डॉ. राम आए। ठीक है।", ["डॉ. राम आए।", "ठीक है।"]),
        ("ค่าใช้จ่าย 1% ต่อปี ผู้จัดการดูแล", ["ค่าใช้จ่าย 1% ต่อปี", "ผู้จัดการดูแล"]),
        ("« Ça baisse ! » écrit la maison. Bien.", ["« Ça baisse ! » écrit la maison.", "Bien."]),
        ("Home > Funds / Help »", ["Home > Funds / Help »"]),
        ("What a year!!", ["What a year!!"]),
    ],
)
def test_sentence_units(line, units):
    at, got = 0, []
    for e in sentences.ends(line, CLASSES):
        got.append(line[at:e].strip())
        at = e
    assert got == units


@pytest.mark.parametrize(
    ("line", "units"),
    [
        ("They chose Plan B. The fund grew by 2%.", ["They chose Plan B.", "The fund grew by 2%."]),
        ("They got an A. Then it rose.", ["They got an A.", "Then it rose."]),
        ("Plan B. Buyers came, and more buyers left.", ["Plan B.", "Buyers came, and more buyers left."]),
        ("The note by A. K. Roe is out.", ["The note by A. K. Roe is out."]),
        ("The desk of J. Then was full.", ["The desk of J.", "Then was full."]),
        ("A. Thenmere left Plan C. Thenmere came back.", ["A. Thenmere left Plan C. Thenmere came back."]),
    ],
)
def test_sentence_initials(line, units):
    """A single letter ends a unit before a word that is no name: the corpus ("s") or the line itself writes it small."""
    at, got = 0, []
    for e in sentences.ends(line, {**CLASSES, "The": "s", "Then": "s"}):
        got.append(line[at:e].strip())
        at = e
    assert got == units


def test_sentence_names_from_corpus(spark):
    """Which words behind single letters are no names is told by the counts of all texts; names stay with their initial."""
    common = [(f"c{i}", f"d{i}", None, "In the end it fell, and then the rest fell.") for i in range(6)]
    rows = [("k", "x", None, "They chose Plan B. The fund grew.\nWe met A. Roe there."), ("j", "y", None, "We met A. Roe again."), *common]
    got = {}
    for r in sentences.sentence_ends(chunks(spark, rows)).collect():
        got.setdefault(r[0], set()).add(r[1])
    assert got["k"] == {18, 33, 54} and got["j"] == {20}


def test_long_abbreviations_count():
    """Abbreviations of more than ten letters are counted and looked up whole."""
    import pandas as pd

    out = next(sentences._count(iter([pd.DataFrame({"doc_id": ["d"], "text": ["The Rechtsanwaltsges. and the Rechtsanwaltsges., too. Rechtsanwaltsgesellschaft is a word."]})])))
    found = {r.token: (r.went_on, r.bare) for r in out.itertuples()}
    assert found["Rechtsanwaltsges"] == (2, 0) and found["Rechtsanwaltsgesellschaft"] == (0, 1)
    line = "Die Rechtsanwaltsges. Meier kam."
    assert sentences.ends(line, {"Rechtsanwaltsges": "n"}) == [len(line)]


def test_sentences_table(spark):
    base = [(f"k{i}", f"d{i % 3}", None, f"Dr. Name{chr(97 + i)} met us, e.g. today. Net worth grew, says Acme Ltd. today.\nShort Acme Ltd.\nDr. Other{chr(97 + i)} left.") for i in range(20)]
    odd = [("e", "d0", None, ""), ("n", "d0", None, None), ("w", None, None, " \n \n"), ("l", "d1", None, "word. " * 50_000 + "End."), base[0]]
    df = chunks(spark, base + odd)
    got = {}
    for r in sentences.sentence_ends(df).collect():
        got.setdefault(r[0], set()).add(r[1])
    text = base[0][3]
    first = text.index("today.") + 6
    assert got["k0"] == {first, text.index("\n"), text.index("Ltd.\n") + 4 if False else text.rindex("\nDr."), len(text)}
    assert "e" not in got and "n" not in got and "w" not in got
    assert max(got["l"]) == len(odd[3][3])
    parts = {(r["chunk_id"], r["unit"]): r["sentence"] for r in sentences.sentences(df.where("chunk_id = 'k0'")).collect()}
    assert parts["k0", 1].startswith("Dr. Namea met us") and len(parts) == 4
    assert sentences.sentence_ends(df.where("false")).count() == 0


# --- problem 4 -----------------------------------------------------------------------------------


def test_main_content(spark):
    body = "The risk grade of Acme Long Horizon Fund Direct is Very High. Stamp duty of 0.5% is taken from each purchase of the fund."
    page = f"Skip to main content\nHome | Blog | Sitemap | Glossary | Help\n{body}\nShare this page from Acme: copy link, mail, message\nAcme Foods Ltd. | Metals | 1.5%"
    rows = [("a", "d", None, page), ("a", "d", None, page), ("e", "d", None, ""), ("n", "d", None, None), ("b", "d", None, " \n "), ("l", "d", None, "\n".join([body] * 20_000))]
    df = chunks(spark, rows)
    got = {(r[0], r[1]) for r in main_content.furniture(df).collect()}
    assert {n for c, n in got if c == "a"} == {1, 2, 4}
    assert not {c for c, _ in got} & {"e", "n", "b", "l"}
    kept = {r["chunk_id"]: r["text"] for r in main_content.main_body(df).collect()}
    assert kept["a"] == "\n".join(page.split("\n")[i] for i in (2, 4))
    assert main_content.furniture(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "body"),
    [
        ("The city council met on Tuesday. It voted to close the old bridge for repairs next year.\nResidents said they had not been told.\nThe work will cost 3.2 million and take eight months.", [1, 2, 3]),
        ("Tomato soup\nCut two onions and fry them in butter until soft.\nAdd 500 g of tomatoes and a litre of stock.\nSimmer for twenty minutes, then blend.\nServe with bread.", [1, 2, 3, 4, 5]),
        ("Home | News | Sport | Weather | Travel | Video\nThe Eiffel Tower is a lattice tower in Paris. It was built from 1887 to 1889.\nIt is 330 metres tall and the most visited paid monument in the world.\nShare this page\n© 2024 All rights reserved", [2, 3]),
        ("Dr. Mary Holt joined the clinic in Leeds in 2011 and now leads its heart unit.\nShe trained in Glasgow, where she also taught for six years.\nRead next: ten tips for a healthy heart\nShare this page with a friend", [1, 2]),
    ],
)
def test_main_content_of_other_pages(page, body):
    """Pages that are not about funds keep their body."""
    assert main_content.label_lines([page], urls=["https://news.example/2024/06/some-other-story"])[0][0] == body


def test_main_content_model_knows_no_brand():
    """No word of the model is a brand of the pages it was trained on: each occurs on several sites."""
    known = set(main_content.Model.load().vocabulary)
    assert known and not known & {"gavrane", "keshtova", "niksella", "thovdor", "shunbria", "gathdor", "troldal", "krathdor"}


def test_main_content_subject():
    assert main_content.subject("https://a.example/schemes/Blue-Harbour-fund/?x=1") == "blue harbour fund"
    assert [main_content.subject(u) for u in (None, "", "https://a.example", "https://a.example/fund", "x/tomato-soup.html")] == ["", "", "", "", "tomato soup"]


def test_main_content_takes_url_of_document(spark):
    """A row without URL is read with the URL of its document's other rows; without any it has no subject."""
    row = "About Nordic Vale Pebble Fund"
    df = chunks(spark, [("a", "d", "https://s.example/x/nordic-vale-pebble-fund", "Costs of Nordic Vale Pebble Fund fell by 2%."), ("b", "d", None, row), ("c", "e", None, row), ("d", None, None, row)])
    got = {r[0]: r[1] for r in main_content.main_body(df).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["b"] == row


def test_decoding_has_no_contradiction():
    import numpy as np

    assert main_content.decode(np.array([5.0, 4.0, -0.2, 6.0])).all()
    assert not main_content.decode(np.array([-5.0, 0.1, -4.0])).any()
    assert main_content.decode(np.array([5.0, 5.0, -5.0, -5.0])).tolist() == [True, True, False, False]


def test_trees_learn():
    import numpy as np

    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (4000, 12)).astype(np.uint8)
    y = ((x[:, 0] & x[:, 3]) | x[:, 7]).astype(float)
    t = main_content.Trees.fit(x[:3000], y[:3000], n=30)
    assert ((t.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.99


# --- problem 6 -----------------------------------------------------------------------------------


def test_packing(spark):
    rnd = random.Random(5)
    docs = [(i, "word " * rnd.choice([1, 3, 20, 50, 90, 130])) for i in range(300)] + [(1000, None), (1001, ""), (1002, "word " * 1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.lit(1))
    caps = spark.createDataFrame([("s", 128), ("m", 256), ("m", 256)], "container_kind string, capacity_tokens int")
    out = packing.pack(df, caps).collect()
    size = {r[0]: r[1] for r in packing.token_counts(df).collect()}
    for kind, cap in (("s", 128), ("m", 256)):
        rows = [r for r in out if r["container_kind"] == kind]
        fill, whole, pieces = {}, {}, {}
        for r in rows:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
            whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["tokens"]
            pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + 1
        assert max(fill.values()) <= cap
        assert whole == {d: n for d, n in size.items() if n}
        assert all(n == -(-size[d] // cap) for d, n in pieces.items())
        assert len(fill) <= 1.1 * packing.lower_bound([r["tokens"] for r in rows], cap) + 1
    assert packing.pack(df.where("false"), caps).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([("s", 0)], "container_kind string, capacity_tokens int"))


def test_packing_certificate(spark):
    """Full containers and those of partitions that meet their bound are certified; one that misses it is not."""
    docs = [(i, "word " * 64) for i in range(8)] + [(10 + i, "word " * 43) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    caps = spark.createDataFrame([("full", 128), ("loose", 100)], "container_kind string, capacity_tokens int")
    size = {r[0]: r[1] for r in packing.token_counts(df).collect()}
    rows = packing.pack(df, caps).collect()
    for kind, cap in (("full", 128), ("loose", 100)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert {r["doc_id"] for r in mine} == set(size)
        bound = packing.lower_bound(list(size.values()), cap)
        if len({r["container_id"] for r in mine}) == bound:
            assert all(r["certified"] for r in mine)
    assert any(r["certified"] for r in rows)


def test_lower_bound_is_one():
    def best(items, cap):
        if not items:
            return 0
        found = [len(items)]

        def go(rest, bins):
            if len(bins) >= found[0]:
                return
            if not rest:
                found[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + rest[0] <= cap:
                    bins[i] += rest[0]
                    go(rest[1:], bins)
                    bins[i] -= rest[0]
            go(rest[1:], [*bins, rest[0]])

        go(sorted(items, reverse=True), [])
        return found[0]

    rnd = random.Random(2)
    for _ in range(150):
        cap = rnd.randint(5, 30)
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 8))]
        least = best(items, cap)
        assert packing.lower_bound(items, cap) <= least <= len(packing.best_fit_decreasing([(t, i, 0) for i, t in enumerate(items)], cap))


# --- problem 7 -----------------------------------------------------------------------------------


def brute_leaks(docs, items):
    grams = {}
    for i, *parts in items:
        for t in parts:
            w = leakage.words(t)
            for a in range(len(w) - 11):
                grams.setdefault(tuple(w[a : a + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for a in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[a : a + 12]), ())}
    return out


def test_leaks(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "née", "naïve"]

    def some(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(some(rnd.randint(8, 30))), " ".join(some(rnd.randint(12, 60)))) for i in range(30)] + [(98, None, ""), (99, None, "one two")]
    items.append((77, items[0][1], items[0][2]))
    docs = []
    for d in range(200):
        w = some(rnd.randint(0, 80))
        if d % 2:
            source = leakage.words(items[rnd.randrange(30)][2])
            a, n = rnd.randrange(max(1, len(source) - 11)), rnd.randint(9, 16)
            piece = source[a : a + n]
            if d % 6 == 1 and len(piece) > 6:
                piece[len(piece) // 2] = "changed"
            w[len(w) // 2 : len(w) // 2] = [x.upper() if d % 4 == 1 else x[:1] + "​" + x[1:] for x in piece]
        docs.append((d, " — ".join(w) if d % 5 == 0 else "  ".join(w)))
    docs += [(500, None), (501, ""), (502, items[3][2] + " " + "filler " * 30_000), (503, items[3][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit(0))
    it = spark.createDataFrame(items, "item_id long, query string, expected string")
    got = {(r[0], r[1]) for r in leakage.leaks(df, it).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 20
    assert leakage.leaks(df, it.where("false")).count() == 0 and leakage.leaks(df.where("false"), it).count() == 0


def test_edited_leaks(spark):
    """A part with words changed, left out or put in is reported up to its budget, against a plain edit distance."""
    rnd = random.Random(21)
    vocabulary = [f"t{i}" for i in range(400)]

    def least_distance(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            old, row = row, [i]
            for j, y in enumerate(t, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
        return min(row)

    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(12, 40))), None) for i in range(20)]
    docs, want = [], {}
    for d in range(120):
        i = rnd.randrange(20)
        w = items[i][1].split()
        for _ in range(rnd.randint(0, 9)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], ["new"], [w[k], "new"]])
        text = [rnd.choice(vocabulary) for _ in range(15)] + w + [rnd.choice(vocabulary) for _ in range(15)]
        docs.append((d, " ".join(text)))
        for n, t, _ in items:
            p = t.split()
            k = least_distance(p, text)
            if k <= leakage.budget(len(p), leakage.EDITS):
                want[d, n] = k
    docs.append((900, "The yearly costs of this fund are paid by all who hold its units on the last day of the changed month, says the note."))
    items.append((50, "the yearly costs of this fund are paid by all who hold its units on the last day of the month", None))
    want[900, 50] = 1
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, query string, expected string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in leakage.leaks(df, it, edits=leakage.EDITS).collect() if r["distance"] <= leakage.budget(r["part_words"], leakage.EDITS)}
    assert got == want and len({k for k in want.values()}) > 3


def test_myers():
    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    rnd = random.Random(1)
    for _ in range(1000):
        p, t = rnd.choices("abcd", k=rnd.randint(1, 9)), rnd.choices("abcd", k=rnd.randint(0, 20))
        assert leakage.myers(p, t) == brute(p, t)


# --- problem 8 -----------------------------------------------------------------------------------

SAID = {
    "en": ["The costs of the fund fell by two points this year.", "Investors share the desk with two other plans.", "Is the plan open to new buyers?", "Orders must arrive before noon on a working day."],
    "de": ["Die Kosten des Fonds sinken in diesem Jahr deutlich.", "Das Vermögen wuchs auf rund drei Millionen.", "Kann man schon ab hundert Rupien im Monat kaufen?", "Der größte Posten ist weiterhin eine Bank."],
    "fr": ["Les frais du fonds baissent cette année encore.", "La première ligne reste une banque du pays.", "Peut-on acheter à partir de cent roupies par mois ?", "Le risque est jugé très élevé par la maison."],
    "hi": ["इस योजना की लागत घटी है।", "क्या इसमें हर महीने पैसा लगाया जा सकता है?", "जोखिम बहुत अधिक माना गया है।", "निवेशकों की संख्या भी बढ़ी।"],
    "th": ["ความเสี่ยงอยู่ในระดับสูงมาก", "ผู้จัดการดูแลมาหลายปีแล้ว", "บริษัทไม่ได้เปลี่ยนกฎในปีนี้", "สินทรัพย์เพิ่มขึ้นในปีที่แล้ว"],
}


def test_language(spark):
    rnd = random.Random(4)
    names = {"en": "English", "de": "German", "fr": "French", "hi": "Hindi", "th": "Thai"}
    alt = {"en": "eng", "de": "deu", "fr": "fra", "hi": "hin", "th": "tha"}
    codes = spark.createDataFrame([(k, names[k], alt[k]) for k in SAID], "lang_code string, lang_name string, alt_code string")
    rows, want = [], set()
    for i in range(200):
        k = rnd.choice(list(SAID))
        text = "\n".join(["Acme Long Horizon Fund Direct", *rnd.choices(SAID[k], k=rnd.randint(3, 6))])
        label = rnd.choice([k, f" {k.upper()}", names[k], alt[k], f"{k}-XX"])
        if i % 10 == 0:
            label = rnd.choice([None, " ", "und"])
            want.add((i, k))
        elif i % 10 == 1:
            label = rnd.choice([x for x in SAID if x != k])
            want.add((i, k))
        elif i % 10 == 2:
            other = rnd.choice([x for x in SAID if x != k])
            text += "\n" + "\n".join(SAID[other][:2])
            want |= {(i, k), (i, other)}
        rows.append((i, text, label))
    rows += [(900, None, "en"), (901, "", None), (902, "12 34", None), (903, "\n".join(SAID["en"] * 3000), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))
    found = language.segments(docs, codes)
    got = {(r[0], r[1]) for r in language.mislabelled(found).collect()}
    assert got == want
    sure = language.languages(found.where("doc_id < 200")).agg(F.min("confidence")).first()[0]
    assert sure > 0.9
    assert language.mislabelled(language.segments(docs.where("false"), codes)).count() == 0


def test_every_unit_and_document(spark):
    codes = spark.createDataFrame([(k, k, k) for k in SAID], "lang_code string, lang_name string, alt_code string")
    rows = [(i, "\n".join(SAID[k]), k) for i, k in enumerate(SAID)]
    rows += [(50, SAID["en"][0] + "\nFees\n12 34", "en"), (51, "Costs of the fund this year\nOrders before noon on a working day", None), (52, None, "en"), (53, "", None), (54, "12 34", None), (55, "Fees", "en")]
    found = language.segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"), codes)
    units = {}
    for r in language.listed(found).orderBy("doc_id", "start_pos").collect():
        units.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"], r["lang"], r["confidence"] is not None))
    n = len(SAID["en"][0])
    assert units[50] == [(1, n, "en", True), (n + 2, n + 5, "en", True), (n + 7, n + 11, None, False)]
    assert [u[2] for u in units[51]] == ["en", "en"] and units[54] == [(1, 5, None, False)] and units[55] == [(1, 4, None, False)] and not {52, 53} & set(units)
    got = {r["doc_id"]: r for r in language.languages(found).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got[50]["sentences"] == 1 and got[50]["share"] == 1 and got[51]["lang"] == "en" and got[51]["sentences"] == 0
    assert all(got[i]["lang"] is None and got[i]["sentences"] == 0 for i in (52, 53, 54, 55))


def test_mixture():
    import numpy as np

    chosen, share, post = language.mixture(np.array([[-10.0, -50.0, -60.0], [-12.0, -60.0, -70.0], [-80.0, -20.0, -90.0]]))
    assert sorted(chosen) == [0, 1] and abs(share.sum() - 1) < 1e-6 and post.max(axis=1).min() > 0.99
    assert language.mixture(np.array([[-10.0, -11.0]]))[0] == [0]
