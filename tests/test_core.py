from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.functions import dictionaries as D
from factlake.functions import text, vectors
from factlake.operators import answer, audit, bm25, ingest, query, retrieve, units
from factlake.plans import pipeline
from factlake.sources import readers, sinks
from factlake.streaming import streams


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


# --- text ----------------------------------------------------------------------------------------


def test_cleaning(spark):
    assert one(spark, ["10,24,916", "1,00,000", "5,10 and 15,20", "5919.47", "1,2,102", None], text.plain_numbers) == ["1024916", "100000", "510 and 1520", "5919.47", "12102", None]
    assert one(spark, ["18 Jul 2025", "on 2025-07-18.", "18 Foo 2025", "31 February 2024", "", None], text.iso_date) == ["2025-07-18", "2025-07-18", None, "2024-02-31", None, None]
    assert one(spark, ["0.22", "0.22%", "Exit load of 1%"], text.percent) == ["0.22%", "0.22%", "Exit load of 1%"]
    assert one(spark, ["$5 £6 €7 ₹8", ""], text.rupee_sign) == ["₹5 ₹6 ₹7 ₹8", ""]
    assert one(spark, [" a \t b\n\n c ", ""], text.collapse) == ["a b c", ""]
    assert one(spark, ["&eacute;&nbsp;&#8377;", None], text.unescape) == ["é\xa0₹", None]
    assert one(spark, ["ﬁ ①"], text.nfkc) == ["fi 1"]
    page = "<html><head><style>x</style></head><nav>Menu</nav><p>A &lt; B</p><!-- c --><p> </p><footer>F</footer></html>"
    assert one(spark, [page], text.visible_text) == ["A < B"]


def comma_free(s):
    s = re.sub(r"\d{1,3}(?:,\d{3})+", lambda m: m[0].replace(",", ""), s)
    return re.sub(r"\d{1,3}(?:,\d{2,3})+", lambda m: m[0].replace(",", ""), s)


def test_numbers_property(spark):
    rnd = random.Random(1)
    values = ["".join(rnd.choice("0123456789,. ") for _ in range(12)) for _ in range(800)]
    assert one(spark, values, text.plain_numbers) == [comma_free(v) for v in values]


def test_rejections(spark):
    rows = [("expense_ratio", "abc"), ("expense_ratio", "%"), ("nav", "38.34"), ("nav", " "), ("inception_date", "x"), ("nav", "₹5"), ("other", "x"), ("nav", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v string")
    got = [r[0] for r in df.select("i", text.rejection(F.col("t"), F.col("v")).alias("r")).orderBy("i").select("r").collect()]
    assert got == ["Percentage enforcement failed: missing %", "No numeric value found", "Currency enforcement failed: missing ₹", "Empty value after normalization", "Date enforcement failed: not YYYY-MM-DD", None, None, "Empty value after normalization"]
    typed = df.select("i", text.typed_value(F.col("t"), F.col("v")).alias("r")).orderBy("i").select("r").collect()
    assert [r[0] for r in typed][2] == "₹38.34"


def test_extraction(spark):
    page = "Acme\nNAV: as of today ₹5,919.47\nFund size (AUM) ₹12.5 Cr\nMinimum SIP ₹500\nExpense ratio: 0.22%\nExit load of 1%, if redeemed within 1 year. Ok\nBenchmark NIFTY 50 Rank 1\n"
    facts = {f["fact_type"]: f for f in one(spark, [page, "", None], text.extract_facts)[0]}
    assert facts["nav"]["value"] == "₹5,919.47" and facts["aum"]["value"] == "₹12.5 Cr" and facts["expense_ratio"]["value"] == "0.22%"
    assert facts["exit_load"]["value"] == "Exit load of 1%, if redeemed within 1 year" and facts["benchmark"]["value"] == "NIFTY 50"
    assert facts["min_sip"]["confidence"] == "HIGH"
    df = spark.createDataFrame([("d", "u", f"<p>{page}</p>"), ("e", "u", ""), ("n", "u", None)], "doc_id string, source_url string, html string")
    got = {r["doc_id"]: r["extraction_success"] for r in ingest.extract(df).collect()}
    assert got == {"d": True, "e": False, "n": False}


def py_tokenize(t):
    t = re.sub(r"(\w+)\.", lambda m: m[1].lower() + "\0" if m[1].lower() in D.ABBREVIATIONS else m[0], t)
    return [s for s in (x.replace("\0", ".").strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t)) if s]


def py_chunks(sents, most):
    """Independent statement of the chunk rules: a list machine."""
    out, cur, kind = [], [], "overview"

    def n(x):
        return len(x.split())

    for s, t in sents:
        if n(s) > most:
            if cur:
                out.append((" ".join(cur), kind))
            w = s.split()
            out += [(" ".join(w[i : i + most]), t) for i in range(0, len(w), most)]
            cur, kind = [], t
        elif cur and n(" ".join([*cur, s])) > most:
            out.append((" ".join(cur), kind))
            if n(cur[-1]) + n(s) > most:
                out.append((cur[-1], kind))
                cur = [s]
            else:
                cur = [cur[-1], s]
            kind = t
        else:
            cur.append(s)
            kind = t if t != "overview" else kind
    return out + ([(" ".join(cur), kind)] if cur else [])


def test_tokenizer_and_chunks(spark):
    assert one(spark, ["Acme Ltd. Is big. NAV. Rose 5%! Ok?"], text.tokenize) == [["Acme ltd. Is big. nav. Rose 5%!", "Ok?"]]
    assert one(spark, ["It is 1.34%. Mr. X. ok? e.g. yes! done"], text.answer_sentences) == [["It is 1.34%.", "Mr. X.", "ok?", "e.g. yes!", "done"]]
    rnd = random.Random(7)
    vocabulary = ["fund", "Holdings", "Dr.", "étude", "exit", "load.", "Expense", "ratio", "Big.", "why?", "The", "cap!", "sitemap", "x"]
    docs = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(150)] + ["", "a " * 70]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(999, None)], "doc_id long, text string")
    got: dict = {}
    for r in ingest.chunked(df, most=8).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["chunk_type"]))
        assert r["token_count"] == len(r["text"].split()) and r["overlap"] == (r["idx"] > 0) and r["token_count"] <= 8

    def kind(s):
        low = s.lower()
        return next((k for k, ps in D.CHUNK_TYPES if any(p in low for p in ps)), "overview")

    def noise(s):
        low = s.lower()
        return not any(p in low for p in D.PROTECTED) and any(p in low for p in D.NOISE)

    for i, d in enumerate(docs):
        assert got.get(i, []) == py_chunks([(s, kind(s)) for s in py_tokenize(d) if not noise(s)], 8), d
    again = ingest.chunked(df, most=8).select("chunk_id").exceptAll(ingest.chunked(df, most=8).select("chunk_id"))
    assert again.count() == 0
    m = {r["doc_id"]: r["error"] for r in ingest.chunk_manifest(df).collect()}
    assert m[999] == "CORPUS_EMPTY"


# --- vectors and retrieval ------------------------------------------------------------------------


def test_vectors(spark):
    v = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [0.6, 0.8]]
    assert one(spark, v, lambda c: vectors.validity(c, 2), "array<float>") == ["norm", "zero", "nan", "inf", "dimension", None]
    assert one(spark, v[:2], vectors.l2_normalize, "array<float>")[1] == [0.0, 0.0]
    assert one(spark, [[1.0, 2.0]], lambda c: vectors.align(c, 4), "array<float>") == [[1.0, 2.0, 0.0, 0.0]]
    e = one(spark, [["a", "b", "a"], [], None], lambda c: vectors.hashed_embedding(c, 8), "array<string>")
    assert abs(sum(x * x for x in e[0]) - 1) < 1e-6 and not any(e[1])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = audit.integrity(df, 2).first().asDict()
    assert got == {"total": 6, "dimension_bad": 1, "nan_bad": 1, "inf_bad": 1, "zero_bad": 1, "norm_bad": 1}


def test_dense_search(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in retrieve.dense_top_k(df, df.where("vec_id in (0, 100, 200)"), 7).collect()}
    for q in (0, 100, 200):
        want = sorted(((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows[:300]))[:7]
        assert [i for _, i in want] == sorted((v for k, v in got if k == q), key=lambda v: got[q, v])
    assert retrieve.dense_top_k(df, df.where("false")).count() == 0


def test_bm25(spark):
    docs = ["the fund rose", "the fund fell and the fund rose", "no fees", "", "costs of the fund", None, "naïve étude"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Fund fund fees"), (2, "étude"), (3, "zzz"), (4, None)], "query_id long, q string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.scores(df, "doc_id", "text", q, "query_id", "q").collect()}
    bags = {i: re.findall(r"\w+", d.lower()) for i, d in enumerate(docs) if d}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    df_ = Counter(t for b in bags.values() for t in set(b))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df_.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else floor for t, x in idf.items()}
    for qi, text_ in ((1, "fund fund fees"), (2, "étude")):
        for i, b in bags.items():
            s = sum(idf.get(t, 0) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for t in text_.split())
            assert got.get((qi, i), 0) == pytest.approx(s, abs=1e-9)
    assert not [k for k in got if k[0] > 2]


def test_fusion(spark):
    d = spark.createDataFrame([(1, 10, 1, 0.8), (1, 11, 2, 0.7), (1, 12, 3, 0.9)], "query_id long, id long, rank int, score double")
    s = spark.createDataFrame([(1, 11, 1, 4.0), (1, 13, 2, 2.0)], "query_id long, id long, rank int, score double")
    x = spark.createDataFrame([(1, 14)], "query_id long, id long")
    got = {r["id"]: r for r in retrieve.fuse(d, s, x).collect()}
    assert got[11]["rrf"] == pytest.approx(1 / 62 + 1 / 61) and got[11]["rank"] == 1 and got[11]["similarity"] == 0.7 and got[11]["retriever"] == "dense+bm25"
    assert got[13]["similarity"] == 0.825 and got[14]["similarity"] == 1.0 and got[14]["rrf"] == pytest.approx(1 / 61)
    kept = [(r["id"], r["rank"]) for r in retrieve.relevant(retrieve.fuse(d, s, x)).orderBy("rank").collect()]
    assert kept == [(14, 1), (12, 2), (13, 3), (10, 4)]
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a")], "query_id long, rank int, source string")
    assert retrieve.single_source(c, "source").count() == 2


# --- questions and answers ------------------------------------------------------------------------


def test_questions(spark):
    got = one(spark, ["My PAN is ABCDE1234F", "My PAN is ABCD1234E, what?", "aadhaar 1234 5678 9012", "Call 9876543210", "OTP is 123456", "a.b@c.in", None], query.personal_data)
    assert got[:6] == [["PAN"], [], ["AADHAAR"], ["ACCOUNT_NUMBER", "PHONE"], [], ["EMAIL"]]
    got = one(spark, ["Should I invest in the Small Cap Fund?", "What is the expense ratio of the Small Cap Fund?", "Funds", "see https://x.example/a?b=1 now"], query.intent)
    assert [r["classification"] for r in got] == ["ADVISORY", "FACTUAL", "UNCLEAR", "URL_ADDITION"] and got[0]["advisory_score"] == 1.0 and got[3]["url"] == "https://x.example/a?b=1"
    assert one(spark, ["Expense ratio of the Small Cap Fund?"], query.normalize_terms) == ["total expense ratio ratio of the small cap fund"]
    assert one(spark, ["what is the total aum", "the risk level", "hello"], query.fact_type) == ["total_aum", "risk_level", None]
    assert one(spark, ["  " + "x" * 300], query.sanitize) == ["x" * 200]


def test_funds(spark):
    docs = spark.createDataFrame([("D1", "https://a.example/acme-small-cap-fund-direct-growth"), ("D2", "https://a.example/acme-small-cap/"), ("D3", "https://a.example/zed-gold"), ("D4", None)], "doc_id string, source_url string")
    named = query.aliases(docs)
    assert {r["alias"]: r["doc_id"] for r in named.collect()} == {"acme small cap fund": "D1", "acme small cap": "D2", "zed gold": "D3"}
    q = spark.createDataFrame([(1, "Is Zed Gold like Acme Small Cap Fund or ACME small cap?"), (2, "acme"), (3, "")], "query_id long, query string")
    got = {r["query_id"]: r["doc_ids"] for r in query.find_funds(q, named).collect()}
    # the shorter alias lies inside the longer one at its first occurrence
    assert got == {1: ["D1", "D3"]}


def _stages(spark):
    """Rows that each stage has shuffled, by the stage's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_funds_shuffle_only_runs_that_may_be_names(spark):
    named = spark.createDataFrame([("acme small cap", "D1"), ("acme gold of the far north east", "D2")], "alias string, doc_id string")
    text = "word other thing " * 1000 + "acme small cap " * 500 + "acme gold of the far north west"
    q = spark.createDataFrame([(i, text) for i in range(4)], "query_id long, query string")
    before = max(_stages(spark), default=-1)
    assert {r["query_id"]: r["doc_ids"] for r in query.find_funds(q, named).collect()} == {i: ["D1"] for i in range(4)}
    # these texts have about 126 000 runs of up to seven words
    assert 0 < sum(rows for stage, rows in _stages(spark).items() if stage > before) < 100


def test_funds_match_brute_force(spark, monkeypatch):
    def brute(texts, names):
        first = {}
        for text in texts:
            if text is not None:
                w = re.sub(r"\W+", " ", text.lower()).strip(" ").split(" ")
                for at in range(len(w)):
                    for n in range(1, len(w) - at + 1):
                        if (run := " ".join(w[at : at + n])) in names:
                            first[run] = min(first.get(run, at), at)
        kept, ids = [], []
        for run, at in sorted(first.items(), key=lambda x: (-len(x[0]), x[1])):
            end = at + len(run.split(" "))
            if not any(a <= at and end <= e for a, e in kept):
                kept.append((at, end))
                ids.append(names[run])
        return list(dict.fromkeys(ids))

    pick = random.Random(7)
    vocab = ["acme", "zed", "gold", "cap", "fond", "größe", "基金", "a_b", "7", "ñu"]
    names = {" ".join(pick.choices(vocab, k=pick.randint(1, 5))): f"D{i % 25}" for i in range(40)} | {" ".join(["acme"] * 30): "LONG", "gold-cap": "NEVER"}
    rows = [(i, pick.choice(["", " ", "... "]) + pick.choice([" ", ", ", "\n", "\u00a0"]).join(pick.choices([*vocab, "Acme", "GOLD", "x"], k=pick.randint(0, 25))) + pick.choice(["", "!", " "])) for i in range(60)]
    rows += [(1, "again Gold gold cap"), (2, None), (60, None), (61, ""), (62, "acme " * 40)]
    want = {i: got for i in {i for i, _ in rows} if (got := brute([t for k, t in rows if k == i], names))}
    q, named = spark.createDataFrame(rows, "query_id long, query string"), spark.createDataFrame(list(names.items()), "alias string, doc_id string")
    assert {r["query_id"]: r["doc_ids"] for r in query.find_funds(q, named).collect()} == want
    # texts split in small pieces, and bits so crowded that all runs pass
    monkeypatch.setattr(query, "_PART", 50)
    monkeypatch.setattr(query, "_name_bits", lambda names: (np.full(1 << 12, 255, "uint8"), 15))
    assert {r["query_id"]: r["doc_ids"] for r in query.find_funds(q, named).collect()} == want
    assert query.find_funds(q, named.limit(0)).collect() == []
    assert query.find_funds(q.limit(0), named).collect() == []


def test_answers(spark):
    assert one(spark, ["You SHOULD buy now, a safe bet", "fine"], answer.banned) == [["you should", "safe bet", "buy now"], []]
    df = spark.createDataFrame([("NAV is 10.92 as of 2026-05-06", "10.92 on 2026")], "a string, c string")
    assert df.select(answer.untraceable_numbers(F.col("a"), F.col("c"))).first()[0] == ["05", "06"]
    assert one(spark, ["A. B. C. D."], answer.first_sentences) == ["A. B. C."]
    assert one(spark, ["See https://a.b/c?d=1."], answer.linked) == ["See [https://a.b/c?d=1](https://a.b/c?d=1)."]
    assert one(spark, ["<a & 'b'>"], answer.escaped) == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    c = spark.createDataFrame([(1, 1, "one two three."), (1, 2, "four five. six seven eight"), (1, 3, "never"), (2, 1, None)], "query_id long, rank int, text string")
    got = answer.context(c, F.lit("X"), budget=9).collect()
    assert [r["context"] for r in got] == ["Information for X:\none two three. four five."]


def test_context_budget_takes_all_short_texts(spark, tmp_path):
    from factlake import catalog

    spark.createDataFrame([(i, "s", f"w{i}.") for i in range(100)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.context_budget(spark, str(tmp_path)).collect()
    assert len(got) == 1 and "w0." in got[0]["context"] and got[0]["context"].endswith("w99.")


def test_pipeline(spark):
    chunks = spark.createDataFrame([("c1", "D1", "https://a.example/acme-gold-fund", "The NAV of Acme Gold is ₹10.5 today. It rose."), ("c2", "D2", "https://a.example/zed-cap", "Zed holds bank stocks.")], "chunk_id string, doc_id string, source_url string, text string")
    facts = spark.createDataFrame([(1, "D1", "https://a.example/acme-gold-fund", "nav", "₹10.5", "HIGH", "x")], "id long, doc_id string, source_url string, fact_type string, value string, confidence string, indexed_at string")
    q = spark.createDataFrame([(1, "What is the NAV of Acme Gold Fund?"), (2, "Should I buy?"), (3, "PAN ABCDE1234F nav"), (4, "tell me about xyz")], "query_id long, query string")
    got = {r["query_id"]: r for r in pipeline.answers(q, chunks, facts, "2026-06-01").collect()}
    assert got[1]["status"] == "APPROVED" and "₹10.5" in got[1]["response"] and got[1]["response"].endswith("2026-06-01")
    assert [got[i]["status"] for i in (2, 3, 4)] == ["ADVISORY", "PERSONAL_DATA", "UNKNOWN"]


# --- sources, sinks, audit, streams -----------------------------------------------------------------


def test_hybrid(spark):
    chunks = [("c1", "D1", "acme gold fund nav today"), ("c2", "D2", "what is the nav of acme gold fund"), ("c3", "D1", "risk"), ("c4", "D3", "bank stocks held"), ("c5", "D3", "unrelated")]
    c = spark.createDataFrame([(i, d, f"https://a.example/{d}", t) for i, d, t in chunks], "chunk_id string, doc_id string, source_url string, text string")
    facts = spark.createDataFrame([(1, "D1", "https://a.example/acme-gold-fund", "nav", "10.5"), (2, "D3", "https://a.example/zed-cap", "nav", "1")], "id long, doc_id string, source_url string, fact_type string, value string")
    q = spark.createDataFrame([(1, "What is the NAV of Acme Gold Fund?"), (2, "bank stocks held")], "query_id long, query string")
    got = pipeline.hybrid(q, c, facts).collect()
    first = {r["query_id"]: r for r in got if r["rank"] == 1}
    # a named fund keeps other funds' chunks out, even one with the question's own words; its fact is fused
    assert {r["doc_id"] for r in got if r["query_id"] == 1} == {"D1"} and first[1]["retriever"] == "structured" and "10.5" in first[1]["text"]
    # found by vector and by words
    assert first[2]["text"] == "bank stocks held" and first[2]["retriever"] == "dense+bm25" and first[2]["similarity"] == pytest.approx(1)
    # the filter comes before the k best, so the listed rows are not crowded out
    v = spark.createDataFrame([("a", "D1", [1.0, 0.0]), ("b", "D2", [0.6, 0.8]), ("c", "D2", [0.0, 1.0])], "k string, d string, embedding array<float>")
    qv = spark.createDataFrame([(1, ["D2"], [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, ["D9"], [1.0, 0.0])], "k long, d array<string>, embedding array<float>")
    assert sorted((r["query_id"], r["k"]) for r in retrieve.dense_top_k(v, qv, 1, "k", within="d").collect()) == [(1, "b"), (2, "a")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "list.md").write_text("# Sites\n- https://a.example/x\nhttps://b.example/y\n- no\n")
    assert [(r["pos"], r["doc_id"]) for r in readers.address_list(spark, str(tmp_path / "list.md")).collect()] == [(1, "DOC-001"), (2, "DOC-002")]
    assert readers.address_list(spark, str(tmp_path / "list.md"), bare=False).count() == 1
    assert readers.address_setting(spark, "https://a, ,https://b").count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"a": ["Buy NOW"], "b": ["x", "y"]}))
    assert {tuple(r) for r in readers.phrases(spark, str(tmp_path / "p.json")).collect()} == {("a", "buy now"), ("b", "x"), ("b", "y")}
    (tmp_path / "c.jsonl").write_text('{"chunk_id":"1","text":"t"}\n\n')
    assert readers.chunk_lines(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "DOC-001.html").write_text("<p>x</p>")
    assert readers.pages(spark, str(tmp_path / "*.html")).first()["doc_id"] == "DOC-001"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert sorted(r["v"] for r in sinks.upsert(old, new, "k", "n").collect()) == ["a", "d", "e"]
    assert sorted(r["v"] for r in sinks.replace_documents(old, new, "k").collect()) == ["a", "c", "d", "e"]
    assert sorted(r["v"] for r in sinks.new_only(new, old, "k").collect()) == ["e"]
    runs = spark.createDataFrame([("r1", "2026-01-01"), ("r2", "2026-01-02")], "run_id string, activated_at string")
    assert sinks.active_run(runs).where("age = 1").first()["previous_run_id"] == "r1"
    assert sinks.retained(runs, "activated_at", "2026-01-08 12:00:00").count() == 1
    built = spark.createDataFrame([("d", "t", ["x"])], "doc_id string, text string, discarded array<string>")
    assert sinks.write_chunks(built, str(tmp_path / "out")) == 1


def test_audit(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    assert audit.digest(df, "k", "n").first() == audit.digest(df.orderBy(F.desc("k")), "k", "n").first()
    assert {r["name"]: r["failures"] for r in audit.report(df, {"n": "n > 0", "k": "k is not null"}).collect()} == {"n": 1, "k": 0}
    log = spark.createDataFrame([("u", i, s) for i, s in enumerate("fffsff")], "k string, at int, s string")
    got = sorted((r["started"], r["failures"], r["opens"]) for r in ingest.failure_runs(log, "k", "at", F.col("s") == "f", 3).collect())
    assert got == [(0, 3, True), (4, 2, False)]


def test_streams(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 10 as int)) as ts, id % 3 as user_id, 'a' as event_type, 1.0D as value, id % 2 = 0 as bad from range(60)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = streams.read(spark, str(tmp_path / "e"), rows.schema)
    w = streams.run_once(streams.windowed(streams.timed(stream), "event_type", size="1 hour"), "t_windows", str(tmp_path / "c1"))
    assert w.agg(F.sum("n")).first()[0] == 60 and w.count() == 10
    b = streams.run_once(streams.breaker(streams.timed(stream), "user_id", "bad", 2), "t_breaker", str(tmp_path / "c2"), "update")
    assert b.count() >= 3
    table = str(tmp_path / "t")
    put = streams.upsert_into(table, "event_id", "ts")
    put(rows, 0)
    put(rows.where("event_id < 5").withColumn("value", F.lit(9.0)), 1)
    put(rows.where("event_id < 5").withColumn("value", F.lit(9.0)), 1)
    assert spark.read.parquet(f"{table}/version=1").agg(F.sum("value")).first()[0] == 55 + 45


def test_breaker_states(spark, tmp_path):
    """Opens after failures in a row, refuses within the timeout, tries half open behind it."""
    calls = [("a", 0, True), ("a", 10, True), ("a", 20, False), ("a", 400, False), ("b", 0, True), ("b", 10, True), ("b", 350, True), ("b", 360, False), ("c", 0, True), ("c", 1, False), ("c", 2, True)]
    rows = spark.createDataFrame([(i, k, t, f) for i, (k, t, f) in enumerate(calls)], "i long, user_id string, t int, bad boolean")
    rows = rows.selectExpr("i", "user_id", "cast(timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) as timestamp_ntz) as ts", "bad")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = streams.timed(streams.read(spark, str(tmp_path / "e"), rows.schema))
    b = streams.run_once(streams.breaker(stream, "user_id", "bad", 2), "breaker", str(tmp_path / "c"), "update")
    got = {r["user_id"]: (r["state"], r["failures"], r["refused"]) for r in b.collect()}
    assert got == {"a": ("closed", 0, 1), "b": ("open", 3, 1), "c": ("closed", 1, 0)}


def test_stream_results_are_tables(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 10 as int)) as ts, 'a' as event_type, 1.0D as value from range(20)")
    rows.unionByName(rows).write.parquet(str(tmp_path / "e"))
    stream = streams.timed(streams.read(spark, str(tmp_path / "e"), rows.schema))
    d = streams.run_once(streams.deduplicated(stream, "event_id"), "once", str(tmp_path / "c"), "append")
    assert d.count() == 20 and set(d.columns) >= {"event_id", "ts"}


# --- audit of a run --------------------------------------------------------------------------------


def test_audit_checks(spark):
    m = spark.createDataFrame([("r", "hashed", 64, 3, 2, 1, 2, 2)], "run_id string, model string, expected_dim int, total_chunks long, embedded long, rejected long, stored long, documents long")
    said = lambda c: tuple(c.first())[1:]
    assert said(audit.manifest_check(m, ["hashed"], [64], 2)) == (False, "rejected chunks")
    assert said(audit.manifest_check(m, ["other"], [32], 9)) == (False, "model not listed; dimension not listed; rejected chunks; documents missing")
    assert said(audit.manifest_check(m.withColumn("rejected", F.lit(0)), ["hashed"], [64], 2)) == (True, "valid")
    assert said(audit.manifest_check(m.drop("model"), ["hashed"], [64], 2)) == (False, "missing columns: model")
    assert said(audit.columns_check(m, "t", ["model", "zzz"])) == (False, "missing columns: zzz") and said(audit.columns_check(m.where("false"), "t", ["model"])) == (False, "no rows")
    assert said(audit.count_check(m, "t", F.lit(1))) == (True, "1 of 1") and said(audit.count_check(m, "t", F.lit(None).cast("long")))[0] is False
    d = spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string")
    assert said(audit.coverage_check(d.where("doc_id = 'a'"), d, d)) == (True, "0 of 1 documents incomplete")
    assert said(audit.coverage_check(d.where("doc_id is not null"), d, d.where("doc_id = 'a'")))[0] is False
    assert said(audit.subset_check(d, "t", ["a", "z", "y"], "doc_id")) == (False, "missing: y, z") and said(audit.subset_check(d, "t", ["a"], "doc_id")) == (True, "all")
    good, bad = audit.count_check(m, "one", F.lit(1)), audit.count_check(m, "two", F.lit(2))
    s = audit.summary(audit.checks_of(good, bad), "r").first()
    assert (s["passed"], s["failed"], s["live"], s["failures"]) == (1, 1, False, "two") and audit.summary(good, "r").first()["live"]
    registry = spark.createDataFrame([("r0", "2026-01-01")], "run_id string, activated_at string")
    run = spark.createDataFrame([("r1", "2026-01-02")], registry.schema)
    assert {r[0] for r in audit.swapped(registry, run, bad).collect()} == {"r0"} and {r[0] for r in audit.swapped(registry, run, good).collect()} == {"r0", "r1"}
    assert {r[0] for r in audit.swapped(registry, run, good.where("false")).collect()} == {"r0"}


def test_embed_totals(spark):
    c = spark.createDataFrame([("c1",), ("c1",), ("c2",), ("c3",)], "chunk_id string")
    v = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    assert tuple(audit.embed_totals(c, v, c, 2).first()) == (3, 1, 2, 4)
    f = spark.createDataFrame([("a", "nav", "1"), ("a", "nav", "2"), ("a", "aum", None), ("z", "nav", "1")], "doc_id string, fact_type string, value string")
    got = audit.facts_of_chunks(spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "doc_id string, chunk_id string"), f).collect()
    assert {tuple(r) for r in got} == {("a", 1, 2, 1), ("b", 1, 0, 0)}


def test_trusted_hosts(spark):
    urls = ["https://a.example/x", "https://A.EXAMPLE", "https://a.example:8443/x", "https://a.example.evil.test/", "https://u@a.example/", "a.example", "", None]
    assert one(spark, urls, lambda u: ingest.trusted(u, ["a.example"])) == [True, True, False, False, True, False, False, False]


def test_new_facts_by_several_columns(spark):
    a = spark.createDataFrame([(1, "d", "nav"), (2, "d", "aum"), (3, "e", "nav")], "i int, doc_id string, fact_type string")
    assert {r["i"] for r in sinks.new_only(a, a.where("i = 1"), ["doc_id", "fact_type"]).collect()} == {2, 3} and {r["i"] for r in sinks.new_only(a, a.where("i = 1"), "doc_id").collect()} == {3}


def test_models_in_tiers(spark):
    """The first model that answers counts; without one the first sentence of the context does."""
    df = spark.createDataFrame([(1, "Information for x:\nFirst. Second.", "q")], "i int, c string, q string")
    silent, loud = (lambda c, q: F.lit(" ")), (lambda c, q: F.concat(F.lit("said "), q))
    ask = lambda models: df.select(answer.inferred(F.col("c"), F.col("q"), models)).first()[0]
    assert ask(None) == "First." and ask([silent]) == "First." and ask([silent, loud]) == "said q"
    assert df.select(answer.with_disclaimer(F.col("q"), "No advice.")).first()[0] == "q\n\nNo advice."


def test_pipeline_takes_models_and_addresses(spark):
    chunks = [("c1", "D1", "https://a.example/acme-gold", "The nav of acme gold fund is 10.5 today."), ("c2", "D2", "https://b.example/zed-cap", "Holdings of zed cap fund: bank stocks 12%.")]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, source_url string, text string")
    facts = spark.createDataFrame([(1, "D1", "https://a.example/acme-gold", "nav", "10.5"), (2, "D2", "https://b.example/zed-cap", "nav", "1")], "id long, doc_id string, source_url string, fact_type string, value string")
    q = spark.createDataFrame([(1, "What is the NAV of Acme Gold?"), (2, "Holdings of Zed Cap compared with Acme Gold?"), (3, "My PAN is ABCDE1234F"), (4, "NAV of Zed Cap?")], "query_id long, query string")
    length = lambda t: F.array(F.length(t).cast("float"), F.lit(1.0).cast("float"))
    allowed = spark.createDataFrame([("https://a.example/acme-gold",)], "url string")
    got = {r["query_id"]: r for r in pipeline.answers(q, c, facts, "2026-01-01", embed=length, models=[lambda ctx, question: F.lit("It is 10.5.")], allowed=allowed).collect()}
    assert got[1]["response"].startswith("It is 10.5.\n\nSource: https://a.example/acme-gold") and got[1]["status"] == "APPROVED"
    assert got[2]["status"] == "ADVISORY" and got[3]["status"] == "PERSONAL_DATA" and got[4]["status"] == "UNKNOWN" and got[4]["response"] is None


def test_alias_shorthands(spark):
    d = spark.createDataFrame([("D1", "https://a.example/icici-prudential-gold-fund-direct-growth")], "doc_id string, source_url string")
    assert {r["alias"] for r in query.aliases(d, (("icici prudential", "icici"),)).collect()} == {"icici prudential gold fund", "icici prudential gold", "icici gold fund", "icici gold"}
    assert {r["alias"] for r in query.aliases(d).collect()} == {"icici prudential gold fund", "icici prudential gold"}


def test_lookup_needs_confidence(spark):
    facts = spark.createDataFrame([(1, "D1", "nav", "10", "https://a.example/x-y")], "id long, doc_id string, fact_type string, value string, source_url string")
    asked = spark.createDataFrame([(1, ["D1"], "nav", 1.0), (2, ["D1"], "nav", 0.5), (3, ["D9", "D1"], "nav", 0.8), (4, [], "nav", 1.0)], "query_id long, doc_ids array<string>, fact_type string, confidence double")
    got = {r["query_id"]: r["sentence"] for r in retrieve.structured_lookup(asked, facts).collect()}
    assert got == {1: "The nav for X Y is 10.", 3: "The nav for X Y is 10."}


def test_table_function(spark):
    from factlake.functions import sqlfunctions

    sqlfunctions.register(spark)
    got = spark.sql("select id, c.* from values (1, 'a b c d e'), (2, ''), (3, cast(null as string)), (4, ' x ') t(id, body), lateral chunk_text(body, 2) c").collect()
    assert sorted((r["id"], r["piece"], r["words"], r["text"]) for r in got) == [(1, 0, 2, "a b"), (1, 1, 2, "c d"), (1, 2, 1, "e"), (2, 0, 0, ""), (4, 0, 1, "x")]
    assert spark.sql("select plain_numbers('10,24,916'), percent('0.5')").first()[:] == ("1024916", "0.5%")


# --- quantities ---------------------------------------------------------------------------------------


def test_units(spark):
    facts = [
        (1, "aum", "₹12.5 Cr", "AUM\n₹12.5 Cr"), (2, "aum", "1,250 lakh", "AUM"), (3, "aum", "INR 513,386,843", ""), (4, "aum", "60.65", "Assets managed – Rs. crore\n60.65"), (5, "aum", "60.65", "AUM\n60.65\nFigures in लाख"),
        (6, "aum", "7", "all amounts in à¤²à¤¾à¤– of rupees\n7"), (7, "nav", "₹12", "Volume ’000\nNAV\n₹12"), (8, "nav", "1,234 p.", ""), (9, "nav", "12", "NAV, paise – 23 May '26\n12"), (10, "min_sip", "Rs. 1k", ""), (11, "min_sip", "0.01", "SIP from (₹ lakh) starts at 0.01."),
        (12, "expense_ratio", "152 Basispunkte", ""), (13, "expense_ratio", "17", "TER (â€°)\n17"), (14, "expense_ratio", "1.5", "Spread 12 bps – note\nTER\n1.5"), (15, "exit_load", "Exit load of 50 bps up to 365 days", ""), (16, "exit_load", "Nil", ""), (17, "exit_load", "0 bps", ""),
        (18, "exit_load", "Load 1 प्रतिशत up to 15 days", ""), (19, "nav", None, "NAV (in paise)"), (20, "nav", "--", "x"), (21, "risk_level", "5 lakh", ""), (22, "aum", "१२ करोड़", ""), (23, "nav", "1.234,50 रुपये", ""), (1, "aum", "₹12.5 Cr", "AUM\n₹12.5 Cr"), (24, "nav", "x" * 100_000, None), (25, "min_sip", "₹ 500/-", None),
    ]
    f = spark.createDataFrame([(i, "d", t, v, s, 1) for i, t, v, s in facts], "fact_id long, doc_id string, fact_type string, value string, raw_snippet string, unit int")
    old = spark.createDataFrame([(1, "d", "nav", "₹12", 1)], "id long, doc_id string, fact_type string, value string, centre int")
    common = spark.createDataFrame([("aum", "rupees crore"), ("nav", "rupees"), ("min_sip", "rupees"), ("expense_ratio", "percent"), ("exit_load", "percent")], "fact_type string, common_unit string")
    assert sorted(r[0] for r in units.found(f, old, common).collect()) == [2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 15]
    got = {r["fact_id"]: r for r in units.convert(f, old, common).collect()}
    for i, v in {1: 12.5, 2: 12.5, 3: 51.3386843, 5: 0.6065, 8: 12.34, 9: 0.12, 10: 1000, 11: 1000, 12: 1.52, 13: 1.7, 15: 0.5, 22: 12, 23: 1234.5, 25: 500}.items():
        assert got[i]["converted"] == pytest.approx(v), i
    assert got[1]["unique"] and got[1]["agrees"] and not got[16 if 16 in got else 17]["unique"]
    assert 16 not in got and 19 not in got and 20 not in got and 21 not in got
    assert units.found(f.where("false"), old, common).count() == 0


def test_units_fraction(spark):
    facts = [(1, "expense_ratio", "0.0215", "Expense ratio (share of 1)\n0.0215"), (2, "exit_load", "0.0100", "Menu\nExit load as a fraction of assets\n0.0100"), (3, "exit_load", "0.0000", "Exit load (share of 1)\n0.0000"), (4, "expense_ratio", "0.05", "TER, per cent\n0.05"), (5, "expense_ratio", "0.05", "TER\n0.05")]
    f = spark.createDataFrame([(i, "d", t, v, s) for i, t, v, s in facts], "fact_id long, doc_id string, fact_type string, value string, raw_snippet string")
    old = spark.createDataFrame([], "id long, doc_id string, fact_type string, value string")
    common = spark.createDataFrame([("expense_ratio", "percent"), ("exit_load", "percent")], "fact_type string, common_unit string")
    assert sorted(r[0] for r in units.found(f, old, common).collect()) == [1, 2]
    assert {r["fact_id"]: round(r["converted"], 6) for r in units.convert(f, old, common).collect()} == {1: 2.15, 2: 1.0, 3: 0.0, 4: 0.05, 5: 0.05}


def test_units_leave_own_fact_out(spark):
    facts = [(1, "a", "₹5 Cr"), (1, "a", "₹5 Cr"), (2, "b", "₹5 Cr"), (3, "b", "₹6 lakh"), (4, "c", "₹7 Cr"), (5, "d", "8"), (6, "e", "₹1 Cr"), (7, "e", "₹2 Cr"), (8, "e", "₹90 Cr"), (9, "e", "3")]
    f = spark.createDataFrame([(i, d, "aum", v, "") for i, d, v in facts], "fact_id long, doc_id string, fact_type string, value string, raw_snippet string")
    old = spark.createDataFrame([(1, "c", "aum", "₹7.5 Cr"), (2, "d", "aum", "₹8 Cr")], "id long, doc_id string, fact_type string, value string")
    common = spark.createDataFrame([("aum", "rupees crore")], "fact_type string, common_unit string")
    got = {r["fact_id"]: r for r in units.convert(f, old, common).collect()}
    assert len(got) == 9
    # nothing to compare with
    assert got[1]["residual"] is None and got[1]["proposed"] is None and not got[1]["unique"] and got[1]["agrees"] is None
    # two facts have only each other
    assert got[2]["proposed"] != "crore" and got[2]["agrees"] is False and got[3]["residual"] > 0 and got[3]["agrees"] is False
    assert got[4]["unique"] and got[4]["agrees"] and got[4]["residual"] == pytest.approx(math.log(7.5 / 7))
    assert got[5]["unique"] and got[5]["proposed"] == "crore" and got[5]["residual"] == pytest.approx(0)
    # lower medians of what is left: 2 of (2, 90), 1 of (1, 90), 1 of (1, 2); all three for the open one
    assert [round(got[i]["residual"], 6) for i in (6, 7)] == [round(math.log(2), 6)] * 2 and got[9]["residual"] == pytest.approx(math.log(1.5))


def test_units_residuals_decide(spark):
    """Where a reading is doubtful the quantity's other observations choose the unit; a clear one stands whatever they say."""
    facts = [
        (1, "a", "1250", "AUM (₹ in Cr)\nFigures in lakh\n1250"), (2, "b", "12.5", "AUM (₹ in Cr)\nFigures in lakh\n12.5"), (3, "c", "1250", "AUM (₹ in Cr)\nFigures in lakh\n1250"),
        (4, "a", "1250 लक्ष", ""), (5, "c", "1250 लक्ष", ""), (6, "a", "1250", "AUM"), (7, "a", "1250 crore", ""), (8, "a", "1250 crore", None),
    ]
    f = spark.createDataFrame([(i, d, "aum", v, s) for i, d, v, s in facts], "fact_id long, doc_id string, fact_type string, value string, raw_snippet string")
    old = spark.createDataFrame([(i, d, "aum", "₹12.5 Cr") for i, d in ((1, "a"), (2, "a"), (3, "a"), (4, "b"))], "id long, doc_id string, fact_type string, value string")
    common = spark.createDataFrame([("aum", "rupees crore")], "fact_type string, common_unit string")
    got = {r["fact_id"]: r for r in units.convert(f, old, common).collect()}
    assert {i: r["unit"] for i, r in got.items()} == {1: "lakh", 2: "crore", 3: "crore", 4: "lakh", 5: "crore", 6: "crore", 7: "crore", 8: "crore"}
    assert got[1]["converted"] == pytest.approx(12.5) and got[1]["unique"] and not got[3]["unique"] and got[7]["agrees"] is False
    assert sorted(r[0] for r in units.found(f, old, common).collect()) == [1, 4]


def test_entry_lists():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60 and "p5_found" in q
