import hashlib
import itertools
import json
import os
import random
import re
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import duckdb  # noqa: E402
from oracle import SF, compare, connect  # noqa: E402

from lumatrace.llm import bpe, common, curves, decontaminate, extract, graph, language, queries, ranked, resample, simhash, substrings, toolcalls, topk, toxicity, urls  # noqa: E402

ODD = [None, "", " ", "\n\t", "a", "%%% ---", "é" * 3, "word " * 50, "x" * 5000, "ß<|endoftext|>ß", "ein zwei drei", "ein zwei drei"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    compare(spark, con, queries.queries()[name], queries.oracle_sql()[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_queries_take_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and unlabelled rows: a row for each, and no crash."""
    docs = documents(spark, ODD)
    docs = docs.union(docs.filter("doc_id < 3")).union(spark.createDataFrame([(None, None, None, None, None), (None, "null id", "en", None, 1)], DOCS))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "drei"), (None, "word word"), (3, "drei")], "item_id long, text string")
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "no scheme", "<p>a"), (None, "HTTP://A.B/c?d", "<b>" * 2000), (3, "no scheme", "<p>a")], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [3.0, -1.0]), (None, [1.0, 1.0]), (4, [3.0, -1.0]), (100, [])], "vec_id long, embedding array<float>")
    talk = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x"), (None, 1, "user", "y"), (1, None, "tool", "{"), (1, 0, "user", "z"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    at = folder(spark, tmp_path, documents=docs, benchmark=bench, pages=pages, embeddings=vectors, conversations=talk, labels=label_rows(spark, [(4, 1, 1), (5, None, 0), (None, 0, 1)]))
    rows = {name: f(spark, at).collect() for name, f in queries.queries().items()}
    for name in ("op1_toxicity", "op2_decontaminate", "op4_substrings", "op5_bpe", "op6_language", "op8_simhash", "op13_resample"):
        assert len(rows[name]) == docs.count(), name
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows["op11_curves"]} == {(0, 1, 4, 1.0), (0, 2, 4, 1.0)}
    assert {(r.item_id, r["rank"], r.doc_id) for r in rows["op12_ranked"]} == {(3, 1, 10), (3, 2, 11), (None, 1, 7)}
    assert len(rows["op3_urls"]) == len(rows["op7_extract"]) == 5
    assert {(r.host, r.path) for r in rows["op3_urls"]} == {("", ""), ("a.b", "/c")}
    assert {(r.query_id, r.vec_id, r.score) for r in rows["op10_topk"]} == {(0, 4, 256 * 256)}
    assert {r.status for r in rows["op9_toolcalls"]} == {"linked", "pending", "orphan"}


def test_queries_take_empty_tables(spark, tmp_path):
    empty = lambda schema: spark.createDataFrame([], schema)
    at = folder(spark, tmp_path, documents=empty(DOCS), benchmark=empty("item_id long, text string"), pages=empty("page_id long, url string, html string"), embeddings=empty("vec_id long, embedding array<float>"), conversations=empty("conv_id long, turn long, role string, text string"), labels=label_rows(spark, []))
    for name, f in queries.queries().items():
        assert f(spark, at).count() == 0, name


def test_clashing_columns_stay_or_are_replaced(spark):
    docs = documents(spark, ["eins zwei", "drei"]).withColumns({c: F.lit(7) for c in ("fp", "key", "tk", "body", "repeats", "n_tokens", "score", "count", "chosen", "base", "hit_words", "r_key", "emptied")})
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.one_of_each(docs.withColumn("wide", F.lit(1)).withColumn("node", F.lit(1)), rule=simhash.Similar()).count() == 2
    assert substrings.with_repeats(docs).count() == 2
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, "drei")], "item_id long, text string")).filter("size(hit_items) > 0").count() == 1
    assert bpe.tokenize(docs).filter("n_tokens > 7").count() == 0
    assert toxicity.score(docs, toxicity.train([], 0, 0)).filter("score > 1").count() == 0
    own = docs.withColumns({c: F.lit("old") for c in ("lang_pred", "label", "words")})
    found = language.identify(own, language.train([("eins zwei", "de")]))
    assert sorted(found.columns) == sorted(own.columns) and found.filter("lang_pred = 'de' AND score <= 1 AND label = 'old'").count() == 2
    added = {c: F.lit(7) for c in ("host", "path", "rule", "verdict", "src", "dst", "trust", "distrust", "text", "n_chars", "link", "weight")}
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>a b"), (2, None, None)], "page_id long, url string, html string").withColumns(added)
    judged, extracted = urls.judge(pages), extract.extract(pages)
    assert sorted(judged.columns) == sorted(extracted.columns) == sorted(pages.columns)
    assert {(r.page_id, r.host, r.verdict, r.src) for r in judged.collect()} == {(1, "a.org", "allow", 7), (2, "", "allow", 7)}
    assert {(r.page_id, r.text, r.n_chars, r.link) for r in extracted.collect()} == {(1, "a b", 3, 7), (2, "", 0, 7)}
    extra = {c: F.lit(1) for c in ("key", "uid", "stands", "n", "n_calls", "r_key", "level", "status")}
    calls = spark.createDataFrame([(1, 0, "c", "t", "{}", None)], "conv_id long, turn long, call_id string, name string, arguments string, after string").withColumns(extra)
    results = spark.createDataFrame([(1, 1, "c", "x")], "conv_id long, turn long, call_id string, content string").withColumns(extra)
    assert [(r.status, r.level, r.result_turn) for r in toolcalls.link(calls, results, {}).collect()] == [("linked", 0, 1)]
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit(9) for c in ("v", "score", "rank", "ask", "copies", "query_id")})
    assert [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 * 256 * 256)]
    own = vectors.withColumns({c: F.lit(9) for c in ("id", "i", "asked", "ids", "vid", "floor", "place", "position", "list")})
    assert [tuple(r) for r in curves.nearest(own, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    wide = docs.withColumns({c: F.lit(9) for c in ("doc", "n", "terms", "tfs", "ask", "rank", "score", "k", "t", "item_id")})
    items = spark.createDataFrame([(1, "DREI")], "item_id long, text string").withColumns({c: F.lit(9) for c in ("k", "t", "query", "doc_id")})
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranked.search(wide, items).collect()] == [(1, 1, 1)]
    kept = docs.withColumns({c: F.lit("own") for c in ("kept", "steps", "weight", "rank", "n_words", "bucket", "fit", "row", "place")})
    drawn = resample.resample(kept, items, keep=["doc_id", "text", "place", "weight"], least=1, share=(1, 1)).collect()
    assert {(r.doc_id, r.text, r.place, r.n_words, r.n_features) for r in drawn} == {(0, "eins zwei", "own", 2, 3), (1, "drei", "own", 1, 1)}
    assert [r["rank"] for r in sorted(drawn, key=lambda r: -r.score)] == [1, 2] and all(isinstance(r.weight, int) for r in drawn)


# 1 toxicity


def test_toxicity_learns(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ba", "do", "ki", "lu", "me", "so"]) for _ in range(rnd.randint(2, 4)))
    def text(bad):
        words = [word() for _ in range(120)]
        for _ in range(8 * bad):
            words[rnd.randrange(120)] = rnd.choice(["grumwitz", "schnarkel", "vopplig"])
        return " ".join(words)
    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.train(rows, 100, 300)
    test = [(text(i % 2), i % 2) for i in range(100)]
    predicted = model.scores([t for t, _ in test]) >= toxicity.CUT
    assert np.mean(predicted == np.array([y for _, y in test], bool)) > 0.95


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    """What stands behind the first 4,000 characters is learned, a repeated row once, and a bound drops rows, not ends."""
    late = "plain words of no harm " * 400 + "vilestinsult"
    docs = documents(spark, [late, late, "short", None])
    docs = docs.union(docs.filter("doc_id = 0"))
    known = label_rows(spark, [(0, 1, 1), (1, 1, 1), (2, 1, 0), (3, 1, 0)])
    rows, toxic, ordinary = toxicity.training_sample(docs, known)
    assert rows == [(late, 1), (late, 1), ("short", 0), ("", 0)] and (toxic, ordinary) == (2, 2)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", len(late) + 10)
    assert toxicity.training_sample(docs, known)[0] == [(late, 1), ("short", 0), ("", 0)]


def test_toxicity_words_stay_in_tasks(spark, tmp_path):
    """Training takes little more of the driver than the texts of its sample, and gives what ``train`` gives."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 9)))
    bad = [i % 4 == 0 for i in range(600)]
    texts = [" ".join([word() for _ in range(400)] + rnd.choices(["grumwitz", "vopplig"], k=8 * b)) for b in bad]
    at = folder(spark, tmp_path, documents=documents(spark, texts), labels=label_rows(spark, [(i, 1, int(b)) for i, b in enumerate(bad)]))
    tracemalloc.start()
    try:
        found = toxicity.op1_toxicity(spark, at)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * sum(map(len, texts))
    rows = [(t, int(b)) for i, (t, b) in enumerate(zip(texts, bad, strict=True)) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxicity.train(rows, sum(y for _, y in rows), sum(1 - y for _, y in rows))
    assert b"vopplig" in model.toxic and any(model.weights)
    assert [r.score for r in found.orderBy("doc_id").collect()] == model.scores(texts).tolist()


def test_toxicity_grams_and_samples():
    """Grams and samples are those of a search word by word, whatever the step and the spaces between."""
    texts = ["", " ", "a", "ab  abc\nabcd ABCDE abcdef", "ü é-ß  zz", "one two three four five six seven eight nine ten"]
    grams = lambda w: {m[i : i + 5] for m in (b" " + w + b" ",) for i in range(max(1, len(m) - 4))}
    for chunk in (1, 3, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "CHUNK_BYTES", chunk)
            for text in texts:
                words = toxicity.words_of(text)
                every, bad, good = toxicity.gram_counts([(text, 1), (text, 1), (text, 0)])
                assert {int(g).to_bytes(8).lstrip(b"\0") for g in every} == set().union(*map(grams, words))
                assert (bad == 2).all() and (good == 1).all()
                assert toxicity.samples(text, 0, every) == [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
                for g in every:
                    assert toxicity.samples(text, 1, np.array([g])) == [b" " + w + b" " for w in words if int(g).to_bytes(8).lstrip(b"\0") in grams(w)]


def test_toxicity_held_out(spark):
    found = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in found.items())
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    bad, good = ([found[i].score for i, y in labels.items() if y == k and found[i].held_out] for k in (1, 0))
    assert np.mean([b > g for b, g in itertools.product(bad, good)]) + 0.5 * np.mean([b == g for b, g in itertools.product(bad, good)]) > 0.7


# 2 decontamination


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate_against_search(spark, block_bytes):
    rnd = random.Random(4)
    words = ["a", "B", "c", "d1", "é"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) + rnd.choice(["", ".", "--"]) for _ in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 4, 5, 12])))) for i in range(2, 14)] + [(20, texts[0]), (21, texts[1]), (21, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: t.encode().translate(decontaminate.TO_WORDS).split()
    found = decontaminate.decontaminate(documents(spark, texts), bench, window=4, block_bytes=block_bytes)
    for r in found.collect():
        own, hit, names = split(r.text), set(), set()
        for name, body in items:
            ws = split(body)
            for i in range(len(ws) - min(4, len(ws)) + 1 if ws else 0):
                w = ws[i : i + 4]
                for j in range(len(own) - len(w) + 1):
                    if own[j : j + len(w)] == w:
                        hit |= set(range(j, j + len(w)))
                        names.add(str(name))
        spans = list(zip(r.hit_words[::2], r.hit_words[1::2]))
        assert {k for b, e in spans for k in range(b, e)} == hit and set(r.hit_items) == names and r.n_words == len(own)
        cut = [w for b, e in zip(r.removal_spans[::2], r.removal_spans[1::2]) for w in split(r.text.encode()[b:e].decode())]
        assert cut == [own[k] for k in sorted(hit)]


def test_repeated_items_do_not_fill_a_block(spark, monkeypatch):
    taken, scan = [], decontaminate.scan_block
    monkeypatch.setattr(decontaminate, "scan_block", lambda docs, rows, *a: taken.append(rows) or scan(docs, rows, *a))
    bench = spark.createDataFrame([(1, "ten words of a row")] * 50 + [(2, "other words"), (None, None)], "item_id long, text string")
    found = decontaminate.decontaminate(documents(spark, ["see ten words of a row", "none"]), bench, block_bytes=40).collect()
    assert sorted(r for rows in taken for r in rows) == [("1", b"ten words of a row"), ("2", b"other words")] and len(taken) == 1
    assert {r.doc_id: r.hit_items for r in found} == {0: ["1"], 1: []}


def test_blocks_leave_no_copies(spark):
    """Six blocks find what one does, and leave one table of what was found, not of the documents."""
    rnd = random.Random(21)
    say = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 3))) for _ in range(n))
    items = [(i, say(14)) for i in range(30)]
    docs = documents(spark, [f"{say(9)} {items[i % 30][1]} {say(5)} {items[i % 7][1]}" if i % 3 else say(40) for i in range(50)] + [None, ""])
    docs = docs.union(docs.filter("doc_id < 5"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    before = len(common.WRITTEN)
    whole = decontaminate.decontaminate(docs, bench)
    assert len(common.WRITTEN) == before
    parts = decontaminate.decontaminate(docs, bench, block_bytes=-(-size // 6))
    assert len(common.WRITTEN) == before + 1
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(whole.columns).collect())) and whole.filter("size(hit_items) > 1").count() > 0


def test_fm_index():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.concatenate([[0], rng.integers(1, 6, n)]) for n in (30, 1, 50, 7)])
    index = decontaminate.FmIndex(text, 5)
    for size in (1, 2, 3, 5):
        patterns = rng.integers(1, 6, (40, size))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            expected = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


# 3 urls


def test_trust_and_distrust_travel(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(1, "http://good.org/", link("friend.net")), (2, "http://friend.net/a", ""), (3, "http://bad.com/de/x", ""), (4, "http://farm.net/a", link("bad.com")), (5, "http://other.net/", link("friend.net", "bad.com")), (6, "http://bad.com/xx", "")]
    found = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), block_from=0.15).collect()}
    assert found == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block"}


def test_scores_against_matrix(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(8)]
    edges = [(a, b, float(rng.randint(1, 3))) for a in hosts for b in hosts if a != b and rng.random() < 0.3]
    seeds = [("h0", 1.0, 0.0), ("h1", 0.5, 0.25), ("h2", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in urls.host_scores(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    w = np.zeros((8, 8))
    for a, b, k in edges:
        w[int(a[1]), int(b[1])] = k
    out, into = (w / np.maximum(w.sum(1, keepdims=True), 1e-9)), (w / np.maximum(w.sum(0, keepdims=True), 1e-9)).T
    t0, d0 = np.zeros(8), np.zeros(8)
    for h, t, d in seeds:
        t0[int(h[1])], d0[int(h[1])] = t, d
    t, d = 0.15 * t0, 0.15 * d0
    for _ in range(urls.ROUNDS):
        t, d = 0.15 * t0 + 0.85 * (t @ out), 0.15 * d0 + 0.85 * (d @ into)
    for i, h in enumerate(hosts):
        assert got.get(h, (0, 0)) == pytest.approx((t[i], d[i]))


@pytest.mark.parametrize("url,host,path", [("http://A.Org/En/1?x", "a.org", "/En/1"), ("x://h#f/p", "h", ""), ("x://h?a/b", "h", ""), ("a/b", "", ""), ("http://", "", ""), ("a://É.b://c/d", "É.b:", "//c/d")])
def test_url_parts(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "u string").select(urls.host_of(F.col("u")), urls.path_of(F.col("u")))
    assert tuple(df.first()) == (host, path)


# 4 substrings


def repeated_texts():
    rnd = random.Random(3)
    pool = ["".join(rnd.choices("abcd efghé", k=rnd.randint(100, 900))) for _ in range(10)]
    texts = ["".join(rnd.choice(pool)[rnd.randint(0, 100) :][: rnd.randint(50, 900)] for _ in range(rnd.randint(0, 4))) for _ in range(60)]
    texts += ["a" * 1500, "ab" * 700, "", "abc" * 1000, texts[0], texts[0]]
    near = "".join(rnd.choices("abcdefgh ijklmnop", k=1500))
    for _ in range(30):
        t = list(near)
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("group", [192, 4])
def test_substrings_against_brute_force(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    texts = repeated_texts()
    at = folder(spark, tmp_path, documents=documents(spark, texts))
    raw = [t.encode() for t in texts]
    expected = {i: brute.digest(t, m) for i, (t, m) in enumerate(zip(raw, brute.repeats(raw, 400)))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op4_substrings(spark, at).collect()}
    assert got == expected


def test_long_texts_are_taken_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 1000)
    rnd = random.Random(8)
    passage = "".join(rnd.choices("abcdefghij", k=700))
    texts = ["".join(rnd.choices("klmnopqrst", k=20_000)) for _ in range(3)]
    texts = [t[:k] + passage + t[k:] for t, k in zip(texts, (0, 7_900, 19_000))]
    at = folder(spark, tmp_path, documents=documents(spark, texts))
    assert [r.n_removed for r in substrings.op4_substrings(spark, at).collect()] == [brute.repeats([t.encode() for t in texts], 400)[i].sum() for i in range(3)]


def test_repeated_rows_are_linear(spark):
    """Copies of a row give equal spans once: thousands of rows of one text, and of another that shares a passage with it."""
    passage = "".join(random.Random(6).choice("abcdefgh ") for _ in range(60))
    texts = [passage + "first ending that is longer", "other beginning " + passage, "nothing that repeats here"]
    rows = spark.range(0, 5000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit(texts[0]).alias("text"))
    rows = rows.union(spark.createDataFrame([(8, texts[1]), (9, texts[2])], "doc_id long, text string"))
    began = time.time()
    found = {(r.doc_id, r.text): {tuple(x) for x in r.repeats or []} for r in substrings.with_repeats(rows, min_len=40).distinct().collect()}
    masks = brute.repeats([texts[0].encode()] * 2 + [t.encode() for t in texts[1:]], 40)
    for key, text, mask in ((7, texts[0], masks[0]), (8, texts[1], masks[2]), (9, texts[2], masks[3])):
        covered = np.zeros(len(text), bool)
        for b, e in found[key, text]:
            covered[b:e] = True
        assert (covered == mask).all() and len(found[key, text]) <= len(text)
    assert time.time() - began < 60


def test_maximal_repeats_have_all_occurrences():
    pieces = [b"xxabcdefyy", b"zabcdefw", b"abcdeq"]
    found = {(n, tuple(sorted(p.tolist()))) for n, p in substrings.EnhancedSuffixArray(pieces, 4).repeats()}
    assert found == {(6, (2, 12)), (5, (2, 12, 20))}


def test_cut_keeps_whole_characters(spark):
    df = spark.createDataFrame([("aéb", [(2, 3)]), ("éé", [(0, 4)]), (None, None), ("x", None)], "text string, repeats array<struct<begin:long,end:long>>")
    assert [(r.text, r.emptied) for r in substrings.cut(df).collect()] == [("aéb", False), ("", True), (None, False), ("x", False)]


# 5 bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_is_exact(library):
    mine, rnd = bpe.ByteBpe(bpe.vocabulary()), random.Random(1)
    odd = [chr(c) for c in [*range(0, 128), *range(0x80, 0x2FF), 0x660, 0x1680, 0x2000, 0x2028, 0x202F, 0x3000, 0x4E00, 0x1F600, 0x200B, 0xFEFF, 0xE000]]
    texts = ["".join(rnd.choices(odd, k=rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rnd.choice(["<|endoftext|>", " ", "the", "'s", "a", "zz", "\n", "  ", "é", "ing"]) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + ["a" * 5000 + "bé" * 500]
    for text, (ids, raw), want in zip(texts, mine.both(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids == ",".join(map(str, want.ids))
        assert raw.decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)
        assert not ids or mine.decode(map(int, ids.split(","))) == raw.decode("utf-8", "replace")
    assert 0 < mine.merged_words < mine.proposed_words


def test_bpe_query(spark, library, tmp_path):
    at = folder(spark, tmp_path, documents=documents(spark, ODD))
    for r in bpe.op5_bpe(spark, at).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# 6 language


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    model = language.Crf(["x", "y", "z"], {})
    model.step, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(1, 4, 3))
    total, want = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(model.start[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, k in enumerate(path):
            want[t, k] += p
    live = np.ones((1, 4), bool)
    assert model.marginals(scores, live)[0] == pytest.approx(want / total)
    padded = np.concatenate([scores, rng.normal(size=(1, 2, 3))], 1)
    assert model.marginals(padded, np.array([[True] * 4 + [False] * 2]))[0, :4] == pytest.approx(want / total)


@pytest.mark.parametrize("held", [1 << 21, 9, 40])
def test_a_text_is_one_chain_over_its_blocks(monkeypatch, held):
    monkeypatch.setattr(language, "MATRICES", held)  # 9: one block's transfer matrix at a time
    rng = np.random.default_rng(4)
    model = language.Crf(["x", "y", "z"], {})
    model.step, model.start = rng.normal(size=(3, 3)) + 3 * np.eye(3), rng.normal(size=3)
    sizes, block = [1, 37, 5, 10, 200, 11], 5
    scores = [rng.normal(size=(1, n, 3)) for n in sizes]
    chains = [-(-n // block) for n in sizes]
    cut, live = np.zeros((sum(chains), block, 3)), np.zeros((sum(chains), block), bool)
    for s, at in zip(scores, np.cumsum(chains) - chains):
        for t in range(s.shape[1]):
            cut[at + t // block, t % block], live[at + t // block, t % block] = s[0, t], True
    first = np.isin(np.arange(len(cut)), np.cumsum(chains) - chains)
    last = np.isin(np.arange(len(cut)), np.cumsum(chains) - 1)
    before, beyond = model.carried(lambda part: (np.exp(cut[part]), live[part]), len(cut), first, last)
    got = model.marginals(cut, live, before=before, beyond=beyond)[live]
    assert got == pytest.approx(np.concatenate([model.marginals(s, np.ones(s.shape[:2], bool))[0] for s in scores]))


def test_letters_and_long_words(spark):
    """Numerals are no letters; a run without spaces counts to its end, in training as well."""
    docs = documents(spark, ["²³ ½", "123", "é", "x" * 100 + " y"])
    model = language.train([("x " * 50, "a"), ("q" * 80 + "zz", "b")])
    assert [r.lang_pred == "und" for r in language.identify(docs, model).orderBy("doc_id").collect()] == [True, True, False, False]
    assert language.words_of("A" * 85 + "-b") == ["a" * 40, "a" * 40, "a" * 5, "b"] and language.words_of("é" * 30) == ["é" * 30]
    late, early = language.Labeller(model).shares(["q" * 80 + "zz", "q" * 80])[0], language.Labeller(model).shares(["q" * 80])[0]
    assert late[0, 1] > 0.9 and early[0, 1] > 0.9


def test_language_sample(spark, monkeypatch):
    docs = documents(spark, [f"t{i} " * (i + 1) for i in range(50)] + [None], ["a"] * 40 + ["b"] * 9 + [None, "a"])
    monkeypatch.setattr(language, "SAMPLE_ROWS", 12)
    rows = language.training_sample(docs, "text", "lang", "doc_id")
    assert {y: sum(k == y for _, k in rows) for y in "ab"} == {"a": 12, "b": 9} and len(set(rows)) == 21
    assert all(t == f"t{t.count(' ') - 1} " * t.count(" ") for t, _ in rows)
    monkeypatch.setattr(language, "SAMPLE_CHARS", 300)
    few = language.training_sample(docs, "text", "lang", "doc_id")
    assert 0 < sum(len(t) for t, y in few if y == "a") <= 300


def test_language_held_out(spark):
    found = language.op6_language(spark, SF).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_words_of_switched_text_get_their_own_labels():
    rows = duckdb.sql(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE lang IN ('en', 'de') ORDER BY doc_id LIMIT 300").fetchall()
    model = language.train([(t[:1000], y) for t, y in rows])
    by = {y: " ".join(next(t for t, k in rows if k == y and len(t) > 800).split()[:30]) for y in ("de", "en")}
    whole = language.Labeller(model).shares(list(by.values()) + ["", "de"])
    old, language.SCORES = language.SCORES, 1
    parts, language.SCORES = language.Labeller(model).shares(list(by.values()) + ["", "de"]), old
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()
    shares, _ = language.Labeller(model).shares([by["de"], by["en"], by["de"] + " " + by["en"]])
    assert shares[0, 0] > 0.9 and shares[1, 1] > 0.9 and 0.2 < shares[2, 0] < 0.8


# 7 extraction


@pytest.mark.parametrize("page,text", [
    ("<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; t</h1><p><b>one<br>two<p>three\n four</article><footer>f</footer>", "T & t\n\none two\n\nthree four"),
    ("<body><div id='side-bar' class=sidebar><p>no no no no no no</p></div><div><h1>H</h1><div><p>aa bb cc dd ee ff</p><p>gg hh ii jj kk ll</p></div></div><section class=comments><p>reader says a lot of things here</p></section>", "H\n\naa bb cc dd ee ff\n\ngg hh ii jj kk ll"),
    ("plain &lt;text&gt;", "plain <text>"),
    ("<article><script>var t='</p>'</script><p>a&nbsp;b</p><form><p>mail</p></form><style>p{}</style></article>", "a b"),
    ("<p>torn <b attr='", "torn"),
    ("", ""),
])
def test_main_text(page, text):
    assert extract.main_text(page) == text


def test_main_text_in_several_places():
    """Text split over containers or articles is whole, and words of class that name the layout don't exclude it."""
    say = lambda c: [f"{c}{i} " + f"{c}word " * 50 + "end" for i in range(10)]
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    a, b, both = say("a"), say("b"), "\n\n".join(say("a") + say("b"))
    foot = "<nav><a href=x>menu</a></nav>"
    assert extract.main_text(f"<body>{foot}<div>{p(a)}</div><div class=advert><p>buy</p></div><div>{p(b)}</div></body>") == both
    assert extract.main_text(f"<body>{foot}<article>{p(a)}</article><article>{p(b)}</article></body>") == both
    assert extract.main_text(f"<body>{foot}<div><article>{p(a)}</article><article>{p(b[:3])}</article></div></body>") == "\n\n".join(a + b[:3])
    assert extract.main_text(f"<body>{foot}<div class='layout sidebar-right'><div>{p(a)}</div><div class=sidebar><p>more</p></div></div></body>") == "\n\n".join(a)
    assert extract.main_text(f"<body><div class=ad><p>{'buy this ' * 20}</p></div><article><p>brief text</p></article></body>") == "brief text"


def test_markup_loses_no_text():
    """Self-closing drawings, quotes in bare values, nested templates, words of class in articles, labels in sentences."""
    of = lambda body: extract.main_text(f"<body><article>{body}</article></body>")
    assert of("<p>one two</p><svg width=1 /><p>three four</p>") == "one two\n\nthree four"
    assert of("<p>one</p><svg><svg/><svg><text>no</text></svg><text>no</text></svg><p>two</p>") == "one\n\ntwo"
    assert of("<p title=it's>Hello one two three</p><p title=it's>World four five</p>") == "Hello one two three\n\nWorld four five"
    assert of("<p title='a > b' id=\"x > y\" data-a=q='r>s</p>") == "s"
    assert of("<p>one</p><template>no<template>no</template>no</template><p>two</p>") == "one\n\ntwo"
    assert of("<p>one</p><script>if (a < b) '<script>'</script ><p>two</p>") == "one\n\ntwo"
    long = "a sentence of the article that goes on for some time, with one more clause"
    parts = "".join(f"<div class={c}><p>{c} {long}</p></div>" for c in ("related-work", "discussion", "share"))
    assert of(f"<p>{long}</p>{parts}") == "\n\n".join([long, *(f"{c} {long}" for c in ("related-work", "discussion", "share"))])
    assert of(f"<p>{long}</p><div class=share><a href=x>Share</a> <a href=y>Send</a></div><div class=comments><p>{long}</p></div>") == long
    assert of("<p>the <label>inline label</label> stays</p>") == "the inline label stays"
    assert extract.main_text("<p>torn <svg") == "torn" and extract.main_text("<p>torn <template> a") == "torn"


def test_open_elements_are_linear():
    n = 20_000
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<h1></h1>" * n, "<ul>" + "<b>" * n + "<tr></tr>" * n, "<p>" * n, "<a b='" * n):
        began = time.time()
        extract.main_text(f"<body>{page}text of the page</body>")
        assert time.time() - began < 5, page[:20]


def test_articles_of_the_given_pages(spark):
    import html
    import re

    source = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    for r in extract.op7_extract(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 8 simhash


def test_trie_pairs_against_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(6)]))
    got = {tuple(sorted(p)) for a, b in simhash.trie_pairs(fps, np.array([0])) for p in zip(a.tolist(), b.tolist())}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


@pytest.mark.parametrize("most", [512, 3])
def test_linked_fingerprints_against_all_pairs(spark, most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = sorted({int(v) for b in base for v in [b] + [b ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, n))) for n in (1, 2, 3, 5, 4)]})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    before = len(common.WRITTEN)
    found = {r.node: r.root for r in graph.components(simhash.linked_fingerprints(df, 3, most)).collect()}
    common.discard(spark, common.WRITTEN[before:])
    assert len(common.WRITTEN) == before
    root = brute.linked(values)
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    groups = {}
    for v, r in zip(values, root):
        groups.setdefault(r, []).append(sign(v))
    assert found == {v: min(g) for g in groups.values() if len(g) > 1 for v in g}


def test_simhash_query(spark, tmp_path):
    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]
    at = folder(spark, tmp_path, documents=documents(spark, texts))
    prints = [brute.fingerprint(t) for t in texts]
    root = brute.linked(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, at).collect()}
    assert got == {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, root))}
    kept = sorted(r.doc_id for r in simhash.one_of_each(documents(spark, texts)).collect())
    assert kept == sorted(set(root))


@pytest.mark.parametrize("leaf,compared", [(1024, 1 << 20), (4, 64), (1, 5)])
def test_trie_forest_against_all_pairs(monkeypatch, leaf, compared):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = np.random.default_rng(leaf)
    flip = lambda x, n: x ^ np.uint64(sum({1 << int(k) for k in rng.integers(0, 64, n)}))
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    rows = [(g, flip(b, rng.integers(0, 8)), flip(w, rng.integers(0, 12))) for g in range(4) for b in rng.choice(base, 15) for w in rng.integers(0, 2**63, 1, dtype=np.uint64) for _ in range(rng.integers(1, 20))]
    rows.sort()
    group, fp, wide = (np.array(x, np.uint64) for x in zip(*rows))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    near = (np.bitwise_count(fp[:, None] ^ fp) <= 7) & (np.bitwise_count(wide[:, None] ^ wide) <= 12) & (group[:, None] == group)
    want, before = np.arange(len(fp)), None
    while before is None or (want != before).any():
        before, want = want, np.array([want[n].min() for n in near])
    assert simhash.trie_forest(fp, wide, starts, simhash.Similar()).tolist() == want.tolist()


@pytest.mark.parametrize("subtrie,path_rows", [(1024, 1 << 16), (2, 1 << 16), (1024, 24)])
def test_similar_texts_against_all_pairs(spark, monkeypatch, subtrie, path_rows):
    """Near copies of at least 0.8 in five words are one component, with paths split and dealt in parts as well."""
    monkeypatch.setattr(simhash, "PATH_ROWS", path_rows)
    rnd = random.Random(9)
    words = lambda n: [rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(99)) for _ in range(n)]
    texts, of = list(ODD), []
    for _ in range(12):
        own = words(400)
        for _ in range(5):
            changed = list(own)
            for k in rnd.sample(range(400), rnd.randrange(4)):
                changed[k] = "new"
            of.append(len(texts))
            texts.append(" ".join(changed))
    prints = [(brute.word_fingerprint(t, 2), brute.word_fingerprint(t, 5)) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j, q in enumerate(prints) if (p[0] ^ q[0]).bit_count() <= 7 and (p[1] ^ q[1]).bit_count() <= 12) for p in prints]
    rule = simhash.Similar(subtrie=subtrie)
    got = {r.key: r.component_id for r in simhash.similar_components(documents(spark, texts), rule=rule).collect()}
    assert got == dict(enumerate(root))
    assert len({got[i] for i in of}) == 12
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, texts), rule=rule).collect()) == sorted(set(root))


def similarity(a, b):
    """Of the sets of five-word shingles; a text of fewer words is one."""
    sets = []
    for text in (a, b):
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


@pytest.mark.parametrize("rounds", [1, 16])
def test_links_are_verified_by_count(spark, rounds):
    """Everything is proposed, and what has similarity 0.8 links: chains, several kinds in a group, repeated rows, null keys."""
    rnd = random.Random(rounds)
    words = lambda n: [rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(99)) for _ in range(n)]
    texts = ["ein zwei drei", None, "Ein  zwei drei"]
    for _ in range(2):
        own = words(200)
        for _ in range(4):  # each is like the one before it
            texts.append(" ".join(own))
            own = own[8:] + words(8)
        texts.append(" ".join(own[:100] + words(100)))
    docs = documents(spark, texts)
    docs = docs.union(docs.filter("doc_id IN (3, 4)")).union(documents(spark, [texts[5]]).withColumn("doc_id", F.lit(None).cast("long")))
    rule = simhash.Similar(budget=7, most=64, share=0.8, rounds=rounds)
    own = docs.select(F.col("doc_id").alias("key"), common.text_key("text").alias("tk"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    distinct = own.groupBy("node").agg(F.min(F.struct("key", "tk")).alias("one"))
    edges = simhash.verified(docs, distinct, distinct.select("node", F.lit(1).cast("long").alias("root")), "text", "doc_id", rule).collect()
    text = {r.node: texts[r.key] if r.key is not None else texts[5] for r in own.collect()}
    links = {frozenset((r.u, r.v)) for r in edges}
    like = {frozenset((u, v)) for u in text for v in text if u < v and similarity(text[u], text[v]) >= 0.8}
    assert links <= like and links
    if rounds == 16:
        all_in = {u for pair in like for u in pair}
        assert {u for pair in links for u in pair} == all_in
    assert {r.component_id for r in simhash.similar_components(docs.limit(0), rule=rule).collect()} == set()


@pytest.mark.parametrize("group_bytes", [1 << 20, 16_000])
def test_no_link_of_a_proposed_group_is_lost(spark, monkeypatch, group_bytes):
    """Components by all pairs: many kinds, chains that run against the order of keys, copies of one print, groups in parts."""
    monkeypatch.setattr(simhash, "GROUP_BYTES", group_bytes)
    rnd = random.Random(3)
    words = lambda n: [rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(99)) for _ in range(n)]
    texts = [None, "", " ", "ein zwei drei", "Ein  zwei drei"]
    for _ in range(14):  # each is like the one before it, far from others: more kinds than rounds
        own = words(120)
        for _ in range(rnd.randint(1, 7)):
            texts.append(" ".join(own))
            own = own[5:] + words(5)
    rnd.shuffle(texts)
    docs = documents(spark, texts)
    docs = docs.union(docs.filter("doc_id < 4"))
    root = list(range(len(texts)))
    like = [(a, b) for a, b in itertools.combinations(root, 2) if similarity(texts[a], texts[b]) >= 0.8 or not (texts[a] or "").strip() and not (texts[b] or "").strip()]
    for _ in range(len(texts)):
        for a, b in like:
            root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(simhash, "similar_links", lambda distinct, rule: distinct.select(F.col("print").alias("u"), F.lit(1).cast("long").alias("v")))
    got = {r.key: r.component_id for r in simhash.similar_components(docs, rule=simhash.Similar(share=0.8)).collect()}
    assert got == dict(enumerate(root))


@pytest.mark.parametrize("group_bytes, rounds", [(3_000, 0), (3_000, 2), (1 << 20, 3)])
def test_clusters_that_meet_away_from_their_first_texts(spark, monkeypatch, group_bytes, rounds):
    """Of a chain 0-1-2-3 whose least keys are its ends, the link in the middle counts too."""
    monkeypatch.setattr(simhash, "GROUP_BYTES", group_bytes)
    rnd = random.Random(4)
    own = [f"w{rnd.randrange(10**6)}" for _ in range(260)]
    texts = [" ".join(own[15 * k : 15 * k + 200]) for k in (0, 3, 1, 2)]
    docs = documents(spark, texts)
    own = docs.select(F.col("doc_id").alias("key"), common.text_key("text").alias("tk"), F.col("doc_id").alias("node"))
    distinct = own.select("node", F.struct("key", "tk").alias("one"))
    rule = simhash.Similar(share=0.8, rounds=rounds)
    edges = simhash.verified(docs, distinct, distinct.select("node", F.lit(1).cast("long").alias("root")), "text", "doc_id", rule)
    assert [similarity(texts[a], texts[b]) >= 0.8 for a, b in ((0, 2), (2, 3), (3, 1), (0, 3), (0, 1))] == [True, True, True, False, False]
    assert {r.root for r in graph.components(edges).collect()} == {0} and graph.components(edges).count() == 4


def test_only_similar_texts_go(spark):
    """On the given documents each text that goes has a chain of similarity 0.8 to the one that stays for it, and 0.9 of all such pairs meet."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    sets = {d: s for d, s in zip(texts, simhash.shingle_sets([(t or "").encode() for t in texts.values()], 5))}
    held = {}
    for d, s in sets.items():
        for h in s.tolist():
            held.setdefault(h, []).append(d)
    shared = {}
    for ds in held.values():
        for pair in itertools.combinations(sorted(ds), 2):
            shared[pair] = shared.get(pair, 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    root = {d: d for d in texts}
    changed = True
    while changed:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        changed = root != before
    got = {r.key: r.component_id for r in simhash.similar_components(docs, rule=simhash.Similar(share=0.8, most=16)).collect()}
    assert all(root[d] == root[c] for d, c in got.items() if len(sets[d]))
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) > 0


def test_component_of_a_long_chain(spark):
    n = 200
    found = graph.components(spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long").select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))).collect()
    assert len(found) == n + 1 and len({r.root for r in found}) == 1


# 9 tool calls


def test_explicit_calls(spark):
    call = lambda i, args, after=None: {"id": i, "name": "sum", "arguments": args, "after": after}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("c", {"b": 1, "a": "x"}, "b"), call("a", {"a": 2})]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": 'q"\n'})),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("b", {"a": "long text"}, "a"), call("l", {}, "m"), call("m", {"z": 1}, "l")]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "?", "content": "lost"})),
        (1, 4, "assistant", "plain"),
    ]
    schema = {"sum": {"properties": {"a": {"type": "string", "maxLength": 5}, "b": {"type": "integer", "minimum": 1}}, "required": ["a"], "additionalProperties": False}}
    calls, results = toolcalls.explicit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: r for r in toolcalls.link(calls, results, schema).collect()}
    assert {k: (r.status, r.level, r.errors) for k, r in got.items()} == {
        "a": ("linked", 0, "a: not string"), "b": ("pending", 1, "a: too long"), "c": ("pending", 2, ""),
        "l": ("pending", None, "a: missing"), "m": ("pending", None, "a: missing; unknown: z"), "?": ("orphan", None, None),
    }
    assert got["c"].message == '{"call":{"arguments":{"a":"x","b":1},"id":"c","name":"sum"}}'
    assert json.loads(got["a"].message)["result"] == {"content": 'q"\n', "id": "a"}


def test_plain_results_and_canonical_content(spark):
    """A tool's text of another form keeps its content; JSON content has its keys in order; lists and texts that look like JSON stay what they are."""
    texts = ["no JSON at all", json.dumps({"tool_call_id": "a", "content": {"b": [1, {"d": 2, "c": 3}], "a": "x"}}), json.dumps({"tool_call_id": "b", "content": "[2, 1]"}), json.dumps({"tool_call_id": "c", "content": "17"}), "{torn", None]
    calls, results = toolcalls.explicit(spark.createDataFrame([(1, i, "tool", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    got = {r.result_turn: (r.status, r.message) for r in toolcalls.link(calls, results, {}).collect()}
    assert {s for s, _ in got.values()} == {"orphan"}
    assert [got[i][1] for i in range(6)] == ['{"result":{"content":"no JSON at all"}}', '{"result":{"content":{"a":"x","b":[1,{"c":3,"d":2}]},"id":"a"}}', '{"result":{"content":[2,1],"id":"b"}}', '{"result":{"content":"17","id":"c"}}', '{"result":{"content":"{torn"}}', '{"result":{}}']


def test_levels_are_longest_ways(spark):
    """Random graphs with chains, joins and cycles, against a plain search; no folder of it is left."""
    rnd = random.Random(3)
    calls, after = [], {}
    for conv in range(6):
        names = [f"c{i}" for i in range(25)]
        for i, name in enumerate(names):
            few = rnd.choice((0, 1, 1, 1, 2, 3))
            of = rnd.sample(names[:i] or ["nowhere"], min(few, max(1, i))) if few else []
            if conv == 5 and i in (4, 7):
                of = [*of, names[11 - i]]  # a cycle of these two
            after[conv, name] = of
            calls.append((conv, i, name, "t", "{}", json.dumps(of) if len(of) != 1 or i % 2 else of[0]))
    calls += [(9, i, f"k{i}", "t", "{}", f"k{i - 1}") for i in range(200)]
    after |= {(9, f"k{i}"): [f"k{i - 1}"] for i in range(200)}

    def level(key, path=()):
        if key in path:
            return None
        found = [level((key[0], n), (*path, key)) for n in after[key] if (key[0], n) in after]
        return None if None in found else max((f + 1 for f in found), default=0)

    sys.setrecursionlimit(5000)
    before = len(common.WRITTEN)
    rows = toolcalls.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string"), spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), {}).collect()
    got = {(r.conv_id, r.call_id): r.level for r in rows}
    want = {key: level(key) for key in after}
    assert got == want and None in want.values() and got[9, "k199"] == 199
    assert len(common.WRITTEN) - before < 12


def test_messages_with_calls_are_no_plain_results(spark, tmp_path):
    """Two conversations use the same identifiers; what carries calls is not read as the answer to a user."""
    call = json.dumps({"tool_calls": [{"id": "call_1", "name": "reply", "arguments": {"prompt": "p", "turn": 1}}]})
    rows = [(c, t, role, text) for c in (1, 2) for t, role, text in ((0, "user", "hi"), (1, "assistant", call), (2, "tool", json.dumps({"tool_call_id": "call_1", "content": f"of {c}"})), (4, "user", "on"), (5, "assistant", "yes"))]
    at = folder(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.conv_id, r.call_id, r.status, r.call_turn, r.result_turn, r.valid) for r in toolcalls.op9_toolcalls(spark, at).collect())
    assert got == [x for c in (1, 2) for x in ((c, f"{c}/0", "pending", 0, None, True), (c, f"{c}/4", "linked", 4, 5, True), (c, "call_1", "linked", 1, 2, True))]


def test_every_call_and_result_has_its_row(spark):
    """Identifiers repeat over conversations and within one, or are null: nothing collapses or crosses over."""
    calls = [(1, 0, "c", "t", "1", None), (2, 0, "c", "t", "2", None), (1, 2, "d", "t", "3", "c"), (3, 0, "d", "t", "4", "c"), (1, 4, "c", "t", "5", None), (1, 0, None, "t", "6", None), (1, 0, None, "t", "6", None), (None, 0, "c", "t", "7", None)]
    results = [(1, 1, "c", "one"), (2, 1, "c", "two"), (4, 1, "c", "lost"), (1, 3, "c", "again"), (1, 3, None, "x"), (2, 3, None, "y"), (None, 1, "c", "three")]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string")
    found = toolcalls.link(calls, spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), {}).collect()
    got = []
    for r in found:
        m = json.loads(r.message)
        got.append((r.status, r.conv_id, m.get("call", {}).get("arguments", {}), m.get("result", {}).get("content"), r.level, r.n_calls, r.n_results))
    expected = [
        ("linked", 1, 1, "one", 0, 2, 2), ("linked", 2, 2, "two", 0, 1, 1), ("linked", None, 7, "three", 0, 1, 1),
        ("pending", 1, 3, None, 1, 1, 0), ("pending", 3, 4, None, 0, 1, 0), ("pending", 1, 5, None, None, 1, 0), *[("pending", 1, 6, None, None, 1, 0)] * 2,
        ("orphan", 4, {}, "lost", None, 0, 1), ("orphan", 1, {}, "again", None, 0, 1), ("orphan", 1, {}, "x", None, 0, 1), ("orphan", 2, {}, "y", None, 0, 1),
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)



# 10 top-k


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (np.round(rng.normal(size=6), 1) if i % 9 else rng.normal(size=6) * 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    for most in (20_000, 4):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, most_queries=most).collect()}
        want = {}
        for i in range(0, 300, 20):
            order = sorted((-int(whole[i] @ whole[j]), j) for j in range(300) if j != i)[:5]
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(order)}
        assert got == want


@pytest.mark.parametrize("sample", [8192, 20])
def test_topk_with_repeated_ids(spark, monkeypatch, sample):
    """Each row asks, and all rows but itself are candidates, rows of the same id and equal ones too."""
    monkeypatch.setattr(topk, "SAMPLE", sample)
    rng = np.random.default_rng(2)
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [0.5, 0.0]), (100, [3.0, 1.0]), (100, [3.0, 1.0]), (100, [3.0, 1.0])]
    rows += [(int(i), [float(x) for x in rng.integers(-2, 3, 2)]) for i in rng.integers(0, 9, 40) * 25]
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q, (i, v) in enumerate(whole):
        if i % 50 == 0:
            order = sorted((-int(v @ w), j) for c, (j, w) in enumerate(whole) if c != q)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert len(topk.top_k(few, F.col("vec_id") % 50 == 0).collect()) == 4


# 11 curves


def test_hilbert_visits_every_cell_by_steps_of_one():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = curves.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def nearest_of(ids, m, query, k=20):
    """All others by inner product, ties to the lesser id."""
    score = (m * m[query]).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if i != query][:k]
    return [ids[i] for i in order], score[order]


def test_curves_recall(spark):
    """At least 0.9 of the nearest on the given vectors; ranks, scores and counts are exact for what is found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, m = df["vec_id"].to_numpy(), np.stack(df["embedding"]).astype(float)
    got = {}
    for r in curves.op11_curves(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits, total = 0, 0
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for query, rows in got.items():
        want, _ = nearest_of(ids, m, int(np.searchsorted(ids, query)))
        assert [r[0] for r in rows] == list(range(1, 21)) and query not in [r[1] for r in rows]
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert np.allclose([r[2] for r in rows], (m[np.searchsorted(ids, [r[1] for r in rows])] * m[np.searchsorted(ids, query)]).sum(1), rtol=0, atol=1e-14)
        hits, total = hits + len({r[1] for r in rows} & set(want)), total + len(want)
    assert hits / total >= 0.9


@pytest.mark.parametrize("wide", [64, 8192])
def test_curves_on_clusters_and_copies(spark, monkeypatch, wide):
    """Clusters are found in narrow windows; of vectors with many copies the least ids are answers; lengths don't mix."""
    monkeypatch.setattr(curves, "NARROW", 32)
    monkeypatch.setattr(curves, "WIDE", wide)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16)) * 4
    m = (centres[rng.integers(0, 60, 1500)] + 0.05 * rng.standard_normal((1500, 16))).round(6)
    m[300:600] = m[5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, [1.0, 2.0]), (5001, [2.0, 2.0]), (5020, [0.0, 0.0]), (5040, None), (5060, [1.0, None]), (5080, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in curves.nearest(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.pop(5000) == [5001]
    assert sorted(got) == list(range(0, 1500, 20))
    shares = [len(set(found) & set(nearest_of(np.arange(1500), m, q, 5)[0])) / 5 for q, found in got.items()]
    assert np.mean(shares) >= 0.9
    for q in (320, 400):
        assert got[q] == nearest_of(np.arange(1500), m, q, 5)[0]


# 12 ranked


def test_ranked_against_brute_force(spark, monkeypatch):
    """Shards, reads and ties at their smallest; repeated documents and items, a term in no document, null texts."""
    monkeypatch.setattr(ranked, "SHARD_DOCS", 50)
    monkeypatch.setattr(ranked, "FIRST_READ", 2)
    monkeypatch.setattr(common, "BATCH_ROWS", 20)
    rnd = random.Random(9)
    vocabulary = ["w%d" % int(rnd.paretovariate(0.6)) for _ in range(4000)]
    docs = [(rnd.randrange(150), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30)))) for _ in range(300)] + [(None, "w1 w2"), (3, None), (4, "%% --"), (5, "W1, w2;É w2")] * 2
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(8))) for i in range(12)] + [(3, "w1 W2"), (90, None), (91, "nowhere"), (92, "w1"), (92, "w1")]
    words = lambda t: [w.lower() if w.isascii() else w for w in re.findall(ranked.TERM, t or "")]
    every = [(d, words(t)) for d, t in docs]
    every = [(d, w) for d, w in every if w]
    n_docs, n_terms = len(every), sum(len(w) for _, w in every)
    df = {t: sum(t in w for _, w in every) for _, ws in every for t in ws}
    want = []
    for item in {i for i, _ in items}:
        terms = {t for i, text in items if i == item for t in words(text)} & set(df)
        scored = []
        for d, w in every:
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(int(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in terms & set(w))
            scored.append((-score, d is None, d)) if score else None
        want += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    schema = "{} long, text string"
    found = ranked.search(spark.createDataFrame(docs, schema.format("doc_id")).repartition(3), spark.createDataFrame(items, schema.format("item_id")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(ranked, "QUERY_BYTES", 60)
    found = ranked.search(spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_reads_end_when_all_is_settled(monkeypatch):
    """Of two long lists the heads settle who is best; what lies deeper isn't read."""
    monkeypatch.setattr(ranked, "FIRST_READ", 4)
    n = 4000
    impact = np.concatenate([np.full(n, 10), np.full(n, 10)])
    impact[:3] = impact[n : n + 3] = 1000
    shard = ranked.Shard(np.tile(np.arange(n), 2), np.repeat([0, 1], n), impact, n)
    doc, score = shard.best(np.array([0, 1]), 3)
    assert (doc.tolist(), score.tolist()) == ([0, 1, 2], [2000] * 3) and shard.read == 8
    doc, score = shard.best(np.array([0, 1]), 4)  # the fourth ties with all the rest
    assert (doc.tolist(), score.tolist()) == ([0, 1, 2, 3], [2000] * 3 + [20])


# 13 resample


def resampled(docs, bench, least=20):
    """doc_id, n_features, weight, score and rank in plain Python."""
    def found(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(resample.WORD, low)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    source, target = [(d, *found(t)) for d, t in docs], [found(t)[1] for t in bench]
    s, t = np.bincount([b for x in source for b in x[2]], minlength=10000), np.bincount([b for x in target for b in x], minlength=10000)
    gain = [int(np.floor(1000 * np.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000))))) for b in range(10000)]
    rows = []
    for d, n, features in source:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        rows.append((d, n, len(features), weight, weight + int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = [(*r[:1], *r[2:], i + 1 if i < 5 * len(fit) // 100 else None) for i, r in enumerate(fit)]
    return sorted([*ranks, *((*r[:1], *r[2:], None) for r in rows if r[1] < least)], key=str)


def test_resample_against_brute_force(spark):
    """Odd texts, words over the table of short lengths, pieces without spaces, repeated rows; ranks over several partitions."""
    rnd = random.Random(12)
    word = lambda: rnd.choice(["Ab", "cd", "É", "日本語", "x" * 300, "e9", "ef,gh", "i\u0000j"])
    texts = [*ODD, "q" * 70_000 + " ab", ",".join(word() for _ in range(3000)), *(" ".join(word() for _ in range(rnd.randrange(60))) for _ in range(300))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20])] * 5 + [(None, texts[40])]
    bench = ["ab cd ef gh", "É É 日本語", None, ""]
    schema = "doc_id long, text string"
    got = resample.resample(spark.createDataFrame(docs, schema).repartition(5), spark.createDataFrame([(t,) for t in bench], "text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == resampled(docs, bench)


def test_crc_of_joined_parts():
    rnd, shifts = random.Random(2), resample.Shifts()
    parts = [(rnd.randbytes(rnd.randrange(20)), rnd.randbytes(n)) for n in (0, 1, 2, 7, 8, 255, 256, 300, 70_000)]
    for some in (parts[:6], parts):
        first, second = (np.array([zlib.crc32(p[i]) for p in some], np.uint32) for i in (0, 1))
        joined = shifts.over(first, np.array([len(p[1]) for p in some])) ^ second
        assert joined.tolist() == [zlib.crc32(a + b) for a, b in some]
