import random
import re

import pytest

import corpus_pipeline
from lumatrace.llm import decontaminate


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda v: "".join(rnd.choice(v) for _ in range(rnd.randint(2, 4)))
    de, en = ["ei", "sch", "ung", "ver"], ["th", "ing", "ea", "on"]
    say = lambda v, n: " ".join(word(v) for _ in range(n))
    item, passage = say(en, 20), say(en, 150)
    texts = [(say(v, 80), name) for v, name in ((de, "de"), (en, "en")) for _ in range(30)]
    texts += [("123 456 !!", "en"), (None, "en"), (texts[0][0], "de"), (say(en, 60) + " " + item + " " + say(en, 60), "en")]
    texts += [(say(en, 90) + " " + passage + " " + say(en, 90), "en") for _ in range(2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, y, "s", len(t or "")) for i, (t, y) in enumerate(texts)], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found[name] = {r.doc_id: r for r in docs.collect()}
    everyone = set(range(len(texts)))
    assert set(found["language"]) == everyone - {60, 61}
    assert set(found["near_copies"]) == everyone - {60, 61, 62}
    assert all(passage[10:-10] not in r.text for r in found["repeats"].values()) and set(found["repeats"]) == set(found["near_copies"])
    words = lambda t: b" ".join(t.encode().translate(decontaminate.TO_WORDS).split()).decode()
    assert words(item) in words(found["repeats"][63].text) and words(item) not in words(found["benchmark"][63].text)
    assert found["benchmark"][63].n_chars == len(found["benchmark"][63].text)
    assert found["benchmark"][5].text == texts[5][0]
    assert set(found["encode"]) == set(found["benchmark"]) and all(r.n_tokens == len(r.token_ids) > 0 for r in found["encode"].values())
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r.ids_sha256 for i, r in found["encode"].items()}


def test_planted_near_copies_and_passages(spark, tmp_path):
    """Near copies of at least 0.9 in five words go; passages of 51 to 60 words that repeat go, and nothing else does."""
    rnd = random.Random(5)
    say = lambda n: " ".join("".join(rnd.choice(["th", "ing", "ea", "on", "er", "st", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    clean = [say(300) for _ in range(40)]
    near = []
    for text in clean[:10]:
        words = text.split()
        for k in rnd.sample(range(300), 3):
            words[k] = "changed"
        near.append(" ".join(words))
    passages = [say(n) for n in range(51, 61)]
    planted = [f"{say(120)} {p} {say(120)}" for p in passages for _ in range(2)]
    texts = clean + near + planted
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_copies"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert {*range(40), *range(50, 70)} <= ids and len(ids & set(range(40, 50))) <= 1
    cut = {r.doc_id: r.text for r in stages["repeats"](spark, docs.filter("doc_id < 40 OR doc_id >= 50"), str(tmp_path)).collect()}
    assert all(cut[i] == clean[i] for i in range(40))
    lengths = [len(p) for p in passages]
    gone = [all(p[20:-20] not in cut[50 + 2 * i + k] for k in (0, 1)) for i, p in enumerate(passages)]
    assert all(g for g, n in zip(gone, lengths) if n >= corpus_pipeline.PASSAGE_BYTES) and sum(gone) >= 8


@pytest.mark.parametrize("at", range(5))
def test_stages_take_empty_tables(spark, tmp_path, at):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "a", None, "s", 1), (1, "a", None, "s", 1)], schema)
    assert stage(spark, odd, str(tmp_path)).count() >= 1


def test_the_rest_does_not_import_it():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "lumatrace"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
