import random
import zlib

import numpy as np

from textloom.llm import toxicity
from textloom.llm.toxicity import FEATURES, Tokens, features, op3_toxicity, score


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


def test_features():
    tokens = Tokens({"=idiot": 2.0, "stup": 1.0})
    own = ["You idiot, you stupid thing!", "", "An 1d1ot and an i.d.i.o.t here", "plain words " * 60 + "idiot idiot"]
    got = {name: features(own, tokens)[:, i] for i, name in enumerate(FEATURES)}
    assert got["hits"].tolist() == [2, 0, 0, 2] and got["hidden_hits"].tolist() == [0, 0, 2, 0]
    assert got["weight"].tolist() == [3, 0, 0, 4] and got["near_second"].tolist() == [2, 0, 0, 0]
    assert got["density"][0] == 40 and got["window"].tolist() == [2, 0, 2, 2]
    assert got["exclaim_rate"][0] > 0 and got["odd_words"][2] > 0 and got["capital_rate"][0] > 0


def test_held_out_accuracy(spark):
    spark.sparkContext.setLogLevel("ERROR")
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op3_toxicity(spark, d).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    yes, no = np.array([s for s, x in own if x]), np.array([s for s, x in own if not x])
    assert len(yes) and (yes[:, None] > no).mean() > 0.75
    assert np.mean([(s >= 0.5) == x for s, x in own]) > 0.93


def test_lexicon_is_learned_and_calibrated(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        docs.append((i, " ".join([word() for _ in range(30)] + ["zorkle"] * (2 if toxic and i % 8 else 0)), "en"))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    marked = [got[i] for i in range(400) if i % 8 == 4]
    rest = [got[i] for i in range(400) if i % 8 != 4]
    assert min(marked) > max(rest) and np.mean(marked) > 0.9 and np.mean(rest) < 0.3


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    want = sorted(str(r.doc_id) for r in odd_docs.collect())
    for labels in (none, some):
        rows = score(odd_docs, labels).collect()
        assert sorted(str(r.doc_id) for r in rows) == want and all(0 <= r.score <= 1 for r in rows)
    assert score(no_docs, some).count() == 0
    texts = odd_docs.select("doc_id").collect()
    assert len(features([""] * len(texts), toxicity.Tokens({}))) == len(texts)
