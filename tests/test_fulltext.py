import itertools
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from textloom.operators import segment
from textloom.operators.fulltext import FullTextIndex, IndexConfig

SCHEMA = "lang string, hash long, content string"


def made(rng, n):
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "x.y"]
    return [(rng.choice(["en", "de", "fr"]), i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(n)]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def phrase_hits(rows, langs, terms):
    out = set()
    for lang, h, text in rows:
        own = fold(text)
        at = [i for i in range(len(own) - len(terms) + 1) if own[i : i + len(terms)] == terms]
        if lang in langs and at:
            out.add((lang, h, at[0], len(at)))
    return out


def test_index_follows_changes(spark, tmp_path):
    """Build, refresh twice, search and compact; what has no row in the log is not read; another configuration rebuilds."""
    rng = random.Random(7)
    first = made(rng, 120) + [("en", 900, None), ("en", 901, "")]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    index = FullTextIndex(spark, f"file://{tmp_path}/index", IndexConfig(("en", "de"), buckets=4))
    assert index.needs_rebuild(frame(first)) and index.ensure(frame(first)) and not index.ensure(frame(first))
    state = first
    for step in range(2):
        after = [(lang, h, text if rng.random() < 0.6 else text and text + " mat cat sat") for lang, h, text in state if rng.random() < 0.9]
        after += [("de", 1000 + 10 * step + i, "the cat sat on the cat sat") for i in range(3)]
        index.refresh(frame(state), frame(after))
        state = after
        for terms in (["cat", "sat"], ["the"], ["sat", "cat", "sat"], ["none", "the"]):
            got = {(r.lang, r.hash, r.at, r.n) for r in index.phrase(terms).collect()}
            assert got == phrase_hits(state, ("en", "de"), terms)
            every = {(r.lang, r.hash) for r in index.every(terms).collect()}
            assert every == {(lang, h) for lang, h, text in state if lang in ("en", "de") and set(terms) <= set(fold(text))}
    generations = len(index.log())
    index._write(index._lists([index.log()[0].generation]).select("bucket", "term", "lang", "hash", "n", "deltas"), 77)  # never committed
    assert len(index.log()) == generations == 3
    before = index.phrase(["cat", "sat"]).collect()
    index.compact()
    assert len(index.log()) == 1 and sorted(map(tuple, index.phrase(["cat", "sat"]).collect())) == sorted(map(tuple, before))
    for lang in ("en", "fr"):
        got = {r.hash for r in index.find(frame(state), "“cat Sat”", lang).collect()}
        assert got == {h for x, h, text in state if x == lang and {"cat", "sat"} <= set(fold(text))}
    other = FullTextIndex(spark, index.path, IndexConfig(("en",), buckets=4))
    assert other.needs_rebuild(frame(state)) and {r.hash for r in other.find(frame(state), "cat", "en").collect()} == {h for x, h, t in state if x == "en" and "cat" in fold(t)}
    assert index.find(frame(state), "", "en").count() == 0


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    index = FullTextIndex(spark, f"file://{tmp_path}/index", IndexConfig(("en",), buckets=16))
    index.build(spark.createDataFrame([("en", i, f"w{i} the") for i in range(50)], SCHEMA))
    plan = index.every(["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def best_paths(text, counts):
    total = sum(counts.values())
    found = []
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        words, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                words.append(text[start:i])
                start = i
        words.append(text[start:])
        if all(len(w) == 1 or w in counts for w in words):
            found.append((round(sum(math.log(counts.get(w, 1)) - math.log(total) for w in words), 9), [len(w) for w in words], words))
    return max(found)[2]


def test_best_path_against_all_paths(spark):
    rng = random.Random(4)
    for _ in range(40):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        own = segment.Lattice(counts)
        for _ in range(12):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
            assert own.path(text) == best_paths(text, counts)


def test_dictionary_changes_terms(spark):
    texts = spark.createDataFrame([("中文分词 器",), ("",), (None,), ("ab",)], "c string")
    make = lambda rows: spark.createDataFrame(rows, "word string, n long")
    terms = lambda d: [r[0] for r in texts.select(segment.terms(F.col("c"), make(d))).collect()]
    assert terms([("中文", 5), ("分词", 3), ("中文分词", 9), ("", 4), ("文", 0)]) == [["中文", "分词", "中文分词", "器", "中文分词器"], [], None, ["ab"]]
    assert terms([("中文", 5)])[0] == ["中文", "分词", "词器", "中文分词器"]
    assert terms([])[0] == ["中文", "文分", "分词", "词器", "中文分词器"]


def test_segmented_texts_against_brute_force(spark):
    from textloom.plans import indexes, queries as plans  # noqa: F401

    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_terms for r in plans.queries()["segmented_texts"](spark, path).collect()}
    counts: dict[str, int] = {}
    for r in spark.read.parquet(f"{path}/benchmark.parquet").collect():
        for word in "".join(c if "a" <= c <= "z" else " " for c in " ".join(fold(r.text))).split():
            counts[word] = counts.get(word, 0) + 1
    own = segment.Lattice(counts)
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert got == {r.doc_id: len(own.terms("".join(fold(r.text)))) for r in docs}


def test_words_of_a_batch_are_made_in_slices():
    texts = pd.Series(["aaa", None, "bb", "c" * 10, "", "d"])
    assert list(segment.slices(texts, 5)) == [(0, 3), (3, 4), (4, 6)] and list(segment.slices(texts[:0], 5)) == []


def test_lists_need_no_shuffle(spark, monkeypatch):
    """Posting lists come from each text alone, in parts of any size; a build deals no words or postings between tasks."""
    from textloom.operators import fulltext

    rng = random.Random(4)
    rows = [*made(rng, 40), ("en", 900, None), ("en", 901, " "), ("fr", 902, "the é the")]
    want = {}
    for lang, h, text in rows:
        for at, word in enumerate(fold(text) if lang != "de" else []):
            want.setdefault((word, lang, h), []).append(at)
    for most in (1, 30, 1_000_000):
        monkeypatch.setattr(fulltext, "WORDS_AT_ONCE", most)
        found = fulltext.postings_of(spark.createDataFrame(rows, SCHEMA), IndexConfig(("en", "fr")))
        got = {(r.term, r.lang, r.hash): list(itertools.accumulate(r.deltas)) for r in found.collect()}
        assert got == want and all(r.n == len(r.deltas) for r in found.collect())
    assert "Exchange" not in found._jdf.queryExecution().toString()
