import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import phrases
from textloom.llm.phrases import mine

SCHEMA = "doc_id long, text string, lang string"


def brute(docs, least, first=2000, longest=5):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", text):
            words = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {(lang, w): a for (lang, w), a in counts.items() if len(w) > 1 and a >= least}
    rows = []
    for (lang, w), a in found.items():
        longer = [b for (x, v), b in found.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], totals[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:first])]
    return sorted(out)


def listed(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(rng, n):
    """Texts of a small vocabulary, so that many runs repeat, with signs, tabs and line ends between."""
    words = ["Alpha", "beta", "GAMMA", "delta", "\u00c9t\u00e9", "\u4e2d\u6587", "e\u00a0f", "x\x00y", "z\u0085z", "1"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "?!", " \x1c "]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("width", [None, 4])
def test_against_brute_force(spark, width):
    """Also with a sketch so narrow that nearly everything survives it."""
    rng = random.Random(13)
    docs = [(i, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate(made(rng, 300))]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    want = brute([d[1:] for d in docs], 6)
    assert listed(mine(df, least=6, width=width)) == want and len(want) > 100
    assert listed(mine(df, least=6, first=7, width=width)) == [r for r in want if r[1] <= 7]


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("text", "lang").collect()]
    assert listed(mine(odd_docs, least=2)) == brute(docs, 2)
    assert listed(mine(no_docs)) == []
    assert listed(mine(odd_docs.where("text = ''"), least=1)) == []


def test_long_text_and_many_counts(spark, monkeypatch):
    """Texts that are cut between pieces, counts sent more than once, cells that stop at their highest value."""
    monkeypatch.setattr(phrases, "SLICE", 500)
    monkeypatch.setattr(phrases, "HELD", 20)
    rng = random.Random(4)
    docs = [(1, "\n".join(made(rng, 100)), "en"), (2, " ".join(["one", "two"] * 2000), "en"), (3, "one two. " * 700, "fr")]
    batch = phrases.rows_of(spark.createDataFrame(docs, SCHEMA)).toArrow().combine_chunks().to_batches()[0]
    slices = list(phrases.by_language(batch))
    assert len(slices) > 10
    counts = Counter()
    for lang, text in slices:
        words = phrases.Words()
        for k, (places, _) in enumerate(phrases.runs(phrases.numbered(text, words), words, lang, 5)):
            counts[k] += len(places)
    want = Counter()
    for _, text, _ in docs:
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", text):
            n = len(re.findall("[^\\x20\\x09]+", piece))
            want.update({k: max(0, n - k) for k in range(5)})
    assert counts == want
    assert listed(mine(spark.createDataFrame(docs, SCHEMA), least=300)) == brute([d[1:] for d in docs], 300)


def test_bits_never_miss(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made(rng, 200))], SCHEMA).repartition(4)
    rows = phrases.rows_of(docs)
    bits = phrases.frequent_cells(rows, 8, 5, 3)
    counts, cell_of = Counter(), {}
    for lang, text in phrases.by_language(rows.toArrow().combine_chunks().to_batches()[0]):
        words = phrases.Words()
        for _, hashes in phrases.runs(phrases.numbered(text, words), words, lang, 3):
            counts.update(hashes.tolist())
    for h, n in counts.items():
        at = [int(phrases.cells(np.array([h], np.uint64), row, 8)[0]) for row in range(phrases.DEPTH)]
        cell_of[h] = all(bits[row][a >> 3] >> (7 - (a & 7)) & 1 for row, a in enumerate(at))
        assert cell_of[h] or n < 5
    assert not all(cell_of.values())


def test_exact_beyond_64_bits(spark):
    rows = [("en", 0, "", 3_000_000_000_000), ("en", 1, "a", 2_000_000_007), ("en", 1, "b", 1_999_999_993), ("en", 2, "a b", 1_900_000_001), ("en", 3, "a b b", 100), ("en", 2, "b b", 101)]
    df = spark.createDataFrame(rows, "lang string, size int, phrase string, a long")
    got = {r.phrase: r.score for r in phrases.score(df).collect()}
    assert got["a b"] == 1000 * 1_900_000_001 * 3_000_000_000_000 // (2_000_000_007 * 1_999_999_993)
    assert got["b b"] == 1000 * 101 * 3_000_000_000_000 // 1_999_999_993**2 and "a b b" in got
