import random
from collections import defaultdict

from textloom.llm.jaccard import join, op9_ngram_jaccard


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = lower(text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """(doc_id, set size, component) of each row."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                holders[x].append(i)
    pairs = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    for a, b in pairs:
        (x, s), (y, t) = sets[a], sets[b]
        both = len(s & t)
        if 100 * both >= 80 * (len(s) + len(t) - both):
            p, q = sorted((find(x), find(y)))
            root[q] = p
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def test_same_as_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op9_ngram_jaccard(spark, sf_dir).collect()), key=str)
    want = brute(docs)
    assert got == want
    assert sum(d != c for d, _, c in want) > 5


def test_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.jaccard.BLOCK_ROWS", 8)
    monkeypatch.setattr("textloom.llm.jaccard.HOT", 3)
    rng = random.Random(7)
    docs, base = [], [f"w{i}" for i in range(60)]
    for i in range(120):  # a chain: each text drops a word and takes a new one
        docs.append((1000 - i, " ".join(base)))
        base = [*base[1:], f"n{i}"]
    hot = [f"h{i}" for i in range(80)]
    for i in range(60):
        own = list(hot)
        own[rng.randrange(80)] = f"x{i}"
        docs.append((2000 + i, " ".join(own)))
    docs += [(3000 + i, "same short text") for i in range(40)] + [(4000, "Same SHORT text"), (4001, "same short")]
    # A line that unlike texts share, in hot columns of some parts and not of others.
    docs += [(5000 + i, " ".join([f"u{i}_{k}" for k in range(30)] + hot[:40])) for i in range(30)] + [(5100 + i, " ".join(hot[:40] + [f"v{i}"])) for i in range(9)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in join(odd_docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(docs)
    assert join(no_docs).count() == 0


def test_near_copies_of_a_repeated_id(spark):
    """Doc 1 is the smallest holder of three sets; all of them have near copies under other ids, and an empty text."""
    text = lambda name, i=None: " ".join(f"{name}{x}" if x != i else "other" for x in range(60))
    docs = [(1, text("a")), (1, text("b")), (1, text("c")), (1, ""), (7, text("a", 59)), (8, text("b", 0)), (9, text("b")), (6, text("c", 1))]
    docs += [(20, text("d")), (21, text("d", 59)), (21, text("e")), (5, text("e", 0)), (3, text("f")), (4, text("f", 0)), (None, text("a")), (30, None), (30, "a b"), (31, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(docs)
    assert {d: c for d, _, c in got} == {1: 1, 7: 1, 8: 1, 9: 1, 6: 1, 20: 5, 21: 5, 5: 5, 3: 3, 4: 3, None: None, 30: 30, 31: 31}
