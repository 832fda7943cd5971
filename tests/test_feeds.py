import random
from collections import Counter, defaultdict

from textloom.operators import feeds, intervals, running


def test_numbers_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", 50)
    rng = random.Random(1)
    rows = [("hot", i) for i in rng.sample(range(10_000), 1000)] + [(f"k{i % 7}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v long")
    assert running.most_of_one(df, ["k"]) == 1000
    got = {(r.k, r.v): r.nth for r in running.numbered(df, ["k"], "v", "nth", 1000).collect()}
    by = defaultdict(list)
    for k, v in sorted(rows, key=lambda r: r[1]):
        by[k].append(v)
    assert got == {(k, v): i + 1 for k, own in by.items() for i, v in enumerate(own)}


def brute_alike(old, new, share):
    def lines(text):
        return Counter(text.split("\n"))

    size = lambda c: sum(n * (len(x.encode()) + 1) for x, n in c.items())
    out = set()
    for p, x in old:
        for q, y in new:
            a, b = lines(x), lines(y)
            kept, larger = size(a & b), max(size(a), size(b))
            if kept * 100 >= larger * share:
                out.add((p, q, kept * 100 // larger, kept))
    return out


def test_alike_against_brute_force(spark):
    """All pairs, with lines that every file holds, repeated lines and empty ones."""
    rng = random.Random(6)
    line = lambda: rng.choice(["", "}", "return", "the end", *(f"line {rng.randint(0, 60)}" for _ in range(4))])
    old = [(f"a{i}", "\n".join(line() for _ in range(rng.randint(1, 12)))) for i in range(60)]
    new = [(f"b{i}", "\n".join([x for x in rng.choice(old)[1].split("\n") if rng.random() < 0.8] + [line()])) for i in range(60)]
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    for share in (50, 70, 100):
        got = {tuple(r) for r in feeds.alike(make(old), make(new), share).collect()}
        assert got == brute_alike(old, new, share) and got


def test_actions_and_scope(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    old = make([("d/a", "one\ntwo\nthree"), ("d/b", "same"), ("d/c", "stays"), ("d/e", ""), ("x/f", "far"), ("d/g", None)])
    new = make([("d/a2", "one\ntwo\nfour"), ("d/b2", "same"), ("d/b3", "same"), ("d/c", "stays!"), ("d/e2", ""), ("d/f", "far"), ("d/g", "")])
    got = {tuple(r) for r in feeds.name_status(old, new, ("d/",)).collect()}
    assert got == {
        ("R", "d/a", "d/a2", 57), ("R", "d/b", "d/b2", 100), ("A", None, "d/b3", None), ("M", "d/c", "d/c", None), ("D", "d/e", None, None), ("A", None, "d/e2", None), ("A", None, "d/f", None),
    }
    assert ("R", "x/f", "d/f", 100) in {tuple(r) for r in feeds.name_status(old, new).collect()}
    assert feeds.name_status(old.limit(0), new.limit(0)).count() == 0


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    there = {(k, v) for k in range(60) for v in range(1, 10) if rng.random() < 0.75}
    members = [(k % 17, k) for k in range(60)] + [(k % 5 + 100, k) for k in range(60) if rng.random() < 0.1] + [(500, 999)]
    rows = spark.createDataFrame(sorted(there), "key long, version long")
    own = spark.createDataFrame(members, "grp long, key long")
    got = {tuple(r) for r in intervals.together(own, intervals.lifelines(rows, "key"), "grp", "key").collect()}
    by = defaultdict(set)
    for g, k in members:
        by[g].add(k)
    want = set()
    for g, keys in by.items():
        full = [v for v in range(1, 10) if all((k, v) in there for k in keys)]
        for v in full:
            if v - 1 not in full:
                end = v
                while end + 1 in full:
                    end += 1
                want.add((g, v, end))
    assert got == want and want
