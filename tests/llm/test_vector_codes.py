import hashlib
import math
from collections import defaultdict

import pytest

from textloom.llm import common, vector_codes
from textloom.llm.vector_codes import compress, decoded, op12_vector_codes, with_label_errors


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label), number by number."""
    fine = [(i, v, c) for i, v, c in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in fine if len(v) == len(fine[0][1])]
    if not fine:
        return []
    width = len(fine[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in fine[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            by = defaultdict(list)
            for _, v, _ in fine:
                by[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(x) for x in zip(*by[k], strict=True)] if k in by else e for k, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, c in fine:
        found = [near(v, p) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), c])
    label = defaultdict(int)
    for _, _, e, c in out:
        label[c] += e
    return sorted(((i, code, e, label[c], digest) for i, code, e, c in out), key=str)


def listed(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert listed(op12_vector_codes(spark, sf_dir)) == brute(rows) and rows


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [((i * 37 + j * 11) % 23 - 11) / 7 for j in range(32)], i % 3 if i % 5 else None) for i in range(90)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], 2), (None, rows[7][1], None)]
    rows += [(-4, None, 1), (-3, [], 1), (-2, [0.0] * 31 + [None], 1), (-1, [nan] * 32, 1), (200, [inf] + [0.0] * 31, 1), (-9, [1.0] * 31, 1), (201, [1.0] * 48, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as vector", "1 as n", "2 as code", "3 as part")
    plain = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert listed(with_label_errors(*compress(df))) == brute(plain)
    for none in ("vec_id = 1000", "vec_id = -3"):
        assert listed(with_label_errors(*compress(df.where(none)))) == []
    few = df.where("vec_id between 10 and 12")
    assert listed(with_label_errors(*compress(few))) == brute([r for r in plain if r[0] in (10, 11, 12)])


def test_ties_and_other_shapes(spark):
    """Entries at equal distance, sums that floor downwards, entries that nobody takes."""
    rows = [(i, [float(x) for x in (i % 2, -(i % 3), 0, i % 2)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    codes, books = compress(df, parts=2, entries=8, rounds=3, scale=1)
    plain = brute([(i, [x / 256 for x in v], c) for i, v, c in rows], 2, 8, 3)
    got = {(r.vec_id, r.code, r.error) for r in codes.collect()}
    assert got == {r[:3] for r in plain}
    assert all(len(decoded(r.code, books)) == 4 for r in codes.collect())
    with pytest.raises(ValueError):
        compress(df, entries=300)


def test_numbers_beyond_machine_arithmetic(spark):
    rows = [(i, [((i * j) % 7 - 3) * 1e6 for j in range(16)], None) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, want = listed(with_label_errors(*compress(df))), brute(rows)
    assert got == want and max(abs(256 * x) for _, v, _ in rows for x in v) > vector_codes.LIMIT


def test_hot_and_rare_keys_meet_their_totals(spark):
    """Keys beyond a thousandth of the rows, and those below, null among the hot ones; no row twice, none lost."""
    keys = [None] * 900 + [1] * 700 + [k for k in range(10, 1400) for _ in range(1 + k % 2)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "n * 2 as twice")
    got = common.joined_by_share(rows, keyed, "k", "n", len(keys)).collect()
    count = {k: keys.count(k) for k in set(keys)}
    assert sorted((r.i, r.k or -1, r.n, r.twice) for r in got) == sorted((i, k or -1, count[k], 2 * count[k]) for i, k in enumerate(keys))
    assert {n * 1000 >= len(keys) for n in count.values()} == {True, False}
