import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm.sharding import op10_sharding, shard


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    count = Counter(r.shard for r in rows)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def cut_share(rows, texts):
    """Pairs of equal texts that lie in different shards, of all such pairs."""
    where = {r.doc_id: r.shard for r in rows}
    by = defaultdict(list)
    for d, t in texts:
        by[t].append(where[d])
    pairs = sum(len(v) * (len(v) - 1) // 2 for v in by.values())
    kept = sum(n * (n - 1) // 2 for v in by.values() for n in Counter(v).values())
    return 1 - kept / pairs


def test_whole_table(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op10_sharding(spark, sf_dir).collect()
    check(rows, texts, 40)
    assert cut_share(rows, texts) < 0.05


@pytest.mark.parametrize("singles", [103, 703])
def test_hot_group_and_pairs(spark, singles):
    texts = [(i, "hot") for i in range(200)] + [(200 + i, f"pair {i // 2}") for i in range(300)] + [(500 + i, f"single {i}") for i in range(singles)]
    rows = shard(spark.createDataFrame(texts, "doc_id long, text string"), shards=6).collect()
    check(rows, texts, 6)
    where = {r.doc_id: r.shard for r in rows}
    together = sum(where[200 + 2 * i] == where[201 + 2 * i] for i in range(150))
    assert together == 150
    shards = Counter(where[i] for i in range(200))
    # With room, 200 documents lie in the two shards that they need, or a third; without, they gather as far as others make way.
    assert len(shards) <= 3


def kept_pairs(rows):
    """Pairs of equal texts in one shard, by the checksums of texts."""
    by = Counter((r.text_crc32, r.shard) for r in rows)
    return sum(n * (n - 1) // 2 for n in by.values())


@pytest.mark.parametrize(
    ("texts", "best"),
    [
        ([f"pair {i // 2}" for i in range(80)], 40),
        ([f"pair {i // 2}" for i in range(300)], 140),  # twenty shards of seven leave a place each
        (["hot"] * 100 + [f"pair {i // 2}" for i in range(200)], 442),
        (["hot"] * 100 + [f"triple {i // 3}" for i in range(200)], 532),
        ([f"pair {i // 2}" for i in range(360)] + [f"single {i}" for i in range(40)], 180),
        ([f"five {i // 5}" for i in range(400)], 800),
    ],
    ids=["40 pairs", "150 pairs", "100 and pairs", "100 and triples", "pairs and singles", "80 fives"],
)
def test_links_kept_against_the_best(spark, texts, best):
    """best: the most that any sharding under the law can keep, or a bound above it."""
    texts = list(enumerate(texts))
    rows = shard(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts, 40)
    assert 0.9 * best <= kept_pairs(rows) <= best


@pytest.mark.parametrize(
    "texts",
    [
        [f"pair {i // 2}" for i in range(80)],
        [f"pair {i // 2}" for i in range(400)],
        [f"triple {i // 3}" for i in range(300)],
        ["one text"] * 130,
        [f"pair {i // 2}" for i in range(14)],
        ["one text"] * 90 + [f"many {i // 7}" for i in range(210)] + ["alone"],
    ],
    ids=["40 pairs", "200 pairs", "triples", "one group", "fewer rows than shards", "a third in one group"],
)
def test_all_rows_linked(spark, texts):
    """Nobody is left to fill gaps: the law holds all the same."""
    texts = list(enumerate(texts))
    rows = shard(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts, 40)


def test_odd_rows(spark, odd_docs, no_docs):
    texts = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    check(shard(odd_docs, shards=4).collect(), texts, 4)
    assert shard(no_docs, shards=4).count() == 0
