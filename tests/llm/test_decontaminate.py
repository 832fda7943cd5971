import hashlib
import re

from textloom.llm.decontaminate import decontaminate, op6_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, size=10):
    wins = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_same_as_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in op6_decontamination(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, bench)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "words enough"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (3, None), (4, "..."), (5, "words enough"), (None, "xyz")], "item_id int, text string"
    )
    rows = decontaminate(odd_docs, bench).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by[None].n_hit == 2 and by[None]["items"] == ["1", "5"]
    assert by[5].n_hit == 11 * 3000 and by[5]["items"] == ["2"]
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert decontaminate(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(odd_docs, bench.limit(0)).collect())


def test_windows_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, op6_decontamination(spark, sf_dir).collect()))
    monkeypatch.setattr("textloom.llm.decontaminate.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, op6_decontamination(spark, sf_dir).collect())) == want
