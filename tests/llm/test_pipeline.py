import os
import sys

from test_decontaminate import brute as leaks
from test_jaccard import brute as groups
from test_packing import check

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from textloom.llm import common, pii, quality  # noqa: E402


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    names = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        verdicts = {r.doc_id for r in quality.judge(docs).collect() if r.kept} if name == "quality_rules" else None
        docs = common.written(stage(spark, docs, sf_dir), "test")
        if name != "best_fit_packing":
            assert docs.columns == names
            after = pairs(docs)
            assert 0 < len(after) <= len(before)
        if name == "quality_rules":
            assert sorted(after) == sorted(x for x in before if x[0] in verdicts)
        elif name == "ngram_jaccard":
            stay = {d for d, _, c in groups(before) if d == c}
            assert sorted(after) == sorted(x for x in before if x[0] in stay)
        elif name == "benchmark_decontamination":
            leaked = {r[0] for r in leaks(before, bench) if r[-1]}
            assert leaked and sorted(after) == sorted(x for x in before if x[0] not in leaked)
        elif name == "personal_data":
            assert [d for d, _ in sorted(after)] == [d for d, _ in sorted(before)]
            assert not any(pii.pattern_spans(t) for _, t in after)
            assert {d: t for d, t in before if not any(c in t for c in "0123456789@")}.items() <= dict(after).items()
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            used, need = check(docs.collect(), before)
            assert used <= need + 2


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    for source in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, sf_dir)
            assert out.columns == source.columns, name
            assert set(ids(out)) <= set(ids(source))
    assert ids(corpus_pipeline.ngram_jaccard(spark, odd_docs, sf_dir)).count("1") == 1
    assert ids(corpus_pipeline.benchmark_decontamination(spark, odd_docs, sf_dir)) == ids(odd_docs)
    assert ids(corpus_pipeline.personal_data(spark, odd_docs, sf_dir)) == ids(odd_docs)
    assert corpus_pipeline.best_fit_packing(spark, no_docs, sf_dir).count() == 0


def test_rows_of_one_doc_id(spark, sf_dir):
    """Linked by text alone: of equal texts the smallest doc_id stays, null only where there is no other."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("b")), (2, words("a")), (None, words("b")), (None, words("c")), (None, words("c") + " more"), (3, ""), (3, None), (0, words("d")), (0, words("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.ngram_jaccard(spark, docs, sf_dir).collect()]
    assert sorted((x for x in got if x[0] is not None), key=str) == sorted([(1, words("a")), (1, words("b")), (3, ""), (3, None), (0, words("d"))], key=str)
    assert [x[1] for x in got if x[0] is None] in ([words("c")], [words("c") + " more"])
