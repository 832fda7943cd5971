import math
import re
import zlib
from collections import Counter

import numpy as np

from textloom.llm import lm_score
from textloom.llm.lm_score import op8_lm_scoring, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*WORD.findall(lower(text)), None]


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def base(docs):
    c = Counter(t for d, text in docs if not is_held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for d, text in docs:
        own = tokens(text)
        out.append((d, is_held(d), len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)))
    return sorted(out, key=str)


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op8_lm_scoring(spark, sf_dir).collect()
    same(rows, base(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    rows = score(odd_docs).collect()
    same(rows, base(docs))
    assert all(math.isfinite(r.score) for r in rows)
    assert score(no_docs).count() == 0
    none = score(odd_docs.where("doc_id = 1000")).count()
    assert none == 0


def test_every_word_has_contexts(spark):
    """Four thousand words, far more than a fixed set of symbols: all runs count, in one part or many."""
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{x}" for x in rng.permutation(4000)[:200]) for _ in range(60)]
    train = [i for i in range(400) if not is_held(i)][:120]
    held = [i for i in range(400) if is_held(i)][:20]
    docs = [(d, lines[j % 60]) for j, d in enumerate(train)]
    for j, d in enumerate(held):
        own = lines[j].split()
        docs.append((d, lines[j] if j % 2 else " ".join(rng.permutation(own))))
    docs.append((held[-1], ""))
    rows = score(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    same(rows, base(docs))
    counts = [Counter() for _ in range(3)]
    for d, text in docs:
        if not is_held(d):
            read = ["<", "<", *tokens(text)]
            for i in range(2, len(read)):
                for k in range(3):
                    counts[k][tuple(read[i - k : i + 1])] += 1
    texts, n_all, kinds = len(train), sum(counts[0].values()), len(counts[0])
    s = []
    for k in (1, 2):
        contexts = Counter(c.bit_length() for c in counts[k - 1].values())
        by = [(contexts[b], sum(c for c in counts[k - 1].values() if c.bit_length() == b)) for b in contexts]
        s.append(lm_score.strength(by, sum(c == 1 for c in counts[k].values())))

    def log_p(text):
        read, out = ["<", "<", *tokens(text)], 0
        for i in range(2, len(read)):
            p = (counts[0][(read[i],)] + 0.5) / (n_all + 0.5 * (kinds + 1))
            for k in (1, 2):
                context = texts if i == 2 else counts[k - 1][tuple(read[i - k : i])]
                p = (counts[k][tuple(read[i - k : i + 1])] + s[k - 1] * p) / (context + s[k - 1])
            out += math.log10(p)
        return out

    want = sorted(((d, log_p(t)) for d, t in docs), key=str)
    got = sorted(((r.doc_id, r.score) for r in rows), key=str)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want, strict=True))
    mean = lambda odd: sum(r.score for r in rows if r.held_out and r.n_tokens > 1 and held.index(r.doc_id) % 2 == odd) / 10
    assert mean(1) > mean(0) + 100  # words in an order that was seen are far likelier


def machine_of(texts, trained, strengths=(0.7, 0.3)):
    """The automaton of a part of texts, of which the first so many are training texts."""
    every = [t.split() + ["\n"] for t in texts]
    names = sorted({w for t in every for w in t})
    hashes = np.array([hash(w) for w in names], np.int64)
    places = np.array([names.index(w) for t in every for w in t])
    lengths = np.array([len(t) for t in every])
    found = lm_score.runs_of(hashes, places, lengths)
    train = np.repeat(np.arange(len(texts)) < trained, lengths)
    counts = [np.bincount(where, train, len(keys)) for keys, where in found]
    starts = np.cumsum(lengths) - lengths
    n_all, kinds = int(counts[0].sum()), int((counts[0] > 0).sum())
    machine = lm_score.Automaton([where for _, where in found], counts, starts, list(strengths), n_all, kinds, trained)
    word = {w: int(found[0][1][places.tolist().index(i)]) for i, w in enumerate(names)}
    return machine, word, starts, lengths, n_all, kinds


def test_states_and_failure_arcs_by_hand():
    machine, word, starts, lengths, n, v = machine_of(["a b c", "a b a", "b d"], 2)
    s1, s2 = 0.7, 0.3
    p1 = {w: (c + 0.5) / (n + 0.5 * (v + 1)) for w, c in {"a": 3, "b": 2, "c": 1, "\n": 2, "d": 0}.items()}
    state = np.array([machine.begin])
    # begin begin -> a: both training texts begin with it
    state, weight = machine.step(state, np.array([word["a"]]))
    p2 = (2 + s1 * p1["a"]) / (2 + s1)
    assert math.isclose(10 ** weight[0], (2 + s2 * p2) / (2 + s2))
    assert machine.fail_to[state[0]] == 1 + word["a"] and machine.fail_to[machine.fail_to[state[0]]] == 0
    # begin a -> c: no arc there, none at a, so two failure arcs lead to the root
    after, weight = machine.step(state, np.array([word["c"]]))
    assert math.isclose(10 ** weight[0], s2 / (2 + s2) * s1 / (3 + s1) * p1["c"])
    assert after[0] == 1 + word["c"]
    # begin a -> b and then d, which no training text has: two failure arcs, and the state is the root
    after, _ = machine.step(state, np.array([word["b"]]))
    last, weight = machine.step(after, np.array([word["d"]]))
    assert math.isclose(10 ** weight[0], s2 / (2 + s2) * s1 / (2 + s1) * p1["d"]) and last[0] == 0


def test_stretches_change_nothing():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 90))) for _ in range(30)]
    machine, _, starts, lengths, _, _ = machine_of(texts, 20)
    whole = machine.walk(starts, lengths, 10_000)
    for stretch in (2, 3, 7, 64):
        assert np.allclose(machine.walk(starts, lengths, stretch), whole, rtol=1e-12)
    one = [sum(w for w in _each(machine, starts[i], lengths[i])) for i in range(len(texts))]
    assert np.allclose(whole, one, rtol=1e-12)


def _each(machine, start, length):
    state = np.array([machine.begin])
    for i in range(start, start + length):
        state, weight = machine.step(state, machine.word[i : i + 1])
        yield float(weight[0])
