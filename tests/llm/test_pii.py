import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        odd = sum(digits[-1::-2])
        return 12 <= len(digits) <= 19 and (odd + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    out = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(k, m[0])]
    return [(a, b, list(PATTERNS)[i]) for a, i, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text("0123456789.@+-() aB_é%4", max_size=50))
def test_patterns(text):
    assert pii.pattern_spans(text) == plain(text)


def test_patterns_in_long_runs():
    text = "x" * 200_000 + " a.b+c@d-e.f.gh " + "1" * 100_000 + " 1.2.3.4.5.6.7.8 300.1.1.1"
    assert [text[a:b] for a, b, _ in pii.pattern_spans(text)] == ["a.b+c@d-e.f.gh", "1.2.3.4", "5.6.7.8"]


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    lengths = np.array([4, 2, 1, 3])
    scores = rng.normal(0, 3, (4, 4, k))
    moves = np.where(pii.forbidden(), -1e4, rng.normal(0, 1, (k, k)))
    got = pii.viterbi(scores, lengths, moves)
    for i, n in enumerate(lengths):
        paths = [p for p in itertools.product(range(k), repeat=int(n)) if pii.LABELS[p[0]][0] != "I"]
        best = max(paths, key=lambda p: sum(scores[i, t, x] for t, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got[i, :n]) == best and not got[i, n:].any()


def outcomes(field, rows):
    """How many spans of each kind are found, missed and made up."""
    out, extractor = Counter(), pii.Extractor()
    for words, labels in rows:
        text = " ".join(words)
        places = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
        own = pii.field_spans([text], [pii.pattern_spans(text)], field, extractor)[0]
        want = {(places[i], x[2:]) for i, x in enumerate(labels) if x[0] == "B"}
        got = {(max(p for p in places if p <= a), k) for a, _, k in own}
        for name, some in (("found", want & got), ("missed", want - got), ("made up", got - want)):
            out.update((name, k) for _, k in some)
    return out


def test_held_out_values(field):
    got = outcomes(field, pii.labelled_rows(400, 99, pii.TEMPLATES))
    for kind in pii.ADDED:
        assert got["found", kind] >= 0.95 * (got["found", kind] + got["missed", kind])
        assert got["found", kind] >= 0.95 * (got["found", kind] + got["made up", kind])


def test_held_out_templates():
    held = pii.TEMPLATES[::5]
    field = pii.fit(pii.labelled_rows(1_000, 11, tuple(t for t in pii.TEMPLATES if t not in held)))
    got = outcomes(field, pii.labelled_rows(400, 98, held))
    found, missed, made = (sum(n for (name, _), n in got.items() if name == x) for x in ("found", "missed", "made up"))
    assert found >= 0.75 * (found + missed) and found >= 0.9 * (found + made)


def test_forms_without_digits(field):
    for text, want in (
        ("please write to user[at]host[dot]com, thank you", "user[at]host[dot]com"),
        ("here is my password: qWeRtYuIoP for now", "qWeRtYuIoP"),
        ("a secret = hunters!QWE it was", "hunters!QWE"),
    ):
        spans = pii.field_spans([text], [pii.pattern_spans(text)], field, pii.Extractor())[0]
        assert [text[a:b] for a, b, _ in spans] == [want]
    for text in ("the key to the house is here", "a token of thanks for the secret of it", "my password was lost on the way"):
        assert pii.field_spans([text], [[]], field, pii.Extractor()) == [[]]


def whole_path(text, base, field):
    """The field's spans by one Viterbi over all words of a text, each scored from its features."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    words = ["", "", *(text[a:b] for a, b in places), "", ""]
    scores = np.zeros((1, max(len(places), 1), len(pii.LABELS)))
    for t in range(len(places)):
        names = [""] + [x for p in pii.PLACES for x in pii.seen_from(p, pii.own_features(words[t + 2 + int(p)]))]
        scores[0, t] = field.weights[[field.names[x] for x in names if x in field.names]].sum(axis=0)
    labels = [pii.LABELS[j] for j in pii.viterbi(scores, np.array([len(places)]), field.moves)[0]][: len(places)]
    out, taken = [], [s[:2] for s in base]
    for t, label in enumerate(labels):
        if label[0] == "B":
            last = t
            while last + 1 < len(labels) and labels[last + 1] == "I" + label[1:]:
                last += 1
            a, b = places[t][0], places[last][1]
            while a < b and not (text[a].isalnum() or text[a] in "[("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a < b and all(b <= x or a >= y for x, y in taken):
                out.append((a, b, label[2:]))
                taken.append((a, b))
    return out


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_every_word_is_labelled(spark, sf_dir, field, monkeypatch, seed):
    """With any weights, so with spans anywhere and of any length, and whatever the slices."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2000").limit(60).collect()]
    texts += ["", " ", "one", ".", "call . (030) 555-1234 ; ... a. : 'tis . 0445 1749022 .", *(" ".join(w) for w, _ in pii.labelled_rows(40, 3, pii.TEMPLATES))]
    if seed:
        rng = np.random.default_rng(seed)
        moves = np.where(pii.forbidden(), -1e4, rng.normal(0, 1, field.moves.shape))
        field = pii.Field(field.names, rng.normal(0, 0.7, field.weights.shape) + np.eye(len(pii.LABELS))[0] * 0.05 * seed, moves)
        monkeypatch.setattr(pii, "SLICE", 100)
        monkeypatch.setattr(pii, "BLOCK", 64)
    base = [pii.pattern_spans(t) for t in texts]
    got = pii.field_spans(texts, base, field, pii.Extractor())
    assert got == [whole_path(t, b, field) for t, b in zip(texts, base, strict=True)]
    assert sum(map(len, got)) > 20


def test_keys_away_from_digits_and_cues(field):
    """No word here has a digit or @, or announces a secret."""
    text = "the new one is qWeRtYuIoPaSdFgHjKlZxCvBnM as of today and nothing else was said of it"
    spans = pii.field_spans([text], [[]], field, pii.Extractor())[0]
    assert [(text[a:b], k) for a, b, k in spans] == [("qWeRtYuIoPaSdFgHjKlZxCvBnM", "secret")]


def test_plain_text_stays(field):
    """Words of any shape in long plain texts are outside."""
    words = "Of the&&& then*** In.%%% thnder,$$$ camelCaseName well-known and/or | # McDonald https://example.com/a/long-path Ünïcödé 中文字 emphatically".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 400)) for _ in range(20)]
    assert pii.field_spans(texts, [[] for _ in texts], field, pii.Extractor()) == [[] for _ in texts]


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op5_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in PATTERNS)
        own = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(own) <= set(spans)
        keys = {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{32,})"', texts[r.doc_id])}
        assert keys == {tuple(map(int, s.split(":")[1:])) for s in set(spans) - set(own)}


def test_odd_rows(spark, odd_docs, no_docs, field):
    rows = pii.find(odd_docs, field).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (r.doc_id for r in odd_docs.collect())))
    assert all(not r._base and not r._spans for r in rows if not r.text)
    assert pii.find(no_docs, field).count() == 0
    own = spark.createDataFrame([(1, 'a b.c@d.ef x, call (030) 555-1234 now: token = "c80fd45a66f8564ae70609f7b2a26100e64e830e" end'), (2, None)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.find(own, field, mask=True).collect()}
    assert texts == {1: 'a [EMAIL] x, call [PHONE] now: token = "[SECRET]" end', 2: None}
