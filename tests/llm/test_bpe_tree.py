import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from textloom.llm.bpe_tree import TreeEncoder, decode, encode, op11_byte_bpe, tree_encoder


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(library, doc, text):
    ids = library.encode_ordinary(text or "")
    return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op11_byte_bpe(spark, sf_dir).collect())
    assert got == sorted(want(library, *r) for r in docs) and got


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = decode(encode(odd_docs)).collect()
    got = sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in rows), key=str)
    assert got == sorted((want(library, r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()), key=str)
    assert decode(encode(no_docs)).count() == 0


def ids(text):
    return np.frombuffer(tree_encoder().ids(text), "<u4").tolist()


def test_long_matches(library):
    """Matches far longer than a leaf: windows grow over repeats, rare joins and scripts of several bytes."""
    rng = random.Random(11)
    texts = ["x" * 5000, "ab" * 3001, "=" * 777 + "-" * 1234, "0123456789" * 200, "中文字" * 300, "ಕ್" * 401, "\U0001f600" * 257]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (25, 49, 97, 200, 1000)]
    texts += ["".join(rng.choice(("th", "e", "ing", "tion", "s", "ab", "er", "zz")) for _ in range(n)) for n in (10, 60, 300) for _ in range(20)]
    texts += ["".join(rng.choice("ab") for _ in range(400)) for _ in range(20)]
    for text in texts:
        got = ids(text)
        assert got == library.encode_ordinary(text)
        assert tree_encoder().text(got) == text.encode()


def test_white_space_and_code_points(library):
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "B", "'s", "'ll", "'", "1", "9", "!", "\xe9", "中", "<|endoftext|>", "\0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert ids(text) == library.encode_ordinary(text), repr(text)
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}." for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert ids(text) == library.encode_ordinary(text), hex(start)


def test_any_tree_any_vocabulary():
    """Toy vocabularies with ties between several splits of a token: joins equal the definition, wherever a text is cut."""
    rng = random.Random(2)
    for _ in range(150):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        while len(ranks) < 20:
            token = rng.choice(list(ranks)) + rng.choice(list(ranks))
            ranks.setdefault(token, len(ranks))
        coder = TreeEncoder(ranks, ".+")
        for _ in range(20):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 120)))
            whole = coder.merged(data)
            assert coder.reduced(data) == whole
            cut = rng.randrange(1, len(data))
            assert coder.joined(coder.merged(data[:cut]), coder.merged(data[cut:])) == whole
            small = [data[i : i + 1] for i in range(len(data))]
            while True:  # the definition, letter by letter
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(small, small[1:], strict=False)) if a + b in ranks]
                if not found:
                    break
                i = min(found)[1]
                small[i : i + 2] = [small[i] + small[i + 1]]
            assert [ranks[x] for x in small] == whole
