import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import id_files
from textloom.llm.id_files import Table, decode_block, encode_block, op2_token_ids, read_ids, write_ids
from textloom.llm.token_count import Counter, count_tokens, op1_token_counts
from textloom.llm.tokens import encoder

LETTERS = "ab zé'srevltmd \n\t1́²中.,<|endoftext|>-\x1c\x85᠎​"


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.fixture(scope="module")
def counter():
    return Counter(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(LETTERS, max_size=60), st.text(max_size=20)), max_size=5))
def test_counts_and_segments_are_the_librarys(library, counter, texts):  # noqa: D103
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert counter.counts(texts).tolist() == [len(ids_of(library["byte_bpe_50k.json"], t)) for t in texts]
    for name, tokenizer in library.items():
        got, counts = encoder(name).encode(texts)
        want = [ids_of(tokenizer, t) for t in texts]
        assert got.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.from_regex(r"([ \n]?[A-Za-zÀ-ÿ0-9]{1,9}[!-/:-@\[-`{-~]{0,3}){0,8}\n?", fullmatch=True), max_size=4))
def test_plain_words_are_the_librarys(library, texts):
    for name, tokenizer in library.items():
        got, _ = encoder(name).encode(texts)
        assert got.tolist() == [i for t in texts for i in ids_of(tokenizer, t)]


def test_op1_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(ids_of(library["byte_bpe_50k.json"], texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_op1_odd_rows(spark, odd_docs, no_docs, library):
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids_of(library["byte_bpe_50k.json"], r.text))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count_tokens(odd_docs).collect()) == want
    assert count_tokens(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 400), st.integers(0, 2**32 - 1))
def test_block_round_trip(n, kinds, seed):
    ids = (np.random.default_rng(seed).zipf(1.3, n) % kinds).astype(np.uint16)
    table = Table(Table.scaled(np.bincount(ids, minlength=500)))
    block = encode_block(ids, table)
    assert np.array_equal(decode_block(block, table), ids)
    if n:
        bad = bytearray(block)
        bad[-1] ^= 1
        with pytest.raises(ValueError):
            decode_block(bytes(bad), table)


def test_checkpoints_decode_apart():
    ids = np.random.default_rng(1).integers(0, 40_000, 500_000).astype(np.uint16)
    table = Table(Table.scaled(np.bincount(ids, minlength=49_408)))
    block = encode_block(ids, table)
    marks = -(-len(ids) // id_files.LANES - 1) // id_files.CHECKPOINT
    parts = [decode_block(block, table, k, k + 1) for k in range(marks + 2) if k * id_files.CHECKPOINT * id_files.LANES < len(ids)]
    assert len(parts) > 3 and np.array_equal(np.concatenate(parts), ids)
    assert len(block) < 2 * len(ids)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def expected(rows, tokenizer):
    out, start = [], 0
    encoded = sorted(((d, np.asarray([*ids_of(tokenizer, t), 2], "<u2").tobytes()) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for d, b in encoded:
        ids = np.frombuffer(b, "<u2")
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_op2_whole_table(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op2_token_ids(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == expected(rows, library["word_bpe_49k.json"])


def test_op2_odd_rows(spark, odd_docs, no_docs, library, tmp_path):
    write_ids(odd_docs, f"file://{tmp_path}/odd")
    got = sorted(((r.doc_id, r.start, r.n_tokens, crc(np.frombuffer(r.ids, "<u4"))) for r in read_ids(spark, f"file://{tmp_path}/odd").collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in odd_docs.collect()], library["word_bpe_49k.json"])
    write_ids(no_docs, f"file://{tmp_path}/none")
    assert read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_other_white_space_beside_line_ends():
    """Tabs and no-break spaces after a line end join it, so such a text is not cut there."""
    from textloom.llm.tokens import SegmentEncoder

    texts = ["a\n\t\tb", "x\n\xa0\t'1", "one \ttwo\r\nthree", "plain words\nand lines"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = SegmentEncoder(name)
        ids, lengths = coder.encode(texts)
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
