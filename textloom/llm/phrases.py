"""Operator 13: phrases of words that stand together more often than chance, by language.

1. Sketch. Each task hashes the runs of 1 to LONGEST words of its texts and counts them in a count-min sketch: DEPTH rows of
   cells, each a count that stops at its highest value, so a cell never holds less than the count of any run that falls
   into it (up to that value). Blocks of the sketches are added up along sorted partitions. What is left is one bit for
   each cell, whether it reaches the least count; a run all of whose cells do is a survivor. No run that is frequent
   enough can fail.
2. Exact counts. Each task lists the runs that survive together with both of their shorter parts, counts them exactly
   before they are shuffled, and Spark adds up the counts of equal phrases. Those that reach the least count stay.
3. Scores. Every cut of a candidate is joined with the exact counts of its two parts, which are frequent where it is; the
   lowest score counts. Numbers that pass 64 bits are decimals of 38 digits.
4. Subsumption. Every shorter run inside a candidate is joined with the candidates, with the highest count that holds it.
5. The first phrases of each language, by hash buckets first, so a language is never ranked in one task.

The bits are broadcast: 2 x 2^LARGEST bits, 8 MB at most. Up to there the width follows the input; beyond, the sketch tells less
apart, more runs are counted exactly and shuffled, and the results are the same. A cluster with room for a wider sketch
passes a larger width.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; texts are whole and
very long ones are cut between pieces only (a single piece is whole); ties in score and count are ordered by phrase; an empty
table gives no rows; doc_id is not read and further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Rows of the sketch; log2 of its smallest and largest width, and of the cells of a block.
DEPTH, SMALLEST, LARGEST, BLOCK = 2, 16, 25, 18
#: Bytes of text for each cell of a row.
BYTES_PER_CELL = 2
#: Bytes of text whose runs meet in one range of phrases.
PER_RANGE = 16_000_000
#: Bytes of text that are hashed at once, and phrases that a task counts before it sends them.
SLICE, HELD = 2_000_000, 300_000
NO_LANGUAGE = "und"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Signs that end a piece, as a line end; a tab, as a space; capital letters, as small ones.
_SIGNS = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")


class Words(dict):
    """Numbers of words in the order of first sight, with their hashes. No word is 0, the end of a piece 1."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})
        self.text: list[bytes] = [b"", b"\n"]
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        self.text.append(word)
        return n


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, texts) of a batch: about SLICE bytes at once, capitals folded, pieces on lines of their own."""
    groups: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
        text = text.as_py().translate(_SIGNS)
        at = 0
        while len(text) - at > 2 * SLICE and (end := text.find(b"\n", at + SLICE)) >= 0:
            yield lang, text[at:end]
            at = end
        groups.setdefault(lang, []).append(text[at:])
        sizes[lang] += len(text) - at
        if sizes[lang] > SLICE:
            yield lang, b"\n".join(groups.pop(lang))
            del sizes[lang]
    for lang, texts in groups.items():
        yield lang, b"\n".join(texts)


def numbered(text: bytes, words: Words) -> np.ndarray:
    """The words of a slice as numbers, with 1 between pieces."""
    parts = text.replace(b"\n", b" \n ").split(b" ")
    numbers = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
    return numbers[numbers > 0]


def runs(numbers: np.ndarray, words: Words, lang: str, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to longest: the places where a run of words begins, and hashes of those runs."""
    own = words.hashes[numbers]
    places = np.flatnonzero(numbers > 1)
    last = np.concatenate([numbers, np.ones(longest, np.int64)])
    hashes = own[places] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))
    for k in range(longest):
        if k:
            stay = last[places + k] > 1
            places, hashes = places[stay], hashes[stay]
            hashes = (hashes ^ own[places + k]) * _ODD[k]
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _ODD[(k + 1) % 5]
        hashes ^= hashes >> np.uint64(29)
        yield places, hashes


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of a row of 2^width cells."""
    return ((hashes ^ (hashes >> np.uint64(32))) * _ODD[row + 1] >> np.uint64(64 - width)).astype(np.int64)


def width_of(size: int) -> int:
    return min(max((size // BYTES_PER_CELL).bit_length(), SMALLEST), LARGEST)


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def task_words(words: Words) -> Words:
    """The words of a task so far, or none where they have become many."""
    return words if len(words) < 1_000_000 else Words()


def frequent_cells(rows: DataFrame, width: int, least: int, longest: int) -> list[np.ndarray]:
    """For each row of the merged sketch: its cells that reach least, as packed bits."""
    block = min(width, BLOCK)
    top = min(least, 255)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros((DEPTH, 1 << width), np.uint8), Words()
        for batch in batches:
            for lang, text in by_language(batch):
                words = task_words(words)
                every = np.concatenate([h for _, h in runs(numbered(text, words), words, lang, longest)])
                for row in range(DEPTH):
                    at = np.sort(cells(every, row, width))
                    starts = np.flatnonzero(np.diff(at, prepend=-1))
                    times = np.diff(starts, append=len(at))
                    at = at[starts]
                    counts[row, at] = np.minimum(counts[row, at] + times, top)
        for row in range(DEPTH):
            for b in range(1 << (width - block)):
                own = counts[row, b << block : (b + 1) << block]
                if own.any():
                    yield pa.record_batch({"row": pa.array([row], pa.int32()), "block": pa.array([b], pa.int32()), "cells": pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= top).tobytes()
            return pa.record_batch({"row": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int32()), "bits": pa.array([bits], pa.binary())})

        for batch in batches:
            for row, number, data in zip(batch["row"].to_pylist(), batch["block"].to_pylist(), batch["cells"], strict=True):
                if key != (row, number):
                    if key is not None:
                        yield done()
                    key, total = (row, number), np.zeros(1 << block, np.uint8)
                more = np.frombuffer(zstandard.decompress(data.as_py()), np.uint8)
                total = np.minimum(total.astype(np.uint16) + more, top).astype(np.uint8)
        if key is not None:
            yield done()

    sent = rows.mapInArrow(sketch, "row int, block int, cells binary")
    blocks = DEPTH << (width - block)
    sent = sent.repartition(min(blocks, max(1, rows.sparkSession.sparkContext.defaultParallelism * 4)), "row", "block").sortWithinPartitions("row", "block")
    found = [np.zeros(max(1, (1 << width) >> 3), np.uint8) for _ in range(DEPTH)]
    size = max(1, (1 << block) >> 3)
    for r in sent.mapInArrow(merge, "row int, block int, bits binary").collect():  # 2^width bits for each row
        found[r.row][r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return found


def exact_counts(rows: DataFrame, bits: list[np.ndarray], width: int, least: int, longest: int, ranges: int) -> DataFrame:
    """(lang, size, phrase, a): exact counts of all runs that occur least times; with size 0, all words of the language.

    A task sends its counts packed, a row for each language and range of phrases; ranges follow the input.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def sent(counts: dict[str, Counter]) -> pa.RecordBatch:
        out: dict[tuple[str, int], tuple[list[bytes], list[int]]] = {}
        for lang, own in counts.items():
            seed = xxhash.xxh3_64_intdigest(lang)
            for phrase, n in own.items():
                phrases, times = out.setdefault((lang, (xxhash.xxh3_64_intdigest(phrase) ^ seed) % ranges), ([], []))
                phrases.append(phrase)
                times.append(n)
        langs, to = zip(*out, strict=True)
        # No phrase holds a line end.
        listed = [zstandard.compress(b"\n".join(phrases), 1) for phrases, _ in out.values()]
        times = [zstandard.compress(np.array(n, "<i8").tobytes(), 1) for _, n in out.values()]
        return pa.record_batch({"range": pa.array(to, pa.int64()), "lang": pa.array(langs), "phrases": pa.array(listed, pa.binary()), "times": pa.array(times, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, counts = shared.value, Words(), {}
        for batch in batches:
            for lang, text in by_language(batch):
                words = task_words(words)
                numbers = numbered(text, words)
                found = counts.setdefault(lang, Counter())
                found[b""] += int((numbers > 1).sum())
                held = np.zeros(len(numbers) + 1, bool)  # where a surviving run of one word less begins
                for k, (places, hashes) in enumerate(runs(numbers, words, lang, longest)):
                    if k:
                        both = held[places] & held[places + 1]
                        places, hashes = places[both], hashes[both]
                    for row in range(DEPTH):
                        at = cells(hashes, row, width)
                        stay = (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                        places, hashes = places[stay], hashes[stay]
                    held = np.zeros(len(numbers) + 1, bool)
                    held[places] = True
                    # Runs are told by the words themselves, not by their hashes.
                    own = numbers[places[:, None] + np.arange(k + 1)]
                    order = np.lexsort(own.T)
                    own = own[order]
                    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])) if len(own) else np.empty(0, np.int64)
                    for run, n in zip(own[starts].tolist(), np.diff(starts, append=len(own)).tolist(), strict=True):
                        found[b" ".join([words.text[w] for w in run])] += n
                if sum(map(len, counts.values())) > HELD:
                    yield sent(counts)
                    counts = {}
        if counts:
            yield sent(counts)

    def total(table: pa.Table) -> pa.Table:
        counts: dict[str, Counter] = {}
        for lang, phrases, times in zip(*(table[c].to_pylist() for c in ("lang", "phrases", "times")), strict=True):
            own = counts.setdefault(lang, Counter())
            for phrase, n in zip(zstandard.decompress(phrases).split(b"\n"), np.frombuffer(zstandard.decompress(times), "<i8").tolist(), strict=True):
                own[phrase] += n
        kept = [(lang, 1 + phrase.count(b" ") if phrase else 0, phrase, n) for lang, own in counts.items() for phrase, n in own.items() if n >= (least if phrase else 1)]
        columns = list(zip(*kept, strict=True)) or [(), (), (), ()]
        return pa.table({"lang": pa.array(columns[0], pa.string()), "size": pa.array(columns[1], pa.int32()), "phrase": pa.array(columns[2], pa.binary()).cast(pa.string()), "a": pa.array(columns[3], pa.int64())})

    found = rows.mapInArrow(count, "range long, lang string, phrases binary, times binary")
    return found.groupBy("range").applyInArrow(total, "lang string, size int, phrase string, a long")


def first_of(df: DataFrame, key: str, order: list[Column], by: str, limit: int, rows: int, name: str) -> DataFrame:
    """The first rows of each key with their rank as name; ranked in buckets first, each of which keeps limit rows."""
    buckets = -(-rows // (20 * limit))
    while buckets > 1:
        within = Window.partitionBy(key, F.pmod(F.xxhash64(by), F.lit(buckets))).orderBy(*order)
        df = df.withColumn(name, F.row_number().over(within)).where(F.col(name) <= limit).drop(name)
        buckets //= 20
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col(name) <= limit)


def score(phrases: DataFrame, keep_share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among phrases (as exact_counts gives them) that no longer one
    with keep_share percent of their count holds."""
    known = phrases.where("size > 0").select("lang", "phrase", "a")
    candidates = phrases.where("size > 1")
    words = F.split("phrase", " ")
    joined = lambda c: F.array_join(c, " ")
    cuts = candidates.withColumn("words", words).select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("words", 1, F.col("k"))).alias("left"), joined(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))).alias("right"))
    part = lambda side, name: known.select(F.col("lang"), F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    totals = phrases.where("size = 0").select("lang", F.col("a").alias("n"))
    if totals.limit(100_001).count() <= 100_000:  # languages
        totals = F.broadcast(totals)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("(1000 * cast(a AS decimal(19,0)) * cast(n AS decimal(15,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase").agg(best, F.first("a").alias("a"), F.first("n").alias("n"))
    longer = candidates.where("size > 2").withColumn("words", words)
    inside = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inside = inside.select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    holding = inside.groupBy("lang", joined(F.slice("words", F.col("at"), F.col("k"))).alias("phrase")).agg(F.max("a").alias("most"))
    kept = scored.join(holding, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * keep_share))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def mine(docs: DataFrame, least: int = LEAST, first: int = FIRST, longest: int = LONGEST, width: int | None = None, keep_share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language."""
    rows = rows_of(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    width = width_of(size) if width is None else width
    bits = frequent_cells(rows, width, least, longest)
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PER_RANGE))
    phrases = common.written(exact_counts(rows, bits, width, least, longest, ranges), "phrases")
    scored = common.written(score(phrases, keep_share), "phrases-scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_of(scored, "lang", order, "phrase", first, scored.count(), "rank")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.documents(spark, sf_dir))
