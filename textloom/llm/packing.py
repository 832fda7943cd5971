"""Operator 7: best-fit packing of token sequences by a grouping genetic algorithm on islands.

1. Pieces. Each document is encoded once; only its pieces' places, lengths and checksums are kept. Documents of more than
   SEQUENCE tokens are cut into whole sequences behind a first, shorter piece; whole pieces are sequences of their own.
2. Islands. The other pieces are dealt by hash into blocks of about ITEMS, and each block to ISLANDS islands, which hold
   its pieces' numbers and lengths alone. A population starts from best-fit decreasing, from sequences that are completed
   by the one or two pieces that fill them best, and from mixtures. Crossover takes whole well-filled sequences of one
   parent into the other, removes the other's sequences that hold any of the same pieces, opens some more that are not
   full, and puts the displaced pieces, longest first, where they fit best or into sequences that are completed. No two of
   a population are equally good. An island rests once it needs no more sequences than the total length asks for.
3. Migration. Each island's elite go to itself and to the next island of the block, for a second epoch; the best solution
   of all islands stands, of equal ones that of the first island.
4. Sequences that are not full are opened again, and the pieces of all blocks' open ones are packed in a further round, as
   long as that saves sequences. So a block's last sequences are not wasted.

Fewer sequences win; of equal numbers the one whose emptiest sequence holds least, which is next to go; then the more
uneven fill (sum of squares).

Defined results: a null or empty text is its end token alone; very long texts are whole; repeated rows, with or without a
doc_id, are pieces of their own; an empty table packs into nothing; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_count import Encoder
from .tokens import text_parts

SEQUENCE, END_ID = 1024, 2
#: Bytes of text that a task encodes at once.
SLICE = 1_000_000
ITEMS, ISLANDS, POPULATION, CHILDREN, ELITE = 20_000, 3, 6, 3, 3
#: Generations without fewer sequences after which an island rests.
PATIENCE = 12
#: What a crossover draws from: tokens that a well-filled sequence leaves empty at most, the share of such ones that it
#: takes, and the shares of the other parent's sequences, not full and full, that it opens besides.
SPARES, SHARES, OPENED, BROKEN = (0, 0, 1, 2, 8), (0.1, 0.3, 0.6, 0.9), (0.2, 0.5, 1.0), (0.0, 0.02, 0.1)


def pieces(docs: DataFrame, name: str = "byte_bpe_50k.json", size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = common.kept(("encoder", name), lambda: Encoder(public_tokenizers.path(name)))
        for batch in batches:
            for part, texts in text_parts(batch["text"], SLICE):
                ids, counts = encoder.encode(texts)
                full = np.insert(ids.astype("<u4"), np.cumsum(counts), END_ID)  # the end after each document
                n = counts + 1
                cuts = -(-n // size)
                total = int(cuts.sum())
                doc = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(total) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first = n - size * (cuts - 1)
                start = np.where(piece == 0, 0, first[doc] + size * (piece - 1))
                length = np.where(piece == 0, first[doc], size)
                at = (np.cumsum(n) - n)[doc] + start
                view = memoryview(full.tobytes())
                sums = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, total)
                numbers = batch["doc_id"][part].to_pylist()
                yield pa.record_batch({"doc_id": pa.array([numbers[i] for i in doc.tolist()], pa.int64()), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": sums})

    return common.doc_rows(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, room: list[int], size: int) -> None:
    """Put items, in their order, each where the least room is left; bins (of all items) and room (of all bins) are changed."""
    open_by: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            open_by[r].append(b)
            mask |= 1 << r
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = open_by[r].pop()
            if not open_by[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), size
            room.append(size)
        bins[i] = b
        room[b] = r - n
        if r > n:
            open_by[r - n].append(b)
            mask |= 1 << (r - n)


def complete(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, room: list[int], size: int) -> None:
    """Open a sequence with the longest item, take the one or two others that fill it best, and so on; as best_fit()."""
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        waiting[n].append(i)
    count = np.array([len(w) for w in waiting])
    every = np.arange(size + 1)
    below = np.maximum.accumulate(np.where(count > 0, every, 0))  # the longest that waits, up to each length

    def take(n: int, b: int) -> int:
        nonlocal below
        bins[waiting[n].pop()] = b
        count[n] -= 1
        if not count[n]:
            below = np.maximum.accumulate(np.where(count > 0, every, 0))
        return n

    n = int(below[size])
    while n:
        left = size - take(n, len(room))
        if left:
            x = every[: left + 1]
            y = below[left - x]
            pairs = np.where((count[x] > 0) & (y > 0) & (x >= y) & ((x != y) | (count[x] > 1)), x + y, 0)
            x = len(pairs) - 1 - int(pairs[::-1].argmax())  # of equal fills the one with the longest item
            if pairs[x] > below[left]:
                y = int(pairs[x]) - x
                left -= take(x, len(room)) + take(y, len(room))
            while left and below[left]:
                left -= take(int(below[left]), len(room))
        room.append(left)
        n = int(below[n])


def fitness(bins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float, float]:
    """Fewer sequences; an emptier last one; a more uneven fill."""
    fill = np.bincount(bins, lengths)
    return -len(fill), -float(fill.min()), float(((fill / size) ** 2).sum())


def crossed(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of b in a; bins of a that share pieces with them go, and some others that are not full."""
    fill = np.bincount(b, lengths)
    chosen = (fill >= size - rng.choice(SPARES)) & (rng.random(len(fill)) < rng.choice(SHARES))
    if not chosen.any():
        chosen[rng.integers(len(fill))] = True
    inject = chosen[b]
    own = np.bincount(a, lengths)
    gone = rng.random(len(own)) < np.where(own < size, rng.choice(OPENED), rng.choice(BROKEN))
    gone[a[inject]] = True
    displaced = np.flatnonzero(gone[a] & ~inject)
    out = np.where(inject, len(gone) + b, a)
    out[displaced] = -1
    kept = out >= 0
    _, out[kept] = np.unique(out[kept], return_inverse=True)
    room = (size - np.bincount(out[kept], lengths[kept]).astype(np.int64)).tolist() if kept.any() else []
    if rng.random() < 0.5:
        complete(displaced, lengths, out, room, size)
    else:
        best_fit(displaced[np.argsort(-lengths[displaced] - rng.random(len(displaced)) * 4, kind="stable")], lengths, out, room, size)
    return out


def first_people(lengths: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Unlike solutions: best-fit decreasing, completed sequences, and mixtures of both."""
    for k in range(POPULATION):
        bins, room = np.full(len(lengths), -1, np.int64), []
        share = (0.0, 1.0)[k] if k < 2 else rng.random()
        some = rng.random(len(lengths)) < share
        complete(np.flatnonzero(some), lengths, bins, room, size)
        rest = np.flatnonzero(~some)
        best_fit(rest[np.argsort(-lengths[rest], kind="stable")], lengths, bins, room, size)
        yield bins


def evolve(lengths: np.ndarray, seed: int, size: int, start: list[np.ndarray] | None = None, patience: int = 150) -> list[np.ndarray]:
    """An epoch of an island: its elite, best first; each tells the bin of each item.

    It ends when no fewer bins are needed than the total length asks for, or have been for so many generations.
    """
    rng = np.random.default_rng(seed)
    need = -(-int(lengths.sum()) // size)
    ranked, number = [], 0

    def add(bins: np.ndarray) -> None:
        nonlocal ranked, number
        fit = fitness(bins, lengths, size)
        if all(fit != f for f, _, _ in ranked):  # no two alike
            ranked = sorted([*ranked, (fit, -number, bins)], key=lambda p: p[:2], reverse=True)[:POPULATION]
        number += 1

    for bins in start or first_people(lengths, size, rng):
        add(bins)
        if ranked[0][0][0] == -need:
            break
    waited = 0
    while waited < patience and ranked[0][0][0] < -need:
        before = ranked[0][0][0]
        for _ in range(CHILDREN):
            a, b = rng.integers(len(ranked), size=2)
            add(crossed(ranked[a][2], ranked[b][2], lengths, size, rng))
        waited = 0 if ranked[0][0][0] > before else waited + 1
    return [p for _, _, p in ranked[:ELITE]]


def islands(items: DataFrame, total: int, size: int) -> DataFrame:
    """(pid, length, block, bin, place, fill) of items (pid, length): the bin within its block, and how full it is."""
    blocks = max(1, -(-total // ITEMS))
    patience = PATIENCE
    items = items.select("pid", "length", F.pmod(F.xxhash64("pid"), F.lit(blocks)).alias("block"))
    isles = items.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))

    def solved(block: int, island: int, pids: np.ndarray, lengths: np.ndarray, start: list[np.ndarray], epoch: int) -> pa.Table:
        found = evolve(lengths, hash((block, island, epoch)) & 0x7FFFFFFF, size, start, patience)
        fit = [fitness(p, lengths, size) for p in found]
        return pa.table(
            {
                "block": np.full(len(found), block, np.int64), "island": pa.array([island] * len(found), pa.int32()), "bins": np.array([-f[0] for f in fit], np.int64),
                "emptiest": np.array([f[1] for f in fit]), "squares": np.array([f[2] for f in fit]), "answer": pa.array([p.astype("<i4").tobytes() for p in found], pa.binary()),
            }
        )

    def sorted_items(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        pids, lengths = table["pid"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(pids)
        return pids[order], lengths[order]

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return solved(key[0].as_py(), key[1].as_py(), *sorted_items(table), [], 1)

    def second(key: tuple[pa.Scalar, ...], table: pa.Table, elite: pa.Table) -> pa.Table:
        start = [np.frombuffer(x, "<i4").astype(np.int64) for x in elite["answer"].to_pylist()]
        return solved(key[0].as_py(), key[1].as_py(), *sorted_items(table), start, 2)

    def placed(key: tuple[pa.Scalar, ...], table: pa.Table, best: pa.Table) -> pa.Table:
        pids, lengths = sorted_items(table)
        bins = np.frombuffer(best["answer"][0].as_py(), "<i4").astype(np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        fill = np.bincount(bins, lengths).astype(np.int64)
        before = np.cumsum(fill) - fill
        return pa.table({"pid": pids[order], "length": lengths[order], "block": np.full(len(order), key[0].as_py(), np.int64), "bin": bins[order], "place": ends - lengths[order] - before[bins[order]], "fill": fill[bins[order]]})

    answer = "block long, island int, bins long, emptiest double, squares double, answer binary"
    elite = common.written(isles.groupBy("block", "island").applyInArrow(first, answer), "pack-elite")
    moved = elite.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
    last = isles.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInArrow(second, answer)
    best = last.groupBy("block").agg(F.max_by("answer", F.struct(-F.col("bins"), "emptiest", "squares", -F.col("island"), F.xxhash64("answer"))).alias("answer"))
    out = items.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(placed, "pid long, length long, block long, bin long, place long, fill long")
    return common.written(out, "pack-placed")


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs."""
    every = common.written(pieces(docs, name, size).withColumn("pid", F.monotonically_increasing_id()), "pack-pieces")
    items, done = every.where(F.col("length") < size).select("pid", "length"), []
    count, tokens = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = islands(items, count, size)
    while True:
        # A sequence's number: the round, the block, the bin.
        found = found.withColumn("sequence_id", F.lit(len(done)) * (1 << 54) + F.col("block") * (1 << 20) + F.col("bin"))
        loose = found.where(F.col("fill") < size)
        count, tokens, bins = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("place") == 0, 1)), F.lit(0))).first()
        if bins <= -(-tokens // size):
            break
        again = islands(loose.select("pid", "length"), count, size)
        if again.where("place = 0").count() >= bins:
            break
        done.append(found.where(F.col("fill") == size))
        found = again
    placed = found.select("pid", "sequence_id", F.col("place").alias("offset"))
    for more in done:
        placed = placed.unionByName(more.select("pid", "sequence_id", F.col("place").alias("offset")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = every.where(F.col("length") == size).select(*columns, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return every.where(F.col("length") < size).join(placed, "pid").select(*columns, "sequence_id", "offset").unionByName(whole)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
