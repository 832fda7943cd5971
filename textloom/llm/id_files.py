"""Operator 2: token ids in binary files, by a static range asymmetric numeral system (rANS).

The documents are encoded once and dealt by ranges of doc_id, so that the files follow ascending doc_id. One table of
frequencies over all ids (a row for each id of the vocabulary, which bounds it) is shared by every block and stands
beside the blocks. A block holds whole documents, about BLOCK ids. Its ids are dealt over interleaved lanes, each with a
state of its own; one step codes one id for every lane, so numpy works on all lanes at once. Blocks know nothing of each
other, and within a block checkpoints (lane states and place in the stream, every CHECKPOINT steps) let a reader start
in the middle or share a block's steps among readers. CRC-32 sums guard the payload, and the decoded ids.

A file is a parquet table whose rows are blocks, so that Spark's own committer writes it anywhere; the column ``payload``
is the binary format: header, lane states, checkpoints, and 32-bit words.

Defined results: a null or empty text has the end id only; very long texts are whole and one block's; rows that repeat a
doc_id (or have none: they come first) follow one another in the order of their ids; an empty table makes an empty file;
further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import encoder, in_parts

BLOCK, LANES, CHECKPOINT = 1 << 18, 1024, 128
#: Parts whose sums are broadcast; beyond that Spark joins them as it sees fit. 16 bytes each.
BROADCAST_PARTS = 200_000
#: Frequencies of a table sum to 1 << SCALE; states lie in [LOW, LOW << 32).
SCALE, LOW = 20, 1 << 31
MAGIC = b"RANS\x01\0\0\0"
HEADER = struct.Struct("<8sQIIIII")  # magic, ids, lanes, checkpoints, words, crc of ids, crc of the payload after the header


class Table:
    """Shared frequencies: 0 for ids that no document has, else 1 at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.id_at = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Counts to frequencies that sum to 1 << SCALE."""
        total = int(counts.sum())
        if not total:
            return np.zeros(len(counts), np.int64)
        freq = np.where(counts > 0, np.maximum(1, np.rint(counts * ((1 << SCALE) / total))), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        off = int(freq.sum()) - (1 << SCALE)
        for i in order:  # the largest ones bear the rounding
            if not off:
                break
            take = min(off, int(freq[i]) - 1) if off > 0 else off
            freq[i] -= take
            off -= take
        return freq


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words, kept, written = [], [], 0
    shift, scale = np.uint64(32), np.uint64(SCALE)
    for k in range(steps - 1, -1, -1):
        part = ids[k * lanes : (k + 1) * lanes]
        x = state[: len(part)]
        f = table.freq[part]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            written += len(out)
            x = np.where(full, x >> shift, x)
        q = x // f
        state[: len(part)] = (q << scale) + (x - q * f) + table.base[part]
        if k and k % CHECKPOINT == 0:
            kept.append((k, written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = state.astype("<u8").tobytes()
    for k, w, s in reversed(kept):
        body += struct.pack("<II", k, written - w) + s.astype("<u8").tobytes()
    body += stream.tobytes()
    return HEADER.pack(MAGIC, n, lanes, len(kept), written, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block, or of its checkpoints first to last: each span between checkpoints can be decoded by itself."""
    magic, n, lanes, marks, words, ids_crc, body_crc = HEADER.unpack_from(payload)
    body = memoryview(payload)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("a block of token ids is damaged")
    size = 8 + 8 * lanes
    starts = [(0, 0, 0)]
    for m in range(marks):
        at = 8 * lanes + m * size
        starts.append((*struct.unpack_from("<II", body, at), at + 8))
    stream = np.frombuffer(body, "<u4", words, 8 * lanes + marks * size).astype(np.uint64)
    steps = -(-n // lanes)
    whole = first == 0 and last is None
    begin, at, place = starts[first]
    end = steps if last is None or last >= len(starts) else starts[last][0]
    state = np.frombuffer(body, "<u8", lanes, place).astype(np.uint64)
    ids = np.empty(max(0, min(end * lanes, n) - begin * lanes), np.uint16)
    mask, shift, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE), np.uint64(LOW)
    for k in range(begin, end):
        count = min(lanes, n - k * lanes)
        x = state[:count]
        slot = x & mask
        got = table.id_at[slot]
        ids[(k - begin) * lanes : (k - begin) * lanes + count] = got
        x = table.freq[got] * (x >> scale) + slot - table.base[got]
        poor = np.flatnonzero(x < low)
        if len(poor):
            x[poor] = (x[poor] << shift) | stream[at : at + len(poor)]
            at += len(poor)
        state[:count] = x
    if whole and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded ids differ from those that were written")
    return ids


def encode_texts(docs: DataFrame, name: str, end_id: int, vocabulary: int) -> DataFrame:
    """(doc_id, ids, counts): ids as little-endian unsigned 16-bit integers, end_id included; and for each task a row
    with nothing but how often it saw each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            texts, own = batch["text"].to_pylist(), batch["doc_id"]
            for part in in_parts(texts):
                ids, counts = encoder(name).encode(texts[part])
                total += np.bincount(ids, minlength=vocabulary)
                total[end_id] += len(counts)
                cut = np.concatenate([[0], np.cumsum(counts)])
                blobs = [np.append(ids[a:b], np.uint16(end_id)).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.record_batch({"doc_id": own[part.start : part.stop], "ids": pa.array(blobs, pa.binary()), "counts": pa.nulls(len(blobs), pa.binary())})
        yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    return common.doc_rows(docs).mapInArrow(run, "doc_id long, ids binary, counts binary")


def id_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, over all documents: a task sends one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for blob in batch["counts"]:
                total += np.frombuffer(blob.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": seen.astype(np.int32), "n": total[seen]})

    counts = np.zeros(vocabulary, np.int64)
    of_tasks = encoded.where("counts is not null").select("counts")
    for r in of_tasks.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int = 2, vocabulary: int = 49_408) -> None:
    """Write the ids of all docs under path: ``blocks`` and ``table``."""
    if vocabulary > 1 << 16:
        raise ValueError("ids are packed into 16 bits")
    spark = docs.sparkSession
    encoded = common.written(encode_texts(docs, name, end_id, vocabulary), "ids")
    freq = Table.scaled(id_counts(encoded, vocabulary))
    encoded = encoded.where("ids is not null").select("doc_id", "ids")
    spark.createDataFrame([(SCALE, freq.astype("<u4").tobytes(), zlib.crc32(freq.astype("<u4").tobytes()))], "scale int, freq binary, crc long").write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        number, held, size, inside = 0, [], 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), "<u2")
            docs, lengths = [d for d, _ in held], [len(b) // 2 for _, b in held]
            return pa.record_batch(
                {
                    "block": pa.array([number], pa.int64()),
                    "inside": pa.array([inside], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "payload": pa.array([encode_block(ids, table)], pa.binary()),
                }
            )

        for batch in batches:
            for d, b in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                held.append((d, b))
                size += len(b) // 2
                if size >= BLOCK:
                    yield block()
                    number, held, size, inside = number + 1, [], 0, inside + size
        if held:
            yield block()

    parts = max(1, spark.sparkContext.defaultParallelism, int(freq.any()) and -(-encoded.count() // 10_000))
    dealt = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    # A part is a range of doc_id; inside tells how many of its ids come before a block.
    blocks = dealt.mapInArrow(run, "block long, inside long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary")
    blocks.select(F.spark_partition_id().alias("part"), "*").write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): from the files alone."""
    stored = spark.read.parquet(f"{path}/table").first()
    if zlib.crc32(stored["freq"]) != stored["crc"]:
        raise ValueError("the table of frequencies is damaged")
    shared = spark.sparkContext.broadcast(np.frombuffer(stored["freq"], "<u4").astype(np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    # Ids before each part: one row for each part, from columns without payload; the blocks themselves are not shuffled.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = common.written(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "id-parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for start, docs, lengths, payload in zip(batch["start"].to_pylist(), batch["doc_ids"], batch["lengths"], batch["payload"], strict=True):
                docs, lengths = docs.values, lengths.values.to_numpy()
                ids = decode_block(payload.as_buffer(), table)
                cut = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.record_batch(
                    {
                        "doc_id": docs,
                        "start": start + cut[:-1],
                        "n_tokens": lengths,
                        "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                    }
                )

    return blocks.join(parts, "part").select((F.col("base") + F.col("inside")).alias("start"), "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/textloom/id-files-{uuid.uuid4().hex}"
    write_ids(common.documents(spark, sf_dir), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
