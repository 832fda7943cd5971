"""Operator 12: product quantisation in whole numbers.

A vector's components become floor(SCALE * x) and its PARTS equal parts are coded by the nearest entry of a codebook for each
place. Codebooks are small (ENTRIES x the vector's length), so they are broadcast. A task reads Arrow batches and finds all
distances of a batch by norms and one exact int64 matrix product for each place; the first of the nearest entries is taken.
It sends one row for each entry and component with the sum and count of its parts, a grouped shuffle adds up those of all
tasks, and the next codebook is their floor(sum / count). Only codebooks pass through the driver.

Where a number does not fit int64 arithmetic (components of LIMIT and more), the same is done with Python's whole numbers.

Defined results: a null vector, one with a null, NaN or infinite component and one whose length is not that of the others
(that of the smallest vec_id whose vector divides into PARTS) are left out; the first codebooks are those of the ENTRIES
smallest by vec_id (nulls last), then by vector, where vectors repeat each counts; with fewer vectors there are fewer entries;
errors that pass 63 bits raise; a null label is a label; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Below it squares of differences, summed over a part of up to 2,048 components, fit 63 bits.
LIMIT = 1 << 25
#: Vectors whose distances are held at once.
HELD = 4096


def kept_vectors(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, vector, label) of the vectors that are coded, and their length (0 where there are none)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = vectors.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & finite)
    own = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("label"))
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    size = first[0] if first else 0
    return own.where(F.size("vector") == size), size


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), as int64 or, where some are LIMIT or more, as Python's whole numbers."""
    scaled = np.floor(values * scale)  # exact for a power of two
    if not len(scaled) or np.abs(scaled).max() < LIMIT:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel().tolist()], object).reshape(scaled.shape)


def batch_vectors(column: pa.Array, size: int, scale: int) -> np.ndarray:
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and its squared distance, for each vector and part; books: (part, entry, component)."""
    if vectors.dtype == object or books.dtype == object:
        vectors, books = vectors.astype(object), books.astype(object)
    parts = vectors.reshape(len(vectors), len(books), -1).transpose(1, 0, 2)
    norms = (books * books).sum(axis=2)
    far = norms[:, None, :] - 2 * np.matmul(parts, books.transpose(0, 2, 1))
    codes = np.argmin(far, axis=2)
    best = np.take_along_axis(far, codes[:, :, None], axis=2)[:, :, 0] + (parts * parts).sum(axis=2)
    return codes.T, best.T


def starting_books(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    own = whole_numbers(np.array([r.vector for r in rows], np.float64).reshape(len(rows), size), scale)
    return own.reshape(len(rows), parts, size // parts).transpose(1, 0, 2)


def next_books(kept: DataFrame, books: np.ndarray, size: int, scale: int = SCALE) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts that are nearest to it; unused entries stay."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    n_parts, n_entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                vectors = batch_vectors(batch["vector"].slice(at, HELD), size, scale)
                codes, _ = nearest(vectors, books)
                parts = vectors.reshape(len(vectors), n_parts, width)
                for p in range(n_parts):
                    more = np.zeros((n_entries, width), vectors.dtype)
                    np.add.at(more, codes[:, p], parts[:, p])
                    total[p] += more
                    count[p] += np.bincount(codes[:, p], minlength=n_entries)
        used = np.argwhere(count > 0)
        if len(used):
            p, e = used.repeat(width, axis=0).T
            c = np.tile(np.arange(width), len(used))
            text = pa.array([str(x) for x in total[p, e, c]], pa.string())
            yield pa.record_batch({"part": p, "entry": e, "component": c, "total": text, "n": count[p, e]})

    partial = kept.select("vector").mapInArrow(sums, "part long, entry long, component long, total string, n long")
    found = partial.groupBy("part", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    after = books.astype(object)
    for r in found.collect():  # a row for each component of the codebooks at most
        after[r.part, r.entry, r.component] = int(r.total) // r.n
    shared.unpersist()
    return after.astype(np.int64) if not after.size or max(map(abs, after.ravel().tolist())) < LIMIT else after


def coded(kept: DataFrame, books: np.ndarray, size: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.slice(at, HELD)
                codes, far = nearest(batch_vectors(part["vector"], size, scale), shared.value)
                code = [row.tobytes().hex() for row in np.ascontiguousarray(codes.astype(np.uint8))]
                error = pa.array([int(x) for x in far.sum(axis=1).tolist()], pa.int64())
                yield pa.record_batch({"vec_id": part["vec_id"], "label": part["label"], "code": pa.array(code, pa.string()), "error": error})

    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, schema)


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The vector of whole numbers that a code stands for."""
    return [int(x) for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e]]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of vectors (vec_id, embedding, label), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    kept, size = kept_vectors(vectors, parts)
    books = starting_books(kept, size, parts, entries, scale)
    if not books.size:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    for _ in range(rounds):
        books = next_books(kept, books, size, scale)
    return coded(kept, books, size, scale), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_errors(*compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def with_label_errors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    rows = common.written(codes, "vector-codes")
    labels = common.written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = ",".join(str(int(x)) for x in books.ravel())
    out = common.joined_by_share(rows, labels, "label", "n", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))
