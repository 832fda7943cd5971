"""Operator 9: n-gram Jaccard join as a blocked product of the sparse document by n-gram matrix with its transpose.

1. Shingles. Each document's distinct five-word shingles become 64-bit hashes (a document of fewer words has its whole
   sequence as one). They are shuffled once, packed: a row holds the hashes of a few thousand documents that fall into
   one range of hashes.
2. Columns. A range knows every holder of its hashes, so it drops columns that one distinct set alone holds; only
   columns with two holders or more leave it. A column that HOT sets of one part hold is shared for certain: its cells
   spread over all ranges and only a mark goes to its own, so a common line fills no task. Documents with equal sets are
   one row of the matrix, which the set's digest and size name.
3. Bounds. A row links only if 0.8 of its set lies in shared columns; others go, and columns are counted again.
   In the order of rarity, rows that link share a column among their first n - ceil(0.8 n) + 1.
4. Product. Rows lie in blocks with those that share their most popular prefix column. Each block is multiplied with
   itself, and those of a large group with the group's first one, which is linear in its size and joins copies. Then
   pairs of blocks are multiplied that share a prefix column: only the rows that have it, whose sizes allow a link with a
   row of the other block, and that are not yet joined to it. A product keeps the pairs whose overlap reaches the bound
   that both sizes give, and returns links enough to hold every linked pair together (a spanning forest), never all pairs.
5. Groups. Alternating large-star and small-star rounds of joins, over these links and those between the sets of one
   doc_id, give each row the smallest doc_id that it reaches.

No pair is skipped: pairs left out by a bound cannot reach the threshold.

Defined results: null and empty texts have no shingles and link with nothing; a null doc_id is reported with a null
component and links with nothing; rows that repeat a doc_id are reported each, and the id links by any of its texts; very long texts are
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import text_parts

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Hashes that a range holds on average (the number of ranges follows the input), and bytes of text that a task packs at once.
PER_RANGE, PACKED = 750_000, 4_000_000
#: Sets of one part that hold a column whose cells need not meet in one range.
HOT = 16
#: Rows of the matrix in a block, and hashes of small groups that a task takes together.
BLOCK_ROWS, TASK_ROWS = 512, 2_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    one = xxhash.xxh3_64_intdigest
    out = []
    for text in texts:
        own = text.lower().split()  # bytes: A-Z only, and just the six ASCII white spaces
        n = len(own)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(one, own), np.uint64, n)
        size = min(n, words)
        total = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            total = (total ^ h[i : n - size + 1 + i]) * _MIX[i % 5]
            total ^= total >> np.uint64(29)
        out.append(np.unique(total))
    return out


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def shuffled_columns(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: (doc_id, digest, n) of each row of docs; kind 1: (digest, n, column) of each shared column's holders.

    kind 2: the same of columns that HOT sets of some part hold, perhaps repeated.
    """
    spark = docs.sparkSession
    # About one shingle for each six bytes of text; the bytes are known without reading what they say.
    size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    ranges = max(1, int(-(-size // (6 * PER_RANGE))), spark.sparkContext.defaultParallelism)

    def packed_rows(sets: list[np.ndarray], ids: list[int | None]) -> pa.RecordBatch:
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        digests = np.fromiter(map(_digest, sets), np.int64, len(sets))
        known = np.fromiter((-1 if i is None else 1 for i in ids), np.int64, len(ids))
        numbers = np.fromiter((i or 0 for i in ids), np.int64, len(ids))
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        row = np.repeat(np.arange(len(sets)), counts)
        # Equal sets: the smallest doc_id alone holds the columns, so copies are one row of a part.
        order = np.lexsort((numbers, counts, digests, known < 0))
        first = np.ones(len(order), bool)
        first[1:] = (digests[order][1:] != digests[order][:-1]) | (counts[order][1:] != counts[order][:-1])
        stands = np.zeros(len(order), bool)
        stands[order[first]] = True
        keep = (stands & (known > 0))[row]
        every, row = every[keep], row[keep]
        meta = np.stack([numbers, digests, counts, known])
        spread = xxhash.xxh3_64_intdigest(meta.tobytes()) % ranges
        rows = {"range": [], "meta": [], "held": [], "hashes": []}

        def add(key: int, row: np.ndarray, hashes: np.ndarray, meta: np.ndarray) -> None:
            own, held = np.unique(row, return_counts=True)
            rows["range"].append(int(key))
            # Digests, then sizes in half as many bytes: a range needs no more of a set, and most bytes shuffled are these.
            rows["meta"].append(meta[0, own].tobytes() + meta[1, own].astype("<i4").tobytes())
            rows["held"].append(held.astype("<u4").tobytes())
            rows["hashes"].append(hashes.tobytes())

        # Columns that many sets of a part hold are shared for certain: their cells go anywhere, and a mark to their range.
        columns, which, times = np.unique(every, return_inverse=True, return_counts=True)
        hot = (times >= HOT)[which]
        if hot.any():
            add(2 * ranges + spread, row[hot], every[hot], meta[1:3])
        marks = columns[times >= HOT]
        every, row = np.concatenate([every[~hot], marks]), np.concatenate([row[~hot], np.full(len(marks), len(sets))])
        marked = np.append(meta[1:3], np.array([[0], [-1]]), axis=1)
        part = (every % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        every, row, part = every[order], row[order], part[order]
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            add(r, row[cuts[r] : cuts[r + 1]], every[cuts[r] : cuts[r + 1]], marked)
        rows["range"].append(int(ranges + spread))
        rows["meta"].append(meta.tobytes())
        rows["held"].append(b"")
        rows["hashes"].append(b"")
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types, strict=True)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch["text"].cast(pa.binary()), PACKED):
                yield packed_rows(shingle_sets(texts, words), batch["doc_id"][part].to_pylist())

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if ranges <= key[0].as_py() < 2 * ranges:
            meta = np.concatenate([np.frombuffer(m, np.int64).reshape(4, -1) for m in table["meta"].to_pylist()], axis=1)
            ids = pa.array(meta[0], mask=meta[3] < 0)
            return pa.table({"kind": pa.array(np.zeros(len(ids), np.int32)), "doc_id": ids, "digest": meta[1], "n": meta[2], "column": np.zeros(len(ids), np.int64)})
        hashes = np.concatenate([np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()])
        metas = [np.stack([np.frombuffer(m, np.int64, len(m) // 12), np.frombuffer(m, "<i4", -1, len(m) // 12 * 8)]) for m in table["meta"].to_pylist()]
        held = [np.frombuffer(h, "<u4") for h in table["held"].to_pylist()]
        meta = np.concatenate(metas, axis=1)
        row = np.repeat(np.arange(meta.shape[1]), np.concatenate(held))
        if key[0].as_py() >= 2 * ranges:
            return cells(np.full(len(row), 2, np.int32), meta[:, row], hashes)
        # One number for each distinct set.
        order = np.lexsort((meta[1], meta[0]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(meta[0][order]) != 0) | (np.diff(meta[1][order]) != 0)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        head = order[new]
        row = which[row]
        order = np.lexsort((row, hashes))
        hashes, row = hashes[order], row[order]
        same = hashes[1:] == hashes[:-1]
        keep = np.append(True, ~same | (row[1:] != row[:-1]))
        hashes, row = hashes[keep], row[keep]
        same = hashes[1:] == hashes[:-1]
        shared = np.append(False, same) | np.append(same, False)
        # A mark tells that the column is hot somewhere, so all its cells are of that kind.
        n = meta[1][head][row]
        first = np.append(True, ~same)
        hot = np.logical_or.reduceat(n < 0, np.flatnonzero(first))[np.cumsum(first) - 1] if len(n) else np.zeros(0, bool)
        keep = shared & (n >= 0)
        return cells(np.where(hot[keep], 2, 1).astype(np.int32), meta[:, head[row[keep]]], hashes[keep])

    def cells(kind: np.ndarray, meta: np.ndarray, hashes: np.ndarray) -> pa.Table:
        return pa.table({"kind": kind, "doc_id": np.zeros(len(kind), np.int64), "digest": meta[0], "n": meta[1], "column": hashes.view(np.int64)})

    packed = docs.mapInArrow(pack, "range long, meta binary, held binary, hashes binary")
    return packed.groupBy("range").applyInArrow(count, "kind int, doc_id long, digest long, n long, column long")


def live_rows(cells: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """(node, n, cells): rows with enough of their set in shared columns; cells: (df, column) in the order of rarity."""
    shared = cells
    for _ in range(rounds):
        enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).where(100 * F.col("m") >= percent * F.col("n")).select("node")
        shared = shared.join(enough, "node", "left_semi")
        df = shared.groupBy("column").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        shared = shared.select("node", "n", "column").join(df, "column")
    rows = shared.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "column"))).alias("cells"))
    return rows.where(100 * F.size("cells") >= percent * F.col("n"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches, by large-star and small-star rounds."""
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.written(moved.unionByName(low.withColumnRenamed("m", "b")).distinct(), label)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def prefix_columns(rows: DataFrame, percent: int) -> DataFrame:
    """(node, n, column, k): the columns of each row of which linked rows share one at least; k rows have it there."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("cells"))
    heads = rows.select("node", "n", F.explode(F.slice("cells", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("cell")).select("node", "n", F.col("cell.column").alias("column"))
    often = heads.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return heads.join(often, "column")


def _blocks(of: Column, size: Column, by: Column) -> tuple[Column, Column]:
    """(block, part): what belongs together by the value of, in blocks of about BLOCK_ROWS rows if it has more."""
    part = F.when(size > BLOCK_ROWS, F.pmod(F.xxhash64(by), F.ceil(size / BLOCK_ROWS))).otherwise(0)
    return F.xxhash64(of, part), part


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that hold together every pair of rows whose similarity reaches percent.

    A row's key is its most popular prefix column, so that groups of near copies share one. First each key's rows are
    multiplied with themselves, in blocks, and the blocks of a large key with its first block: one product for each block,
    which joins groups of copies however large. Then each two blocks that share a prefix column are multiplied, with just
    those rows that have one in common and are not yet joined, and whose sizes allow a link.
    """
    heads = common.written(prefix_columns(rows, percent), "jaccard-heads")
    keys = heads.groupBy("node").agg(F.max(F.struct("k", "column")).alias("best")).select("node", F.col("best.column").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    block, part = _blocks(F.col("key"), F.col("size"), F.col("node"))
    placed = keys.join(sizes, "key").select("node", "key", "size", block.alias("block"), part.alias("part"))
    rows = rows.select("node", "n", F.transform("cells", lambda c: c["column"]).alias("columns"))
    placed = common.written(rows.join(placed, "node"), "jaccard-rows")
    own = placed.where("size > 1").select(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(True).alias("left"), F.lit(True).alias("right"), "node", "n", "columns")
    large = placed.where(F.col("size") > BLOCK_ROWS)
    first = large.where("part = 0").withColumn("other", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / BLOCK_ROWS) - 1)))
    first = first.select("block", F.xxhash64("key", F.col("other").cast(large.schema["part"].dataType)).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), "node", "n", "columns")
    others = large.where("part > 0").select(F.xxhash64("key", F.lit(0).cast(large.schema["part"].dataType)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"), "node", "n", "columns")
    near = common.written(products(own.unionByName(first.withColumnRenamed("block", "i")).unionByName(others), placed.count(), percent), "jaccard-near")
    found = common.written(components(near, "jaccard-roots"), "jaccard-roots")
    # Rows of a large key that are joined lie in blocks of their own now.
    at = placed.select("node", "key", "size", "block").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = at.where(F.col("size") > BLOCK_ROWS).groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    at = at.join(joined, ["key", "root"], "left")
    again, _ = _blocks(F.xxhash64("key", F.when(F.col("own") > BLOCK_ROWS, F.col("root"))), F.coalesce(F.when(F.col("own") > BLOCK_ROWS, F.col("own")), F.lit(0)), F.col("node"))
    at = common.written(at.select("node", "root", F.when(F.col("own").isNull(), F.col("block")).otherwise(again).alias("block"), F.col("own").isNotNull().alias("moved")), "jaccard-blocks")
    heads = heads.select("node", "n", "column").join(at, "node")
    # A column whose rows are all joined asks for no more.
    open_columns = heads.groupBy("column").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("column")
    heads = common.written(heads.join(open_columns, "column"), "jaccard-open")
    met = heads.groupBy("column", F.col("block").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    apart = (F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))
    pairs = heads.join(met, "column").where(fits & apart & ((F.col("block") != F.col("other")) | F.col("moved")))
    pairs = pairs.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "node").distinct()
    pairs = common.written(pairs, "jaccard-pairs")
    far = products(pairs.join(placed.select("node", "n", "columns"), "node"), pairs.count(), percent)
    return far.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def products(rows: DataFrame, count: int, percent: int) -> DataFrame:
    """(a, b) from (i, j, left, right, node, n, columns): the links of rows of block i (left) with rows of block j (right)."""
    # Block pairs are small; a task takes many of them.
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for (i, j), own in pdf.groupby(["i", "j"], sort=False):
            found += _forest(own, None, percent) if i == j else _forest(own[own["left"]], own[own["right"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.withColumn("task", F.pmod(F.xxhash64("i", "j"), F.lit(tasks))).groupBy("task").applyInPandas(run, "a long, b long")


def _forest(a: pd.DataFrame, b: pd.DataFrame | None, percent: int) -> list[tuple[int, int]]:
    """Links of a block with itself (b is None) or with another, reduced to a spanning forest."""
    rows = a if b is None else pd.concat([a, b])
    if len(rows) < 2:
        return []
    nodes, n = rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    half = len(a) if b is not None else len(rows)
    lists = [np.asarray(c, np.int64) for c in rows["columns"]]
    if b is None and len(rows) == 2:
        overlap = np.array([[0, len(np.intersect1d(*lists, assume_unique=True))], [0, 0]])
        left = right = np.arange(2)
    else:
        _, column = np.unique(np.concatenate(lists), return_inverse=True)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        left = np.arange(half)
        right = left if b is None else np.arange(half, len(rows))
        overlap = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 4096  # columns of the matrix that are dense at a time
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, [low, low + width])
            dense = np.zeros((len(rows), width), np.float32)
            dense[row[s:e], column[s:e] - low] = 1
            overlap += dense[left] @ dense[right].T
        overlap = np.rint(overlap).astype(np.int64)
    union = n[left][:, None] + n[right][None, :] - overlap
    linked = 100 * overlap >= percent * union
    if b is None:
        linked = np.triu(linked, 1)
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(left)):
        for j in right[np.flatnonzero(linked[i])].tolist():
            x, y = find(int(left[i])), find(j)
            if x != y:
                root[y] = x
                out.append((int(nodes[left[i]]), int(nodes[j])))
    return out


def node_of(digest: Column | str = "digest", n: Column | str = "n") -> Column:
    """A set's name in the matrix: its digest and size in 64 bits, as columns are named too."""
    return F.xxhash64(digest, n)


def named_classes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets: (node, first), first being the smallest doc_id that has the set; and the doc_ids that have more than one:
    (doc_id, least, most, empty), the least and greatest node, and if it has a text without shingles too."""
    ids = own.where("doc_id is not null")
    sets = ids.where("n > 0").groupBy(node_of().alias("node")).agg(F.min("doc_id").alias("first"))
    node = F.when(F.col("n") > 0, node_of())
    repeated = ids.groupBy("doc_id").agg(F.min(node).alias("least"), F.max(node).alias("most"), (F.min("n") == 0).alias("empty"))
    return common.written(sets, "jaccard-classes"), common.written(repeated.where("least < most or (empty and least is not null)"), "jaccard-repeated")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Each row of docs with n_shingles, class_id (smallest doc_id with an equal set) and component_id."""
    docs = common.doc_rows(docs)
    packed = common.written(shuffled_columns(docs, words), "jaccard-columns")
    own = packed.where("kind = 0").select("doc_id", "digest", "n")
    classes, repeated = named_classes(own)
    cells = packed.where("kind = 1").select(node_of().alias("node"), "n", "column")
    hot = packed.where("kind = 2").select(node_of().alias("node"), "n", "column").distinct()
    live = common.written(live_rows(cells.unionByName(hot), percent), "jaccard-live")
    same_id = own.where("n > 0").select("doc_id", node_of().alias("a")).join(repeated.where("least < most"), "doc_id").select("a", F.col("least").alias("b"))
    links = common.written(block_links(live, percent).unionByName(same_id), "jaccard-links")
    root = components(links, "jaccard-roots")
    root = common.written(root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()).join(classes, "node"), "jaccard-members")
    component = root.join(root.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "component")
    # A text without shingles goes with the other texts of its doc_id.
    rows = own.join(repeated.where("empty").select("doc_id", "least"), "doc_id", "left").withColumn("node", F.when(F.col("n") > 0, node_of()).otherwise(F.col("least")))
    rows = rows.join(classes.join(component, "node", "left"), "node", "left")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id")).alias("component_id"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir)).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")
