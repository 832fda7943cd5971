"""Operator 4: quality rules; a modified Kneser-Ney n-gram model rejects texts whose perplexity leaves their language's band.

1. Spark counts, for each language, all runs of ORDER symbols of its texts. A symbol is a code point, whatever the script;
   capitals share one symbol, digits another. A task adds up its own runs before they are shuffled.
2. Modified Kneser-Ney smoothing, as joins and windows over the tables of n-grams: counts at the highest order, counts of
   distinct predecessors below, three discounts for each order and language from counts of counts.
3. The model is stored in sorted hash arrays: for each n-gram of the highest order a 64-bit hash of language and symbols,
   and its log-probability, in slices of about SLICE n-grams by range of hashes. A task looks up all symbols of its texts.
   One slice is broadcast at a time, so memory has a bound however many n-grams there are; with more slices than one, each
   is a pass of its own and the passes' sums are joined. Back-off happens where the model is made: the texts that it scores
   are those that it counted, so each of their n-grams is in it.
4. The perplexity of a text is per letter or digit: other symbols cost but do not count, so text that is strewn with them
   stands out. Each language and length class gets a band of log-perplexity from the documents that pass the base rules:
   around the language's median, from quartiles of the distance to it, FENCE inter-quartile ranges below the first and
   above the third. The quartiles of a language's class are drawn towards those of the class in all languages with the
   weight of PRIOR documents, and those towards all classes' likewise, so that few documents decide little; in a language
   of about FEW documents or less the band is wider. Documents outside are rejected.

Base rules that hold whatever the model says: fewer than 10 words, or more than a fifth of all words in repeated windows
of five.

Defined results: a null or empty text has no words, fails the base rules and has no perplexity, as any text without
letters and digits; a null language is a language of its own, as is the empty one; repeated rows are reported each and
count each; equal perplexities get equal verdicts; very long texts are whole; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import text_parts

ORDER = 4
#: Bits of a code point; n-grams are two longs, hi and lo, of two symbols each.
BITS = 21
MASK = (1 << BITS) - 1
#: N-grams of a slice of the model: 12 bytes each in the driver and in each worker, one slice at a time.
SLICE = 2_000_000
#: Distinct n-grams that a task holds before it passes them on.
HELD = 700_000
#: Bytes of text that a task reads at once.
PART = 500_000
FENCE, PRIOR, FEW = 3.5, 100, 7
#: The least width of a half band, in powers of ten of perplexity.
LEAST_SPREAD = 0.01
MIN_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Symbols that are no code point of a text: its edge, a capital, a digit.
EDGE, CAPITAL, DIGIT = range(3)
#: Beyond it no code point is a letter, a digit or a capital.
POINTS = 0x40000
SPACES = b" \t\n\v\f\r"
_WORD_START, _SYMBOL = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_WORD_START[[c for c in range(256) if c & 0xC0 != 0x80 and c not in SPACES]] = 1
_SYMBOL[list(b"#*$%&|<>")] = 1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _by_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of flags between cuts; a text may be empty."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[cuts[1:]] - upto[cuts[:-1]]


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a window of five that the text has twice or more."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    each = np.fromiter((hash(w) for own in words for w in own), np.int64, total).view(np.uint64)
    text = np.repeat(np.arange(len(words)), counts)
    n = total - WINDOW + 1
    keys = text[:n].astype(np.uint64) * _MIX[0]
    for i in range(WINDOW):
        keys = (keys ^ each[i : n + i]) * _MIX[i]
        keys ^= keys >> np.uint64(29)
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    keys = keys[inside]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice]
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    return np.bincount(text[np.cumsum(depth[:-1]) > 0], minlength=len(words))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    every = np.frombuffer(b"".join(texts), np.uint8)
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    dup[i] += bool(line.strip(SPACES))
                else:
                    seen.add(line)
    return {
        "n_words": np.fromiter(map(len, words), np.int64, len(words)),
        "word_chars": _by_text(_WORD_START[every], cuts),
        "n_symbols": _by_text(_SYMBOL[every], cuts),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words).astype(np.int64),
    }


def folds() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point below POINTS, and whether it is a letter or digit."""
    symbol, solid = np.arange(POINTS, dtype=np.uint32), np.zeros(POINTS, bool)
    symbol[:3] = 3  # the control characters whose numbers stand for something else
    for c in map(chr, range(POINTS)):
        if c.isdigit():
            symbol[ord(c)] = DIGIT
        elif c.isupper():
            symbol[ord(c)] = CAPITAL
        solid[ord(c)] = c.isalnum()
    return symbol, solid


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point of all texts the n-gram that it ends (hi, lo) and whether it is solid; and where texts end."""
    symbol, solid = common.kept("folds", folds)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, POINTS - 1)
    own = np.where(points < POINTS, symbol[low], points).astype(np.int64)
    ends = np.cumsum(n)
    starts = (ends - n)[n > 0]
    before = []
    for k in range(1, ORDER):
        shifted = np.full(len(own), EDGE, np.int64)
        shifted[k:] = own[:-k] if len(own) > k else own[:0]
        for i in range(k):
            at = starts + i
            shifted[at[at < len(own)]] = EDGE  # a shorter text's next start sets its own
        before.append(shifted)
    # What precedes a text's first symbols is its edge, also where texts are shorter than the order.
    place = np.arange(len(own)) - np.repeat(ends - n, n)
    for k in range(1, ORDER):
        before[k - 1][place < k] = EDGE
    return before[2] << BITS | before[1], before[0] << BITS | own, solid[low] & (points < POINTS), ends


def hashes(lang: str | None, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of a language."""
    seed = np.uint64(xxhash.xxh3_64_intdigest("-" if lang is None else "+" + lang))
    h = (hi.astype(np.uint64) + seed) * _MIX[0]
    h ^= h >> np.uint64(31)
    h = (h + lo.astype(np.uint64)) * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[3]
    return h ^ (h >> np.uint64(32))


def by_language(texts: list[str], langs: list[str | None]) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each language and the places of its texts."""
    places: dict[str | None, list[int]] = {}
    for i, lang in enumerate(langs):
        places.setdefault(lang, []).append(i)
    for lang, own in places.items():
        yield lang, np.array(own)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, hi, lo, n): how often each n-gram of the highest order occurs in each language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            key, hi, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, where = np.unique(key, return_index=True, return_inverse=True)
            return key[first], hi[first], lo[first], np.bincount(where, n, len(first)).astype(np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                _, hi, lo, n = added(parts)
                for at in range(0, len(hi), 200_000):
                    cut = slice(at, at + 200_000)
                    yield pa.record_batch({"lang": pa.array([lang] * len(hi[cut]), pa.string()), "hi": hi[cut], "lo": lo[cut], "n": n[cut]})
            held.clear()

        for batch in batches:
            langs = batch["lang"].to_pylist()
            for part, texts in text_parts(batch["text"], PART):
                for lang, own in by_language(texts, langs[part]):
                    hi, lo, _, _ = streams([texts[i] for i in own])
                    key, first, n = np.unique(hashes(lang, hi, lo), return_index=True, return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((key, hi[first], lo[first], n))
                    if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > len(parts[0][0]):
                        size -= sum(len(p[0]) for p in parts[:-1])
                        held[lang] = parts = [added(parts)]
                        size += len(parts[0][0])
                    else:
                        size += len(key)
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    grams = docs.select("text", "lang").mapInArrow(run, "lang string, hi long, lo long, n long")
    return grams.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _with_discounts(level: DataFrame) -> DataFrame:
    """level with cut: what modified Kneser-Ney takes off its count."""
    freq = [F.greatest(F.lit(1), F.sum(F.when(F.col("n") == i, 1).otherwise(0))).alias(f"f{i}") for i in (1, 2, 3, 4)]
    of = level.groupBy("lang").agg(*freq)
    y = F.col("f1") / (F.col("f1") + 2 * F.col("f2"))
    cuts = [F.least(F.greatest(i - (i + 1) * y * F.col(f"f{i + 1}") / F.col(f"f{i}"), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)]
    of = of.select(F.col("lang").alias("_lang"), *cuts)
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return level.join(of, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "hi", "lo", "n", cut.alias("cut"))


def _without_first(hi: Column, lo: Column, order: int) -> list[Column]:
    """The n-gram without its first symbol, from one of so many symbols."""
    hi = hi.bitwiseAND(MASK) if order == 4 else F.lit(0).cast("long")
    return [hi.alias("hi"), (lo.bitwiseAND(MASK) if order == 2 else lo).alias("lo")]


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, hi, lo, p): the smoothed probability of each n-gram's last symbol after the others; interpolated, with the
    same chance for each symbol of the language, and for an unseen one, at the root."""
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):  # counts of distinct predecessors
        shorter = levels[k + 1].select("lang", *_without_first(F.col("hi"), F.col("lo"), k + 1))
        levels[k] = common.written(shorter.groupBy("lang", "hi", "lo").agg(F.count(F.lit(1)).alias("n")), "quality-level")
    below = None
    for k in range(1, ORDER + 1):
        # A context has as many successors as there are symbols at most.
        context = Window.partitionBy("lang", "hi", F.shiftright("lo", BITS))
        own = _with_discounts(levels[k])
        own = own.select("lang", "hi", "lo", "n", "cut", F.sum("n").over(context).alias("total"), (F.sum("cut").over(context) / F.sum("n").over(context)).alias("gamma"), F.count(F.lit(1)).over(context).alias("kinds"))
        first = (F.col("n") - F.col("cut")) / F.col("total")
        if below is None:
            found = own.select("lang", "hi", "lo", (first + F.col("gamma") / (F.col("kinds") + 1)).alias("p"))
        else:
            lower = below.select(F.col("lang").alias("_lang"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("p").alias("_p"))
            hi, lo = _without_first(F.col("hi"), F.col("lo"), k)
            own = own.withColumn("hi_", hi).withColumn("lo_", lo)
            same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("hi_") == F.col("_hi")) & (F.col("lo_") == F.col("_lo"))
            found = own.join(lower, same).select("lang", "hi", "lo", (first + F.col("gamma") * F.col("_p")).alias("p"))
        below = common.written(found, "quality-model")
    return below


class Model:
    """Sorted hash arrays in a table: (slice, hashes, scores), a row for each slice."""

    def __init__(self, probabilities: DataFrame):
        self.slices = slices = max(1, -(-probabilities.count() // SLICE))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hi, lo = batch["hi"].to_numpy(), batch["lo"].to_numpy()
                key = np.empty(len(hi), np.uint64)
                for lang, own in by_language([], batch["lang"].to_pylist()):
                    key[own] = hashes(lang, hi[own], lo[own])
                yield pa.record_batch({"slice": slice_of(key, slices), "key": key.view(np.int64), "score": np.log10(batch["p"].to_numpy()).astype(np.float32)})

        def sorted_arrays(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            keys, scores = table["key"].to_numpy().view(np.uint64), table["score"].to_numpy()
            order = np.argsort(keys)
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "hashes": pa.array([keys[order].tobytes()], pa.binary()), "scores": pa.array([scores[order].tobytes()], pa.binary())})

        rows = probabilities.mapInArrow(hashed, "slice long, key long, score float")
        self.table = common.written(rows.groupBy("slice").applyInArrow(sorted_arrays, "slice long, hashes binary, scores binary"), "quality-arrays")

    def arrays(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        row = self.table.where(F.col("slice") == number).first()
        if row is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.float32)
        return np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["scores"], np.float32)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slices follow the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


class Lookup:
    """Sorted hashes with the place of each range of leading bits, about one hash in a range: few steps find a key."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray, slices: int):
        bits = max(8, (len(keys) * slices).bit_length())
        self.shift = np.uint64(64 - bits)
        # The last hash stands for the end; no n-gram has it but by chance.
        self.keys, self.scores = np.append(keys, np.uint64((1 << 64) - 1)), np.append(scores, np.float32(0))
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The score of each hash, 0 for one that is not there."""
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] < wanted)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < wanted[todo]]
        return np.where(self.keys[at] == wanted, self.scores[at], np.float32(0))


def trained(docs: DataFrame) -> Model:
    """The model of docs (text without nulls, lang)."""
    return Model(kneser_ney(common.written(gram_counts(docs), "quality-grams")))


def _pass(docs: DataFrame, model: Model, number: int) -> tuple[DataFrame, object]:
    """Each row of docs (text or a _row that has it, lang and more) with its base counts, n_solid, and the sum of the log10 probabilities that a slice holds."""
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays(number))
    slices = model.slices
    more = [f for f in docs.schema.fields if f.name not in ("text", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*shared.value, slices)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            # A row that is carried along holds its text, which comes no second time.
            column = batch["text"] if "text" in batch.schema.names else pc.fill_null(pc.struct_field(batch["_row"], "text"), "")
            for part, texts in text_parts(column, PART):
                n_solid, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                for lang, own in by_language(texts, langs[part]):
                    hi, lo, solid, ends = streams([texts[i] for i in own])
                    score = lookup.of(hashes(lang, hi, lo)).astype(np.float64)
                    cuts = np.concatenate([[0], ends])
                    n_solid[own] = _by_text(solid, cuts)
                    upto = np.concatenate([[0], np.cumsum(score)])
                    total[own] = upto[cuts[1:]] - upto[cuts[:-1]]
                n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
                counts = base_counts([t.encode("utf-8", "surrogatepass") for t in texts])
                yield pa.record_batch({f.name: batch[f.name][part.start : part.stop] for f in more} | {"lang": batch["lang"][part.start : part.stop], "n_chars": n_chars, "n_solid": n_solid, "total": total} | counts)

    counts = "lang string, n_chars long, n_solid long, total double, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in more)
    return docs.mapInArrow(run, schema + counts), shared


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of docs (text or a _row that has it, lang and more) without its text: base counts, size class, and x, log10 perplexity a letter."""
    if model.slices == 1:
        rows, _ = _pass(docs, model, 0)
    else:
        docs = common.written(docs.withColumn("_rid", F.monotonically_increasing_id()), "quality-docs")
        parts = []
        for number in range(model.slices):
            found, shared = _pass(docs if not number else docs.drop("doc_id"), model, number)
            parts.append(common.written(found if not number else found.select("_rid", "total"), "quality-pass"))
            shared.destroy()
        rows, sums = parts[0].drop("total"), parts[0].select("_rid", "total")
        for found in parts[1:]:
            sums = sums.unionByName(found)
        rows = rows.join(sums.groupBy("_rid").agg(F.sum("total").alias("total")), "_rid").drop("_rid")
    size = F.least(F.greatest(F.floor(F.log2(F.col("n_chars") + 1)), F.lit(5)), F.lit(13))
    x = F.when(F.col("n_solid") > 0, -F.col("total") / F.col("n_solid"))
    return rows.withColumn("size", size).withColumn("x", x).drop("n_chars", "n_solid", "total")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """(lang, size, low, high): the band of log10 perplexity of each language and length class that has a document."""
    known = rows.where(F.col("x").isNotNull() & ~base_failed()).select("lang", "size", "x")
    middle = known.groupBy("lang").agg(F.percentile_approx("x", 0.5, 10_000).alias("middle"), F.count(F.lit(1)).alias("own_n"))
    middle = middle.withColumnRenamed("lang", "_lang")
    known = known.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "size", (F.col("x") - F.col("middle")).alias("d"))

    def quartiles(prefix: str, *by: str) -> DataFrame:
        q = F.percentile_approx("d", [0.25, 0.75], 10_000)
        return known.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{prefix}_n"), q.alias(f"{prefix}_q"))

    joined = quartiles("fine", "lang", "size").join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).join(quartiles("class", "size"), "size")
    joined = joined.crossJoin(F.broadcast(quartiles("all")))  # one row

    def drawn(n: str, q: Column, to: Column) -> Column:
        return (F.col(n) * q + PRIOR * to) / (F.col(n) + PRIOR)

    ends = [drawn("fine_n", F.col("fine_q")[i], drawn("class_n", F.col("class_q")[i], F.col("all_q")[i])) for i in (0, 1)]
    spread = F.greatest(ends[1] - ends[0], F.lit(LEAST_SPREAD)) * FENCE * (1 + F.pow(FEW / F.col("own_n"), F.lit(2)))
    return joined.select("lang", "size", (F.col("middle") + ends[0] - spread).alias("low"), (F.col("middle") + ends[1] + spread).alias("high"))


def with_verdict(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (of scored) with perplexity, base_failed and kept, by the bands found."""
    found = found.select(F.col("lang").alias("_lang"), F.col("size").alias("_size"), "low", "high")
    joined = rows.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("size") == F.col("_size")), "left")
    inside = F.coalesce(F.col("x").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.select(*(rows[c] for c in rows.columns), F.pow(F.lit(10.0), "x").alias("perplexity"), base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), *more)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, perplexity, base_failed and kept of each row of docs (doc_id, text, lang, any more)."""
    docs = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rows = common.written(scored(docs, trained(docs)), "quality-scored")
    out = with_verdict(rows, common.written(bands(rows), "quality-bands"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "perplexity", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are. Texts are scored twice, which is less than moving them for a join."""
    model = trained(texts_of(docs))
    found = common.written(bands(common.written(scored(texts_of(docs), model), "quality-scored")), "quality-bands")
    rows = scored(texts_of(docs, F.struct(*(docs[c] for c in docs.columns)).alias("_row")).drop("text"), model)
    return with_verdict(rows, found).where("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
