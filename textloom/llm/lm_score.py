"""Operator 8: language-model scores by a weighted back-off automaton over words.

1. Parts. A task numbers the distinct words of each few megabytes of text and writes the texts as such numbers.
2. Counts. Every run of one, two and three words of a part, once each, goes to a range of hashes with its training count,
   packed. A range adds up the counts of all parts and sends each part the totals of just its own runs, in the order in
   which they came. No run is left out, however rare, and nothing but 64 bucket sizes for each length reaches the driver,
   so words, contexts and arcs grow with the corpus.
3. Automaton. A state is a context of two words, one or none; its arcs are the words seen after it, and its failure arc
   leads to the context without its first word. With n of an arc, t of its state and s of the length of context,
   P(word | context) = (n + s * P(word | shorter context)) / (t + s): the log10 of this is the arc's weight, and the failure
   arc weighs log10(s / (t + s)). At the root stands the base score's P(word), an unknown word among its events, so the root
   has an arc for every word. s is the value at which training words, each left out in turn, take the failure arc as often
   as there are arcs seen once. An arc leads to the longest context that has been seen and ends with its word.
4. Traversal. A task holds the states and arcs that its own part needs, as tables keyed by state and word, and reads its
   texts from left to right: the state of each goes along the word's arc or, as long as there is none, along failure arcs,
   and the weights add up. All texts of a part move side by side. A long text is read in stretches; each begins two words
   early, after which the state is the one that the whole text would have come with, as no state reaches further back.

Defined results: a null or empty text is the end alone; a null doc_id is not held out; repeated rows are reported each;
very long texts are whole; without training texts an unknown word is the only event; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import in_parts

ORDER = 3
#: Words that a text is read in one go; longer ones are read in stretches, side by side.
STRETCH = 256
#: Bytes of text of a part.
PART = 12_000_000
#: Runs of words that a range of hashes gets on average; the number of ranges follows the input.
PER_RANGE = 1_500_000
#: No word: stands for the end of a text.
END = b"\n"
END_HASH = int(np.uint64(xxhash.xxh3_64_intdigest(END)).view(np.int64))
#: Stands before a text; no hash of a word but by chance.
BEGIN = np.uint64(0x6A09E667F3BCC909)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def squeezed(places: np.ndarray) -> bytes:
    """Small numbers, their low bytes together, their next bytes together and so on, and compressed."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def restored(squeezed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(squeezed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def written_parts(docs: DataFrame) -> DataFrame:
    """A row for each part: its dictionary (word hashes), its texts as places in it, its training texts and all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = xxhash.xxh3_64_intdigest
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            every, held = batch["text"].cast(pa.binary()).to_pylist(), np.asarray(batch["held"].to_pylist(), bool)
            for part in in_parts(every, PART):
                hashes, lengths = [], np.empty(part.stop - part.start, np.int64)
                for i, t in enumerate(every[part]):
                    words = t.lower().split()  # bytes: A-Z only, and just the six ASCII white spaces
                    words.append(END)
                    hashes.append(np.fromiter(map(one, words), np.uint64, len(words)).view(np.int64))
                    lengths[i] = len(words)
                words, places, seen = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                order = np.argsort(-seen, kind="stable")  # frequent words get small numbers, which pack well
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                words, places = words[order], rank[places]
                yield pa.record_batch(
                    {
                        "part": [number],
                        "words": pa.array([words.astype("<i8").tobytes()], pa.binary()),
                        "trained": [int((~held[part]).sum())],
                        "tokens": [int(lengths.sum())],
                        "doc_ids": pa.array([batch["doc_id"][part.start : part.stop].to_pylist()], pa.list_(pa.int64())),
                        "held": pa.array([held[part].astype(np.uint8).tobytes()], pa.binary()),
                        "lengths": pa.array([lengths.astype("<i8").tobytes()], pa.binary()),
                        "places": pa.array([squeezed(places)], pa.binary()),
                    }
                )
                number += 1

    return common.written(docs.mapInArrow(run, "part long, words binary, trained long, tokens long, doc_ids array<long>, held binary, lengths binary, places binary"), "lm-parts")


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, the bytes of one weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _mixed(run: np.ndarray, before: np.ndarray) -> np.ndarray:
    out = (run ^ (before * _MIX[0] + _MIX[3])) * _MIX[1]
    out ^= out >> np.uint64(32)
    out *= _MIX[2]
    return out ^ (out >> np.uint64(29))


def runs_of(words: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ORDER words: sorted distinct hashes, and for each token the one of the run that ends there."""
    keys, where = np.unique(words.view(np.uint64), return_inverse=True)
    out = [(keys, where[places].astype(np.int32))]
    hashes = run = words.view(np.uint64)[places]
    starts = np.cumsum(lengths) - lengths
    for k in range(1, ORDER):
        before = np.full(len(hashes), BEGIN)
        before[k:] = hashes[:-k]
        for i in range(k):
            before[starts[lengths > i] + i] = BEGIN
        run = _mixed(run, before)
        keys, where = np.unique(run, return_inverse=True)
        out.append((keys, where.astype(np.int32)))
    return out


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges follow the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def run_counts(parts: DataFrame, ranges: int) -> DataFrame:
    """(part, range, totals): training counts of a part's runs of a range, in the order of runs_of(), all lengths in turn;
    and with part -1 and range 64 * (length - 1) + floor(log2(count)): kinds of runs and tokens of such a count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i8")
                train = np.repeat(np.frombuffer(row["held"], np.uint8) == 0, lengths)
                found = runs_of(np.frombuffer(row["words"], "<i8"), restored(row["places"]), lengths)
                times = [np.bincount(where, train, len(keys)).astype(np.uint64) for keys, where in found]
                cuts = [np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1)) for keys, _ in found]
                out = {"range": [], "part": [], "sizes": [], "keys": [], "times": []}
                for r in range(ranges):
                    own = [slice(c[r], c[r + 1]) for c in cuts]
                    keys = np.concatenate([k[o] for (k, _), o in zip(found, own, strict=True)])
                    if len(keys):
                        out["range"].append(r)
                        out["part"].append(row["part"])
                        out["sizes"].append([o.stop - o.start for o in own])
                        out["keys"].append(packed(np.diff(keys, prepend=np.uint64(0))))  # small steps, but where a length begins
                        out["times"].append(packed(np.concatenate([t[o] for t, o in zip(times, own, strict=True)])))
                yield pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)})

    def count(table: pa.Table) -> pa.Table:
        sizes = np.array(table["sizes"].to_pylist(), np.int64)
        ends = np.cumsum(sizes, axis=1)
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        times = [unpacked(x) for x in table["times"].to_pylist()]
        totals = [np.empty(len(k), np.uint64) for k in keys]
        out = {"part": table["part"].to_pylist(), "range": table["range"].to_pylist(), "kinds": [0] * len(keys), "tokens": [0] * len(keys)}
        for k in range(ORDER):
            own = [slice(e[k] - n[k], e[k]) for e, n in zip(ends, sizes, strict=True)]
            found, where = np.unique(np.concatenate([x[o] for x, o in zip(keys, own, strict=True)]), return_inverse=True)
            total = np.bincount(where, np.concatenate([x[o] for x, o in zip(times, own, strict=True)]).astype(np.float64), len(found))
            at = 0
            for x, o in zip(totals, own, strict=True):
                x[o] = total[where[at : at + o.stop - o.start]]
                at += o.stop - o.start
            total = total[total > 0]
            bucket = np.frexp(total)[1] - 1
            kinds, tokens = np.bincount(bucket, minlength=64), np.bincount(bucket, total, 64)
            for b in np.flatnonzero(kinds).tolist():
                for name, value in (("part", -1), ("range", 64 * k + b), ("kinds", int(kinds[b])), ("tokens", int(tokens[b]))):
                    out[name].append(value)
        values = [packed(x) for x in totals] + [b""] * (len(out["part"]) - len(totals))
        return pa.table({**{k: pa.array(v, pa.int64()) for k, v in out.items()}, "totals": pa.array(values, pa.binary())})

    sent = parts.select("part", "words", "held", "lengths", "places").mapInArrow(send, "range long, part long, sizes array<long>, keys binary, times binary")
    return sent.groupBy("range").applyInArrow(count, "part long, range long, kinds long, tokens long, totals binary")


def strength(contexts: list[tuple[int, int]], once: int) -> float:
    """s of a length of context; contexts: (kinds, tokens) of contexts of like count; once: arcs seen once."""
    low, high = -3.0, 6.0
    for _ in range(60):
        s = 10 ** ((low + high) / 2)
        backed = sum(tokens * s / (tokens / kinds - 1 + s) for kinds, tokens in contexts)
        low, high = ((low + high) / 2, high) if backed < once else (low, (low + high) / 2)
    return 10**low


class Automaton:
    """The states and arcs of a part.

    States are numbered: 0 the root; 1 + word; the begin of a text; then the runs of two words; and the begin twice.
    """

    def __init__(self, where: list[np.ndarray], counts: list[np.ndarray], starts: np.ndarray, strengths: list[float], n_all: int, kinds: int, trained: int):
        """where: for each place the run of one, two and three words that ends there; counts: of each run in training."""
        self.word, pair, triple = where
        one, two, three = counts
        self.n_words = len(one)
        begin, pairs_from = 1 + len(one), 2 + len(one)
        self.begin = pairs_from + len(two)
        after_word = np.where(one > 0, 1 + np.arange(len(one), dtype=np.int32), 0).astype(np.int32)
        is_start = np.zeros(len(pair), bool)
        is_start[starts] = True
        at = self._first(pair, len(two))
        last = self.word[at]
        after_pair = np.where(two > 0, pairs_from + np.arange(len(two), dtype=np.int32), after_word[last]).astype(np.int32)

        self.fail_to = np.zeros(self.begin + 1, np.int32)
        self.fail_to[pairs_from : self.begin] = after_word[last]
        self.fail_to[self.begin] = begin
        seen = np.concatenate([[0.0], one, [trained], two, [trained]])  # of each state
        self.fail_weight = np.empty(len(seen))
        for part, s in ((slice(0, 1), 1.0), (slice(1, pairs_from), strengths[0]), (slice(pairs_from, None), strengths[1])):
            self.fail_weight[part] = np.log10(s / (seen[part] + s))

        p_word = (one + 0.5) / (n_all + 0.5 * (kinds + 1))
        self.root_weight, self.root_to = np.log10(p_word), after_word
        before = np.where(is_start[at], begin, 1 + self.word[at - 1])
        p_pair = (two + strengths[0] * p_word[last]) / (seen[before] + strengths[0])
        # States of one word come before those of two, and so do their arcs.
        shorter = self._arcs(two > 0, before, last, p_pair, after_pair)
        at = self._first(triple, len(three))
        to = pair[at]
        before = np.where(is_start[at], self.begin, pairs_from + pair[at - 1])
        p_three = (three + strengths[1] * p_pair[to]) / (seen[before] + strengths[1])
        del p_pair, seen
        longer = self._arcs(three > 0, before, self.word[at], p_three, after_pair[to])
        del at, to, before, p_three
        self.keys, self.weight, self.to = (np.concatenate(x) for x in zip(shorter, longer, strict=True))

    def _arcs(self, known: np.ndarray, before: np.ndarray, word: np.ndarray, p: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, weights and ends of the arcs that are known, by state and word."""
        keys = before[known] * np.int64(self.n_words) + word[known]
        order = np.argsort(keys)
        return keys[order], np.log10(p[known][order]), to[known][order]

    @staticmethod
    def _first(where: np.ndarray, n: int) -> np.ndarray:
        """The first place of each of n runs."""
        first = np.empty(n, np.int32)
        first[where[::-1]] = np.arange(len(where) - 1, -1, -1, dtype=np.int32)
        return first

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and what the arcs on the way weigh."""
        state, weight = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            own = state[todo]
            at_root = own == 0
            done = todo[at_root]
            weight[done] += self.root_weight[word[done]]
            state[done] = self.root_to[word[done]]
            todo, own = todo[~at_root], own[~at_root]
            if not len(todo):
                break
            key = own.astype(np.int64) * self.n_words + word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            done, at = todo[hit], at[hit]
            weight[done] += self.weight[at]
            state[done] = self.to[at]
            todo, own = todo[~hit], own[~hit]
            weight[todo] += self.fail_weight[own]
            state[todo] = self.fail_to[own]
        return state, weight

    def walk(self, starts: np.ndarray, lengths: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """The weight of each text, read from left to right."""
        parts = -(-lengths // stretch)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = starts[text] + nth * stretch
        left = np.minimum(lengths[text] - nth * stretch, stretch)
        order = np.argsort(-left, kind="stable")
        text, nth, at, left = text[order], nth[order], at[order], left[order]
        state = np.where(nth == 0, self.begin, 0)
        inside = np.flatnonzero(nth > 0)
        for back in (2, 1):
            state[inside], _ = self.step(state[inside], self.word[at[inside] - back])
        total = np.zeros(len(text))
        for i in range(int(left[0]) if len(left) else 0):
            on = int(np.searchsorted(-left, -i, "left"))  # stretches of more than i words
            state[:on], weight = self.step(state[:on], self.word[at[:on] + i])
            total[:on] += weight
        return np.bincount(text, total, len(lengths))


def score(docs: DataFrame, train_unless: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    parts = written_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), common.held_out(train_unless).alias("held")))
    trained, tokens = parts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ranges = max(spark.sparkContext.defaultParallelism, -(-(ORDER - 1) * tokens // PER_RANGE))
    counts = common.written(run_counts(parts, ranges), "lm-counts")
    buckets: list[dict[int, tuple[int, int]]] = [{} for _ in range(ORDER)]
    for r in counts.where("part = -1").groupBy("range").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).collect():
        buckets[r["range"] // 64][r["range"] % 64] = (r["kinds"], r["tokens"])
    kinds, n_all = (sum(x[i] for x in buckets[0].values()) for i in range(2))
    # A run that ends a text is no context, but stands for the begin of a text, which is one and as frequent.
    strengths = [strength([*buckets[k - 1].values()], buckets[k].get(0, (0, 0))[0]) for k in range(1, ORDER)]

    def add(texts: pa.Table, counts: pa.Table) -> pa.Table:
        at = np.argsort(counts["range"].to_numpy())
        by_range = counts["totals"].to_pylist()
        own = [unpacked(by_range[i]) for i in at]
        present = counts["range"].to_numpy()[at]
        out = []
        for row in texts.to_pylist():
            lengths = np.frombuffer(row["lengths"], "<i8")
            starts = np.cumsum(lengths) - lengths
            found = runs_of(np.frombuffer(row["words"], "<i8"), restored(row["places"]), lengths)
            sizes = np.stack([np.bincount(range_of(keys, ranges), minlength=ranges)[present] for keys, _ in found])
            where = [places for _, places in found]
            del found
            ends = np.cumsum(sizes, axis=0)
            totals = [np.concatenate([x[e - s : e] for x, e, s in zip(own, ends[k], sizes[k], strict=True)]) for k in range(ORDER)]
            known = (totals[0] > 0)[where[0]]
            machine = Automaton(where, totals, starts, strengths, n_all, kinds, trained)
            del where, totals
            base = machine.root_weight[machine.word]
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "held_out": np.frombuffer(row["held"], np.uint8).astype(bool),
                        "n_tokens": lengths,
                        "n_known": np.add.reduceat(known.astype(np.int64), starts),
                        "train_tokens": np.full(len(lengths), n_all, np.int64),
                        "base_score": np.add.reduceat(base, starts),
                        "score": machine.walk(starts, lengths),
                    }
                )
            )
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else schema.empty_table()

    texts = parts.select("part", "doc_ids", "held", "words", "lengths", "places")
    return texts.groupBy("part").cogroup(counts.where("part >= 0").select("part", "range", "totals").groupBy("part")).applyInArrow(
        add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
