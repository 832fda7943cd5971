"""Operator 1: token counts by compiled finite-state transducers.

Two deterministic transducers stand for the byte-level BPE tokenizer.

* The cutter reads classes of characters and marks where words (the tokenizer's pre-tokens) begin; it has twelve states.
  The texts of a batch are one stream, cut into equal chunks. For each chunk its state map is computed (where each state
  leads); a parallel prefix scan composes the maps, which gives the true state at the start of each chunk, and then all
  chunks are read side by side. These maps carry states alone; counts are annotations of the merger.
* The merger reads the bytes of a word; each transition carries the number of tokens that it adds. Its states are found
  as they are needed: a state holds, for each suffix of what was read that some token may still begin with, the last
  token before that suffix and its count. The last token of a prefix is the longest that its neighbour on the left
  admits, so no merge loop runs over texts; equal states share their transitions.

Only the tokenizer's own file is read. Counts include neither begin nor end tokens. The special token's string inside a
text counts as that one token, as the library does by default.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are reported each; very long texts are
whole; further columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import byte_units, in_parts

CHUNK, FORGETS = 128, 16
#: States, edges and words that a worker remembers; it forgets all of them beyond that, and finds them again.
MOST_STATES, MOST_WORDS, MOST_PAIRS = 400_000, 1_000_000, 1_000_000
#: Words of more bytes are read one by one, the others side by side.
LONG = 64
#: Odd factors: of code points, of places in a word, and of slots. INVERSE undoes PLACE modulo 2 ** 64.
POINT, PLACE, SLOT = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F
INVERSE = pow(PLACE, -1, 1 << 64)

LETTER, S1, R, V, L2, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, STOP, SAME = range(13)
START, IN_L, IN_N, IN_O, SP1, WH1, SP2, WH2, APOS, APOS_R, APOS_V, APOS_L = range(12)


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state and class. Mark 1: a word begins here; mark 2: one began a character before."""
    letters = (LETTER, S1, R, V, L2, E)
    step, mark = np.zeros((12, 13), np.uint8), np.zeros((12, 13), np.uint8)

    def fresh(c: int) -> int:
        """The state after a word's first character."""
        if c in letters:
            return IN_L
        return {NUMBER: IN_N, SPACE: SP1, WHITE: WH1, QUOTE: APOS, OTHER: IN_O, STOP: START}[c]

    def joined(c: int) -> int:
        """After one space that the word takes in."""
        return IN_O if c == QUOTE else fresh(c)

    for s in range(12):
        for c in range(12):
            to, out = fresh(c), int(c != STOP)
            if (s == IN_L and c in letters) or (s == IN_N and c == NUMBER):
                to, out = s, 0
            elif s in (IN_O, APOS) and c in (OTHER, QUOTE):
                to, out = IN_O, 0
            elif s == APOS and c in (S1, R, V, L2):
                to, out = {S1: START, R: APOS_R, V: APOS_V, L2: APOS_L}[c], 0
            elif (s, c) in ((APOS_R, E), (APOS_V, E), (APOS_L, L2)):
                to, out = START, 0
            elif s in (APOS_R, APOS_V, APOS_L):  # no contraction after all: the letter before begins a word
                to, out = (IN_L, 2) if c in letters else (to, out | 2)
            elif s in (SP1, WH1, SP2, WH2) and c in (SPACE, WHITE):
                to, out = SP2 if c == SPACE else WH2, 0
            elif s == SP1 and c != STOP:
                to, out = joined(c), 0
            elif s == SP2 and c != STOP:
                to, out = joined(c), 2
            elif s == WH2 and c != STOP:
                out = 3
            step[s, c], mark[s, c] = to, out
        step[s, SAME] = s
    return step, mark


def classes() -> np.ndarray:
    """The class of each code point, by the tokenizer library's own tables."""
    from tokenizers import Regex, pre_tokenizers

    # Beyond these planes no code point is a letter, a number or white space.
    points = [c for c in (*range(0x40000), *range(0xE0000, 0xE1000)) if not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, points))
    index = np.array(points)
    for pattern, c in ((r"[^\p{L}]+", LETTER), (r"[^\p{N}]+", NUMBER), (r"\S+", WHITE)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every):
            table[index[a:b]] = c
    for chars, c in (("stmd", S1), ("r", R), ("v", V), ("l", L2), ("e", E), (" ", SPACE), ("'", QUOTE)):
        table[[ord(x) for x in chars]] = c
    return table


def starts(read: np.ndarray, step: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where words begin in a stream of classes."""
    n, width = len(read), step.shape[1]
    chunks = -(-n // CHUNK)
    stream = np.full(chunks * CHUNK, SAME, np.uint8)
    stream[:n] = read
    by_place = np.ascontiguousarray(stream.reshape(chunks, CHUNK).T)
    flat, out = step.ravel().astype(np.uint8), mark.ravel()
    # State maps of all chunks, for all states at once; most chunks forget their start within FORGETS characters, and
    # from then on one state stands for all.
    every = step.shape[0]
    maps = np.repeat(np.arange(every, dtype=np.uint8)[:, None], chunks, axis=1)
    for c in by_place[:FORGETS]:
        maps = flat[maps.astype(np.int16) * width + c]
    some = np.flatnonzero((maps != maps[0]).any(axis=0))
    one, several = maps[0], maps[:, some]
    for c in by_place[FORGETS:]:
        one = flat[one.astype(np.int16) * width + c]
        if len(some):
            several = flat[several.astype(np.int16) * width + c[some]]
    maps = np.repeat(one[None], every, axis=0)
    maps[:, some] = several
    # Prefix scan: maps[:, k] becomes the composition of the maps of chunks 0 to k.
    d = 1
    while d < chunks:
        maps = np.concatenate([maps[:, :d], np.take_along_axis(maps[:, d:], maps[:, :-d].astype(np.intp), axis=0)], axis=1)
        d *= 2
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.int16)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for j, c in enumerate(by_place):
        at = state * width + c
        marks[j] = out[at]
        state = flat[at].astype(np.int16)
    seen = marks.T.ravel()[:n]
    begins = (seen & 1).astype(bool)
    begins[:-1] |= (seen[1:] & 2).astype(bool)
    return begins


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_keys(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word points[begin:end]: a polynomial in its mixed code points, by differences of running sums."""
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(POINT)
    mixed ^= mixed >> np.uint64(29)
    n = len(points) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(mixed * powers(PLACE, n)[:-1], out=total[1:])
    keys = (total[end] - total[begin]) * powers(INVERSE, n)[begin]
    keys = (keys ^ (end - begin).astype(np.uint64)) * np.uint64(SLOT)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


class Numbers:
    """A map from 64-bit keys (other than -1) to pairs of 32-bit numbers, for many keys at once: open addressing in arrays."""

    def __init__(self) -> None:
        self.size, self.keys, self.values = 0, np.full(1 << 12, -1, np.int64), np.zeros((1 << 12, 2), np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(SLOT)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        todo = np.flatnonzero(held != keys)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            slot[todo[free]] = -1
            todo = todo[~free]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            todo = todo[self.keys[slot[todo]] != keys[todo]]
        return slot

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            old = self.keys != -1
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            room = 1 << (4 * self.size).bit_length()
            self.keys, self.values = np.full(room, -1, np.int64), np.zeros((room, 2), np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            own = slot[todo]
            free = self.keys[own] == -1
            self.keys[own[free]] = keys[todo[free]]  # of several on one slot the last one stays
            done = self.keys[own] == keys[todo]
            self.values[own[done]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)


class Merger:
    """The second transducer: bytes of a word to the number of its tokens. Tokens are numbered: bytes, then merges by rank."""

    def __init__(self, model: dict):
        unit = {u: b for b, u in byte_units().items()}
        number = {bytes([b]): b for b in range(256)}
        #: (left << 20 | right) to the rank of their merge, and by token: when it is made (-1: a byte), and from what.
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * 256, [*range(256)], [*range(256)]
        for i, pair in enumerate(model["merges"]):
            a, b = (bytes(unit[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[number[a] << 20 | number[b]] = i
            if a + b not in number:
                number[a + b] = len(number)
                self.made.append(i)
                self.left.append(number[a])
                self.right.append(number[b])
        #: Trie of tokens: (node << 8 | byte) to node; 0 is the root.
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner: set[int] = {0}
        stands = [True] * 256  # whether a token is what its own bytes merge to
        for t in range(256, len(number)):
            a, b = self.left[t], self.right[t]
            stands.append(stands[a] and stands[b] and self._apart(a, b, self.made[t]))
        for name, t in number.items():
            node = 0
            for b in name:
                self.inner.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.child) + 1)
            if stands[t]:
                self.token[node] = t
        self._forget()

    def _apart(self, x: int, y: int, until: int) -> bool:
        """Whether no merge of a rank below until joins across the border of the neighbours x and y.

        What stands left and right of the border at any time is found by undoing the merges of both, the latest first. A
        pair across the border is joined if its rank comes before the ranks at which either side is taken into a longer
        token; of equal ranks the one further left comes first.
        """
        rank, made = self.rank, self.made
        left_taken = right_taken = until
        while True:
            m = rank.get(x << 20 | y)
            if m is not None and m < left_taken and m <= right_taken and m < until:
                return False
            if made[x] > made[y]:
                left_taken, x = made[x], self.right[x]
            elif made[y] >= 0:
                right_taken, y = made[y], self.left[y]
            else:
                return True

    def _forget(self) -> None:
        self.state: dict[tuple, int] = {}
        self.chain: list[tuple] = []
        self.edge: dict[int, tuple[int, int]] = {}
        self.edges = Numbers()
        self.pair: dict[int, bool] = {}
        self.first = self._named(((0, -1, 0),))

    def _named(self, chain: tuple) -> int:
        found = self.state.get(chain)
        if found is None:
            found = self.state[chain] = len(self.chain)
            self.chain.append(chain)
        return found

    def admits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        found = self.pair.get(left << 20 | right)
        if found is None:
            found = self.pair[left << 20 | right] = self._apart(left, right, 1 << 60)
        return found

    def _new_edge(self, at: int, byte: int) -> tuple[int, int]:
        """A state's chain: (node, last token before that suffix, its count less the whole's), longest suffix first."""
        after, last, count = [], -1, None
        for node, left, less in self.chain[at]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if count is None and (t := self.token.get(to)) is not None and self.admits(left, t):
                last, count = t, less + 1
            if to in self.inner:
                after.append((to, left, less))
        made = self._named((*((n, t, c - count) for n, t, c in after), (0, last, 0)))
        self.edge[at << 8 | byte] = made, count
        return made, count

    def count(self, word: bytes) -> int:
        at, total, edge = self.first, 0, self.edge
        for b in word:
            found = edge.get(at << 8 | b) or self._new_edge(at, b)
            at = found[0]
            total += found[1]
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The tokens of each word: a byte of all words at a time."""
        if len(self.chain) > MOST_STATES or len(self.pair) > MOST_PAIRS:
            self._forget()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        total = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            total[i] = self.count(words[i])
        order = np.argsort(-np.where(sizes > LONG, 0, sizes), kind="stable")
        order = order[sizes[order] <= LONG]
        left = np.searchsorted(-sizes[order], -np.arange(LONG), "left")  # words of more than so many bytes
        state = np.full(len(order), self.first, np.int64)
        for j, k in enumerate(left.tolist()):
            if not k:
                break
            own = order[:k]
            keys = state[:k] << 8 | every[begin[own] + j]
            slot = self.edges.find(keys)
            if (slot < 0).any():
                new = np.unique(keys[slot < 0])
                made = [self.edge.get(x) or self._new_edge(x >> 8, x & 255) for x in new.tolist()]
                self.edges.put(new, np.array(made, np.int32))
                slot = self.edges.find(keys)
            found = self.edges.values[slot]
            state[:k] = found[:, 0]
            total[own] += found[:, 1]
        return total


class Words:
    """Cuts texts into words and remembers a pair of numbers for each distinct word; learned() makes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.tokenizer = json.load(f)
        self.special = [t["content"] for t in self.tokenizer["added_tokens"]]
        self.step, self.mark = cutter()
        self.classes = classes()
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()

    def learned(self, words: list[bytes]) -> np.ndarray:
        raise NotImplementedError

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pair of each word of all texts, and the number of words in each text."""
        if self.known.size > MOST_WORDS:
            self.forget()
        stream = "\0".join(texts) + "\0"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        read = self.classes[points]
        read[ends] = STOP
        at = np.flatnonzero(starts(read, self.step, self.mark))
        text = np.searchsorted(ends, at)
        stop = np.minimum(np.append(at[1:], len(stream)), ends[text])
        keys = word_keys(points, at, stop)
        slot = self.known.find(keys)
        if (slot < 0).any():
            missing = np.flatnonzero(slot < 0)
            new, first = np.unique(keys[missing], return_index=True)
            some = missing[first]
            words = [stream[a:b].encode() for a, b in zip(at[some].tolist(), stop[some].tolist(), strict=True)]
            self.known.put(new, self.learned(words).astype(np.int32))
            slot = self.known.find(keys)
        return self.known.values[slot], np.bincount(text, minlength=len(texts))


class Counter(Words):
    """Numbers of tokens by the merger's transducer."""

    def __init__(self, path: str):
        super().__init__(path)
        self.merger = Merger(self.tokenizer["model"])

    def learned(self, words: list[bytes]) -> np.ndarray:
        return np.stack([self.merger.counts(words), np.zeros(len(words), np.int64)], axis=1)

    def counts(self, texts: list[str]) -> np.ndarray:
        pieces, parts = [], np.zeros(len(texts), np.int64)
        if not texts:
            return parts
        for i, text in enumerate(texts):
            own = [text]
            for s in self.special:
                if s in text:
                    own = [x for part in own for x in part.split(s)]
            parts[i] = len(own)
            pieces += own
        found, words = self.of(pieces)
        upto = np.concatenate([[0], np.cumsum(found[:, 0], dtype=np.int64)])
        cuts = np.concatenate([[0], np.cumsum(words)])[np.concatenate([[0], np.cumsum(parts)])]
        return parts - 1 + np.diff(upto[cuts])


class Encoder(Words):
    """Token ids: each distinct word is merged once by the library's model; texts with special strings are the library's."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.units = byte_units()

    def forget(self) -> None:
        super().forget()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def learned(self, words: list[bytes]) -> np.ndarray:
        merge, units = self.library.model.tokenize, self.units
        found = [[t.id for t in merge(w.decode("latin-1").translate(units))] for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        more = int(lengths.sum())
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + more] = np.fromiter(chain.from_iterable(found), np.uint32, more)
        begin = self.used + np.cumsum(lengths) - lengths
        self.used += more
        return np.stack([begin, lengths], axis=1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if special:
            alone = set(special)
            rest = [i for i in range(len(texts)) if i not in alone]
            counts = np.zeros(len(texts), np.int64)
            ids, counts[rest] = self.encode([texts[i] for i in rest])
            own = dict(zip(rest, np.split(ids, np.cumsum(counts[rest])[:-1]), strict=False)) if rest else {}
            own |= {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in special}
            counts[special] = [len(own[i]) for i in special]
            return np.concatenate([own[i] for i in range(len(texts))]), counts
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found, words = self.of(texts)
        first, lengths = found.T.astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[at], np.diff(ends[np.concatenate([[0], np.cumsum(words)])])


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of docs; name: a byte-level BPE file of public_tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = common.kept(("counter", name), lambda: Counter(public_tokenizers.path(name)))
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [np.zeros(0, np.int64), *(counter.counts(texts[part]) for part in in_parts(texts))]
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": pa.compute.binary_length(batch["text"].cast(pa.binary())).cast(pa.int64()), "n_tokens": np.concatenate(found)})

    return common.doc_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 512)
