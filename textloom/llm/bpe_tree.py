"""Operator 11: byte-level BPE encoding and decoding as tree reductions.

A text falls into the matches of the pattern, each encoded separately, so the ids of a text are those of its matches one
after another. The ids of a match are reduced up a tree: it is halved down to LEAF bytes, leaves are merged by rank, and two
neighbours are joined by merging anew a window of tokens around their border.

Why a window is enough: merges never cross a border of the final tokens, so the tokens of every part between two such borders
are those of that part alone; and the first merge that would cross a border between two tokens would also take place in
those two by themselves. So a row of tokens, each of which is its own encoding, is the encoding of its bytes exactly if each
two neighbours are the encoding of their own bytes. A window stands once that holds at both of its ends; until then the
end that fails is moved outwards, twice as far each time. The joined result does not depend on how the tree was cut.

Decoding joins the bytes of ids, halves first, up the same kind of tree.

Words repeat, so a worker remembers the ids of short stretches of text up to a bound; this changes no id. Nothing is
shuffled, and a task holds one slice of texts at a time.

Defined results: a null or empty text has no ids; special strings are plain text; repeated rows are reported each, a null
doc_id stays null; very long texts and matches are whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import plain, text_parts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of a leaf of the tree.
LEAF = 24
#: Stretches, matches and pairs that a worker remembers of each kind, each of so many characters at most.
REMEMBERED, SHORT = 600_000, 48
#: Ids of a leaf when decoding.
DECODED = 4096
#: Signs that are one match where they follow letters; an apostrophe may begin one with letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Before a space that follows no white space of any kind, a match always ends.
_CUT = re.compile("(?<=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff])(?= )")


class Memory(dict):
    """Computes and remembers values by key; forgets all beyond REMEMBERED, and remembers no long key."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        # The white space of the pattern is Unicode's.
        self.matches = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.stretch = Memory(self._stretch)
        self.match = Memory(lambda text: struct.pack(f"<{len(ids := self.encoded(text.encode()))}I", *ids))
        self.alone = Memory(lambda pair: self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair])

    def merged(self, data: bytes) -> list[int]:
        """The definition: the leftmost neighbours of lowest rank are merged until none can be."""
        ranks, none = self.ranks, len(self.bytes_of)
        if len(data) <= 2 * LEAF:
            rank = ranks.get
            parts = [data[i : i + 1] for i in range(len(data))]
            found = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]  # of each part with the next
            while found and (best := min(found)) < none:
                at = found.index(best)
                part = parts[at] = parts[at] + parts.pop(at + 1)
                del found[at]
                if at < len(found):
                    found[at] = rank(part + parts[at + 1], none)
                if at:
                    found[at - 1] = rank(parts[at - 1] + part, none)
            return [ranks[p] for p in parts]
        # The same with a heap: a part is [start, end), ends and befores link each part's start to its neighbours.
        n = len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2], none)) < none]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != upto:
                continue  # one of the two has been merged since
            end[i], end[middle] = upto, -1
            if upto < n:
                before[upto] = i
                if (r := ranks.get(data[i : end[upto]], none)) < none:
                    heapq.heappush(heap, (r, i, end[upto]))
            if i > 0:
                left = before[i]
                if (r := ranks.get(data[left:upto], none)) < none:
                    heapq.heappush(heap, (r, left, upto))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right or self.alone[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            left_stands = i == len(left) or self.alone[left[-i - 1], window[0]]
            right_stands = j == len(right) or self.alone[window[-1], right[j]]
            if left_stands and right_stands:
                return left[: len(left) - i] + window + right[j:]
            i = i if left_stands else min(2 * i, len(left))
            j = j if right_stands else min(2 * j, len(right))

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def encoded(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        known = self.ranks.get(data)
        return self.reduced(data) if known is None else [known]

    def _stretch(self, text: str) -> bytes:
        word = text.rstrip(SIGNS)
        if word[word.startswith(" ") :].isalpha():  # letters with or without a space before and signs after
            return self.match[word] + self.match[text[len(word) :]] if len(word) < len(text) else self.match[word]
        return b"".join(map(self.match.__getitem__, self.matches(text)))

    def ids(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if plain(text):
            stretches = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            stretches = _CUT.split(text)
        return b"".join(map(self.stretch.__getitem__, stretches))

    def text(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODED:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.text(ids[:half]) + self.text(ids[half:])


def tree_encoder(vocabulary: str = VOCABULARY) -> TreeEncoder:
    def build() -> TreeEncoder:
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return TreeEncoder(ranks, public_tokenizers.PATTERN)

    return common.kept(("bpe-tree", vocabulary), build)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_encoder(vocabulary)
        for batch in batches:
            for part, texts in text_parts(batch["text"]):
                ids = [coder.ids(t) for t in texts]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.record_batch({"doc_id": batch["doc_id"][part], "n_tokens": sizes, "ids": pa.array(ids, pa.binary())})

    return common.doc_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with ids (as encode gives them), and their bytes as decoded."""
    columns = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_encoder(vocabulary)
        for batch in batches:
            for part, every in text_parts(batch["ids"]):
                own = [coder.text(np.frombuffer(ids or b"", "<u4").tolist()) for ids in every]
                yield pa.record_batch([*(batch[c][part] for c in columns), pa.array(own, pa.binary())], [*columns, "decoded"])

    schema = rows.select(*columns).schema.add("decoded", "binary")
    return rows.select(*columns).mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(common.documents(spark, sf_dir)))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
