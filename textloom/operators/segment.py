"""Words of texts that are written without spaces: the best path through the lattice of a dictionary's words.

The dictionary is a table of (word, n). Its words become a trie, and a text's best path is the one whose words' shares of all
n have the highest product; a character that no word covers counts as a word seen once, as does one that is no word. Equal
paths take the longer word first. Characters that remain single and are no words are joined to runs, and a run gives its
pairs of neighbours. Without a dictionary the whole text does.

The trie goes to every task, so the dictionary is bounded by MOST_WORDS and checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MOST_WORDS = 2_000_000
#: Sums of logarithms that differ by less are equal products.
EQUAL = 1e-9
#: Characters of texts whose words are in memory at once.
SLICE = 500_000


class Lattice:
    """A trie of words, flat: every beginning of a word, with the word's weight where it is one."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values())
        self.trie: dict[str, float | None] = {}
        for word, n in counts.items():
            for i in range(1, len(word)):
                self.trie.setdefault(word[:i], None)
            self.trie[word] = math.log(n) - math.log(self.total)
        self.unknown = -math.log(self.total) if self.total else 0.0

    def path(self, text: str) -> list[str]:
        """The words of the best path."""
        n = len(text)
        best, end = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            single = self.trie.get(text[i])
            best[i], end[i] = (self.unknown if single is None else single) + best[i + 1], i + 1
            j = i + 1
            while j <= n and text[i:j] in self.trie:
                weight = self.trie[text[i:j]]
                if weight is not None and j > i + 1 and weight + best[j] >= best[i] - EQUAL:
                    best[i], end[i] = weight + best[j], j
                j += 1
        words, i = [], 0
        while i < n:
            words.append(text[i : end[i]])
            i = end[i]
        return words

    def terms(self, text: str) -> list[str]:
        """What an index holds of a text: words, the shorter words inside them, pairs of what is unknown, and the text itself."""
        out: list[str] = []
        run = ""
        for word in [*self.path(text), ""]:
            if len(word) == 1 and self.trie.get(word) is None:
                run += word
                continue
            if run:
                out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
                run = ""
            for size in (2, 3):
                if len(word) > size:
                    out += [w for i in range(len(word) - size + 1) if self.trie.get(w := word[i : i + size]) is not None]
            out.append(word)
        return [t for t in dict.fromkeys([*out, text]) if t]


def lattice(dictionary: DataFrame, most: int = MOST_WORDS) -> Lattice:
    """The trie of a dictionary (word, n); words that repeat add up, empty ones and counts below one are left out."""
    rows = dictionary.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a dictionary has at most {most} words")
    return Lattice({r.word: r.n for r in found})


def slices(texts: pd.Series, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(begin, end) of rows of about most characters, so the words of a whole batch are never all in memory."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > at and held + size > most:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(texts):
        yield at, len(texts)


def _segmenter(dictionary: DataFrame, method: str):
    shared = dictionary.sparkSession.sparkContext.broadcast(lattice(dictionary))

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        act = getattr(shared.value, method)
        for texts in batches:
            for at, end in slices(texts):
                yield pd.Series([None if t is None else act("".join(t.split())) for t in texts.iloc[at:end]], dtype=object)

    return run


def words(c: Column, dictionary: DataFrame) -> Column:
    """The words of a text's best path, blanks left out; null for null."""
    return _segmenter(dictionary, "path")(c)


def terms(c: Column, dictionary: DataFrame) -> Column:
    """The index terms of a text by the dictionary; null for null."""
    return _segmenter(dictionary, "terms")(c)
