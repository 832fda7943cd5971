"""Public tokenizers inside tasks: one encoder for each worker, and exact encoding of many texts by their segments.

Neither vocabulary joins a space with the character before it, so a text may be cut before any space that follows a
character other than white space, and its ids are those of its segments one after another. Where no two white spaces
meet, signs after a word and single line ends are cut off too. Segments repeat, so each
distinct one is encoded once for a batch and remembered up to a bound; this changes no id. A segment that is one word of
Latin letters, with or without signs after it, is what both vocabularies' rules keep as one piece: it goes to the
vocabulary's own merges without the rules for general text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Segments that a worker remembers; it forgets all of them beyond that.
REMEMBERED = 700_000
#: Before a space that follows neither a space nor any other character that counts as white space.
_CUT = re.compile("(?<=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff])(?= )")
#: Signs between a letter and white space are a piece of their own; an apostrophe may not be.
_SIGNS = re.compile("(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[!-&(-/:-@\\[-`{-~]+(?=[ \n]|$)")
#: One word of letters whose composed form and lower case are one code point each, and signs that are no apostrophe.
_WORD = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


class Places(dict):
    """Numbers segments in the order of their first sight; new: those not encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        self.new.append(segment)
        return n


class SegmentEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        #: Bytes as the vocabulary writes them; whether it drops spaces and case.
        self.bare = self.tokenizer.normalizer is not None
        self.units = byte_units()
        self.space = "" if self.bare else self.units[32]
        self.signs: dict[str, list[int]] = {"": []}
        self._forget()

    def _forget(self) -> None:
        self.place = Places()
        self.ids = np.empty(1 << 16, np.uint16)
        self.start = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _ids(self, segment: str) -> list[int] | None:
        """Ids of a segment that is one word, else None."""
        word = _WORD.fullmatch(segment)
        if word is None:
            return None
        space, letters, signs = word.groups()
        if self.bare:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.units)
        ids = [t.id for t in self.model.tokenize((space and self.space) + letters)]
        after = self.signs.get(signs)
        if after is None:
            if len(self.signs) > REMEMBERED:
                self.signs = {"": []}
            after = self.signs[signs] = self.tokenizer.encode(signs, add_special_tokens=False).ids
        return ids + after

    def _learn(self) -> None:
        """Encode the segments that have been numbered since the last time."""
        segments, self.place.new = self.place.new, []
        n = len(self.place) - len(segments)
        for at in range(0, len(segments), 20_000):
            part = segments[at : at + 20_000]
            encoded = [self._ids(s) for s in part]
            rest = [i for i, ids in enumerate(encoded) if ids is None]
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([part[i] for i in rest], add_special_tokens=False), strict=True):
                encoded[i] = e.ids
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            more = int(lengths.sum())
            while self.used + more > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            while n + len(part) + 1 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.ids[self.used : self.used + more] = np.fromiter(chain.from_iterable(encoded), np.uint16, more)
            self.start[n + 1 : n + 1 + len(part)] = self.used + np.cumsum(lengths)
            self.used += more
            n += len(part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if len(self.place) > REMEMBERED:
            self._forget()
        segments, counts = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not plain(text):
                own = _CUT.split(text)
            else:
                if self.bare:
                    text = text.lower()
                own = _SIGNS.sub("\0\\g<0>", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            segments += own
            counts[i] = len(own)
        which = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
        if self.place.new:
            self._learn()
        first = self.start[which]
        lengths = self.start[which + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first - (ends - lengths), lengths) + np.arange(total)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])[bounds]
        return self.ids[at], np.diff(upto)


def plain(text: str) -> bool:
    """Code points below 256 (composed already, and lower case by one rule), and white space none but single spaces and
    line ends between words; no special token."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    words, blanks = text.split(), text.count(" ") + text.count("\n")
    return "\0" not in text and "<|" not in text and len(words) == blanks + 1 and sum(map(len, words)) + blanks == len(text)


def byte_units() -> dict[int, str]:
    """Byte-level vocabularies write bytes that do not print as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(name: str) -> SegmentEncoder:
    return common.kept(("segments", name), lambda: SegmentEncoder(name))


def in_parts(texts: list[str], characters: int = 2_000_000):
    """Slices of texts of about so many characters, one text at least: the memory of a batch stays bounded."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= characters):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end


def text_parts(texts: pa.Array, size: int = 2_000_000):
    """Slices of a column of texts of about so many bytes, one text at least, each with its texts: never all as objects."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1)
        yield slice(at, end), texts[at:end].to_pylist()
        at = end
