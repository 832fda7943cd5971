"""Operator 5: personal data by patterns with a written rule, and by a linear-chain conditional random field for the rest.

Patterns find e-mail addresses, internet addresses, payment cards and telephone numbers in international form. The field
adds what has no such rule: keys and passwords (``secret``), telephone numbers without a country code, e-mail addresses
that are spelled out, and national identity or account numbers (``identity``). It labels words (runs between white space)
by features of their shape and of their neighbours' shapes. It is trained on a small labelled table, made from written
templates in this module, by the gradient of the conditional log-likelihood; Viterbi decodes many sequences side by side.

Every word of every text is scored and may belong to a span. The labels are those of the best path through the whole text.
What a stretch of other labels can gain over outside at most is the sum of its words' best scores and of the best
transitions; the best such sum through each word comes from running sums. A word where it stays below nothing is outside on
every best path, so the stretches between such words are decoded apart, from outside to outside, with the same result.

Spans count code points, end exclusive. A span of the field that meets one of a pattern or an earlier one is dropped.

Defined results: null and empty texts have no spans; very long texts are whole; repeated rows are reported each, with or
without a doc_id; of pattern spans that begin together the kind listed first comes first; an empty table gives no rows;
further columns are kept where a table is passed on, and ignored in digests.
"""

from __future__ import annotations

import random
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import text_parts

KINDS = ("email", "ip", "card", "phone", "secret", "identity")
#: Kinds that the field may add; the first label is outside, then begin and inside of each.
ADDED = ("email", "phone", "secret", "identity")
LABELS = ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]
#: Rows of the labelled table.
TABLE_ROWS = 1_200
#: A feature that occurs less often in the labelled table tells nothing: values that are filled in are not learned by heart.
LEAST = 3
STEPS, RATE, PENALTY = 90, 0.15, 1e-3

#: No pattern holds without one of these.
_ANY = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD, _SPACE = re.compile(r"\S+"), re.compile(r"\s")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Spans with a written rule, by start and then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Letters, digits and signs as classes; runs are shortened."""
    out, last, n = [], "", 0
    for c in word:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        n = n + 1 if k == last else 1
        last = k
        if n <= 4:
            out.append(k)
    return "".join(out)


_HEX = re.compile(r"[0-9a-fA-F]+")
_SPELLED = re.compile(r"[\[(](?:at|dot)[\])]")
#: Words that announce a secret, whatever it is made of.
_CUE = re.compile(r"(?i)\W*(?:password|passwd|pwd|passwort|passphrase|token|secret|api_?key|key)\W*")
_TURN = re.compile(r"(?<=[a-z])[A-Z]")
_AROUND = "\"'`.,;:!?<>{}"


def own_features(word: str) -> list[str]:
    """What a word tells, its neighbours aside: its shape first; whether it is a cue, the signs around it and its letters last."""
    core = word.strip(_AROUND)
    digits = sum(map(str.isdigit, core))
    n = len(core)
    mixed = 0 < digits < n and core.isalnum()
    ends = [i for i, c in enumerate(core) if c.isalnum()]
    turns = len(_TURN.findall(core))
    inner = core[ends[0] : ends[-1] + 1] if ends else ""
    return [
        "shape=" + shape(core),
        f"size={min(n, 48) // 4}",
        f"digits={min(digits, 24) // 2}",
        f"mixed={mixed},{n >= 16}",
        f"hex={bool(_HEX.fullmatch(core))},{n >= 20}",
        f"turns={min(turns, 4)},{8 * turns // max(n, 1)}",
        f"quoted={word[:1] in '\"' + chr(39) + '`'}",
        "within=" + "".join(sorted({c for c in inner if not c.isalnum()})),
        f"spelled={min(len(_SPELLED.findall(core)), 2)}",
        f"odd={mixed or turns > 0 or inner != '' and not inner.isalnum()},{n >= 9}",
        f"cue={bool(_CUE.fullmatch(core))}",
        "signs=" + "".join(sorted(set(core[: ends[0]] + core[ends[-1] + 1 :] if ends else core))),
        "low=" + core.lower(),
    ]


#: Where a word stands, seen from the one that is labelled.
PLACES = ("0", "-1", "-2", "+1", "+2")
FEATURES_A_WORD = 1 + 13 + 4 * 4


def seen_from(place: str, own: list[str]) -> list[str]:
    return [place + x for x in (own if place == "0" else [own[0], *own[-3:]])]


@dataclass
class Field:
    """Numbers of features, weights of features by label, and of transitions. Feature 0 is that of all words."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray


class Extractor:
    """Words as rows of a table: what a word adds to the scores of all labels over outside, by place.

    Row 0 is the lack of a word. Words with the same known features share a row; words are remembered up to a bound.
    """

    def __init__(self) -> None:
        self.field: Field | None = None

    def use(self, field: Field) -> None:
        """To be called before each set of texts, whose rows stay what they are until the next call."""
        if self.field is not field or self.used > 50_000:
            self.field = field
            self.lows = {x.partition("=")[2] for x in field.names if x.lstrip("-+012").startswith("low=")}
            self.words: dict[str, int] = {}
            self.alike: dict[tuple, int] = {}
            self.numbers: dict[tuple, int] = {}
            self.used, self.table = 0, np.zeros((1 << 10, len(PLACES), len(LABELS) - 1))
            self.row(own_features(""))
            self.numbers.clear()  # words that tell nothing, as ".", are words all the same

    def row(self, own: list[str]) -> int:
        get, weights = self.field.names.get, self.field.weights
        numbers = tuple(tuple(i for x in seen_from(place, own) if (i := get(x)) is not None) for place in PLACES)
        at = self.numbers.get(numbers)
        if at is None:
            at = self.numbers[numbers] = self.used
            self.used += 1
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for p, known in enumerate(numbers):
                score = weights[[*known, *([0] if p == 0 else [])]].sum(axis=0)
                self.table[at, p] = score[1:] - score[0]
        return at

    def of(self, word: str) -> int:
        """The row of a word; of a plain one (one capital at most) its length and a few more tell it."""
        core, own = word.strip(_AROUND), None
        low = core.lower()
        known = low if low in self.lows else None
        if core.isalpha() and (core[1:].islower() or len(core) == 1):
            alike = (min(len(core), 48), core[0].isupper(), bool(_HEX.fullmatch(core)), word[0] in "\"'`", known, bool(_CUE.fullmatch(core)))
        else:
            own = own_features(word)
            alike = (*own[:-1], known)
        at = self.alike.get(alike)
        if at is None:
            if len(self.alike) > 20_000:
                self.alike.clear()
            at = self.alike[alike] = self.row(own or own_features(word))
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.words) > 200_000:
            self.words.clear()
        self.words.update((w, self.of(w)) for w in set(words).difference(self.words))
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each label's score over outside at places of a sequence of rows, all but its first two and last two."""
        out = self.table[rows[at], 0]
        for p, place in enumerate(PLACES[1:], 1):
            out += self.table[rows[at + int(place)], p]
        return out


def forbidden() -> np.ndarray:
    """Transitions that no labelling has: inside without begin or inside of its kind before it."""
    k = len(LABELS)
    out = np.zeros((k, k), bool)
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            out[:, j] = True
            out[j, j] = out[j - 1, j] = False
    return out


def fit(sentences: list[tuple[list[str], list[str]]]) -> Field:
    """Maximum conditional likelihood with a Gaussian prior: forward-backward over all sentences at once, Adam steps."""
    k = len(LABELS)
    n, longest = len(sentences), max(len(w) for w, _ in sentences)
    gold, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    told: dict[str, list[list[str]]] = {}
    found: list[list[str]] = []
    for i, (words, labels) in enumerate(sentences):
        gold[i, : len(labels)], real[i, : len(labels)] = [LABELS.index(x) for x in labels], True
        for w in ["", *words]:
            if w not in told:
                own = own_features(w)
                told[w] = [seen_from(place, own) for place in PLACES]
        for t in range(len(words)):
            near = (words[t + int(place)] if 0 <= t + int(place) < len(words) else "" for place in PLACES)
            found.append(["", *(x for p, w in enumerate(near) for x in told[w][p])])
    often = Counter(x for row in found for x in row)
    names = {x: i for i, x in enumerate(x for x, count in often.items() if x == "" or count >= LEAST)}
    rare = len(names)
    flat = np.array([[names.get(x, rare) for x in row] for row in found], np.int64)
    weights, moves = np.zeros((rare + 1, k)), np.where(forbidden(), -1e4, 0.0)
    start = np.array([x[0] != "I" for x in LABELS], float)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    want = np.zeros((k, k))
    both = real[:, 1:] & real[:, :-1]
    np.add.at(want, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    sure = gold[real]
    for step in range(1, STEPS + 1):
        score = sum(weights[flat[:, f]] for f in range(FEATURES_A_WORD))
        likely = np.ones((n, longest, k))
        likely[real] = np.exp(score - score.max(axis=1, keepdims=True))
        go = np.exp(moves)
        forward, scale = np.zeros((n, longest, k)), np.ones((n, longest, 1))
        for t in range(longest):
            moved = (forward[:, t - 1] @ go if t else start) * likely[:, t]
            scale[:, t] = moved.sum(axis=1, keepdims=True)
            forward[:, t] = moved / scale[:, t]
        backward = np.ones((n, longest, k))
        ahead = likely / scale
        for t in range(longest - 2, -1, -1):
            moved = (ahead[:, t + 1] * backward[:, t + 1]) @ go.T
            backward[:, t] = np.where(real[:, t + 1, None], moved, 1)
        pairs = go * (forward[:, :-1][both].T @ (ahead * backward)[:, 1:][both])
        slope = (forward * backward)[real]
        slope[np.arange(len(slope)), sure] -= 1
        gradient = np.stack([np.bincount(flat.ravel(), np.repeat(slope[:, j], FEATURES_A_WORD), rare + 1) for j in range(k)], axis=1) / n
        gradient[rare] = 0
        gradients = (gradient + PENALTY * weights, np.where(forbidden(), 0, (pairs - want) / n + PENALTY * moves))
        for values, (m, v), g in zip((weights, moves), moments, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            values -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(names, weights, moves)


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of sequences of emissions, padded to one length; sequences begin and end outside by themselves."""
    n, longest, k = scores.shape
    best = scores[:, 0].copy()
    best[:, [x[0] == "I" for x in LABELS]] -= 1e6
    back = np.zeros((n, longest, k), np.int8)
    for t in range(1, longest):
        options = best[:, :, None] + moves
        back[:, t] = options.argmax(axis=1)
        moved = options.max(axis=1) + scores[:, t]
        best = np.where((t < lengths)[:, None], moved, best)
    out = np.zeros((n, longest), np.int8)
    at = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        inside = t < lengths
        out[:, t] = np.where(inside, at, 0)
        if t:
            at = np.where(inside, back[np.arange(n), t, at], at)
    return out


#: The labelled table's templates. Braces name what is filled in; whatever is in capitals is labelled as that kind.
TEMPLATES = (
    '{w} {w} token = "{SECRET}" {w} {w}', '{w} token = "{SECRET}" {w}', "{w} api_key: {SECRET} {w} {w}", "{w} password is {SECRET} {w}", '{w} secret "{SECRET}" {w} {w}',
    "{w} key {SECRET} {w}", '{w}, {w} token = "{SECRET}".', '{w} {w} "{SECRET}" {w} {w}', '{w} {w} "{SECRET}" {w}', "{w} {SECRET} {w} {w} {w}", 'TOKEN = "{SECRET}"!! {w}!! {w}!!', '{w} | token = "{SECRET}" | {w}',
    '{w}*** token = "{SECRET}"### {w}%%% {w}&&&', "{w} {w} call {PHONE} {w}", "{w} phone {PHONE}, {w} {w}", "tel. {PHONE} {w} {w}", "{w} at {PHONE} {w} {w}", "{w} {w} {PHONE} {w}.",
    "{w} {w} {EMAIL} {w} {w}", "mail {EMAIL} {w}", "{w} write to {EMAIL}, {w} {w}", "{w} ssn {IDENTITY} {w}", "{w} number {IDENTITY} {w} {w}", "{w} {w} {IDENTITY} {w}", "iban {IDENTITY} {w}",
    "{w} {w} {n} {w} {w}", "{w} in {n} {w} {w} {w}", "Licensed under the Apache License, Version 2.0. {w} {w}", "{w} under CC BY-NC 4.0. {w}", "{w} {w} {card} {w} {w}", "{w} {card}, {w}",
    "{w} {ip} {w} {w}", "{w} {w} {mail} {w}", "{w} {w} {w} {w} {w} {w}", "{w}, {w} {w}. {w} {w}", "{w} {date} {w} {w}", "{w} {w} {price} {w}", "{w} {n}. {w} {w}", "{n}. {w} {w}", "{w} page {n} {w}",
    "{w} my password: {CODE} {w}", "password is {CODE} {w} {w}", "{w} the passwd {CODE} {w}", "{w} secret = {CODE} {w}", "{w} key={n} {w}", "{w} login {w} pwd {SECRET} {w}", "{w} api_key = '{SECRET}', {w}", "{w} the key to {w} {w}",
    "{w} a token of {w} {w}", "{w} the secret of {w} {w} {w}", "{w} key {w} {w}", "{w} password {w} {w}", "{w} reach me: {EMAIL} {w}", "{EMAIL} {w} {w}", "{w} ({EMAIL}) {w}", "{w} fax {PHONE} or {PHONE} {w}", "{w} mobile: {PHONE}. {w}",
    "ring {PHONE} {w} {w}", "{w} passport {IDENTITY} {w}", "{w} account {IDENTITY}, {w}", "{w} tax id {IDENTITY} {w}", "{w} from {n} to {n} {w}", "{w} room {n}-{n} {w}", "{w} {date} at {n} {w}",
    "{w} {w} {phone} {w} {w}", "{phone} {w} {w}", "{w} {n}, {n} {w} {n} {w}", "{w} {n} {n} {n} {n} {w}", "{w} {w} {version} {w}", "{w} at {w} {w} dot {w}", "{w} at {n} {w} {w}", "{w} {big} {w} {w}", "{w}{n} {w} {w}",
    "{w} passphrase: {CODE} {w}", "{w} my password is {CODE}, {w}", "secret: {CODE} {w} {w}", "{w} token {CODE} {w}", "{w} {KEY} {w} {w}", "{w} {w} {KEY} {w}", "{w} is {KEY} {w} {w}",
    "{w} {camel} {w} {w}", "{w} {link} {w} {w}", "{camel} {w} {camel} {w}", "{w} {w} {link}", "{w} tax id is {IDENTITY} {w}", "{w} (iban {IDENTITY}) {w}",
)
SYLLABLES = "the on er st an re th ing tion ble ed nd or ha ou ach keit ung ver ge be eau ou ai tre ré è ç ción que ado ñ os í de la en und".split()


def labelled_table(spark: SparkSession, rows: int = TABLE_ROWS, seed: int = 11, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """(words, labels): sentences from templates, filled in with seeded values; no text of a corpus."""
    return spark.createDataFrame(labelled_rows(rows, seed, templates), "words array<string>, labels array<string>")


def labelled_rows(rows: int, seed: int, templates: tuple[str, ...]) -> list[tuple[list[str], list[str]]]:
    rng = random.Random(seed)
    pick = rng.choice

    def run(chars: str, low: int, high: int) -> str:
        return "".join(pick(chars) for _ in range(rng.randint(low, high)))

    def word() -> str:
        w = "".join(pick(SYLLABLES) for _ in range(rng.randint(1, 4)))
        return pick((w, w, w, w.capitalize(), w.upper(), w + pick(",.;!")))

    def pad() -> str:
        """Plain text around a template, with signs as in markup."""
        w = word()
        if rng.random() < 0.1:
            w = pick((f"{w}{pick('-/.')}{word()}", f"{w}{chr(39)}{word()}", "".join(pick(SYLLABLES) for _ in range(rng.randint(4, 9))), fill["camel"](), fill["link"]()))
        return w if rng.random() >= marked else pick("|*#-=>&") if rng.random() < 0.1 else w + pick("#*$%&|<>=)/") * rng.randint(1, 3)

    digit = lambda n: run("0123456789", n, n)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def secret() -> str:
        hexes, all_chars = "0123456789abcdef", letters + letters.upper() + "0123456789"
        return pick((run(hexes, 32, 40), run(hexes, 40, 40), run(hexes.upper(), 32, 40), run(all_chars, 20, 40), "sk_live_" + run(all_chars, 20, 28), "AKIA" + run(letters.upper() + "0123456789", 16, 16)))

    def key() -> str:
        return run(letters + letters.upper(), 20, 40)

    def code() -> str:
        return pick((run(letters + letters.upper(), 9, 16), run(letters, 5, 9) + pick("!#$%&") + run(letters.upper(), 3, 6), run(letters, 4, 7) + pick("-_.") + run(letters, 4, 7) + digit(2)))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{digit(3)} {digit(7)}", f"0{digit(3)}/{digit(6)}"))

    def email() -> str:
        user, host, end = run(letters, 3, 9), run(letters, 3, 9), pick(("com", "org", "net", "de", "fr"))
        return pick((f"{user} [at] {host} [dot] {end}", f"{user} (at) {host} (dot) {end}", f"{user}[at]{host}[dot]{end}", f"{user} [at] {host}.{end}"))

    def identity() -> str:
        return pick((f"{digit(3)}-{digit(2)}-{digit(4)}", f"DE{digit(2)} {digit(4)} {digit(4)} {digit(4)} {digit(4)} {digit(2)}", f"FR{digit(2)}{digit(18)}", f"ES{digit(22)}"))

    fill = {
        "w": word, "SECRET": secret, "CODE": code, "KEY": key, "PHONE": phone, "EMAIL": email, "IDENTITY": identity, "n": lambda: run("123456789", 1, 4), "card": lambda: digit(16), "big": lambda: digit(rng.randint(5, 15)),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "mail": lambda: f"{run(letters, 3, 8)}.{digit(2)}@mail{digit(1)}.example.com", "phone": lambda: f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}",
        "date": lambda: pick((f"20{digit(2)}-0{digit(1)}-1{digit(1)}", f"1{digit(1)}/0{digit(1)}/20{digit(2)}", f"1{digit(1)}:3{digit(1)}")), "price": lambda: pick((f"${digit(2)}.99", f"{digit(2)},{digit(3)}", f"{digit(2)}%")),
        "version": lambda: pick((f"v{digit(1)}.{digit(1)}", f"{digit(1)}.{digit(1)}.{digit(1)}", f"x{digit(2)}", f"a{digit(1)}b{digit(1)}")),
        "camel": lambda: "".join(pick(SYLLABLES).capitalize() + pick(SYLLABLES) for _ in range(rng.randint(2, 5))), "link": lambda: f"https://{run(letters, 3, 9)}.{pick(('com', 'org', 'net'))}/" + pick("/-_").join(run(letters, 3, 8) for _ in range(rng.randint(1, 4))),
    }
    out = []
    for i in range(rows):
        marked = pick((0, 0.05, 0.2, 0.9))
        words = [pad() for _ in range(rng.randint(0, 12))]
        labels = ["O"] * len(words)
        for token in templates[i % len(templates)].split(" "):
            m = re.search(r"\{(\w+)\}", token)
            if not m:
                words.append(token)
                labels.append("O")
                continue
            filled = re.sub(r"\{(\w+)\}", lambda m: fill[m[1]](), token).split(" ")
            words += filled
            kind = "secret" if m[1] in ("CODE", "KEY") else m[1].lower()
            labels += [f"{'I' if j else 'B'}-{kind}" if m[1].isupper() else "O" for j in range(len(filled))]
        after = [pad() for _ in range(rng.randint(0, 12))]
        out.append((words + after, labels + ["O"] * len(after)))
    return out


def train(table: DataFrame) -> Field:
    """From (words, labels): a small table, TABLE_ROWS rows at most are read."""
    return fit([(r["words"], r["labels"]) for r in table.limit(TABLE_ROWS).collect()])


#: Signs of a text that are words side by side, and rows that are scored side by side.
SLICE, BLOCK = 1_000_000, 1 << 16


def slices(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of slices of a text that end with a word."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + SLICE)
        end = found.start() if found else len(text)
        yield at, end
        at = end


def gains(field: Field) -> tuple[float, float]:
    """The most that transitions add to a stretch of labels other than outside: for each of its words, and once more."""
    over = field.moves - field.moves[0, 0]
    inner, begin, end = over[1:, 1:].max(), max(over[0, 1:].max(), 0), max(over[1:, 0].max(), 0)
    return inner, begin + end - inner


def open_words(rows: np.ndarray, extractor: Extractor, field: Field) -> np.ndarray:
    """Which rows of texts, each between two rows 0 on either side, may be other than outside on a best path."""
    each, once = gains(field)
    most = np.full(len(rows), -1e4)
    for first in range(2, len(rows) - 2, BLOCK):
        at = np.arange(first, min(first + BLOCK, len(rows) - 2))
        most[at] = extractor.scores(rows, at).max(axis=1) + each
    most[rows == 0] = -1e4

    def best(x: np.ndarray) -> np.ndarray:
        """The largest sum of a stretch that ends with each row."""
        upto = np.concatenate([[0.0], np.cumsum(x)])
        return upto[1:] - np.minimum.accumulate(upto)[:-1]

    return (best(most) + best(most[::-1])[::-1] - most + once >= -1e-6) & (rows > 0)


def field_spans(texts: list[str], base: list[list[Span]], field: Field, extractor: Extractor) -> list[list[Span]]:
    """Spans that the field adds to those of the patterns: every word of every text is labelled."""
    extractor.use(field)
    two = np.zeros(2, np.int32)
    parts, some, first = [two], [], 2  # slices with their first rows
    for i, text in enumerate(texts):
        for a, b in slices(text):
            own = extractor.rows(text[a:b].split())
            some.append((first, first + len(own), i, a, b))
            parts.append(own)
            first += len(own)
        parts.append(two)
        first += 2
    rows = np.concatenate(parts)
    may = open_words(rows, extractor, field)
    runs = np.flatnonzero(np.diff(np.concatenate([[0], may.view(np.int8), [0]]))).reshape(-1, 2)
    found: list[tuple[int, int, str]] = []  # first and last row
    sizes = np.frexp(runs[:, 1] - runs[:, 0])[1]
    for size in np.unique(sizes):
        own = runs[sizes == size]
        step = max(1, 200_000 >> int(size))
        for low, high in (own[at : at + step].T for at in range(0, len(own), step)):
            lengths = high - low
            j = np.repeat(np.arange(len(low)), lengths)
            at = np.arange(len(j)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            scores = np.zeros((len(low), int(lengths.max()), len(LABELS)))
            scores[j, at, 1:] = extractor.scores(rows, low[j] + at)
            scores[:, 0] += np.where(rows[low - 1, None] > 0, field.moves[0], 0)  # from outside, and to it
            scores[np.arange(len(low)), lengths - 1] += np.where(rows[high, None] > 0, field.moves[:, 0], 0)
            labels = viterbi(scores, lengths, field.moves)
            for j, t in zip(*(x.tolist() for x in np.nonzero(labels)), strict=True):
                if LABELS[labels[j, t]][0] == "B":
                    last = t + 1
                    while last < lengths[j] and labels[j, last] == labels[j, t] + 1:
                        last += 1
                    found.append((int(low[j]) + t, int(low[j]) + last - 1, LABELS[labels[j, t]][2:]))
    added: list[list[Span]] = [[] for _ in texts]
    ends = sorted({x for a, b, _ in found for x in (a, b)})
    where: dict[int, tuple[int, int, int]] = {}  # of those rows: text and place
    for low, high, i, a, b in some:
        wanted = {x - low for x in ends[bisect_left(ends, low) : bisect_left(ends, high)]}
        if wanted:
            where.update((low + t, (i, *m.span())) for t, m in enumerate(_WORD.finditer(texts[i], a, b)) if t in wanted)
    for first, last, kind in found:
        (i, a, _), b = where[first], where[last][2]
        while a < b and not (texts[i][a].isalnum() or texts[i][a] in "[("):
            a += 1
        while b > a and not texts[i][b - 1].isalnum():
            b -= 1
        if b > a:
            added[i].append((a, b, kind))
    for i, spans in enumerate(added):
        if spans:
            taken, kept = sorted((a, b) for a, b, _ in base[i]), []
            for a, b, kind in sorted(spans):
                if all(b <= x or a >= y for x, y in taken):
                    kept.append((a, b, kind))
                    taken.append((a, b))
            added[i] = kept
    return added


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, field: Field | None = None, mask: bool = False) -> DataFrame:
    """docs with base and spans (arrays of kind, start, end). mask: text has each span replaced by its kind in brackets."""
    field = field or train(labelled_table(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    name = uuid.uuid4().hex
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = common.kept(("pii", name), Extractor)
        for batch in batches:
            for part, texts in text_parts(pc.fill_null(batch.column(at), "")):
                own = batch.column(at)[part].to_pylist()
                base = [pattern_spans(t) if _ANY.search(t) else [] for t in texts]
                added = field_spans(texts, base, shared.value, extractor)
                spans = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(base, added, strict=True)]
                columns = [batch.column(i)[part.start : part.stop] for i in range(len(names))]
                if mask:
                    columns[at] = pa.array([t and masked(t, s) for t, s in zip(own, spans, strict=True)], pa.string())
                columns += [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in x], _ARROW) for x in (base, spans)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "_base", "_spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_base", _SPANS), T.StructField("_spans", _SPANS)]))


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.doc_rows(common.documents(spark, sf_dir)))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(written_out(F.col("_base")), 256).alias("base_sha256"), written_out(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))
