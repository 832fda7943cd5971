"""Text expressions. Case folds A-Z alone, and trim() takes spaces alone, as the engine's SQL does everywhere."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Quotes that a keyword may stand in, prefixes of test texts, and what short generic texts are made of.
QUOTES = ('""', "''", "“”", "‘’", "「」", "『』", "《》", "〈〉", "«»", "‹›")
TEST_PREFIXES = ("（test）", "（Test）", "(test)", "(Test)")
GENERIC_LENGTH = 8
INTERJECTIONS = "呀啊哇呜嗯唔哦噢欸诶哼哈嘿呵嗷喂呃咦哟哎"
PUNCTUATION = "…？！?!～~。．，、·・—-；:（）()「」『』【】《》〈〉"
RESPONSE_ENDS = "…？！?!～~。．"
RESPONSES = (
    "怎么了", "没错", "没问题", "是的", "交给我吧", "再见", "我明白了", "唉", "这", "我", "什么", "好", "真的吗", "为什么", "这是", "你好",
    "呼", "没有", "谢谢", "好吧", "难道说", "明白了", "好耶", "当然", "什么事", "原来如此", "可是", "好的", "派蒙", "什么意思", "是啊", "你",
    "好久不见", "准备好了", "呼…呼", "没关系", "这样啊", "咳咳", "噗", "确实", "你们好", "你还好吗", "怎么会这样", "走吧", "一起走吧", "这个嘛",
    "喵", "原来是这样",
)
_BLANKS = " \t\r\n　"


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _unquoted(text: str) -> str | None:
    """text without a pair of quotes around it, else without a lone one at an end; None where neither stands."""
    pairs = dict(QUOTES)
    closed = pairs.get(text[0]) == text[-1] and text[1:-1].strip()
    opened = text[0] in pairs and pairs[text[0]] not in text[1:] and text[1:].strip()
    ended = [a for a, b in QUOTES if text[-1] == b and a not in text[:-1]] and text[:-1].strip()
    return closed or opened or ended or None


def keyword(text: str | None) -> str:
    """A keyword without blanks and quotes around it."""
    text = (text or "").strip()
    while text and (inner := _unquoted(text)):
        text = inner
    return text


def escaped(literal: str) -> str:
    """For LIKE: the literal's own wildcards stand for themselves."""
    return "".join("\\" + c if c in "\\%_" else c for c in literal)


def like_any(c: Column, word: str, subsequence: bool = False) -> Column:
    """The folded keyword as a substring; or, where asked for, its characters in order with anything between."""
    word = fold_text(word)
    found = F.contains(fold(c), F.lit(word))
    if subsequence:
        # Each character at its first place after the one before it; possessive, so a text is read once.
        letters = ["\\x{%x}" % ord(x) for x in "".join(word.split())]
        found = found | fold(c).rlike("^" + "".join(f"[^{x}]*+{x}" for x in letters))
    return found


def norm(c: Column, compact: bool = False) -> Column:
    """What matching compares: folded, trimmed, null as empty; compact: without blanks inside."""
    c = fold(F.trim(F.coalesce(c, F.lit(""))))
    return F.translate(c, " \t\n\r", "") if compact else c


def tier(c: Column, word: str, base: int = 0, compact: bool = False) -> Column:
    """0 equal, 1 begins with, 2 contains, 3 anything else."""
    word = fold_text(word.strip())
    c = norm(c, compact)
    return F.when(c == word, base).when(F.startswith(c, F.lit(word)), base + 1).when(F.contains(c, F.lit(word)), base + 2).otherwise(base + 3)


def grams(c: Column, n: int) -> Column:
    """Distinct runs of n characters in order of first sight; a shorter text is its own run."""
    return F.array_distinct(F.when(F.length(c) >= n, every_run(c, n)).otherwise(F.filter(F.array(c), lambda x: x != "")))


def every_run(c: Column, n: int) -> Column:
    """Every run of n characters in turn, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(.{%d}))." % n), F.lit(1))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def unique_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, F.trim), lambda x: x != ""))


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def preview(c: Column) -> Column:
    """One line: a written \\n counts as a line end, blanks as one space; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.replace(c, F.lit("\\n"), F.lit("\n")), r"\s+", " ")), F.lit(""))


def snippet(c: Column, word: str, radius: int = 28, otherwise: int = 72) -> Column:
    """The keyword in its context, with dots where text is left out; without a hit the text's begin."""
    text, word = preview(c), fold_text(word)
    at = F.locate(word, fold(text))
    start = F.greatest(at - radius, F.lit(1))
    stop = F.least(at + len(word) + radius - 1, F.length(text))
    inside = F.concat(
        F.when(start > 1, "...").otherwise(""), F.trim(F.substring(text, start, stop - start + 1)), F.when(stop < F.length(text), "...").otherwise("")
    )
    short = F.when(F.length(text) <= otherwise, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, otherwise - 3)), F.lit("...")))
    return F.when(at > 0, inside).otherwise(short)


def sanitized(c: Column) -> Column:
    """Without replacement, zero-width and control characters; a stray E between two ideographs is a comma."""
    c = F.regexp_replace(c, "[�​-‍﻿\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.regexp_replace(c, "([一-鿿])E(?=[一-鿿])", "$1,")


def base_name(c: Column) -> Column:
    """The last part of a path, without a language suffix before its extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"_[A-Z]{2,3}(\.[^.]*)?$", "$1")


def is_test_text(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(p)) for p in TEST_PREFIXES))


def is_generic(c: Column) -> Column:
    """Short, and only signs, only interjections and signs, or a stock answer with an end sign."""
    text = F.btrim(F.coalesce(c, F.lit("")), F.lit(_BLANKS))
    bare = F.translate(text, PUNCTUATION + _BLANKS, "")
    stem = F.rtrim(text, F.lit(RESPONSE_ENDS + _BLANKS))
    return (text != "") & (F.length(text) <= GENERIC_LENGTH) & ((F.translate(bare, INTERJECTIONS, "") == "") | ((stem != text) & stem.isin(*RESPONSES)))


def twin_text(c: Column, male: bool | None) -> Column:
    """Texts for two player forms, {M#..}{F#..} in either order; male None shows both as {male/female}. A leading # goes."""
    return F.regexp_replace(_twins(c, male), "^#", "")


def _twins(c: Column, male: bool | None) -> Column:
    first, second = (r"\{M#(.*?)}\{F#(.*?)}", r"\{F#(.*?)}\{M#(.*?)}")
    to = {True: ("$1", "$2"), False: ("$2", "$1"), None: ("{$1/$2}", "{$2/$1}")}[male]
    to = tuple(t.replace("{", "\\{").replace("}", "\\}") for t in to)
    return F.regexp_replace(F.regexp_replace(c, first, to[0]), second, to[1])


def placeholders(c: Column, male: bool | None, wanderer: Column, traveller: Column, little_one: Column, words: Column) -> Column:
    """A text with its names filled in: both player forms, pronouns by id from words (a map of id to text), and four names."""
    c = _twins(c, male)
    pronoun = r"\{(.*?)AVATAR#SEXPRO\[(.*?)\|(.*?)]}"
    word = lambda token, group: F.coalesce(F.try_element_at(words, F.regexp_extract(token, pronoun, group)), F.lit(""))
    if male is None:
        said = lambda t: F.concat(F.lit("{"), word(t, 2), F.lit("/"), word(t, 3), F.lit("}"))
    else:
        # The mate is of the other form.
        said = lambda t: F.when((F.regexp_extract(t, pronoun, 1) == "MATE") == F.lit(male), word(t, 3)).otherwise(word(t, 2))
    # A text is what stands between its tokens, and the words for them.
    tokens, between = F.regexp_extract_all(c, F.lit(pronoun), F.lit(0)), F.split(c, pronoun)
    c = F.array_join(F.zip_with(between, F.transform(tokens, said), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    c = F.replace(c, F.lit("{REALNAME[ID(1)|HOSTONLY(true)]}"), wanderer)
    for token in ("#{REALNAME[ID(2)|SHOWHOST(true)]}", "{REALNAME[ID(2)|SHOWHOST(true)]}", "{REALNAME[ID(2)|HOSTONLY(true)]}"):
        c = F.replace(c, F.lit(token), little_one)
    return F.regexp_replace(F.replace(c, F.lit("{NICKNAME}"), traveller), "^#", "")


def index_terms(c: Column, words: bool) -> Column:
    """What a full-text index holds of a text: its words, or for a script without spaces its pairs of characters and itself."""
    if words:
        return F.array_distinct(F.filter(F.split(fold(c), r"\s+"), lambda x: x != ""))
    whole = compact(c)
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(grams(whole, 2), F.array(whole))))


def query_terms(text: str, words: bool, stop: tuple[str, ...] = (), least: int = 1, most: int = 64) -> list[str]:
    """What a keyword asks an index for; the whole keyword is no term of its own where it has parts. Stop words, and terms
    shorter or longer than allowed, are left out."""
    text = keyword(text)
    if words:
        parts = fold_text(text).split()
    else:
        whole = "".join(text.split())
        parts = [whole[i : i + 2] for i in range(len(whole) - 1)] or [whole]
    return [p for p in dict.fromkeys(parts) if least <= len(p) <= most and p.lower() not in stop]


def language_aliases(lang: str | None) -> list[str]:
    """Names that a language goes by: as given, in capitals, its short name, and the files named after it."""
    text = (lang or "").strip()
    if not text:
        return []
    found = re.fullmatch(r"Text(?:Map)?([A-Za-z0-9_]+)\.json", text, re.IGNORECASE)
    short = [found[1], found[1].upper()] if found else []
    stem = short[-1] if found else text.upper() if re.fullmatch("[A-Za-z]{2,4}", text) else None
    files = [f"TextMap{stem}.json", f"Text{stem}.json"] if stem else []
    return list(dict.fromkeys([text, text.upper(), *short, *files]))


def int_keyword(text: str | None) -> int | None:
    """A keyword that is a whole number, plain or hexadecimal."""
    text = (text or "").strip()
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return int(text)
    return int(text, 16) if re.fullmatch(r"[+-]?0[xX][0-9a-fA-F]+", text) else None


def anchors(c: Column, size: int = 4) -> Column:
    """Distinct (kind, run): the first, last and middle characters of a text."""
    n = F.least(F.length(c), F.lit(size))
    at = lambda kind, start: F.struct(F.lit(kind).alias("kind"), F.substring(c, start, n).alias("run"))
    every = F.array(at("prefix", F.lit(1)), at("suffix", F.length(c) - n + 1), at("middle", F.floor((F.length(c) - n) / 2).cast("int") + 1))
    return F.when(F.length(c) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<struct<kind:string,run:string>>"))


def speaker(c: Column, compact_name: bool = False) -> Column:
    """A speaker's name as it is compared: lower case, no blanks at the ends or, for scripts without spaces, anywhere."""
    name = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return compact(name) if compact_name else name


def spoken_tier(c: Column, word: str, compact_name: bool = False) -> Column:
    """0 equal, 1 begins with, 2 contains, 3 anything else, in any script's lower case; an empty word is equal to all."""
    wanted = speaker(F.lit(word), compact_name)
    value = speaker(c, compact_name)
    rank = F.when(value == "", 3).when(value == wanted, 0).when(F.startswith(value, wanted), 1).when(F.contains(value, wanted), 2).otherwise(3)
    return F.when(wanted == "", 0).otherwise(rank)


def typed_key(c: Column) -> Column:
    """What tells values of JSON apart, each with its type: text by its line ends made equal, numbers by value, objects by
    their fields in order of name."""
    v = F.try_parse_json(c)
    shape = F.schema_of_variant(v)
    body = F.when(shape == "STRING", line_ends(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))
    kind = F.when(shape == "STRING", "str").when(shape == "BOOLEAN", "bool").when(shape == "BIGINT", "int").when(F.startswith(shape, F.lit("DECIMAL")) | (shape == "DOUBLE"), "float").when(shape == "VOID", "none").otherwise("json")
    return F.when(v.isNotNull(), F.struct(kind.alias("kind"), body.alias("value")))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def item_name(c: Column) -> Column:
    """A thing's name as it is compared with others: composed, lower case, letters, marks and digits alone."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{M}\p{N}]+", "")


@F.pandas_udf(LongType())
def synthetic_id(keys: pd.Series) -> pd.Series:
    """A negative number for a made text, from the first eight bytes of a keyed digest: the same for the same key anywhere."""
    number = lambda k: -(int.from_bytes(hashlib.blake2s(k.encode(), digest_size=8).digest(), "big") % 2_000_000_000 + 1)
    return keys.map(lambda k: None if k is None else number(k)).astype("Int64")
