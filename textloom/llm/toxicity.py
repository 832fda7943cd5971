"""Operator 3: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. Lexicon. Spark counts the words, and the prefixes of words, of the labelled texts by label; those whose mean count in
   toxic texts exceeds that in others clearly (MIN_Z standard errors, MIN_ODDS times) form the lexicon, which the labelled
   sample bounds. A term weighs its log odds. A few plain insults (SEED) are in it whatever the labels say.
2. Features of a text: densities and sums of lexicon weights, plain and after undoing obfuscation, the densest window,
   second-person words near lexicon words, and rates of capitals, punctuation, symbols and obfuscated words.
3. Trees: Spark's own gradient-boosted trees on three quarters of the labelled rows; isotonic regression on the rest maps
   their margin to a probability. TIE of the score is the margin itself, so that texts on one step keep their order.

Labels are learned from a bounded sample: LABELLED rows by the hash of doc_id, which is all of them for up to that many.
Rows held out (crc32 of doc_id as text mod 5 is 0) are never used. Every text is scored whole.

Defined results: null and empty texts have features of zero and a score like any other; a null doc_id is not held out
and has no label; null labels are left out; a document with contrary labels counts with each; where labels of one kind are
too few to learn from (LEAST_LABELS), every score is the share of toxic labels, 0 without labels; repeated rows are
reported each; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import in_parts

LABELLED, LEAST_LABELS = 50_000, 20
MIN_Z, MIN_ODDS = 4.0, 3.0
#: A text counts a term so often at most when the lexicon is made; prefixes of so many letters.
MOST_COUNT, PREFIXES = 5, range(4, 8)
TREES, DEPTH = 20, 4
TIE = 0.02
WINDOW, NEAR = 50, 5
REMEMBERED = 400_000
#: Fixed words: insults that any annotator would call so, and their least weight.
SEED = frozenset(
    "idiot idiots moron morons imbecile stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown pig bastard bitch asshole jerk retard vermin filth "
    "dummkopf arschloch drecksau abschaum trottel wertlos widerlich connard salaud imbécile crétin ordure minable dégoûtant imbécil estúpido cabrón basura patético asqueroso".split()
)
SEED_WEIGHT = 3.0
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs and digits that stand for letters in obfuscated words; others inside a word are dropped.
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
FEATURES = (
    "log_words", "hits", "density", "weight", "weight_density", "heaviest", "window", "hidden_hits", "hidden_density",
    "near_second", "second_rate", "capital_rate", "capital_words", "exclaim_rate", "question_rate", "punctuation_rate", "symbol_rate", "odd_words",
)


def core(token: str) -> str:
    """A token without the signs around it, in lower case."""
    return _EDGES.sub("", token).lower()


def terms(words: list[str]) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(w for w in words if w).items():
        out["=" + word] += n
        for k in PREFIXES:
            if len(word) > k:
                out[word[:k]] += n
    return out


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms and weights from (text, toxic). "=word" is a word, anything else a prefix of longer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch["text"].to_pylist(), batch["toxic"].to_pylist()
            for part in in_parts(texts):
                found: Counter = Counter()
                squares: Counter = Counter()
                for text, label in zip(texts[part], labels[part], strict=True):
                    for term, n in terms([core(t) for t in text.split()]).items():
                        n = min(n, MOST_COUNT)
                        found[term, label] += n
                        squares[term, label] += n * n
                keys = list(found)
                yield pa.record_batch(
                    {
                        "term": pa.array([k[0] for k in keys], pa.string()),
                        "toxic": pa.array([k[1] for k in keys], pa.int32()),
                        "n": pa.array([found[k] for k in keys], pa.int64()),
                        "squares": pa.array([squares[k] for k in keys], pa.int64()),
                    }
                )

    rows = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    yes, no = float(rows.get(1, 0)), float(rows.get(0, 0))
    sums = labelled.select("text", "toxic").mapInArrow(run, "term string, toxic int, n long, squares long").groupBy("term")
    of = lambda column, label: F.sum(F.when(F.col("toxic") == label, F.col(column)).otherwise(0))
    stats = sums.agg(of("n", 1).alias("a"), of("n", 0).alias("b"), of("squares", 1).alias("aa"), of("squares", 0).alias("bb"))
    a, b = F.col("a") / yes, F.col("b") / no
    spread = F.sqrt((F.col("aa") / yes - a * a) / yes + (F.col("bb") / no - b * b) / no + 1e-9)
    odds = ((F.col("a") + 0.5) / yes) / ((F.col("b") + 0.5) / no)
    strong = stats.where("a >= 4").select("term", ((a - b) / spread).alias("z"), odds.alias("odds")).where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS))
    seed = {"=" + w: SEED_WEIGHT for w in SEED}
    return seed | {r["term"]: float(np.log(r["odds"])) for r in strong.collect()}


class Tokens(dict):
    """The number of each distinct token; properties by number."""

    def __init__(self, words: dict[str, float]):
        super().__init__()
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.kept: list[tuple[float, float, int, int, int]] = []

    def weight(self, word: str) -> float:
        found = [self.words.get("=" + word, 0.0)]
        found += [self.words.get(word[:k], 0.0) for k in PREFIXES if len(word) > k]
        return max(found)

    def __missing__(self, token: str) -> int:
        word = core(token)
        plain, hidden = self.weight(word), 0.0
        odd = 0
        if word and not word.isalpha():
            odd = int(any(c.isalpha() for c in word))
            if odd and not plain:
                hidden = self.weight(_INNER.sub("", word.translate(_PLAIN)))
        capital = int(len(word) > 1 and token.isupper())
        self.kept.append((plain, hidden, int(word in SECOND_PERSON), capital, odd))
        self[token] = len(self.kept) - 1
        return len(self.kept) - 1


def features(texts: list[str], tokens: Tokens) -> np.ndarray:
    """A row of FEATURES for each text."""
    if len(tokens) > REMEMBERED:
        tokens.forget()
    out = np.zeros((len(texts), len(FEATURES)))
    each, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = list(map(tokens.__getitem__, text.split()))
        each += own
        lengths[i] = len(own)
        n = len(text) or 1
        upper = sum(map(str.isupper, text)) if text != text.lower() else 0
        bang, ask = text.count("!"), text.count("?")
        out[i, 11] = upper / n
        out[i, 13], out[i, 14] = bang / n, ask / n
        out[i, 15] = sum(map(text.count, ".,;:'\"-()")) / n
        out[i, 16] = sum(map(text.count, "#*$%&|<>@^~_+=/\\")) / n
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    kept = np.array(tokens.kept)[np.array(each)]
    ends = np.cumsum(lengths)[some]
    begins = ends - lengths[some]
    n = lengths[some]
    total = lambda x: np.add.reduceat(x.astype(float), begins)
    plain, hidden, second, capital, odd = kept.T
    hit = plain > 0
    any_hit = hit | (hidden > 0)
    upto, upto_second = np.concatenate([[0], np.cumsum(any_hit)]), np.concatenate([[0], np.cumsum(second)])
    at = np.arange(len(plain))
    low, high = np.repeat(begins, n), np.repeat(ends, n)
    dense = upto[np.minimum(at + WINDOW, high)] - upto[at]
    close = any_hit & (upto_second[np.minimum(at + NEAR + 1, high)] - upto_second[np.maximum(at - NEAR, low)] > 0)
    columns = (
        np.log1p(n), total(hit), 100 * total(hit) / n, total(plain), 100 * total(plain) / n, np.maximum.reduceat(np.maximum(plain, hidden), begins), np.maximum.reduceat(dense, begins),
        total(hidden > 0), 100 * total(hidden > 0) / n, total(close), total(second) / n, None, total(capital) / n, None, None, None, None, total(odd) / n,
    )
    for k, column in enumerate(columns):
        if column is not None:
            out[some, k] = column
    return out


def with_features(docs: DataFrame, words: dict[str, float]) -> DataFrame:
    """docs (doc_id, text, and more) with text replaced by features."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    name = uuid.uuid4().hex
    more = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = common.kept(("toxicity", name), lambda: Tokens(shared.value))
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in in_parts(texts):
                own = features(texts[part], tokens)
                flat = pa.array(own.ravel())
                lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * len(FEATURES), flat)
                yield pa.record_batch({f.name: batch[f.name][part.start : part.stop] for f in more} | {"features": lists})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in more)
    return docs.mapInArrow(run, f"{schema}, features array<double>")


def score(docs: DataFrame, labels: DataFrame, hold_out: int = 0) -> DataFrame:
    """doc_id, held_out and score of each row of docs."""
    docs = common.doc_rows(docs).withColumn("held_out", common.held_out(hold_out))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    order = F.xxhash64("doc_id")
    known = known.where(~common.held_out(hold_out)).orderBy(order, "toxic").limit(LABELLED)
    # LABELLED rows of two numbers at most: texts need no shuffle to meet their labels.
    labelled = common.written(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"), "toxic-labelled")
    rows = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if min(rows.get(0, 0), rows.get(1, 0)) < LEAST_LABELS:
        share = rows.get(1, 0) / max(1, sum(rows.values()))
        return docs.select("doc_id", "held_out", F.lit(share).alias("score"))
    words = lexicon(labelled)
    train = with_features(labelled, words).select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).alias("rest"))
    train = common.written(train, "toxic-features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=1, checkpointInterval=-1).fit(train.where("not rest").coalesce(2))
    margin = vector_to_array("probability")[1].alias("margin")
    calibrated = IsotonicRegression(featuresCol="margin", labelCol="label").fit(trees.transform(train.where("rest")).select(margin, "label"))
    every = with_features(docs, words).select("doc_id", "held_out", array_to_vector("features").alias("features"))
    found = calibrated.transform(trees.transform(every).select("doc_id", "held_out", margin))
    return found.select("doc_id", "held_out", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - TIE) * F.col("prediction") + TIE * F.col("margin"))).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
