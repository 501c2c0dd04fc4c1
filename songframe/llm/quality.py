"""A quality classifier of supervised subword embeddings.

A word's features are the word itself and its character n-grams, hashed into
BUCKETS rows of learned vectors; a word that repeats the one before it also counts
as a word of its own kind. A document is the average of its features'
vectors; a linear layer with softmax gives the classes. Vectors and layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents: at most SAMPLE documents of at most SAMPLE_CHARS characters each, the
first by a hash of their id. Only documents whose crc32(id) mod 5 is not 0 are
ever in it. Labels, language, source and id are no inputs of a score.

As the layer is linear, a feature's share in the class scores can be computed
once for every row of vectors; scoring whole texts then adds shares of words,
which are kept for recent words.

Null text counts as empty; a text without words gets the score of the layer's
bias. Without labels the model is blank and all scores are 0.5. Rows of an id
that repeats are scored one by one; for training the smallest label and the
smallest text hash of an id count. A null id is held out. An empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import small_batches, table, text_of
from songframe.llm.words import Recent

BUCKETS, DIMENSIONS, NGRAMS = 1 << 16, 8, (3, 4)
#: The bound of the sample for training.
SAMPLE, SAMPLE_CHARS = 1500, 40_000
EPOCHS, RATE, SEED = 4, 0.5, 7
#: Word that no text contains.
AGAIN = "\n"
#: Features of a document at which its step in training is half.
FEW = 100
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """Buckets of a word and of the character n-grams of <word>."""
    spelt, mask, crc = f"<{word}>", BUCKETS - 1, zlib.crc32
    whole = spelt.encode("utf-8", "surrogatepass")
    out = [crc(whole, 1) & mask]
    for n in NGRAMS:
        if len(whole) == len(spelt):
            out += [crc(whole[i : i + n]) & mask for i in range(len(spelt) - n + 1)]
        else:
            out += [crc(spelt[i : i + n].encode("utf-8", "surrogatepass")) & mask for i in range(len(spelt) - n + 1)]
    return out


def bag_of(text: str) -> Counter[str]:
    """Counts of words; AGAIN stands for each word that repeats the one before."""
    words = text.split()
    bag = Counter(words)
    again = sum(map(operator.eq, words, words[1:]))
    if again:
        bag[AGAIN] += again
    return bag


class Embeddings:
    """Vectors of features and a linear layer over their average."""

    def __init__(self, classes: int = 2, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = np.zeros((BUCKETS, DIMENSIONS))
        self.layer = rng.normal(0, 1 / np.sqrt(DIMENSIONS), (classes, DIMENSIONS))
        self.bias = np.zeros(classes)
        self.rng = rng

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> Embeddings:
        of_word = Recent(features)
        bags = []
        for t in texts:
            bag: Counter[int] = Counter()
            for word, n in bag_of(t).items():
                for b in of_word[word]:
                    bag[b] += n
            bags.append((np.fromiter(bag, np.int64, len(bag)), np.fromiter(bag.values(), np.float64, len(bag))))
        want = np.eye(len(self.bias))[labels] if labels else np.zeros((0, len(self.bias)))
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in self.rng.permutation(len(bags)):
                at, n = bags[i]
                step = rate * (1 - done / steps) * n.sum() / (n.sum() + FEW)
                done += 1
                mean = n @ self.vectors[at] / n.sum() if len(at) else np.zeros(DIMENSIONS)
                wrong = self.softmax(self.layer @ mean + self.bias) - want[i]
                back = wrong @ self.layer
                self.layer -= step * np.outer(wrong, mean)
                self.bias -= 0.1 * step * wrong
                if len(at):  # scaled so that this document's own average moves by one step
                    self.vectors[at] -= step * np.outer(n * n.sum() / (n @ n), back)
        return self

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max())
        return e / e.sum()

    def shares(self) -> np.ndarray:
        """Of every bucket, its share in the score of class 1 over class 0."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)


class Scorer:
    def __init__(self, shares: np.ndarray, bias: float):
        self.shares, self.bias, self.of_word = shares.tolist(), bias, Recent(self._word)

    def _word(self, word: str) -> tuple[float, int]:
        found = features(word)
        return sum([self.shares[b] for b in found]), len(found)

    def score(self, text: str) -> float:
        total = count = 0
        for word, n in bag_of(text).items():
            s, k = self.of_word[word]
            total += n * s
            count += n * k
        x = self.bias + (total / count if count else 0.0)
        return float(1 / (1 + np.exp(-x)))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Embeddings:
    """A model of the bounded sample."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("t")).where(F.char_length("t") <= chars)
    rows = rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    got = sorted((r.id, r.t, r.y) for r in rows.collect())
    return Embeddings().fit([t for _, t, _ in got], [int(y > 0) for _, _, y in got])


def scored(docs: DataFrame, model: Embeddings, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id and score of every row, and the columns named in extra."""
    shares, bias = model.shares(), float(model.bias[1] - model.bias[0])
    sent = docs.sparkSession.sparkContext.broadcast((shares, bias))  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Scorer(*sent.value)
        for x in batches:
            yield x.drop(columns="t").assign(score=[own.score(t) for t in x["t"]])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("id"), text_of(text).alias("t"), *extra)
    kinds = dict(docs.dtypes)
    return rows.mapInPandas(run, "id string, " + "".join(f"`{c}` {kinds[c]}, " for c in extra) + "score double")


def good_documents(docs: DataFrame, model: Embeddings, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns."""
    shares, bias = model.shares(), float(model.bias[1] - model.bias[0])
    sent = docs.sparkSession.sparkContext.broadcast((shares, bias))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(*sent.value)
        for x in parts:
            yield pd.Series([own.score(t) for t in x], dtype="float64")

    small_batches(docs.sparkSession)
    return docs.where(score(text_of(text)) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, model).withColumn("id", F.col("id").cast("long"))
    return rows.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
