"""Toxicity by subword-bag embeddings: the vectors of a text's words and character n-grams
are averaged and a linear softmax reads the average. Vectors and softmax are trained
together, in numpy on the driver, on a bounded sample of labelled rows. A misspelling that
no label has shares most of its n-grams with words that have been seen.

As the model is linear after training, each hashed subword has one number (its vector
along the difference of the two classes); tasks average those numbers.

Defined results: a null or empty text has no subwords and scores what the bias alone
gives; without labelled texts of both classes the score is the share of label 1 among the labels
(0.5 if there are none) for all rows; labels of one document that disagree count each; repeated rows score
alike; other columns of the input are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tables import cut_lineage, release_memory, texts

BUCKETS = 1 << 17
SHORTEST, LONGEST = 3, 5
WORD = re.compile(r"\w+")
#: Labelled documents of each class that are fitted on, at most: those with the least hash of the id.
SAMPLE_EACH = 2500
#: Bytes of their features (8 a distinct subword of a text) that go to the driver for each class, at most, but for one row.
SAMPLE_BYTES = 24 << 20
#: Words whose sum, and words whose buckets, a task remembers.
REMEMBERED, FEATURES_REMEMBERED = 200_000, 50_000


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at both ends."""
    marked = f"<{word}>"
    size = len(marked)
    grams = [marked, *[marked[a : a + n] for n in range(SHORTEST, LONGEST + 1) if n < size for a in range(size - n + 1)]]
    return [crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]


class SubwordModel(dict):
    """Weights of the subwords; as a dict, what the words met so far add up to.

    The sum of a word's weights is the real part and their number the imaginary part, so
    that one sum over the words of a text gives both.
    """

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __reduce__(self):
        return SubwordModel, (self.weights, self.bias)

    def __missing__(self, word: str) -> complex:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = subwords(word)
        got = self[word] = complex(float(self.weights[ids].sum()), len(ids))
        return got

    def score(self, text: str) -> float:
        total = sum(map(self.__getitem__, WORD.findall(text.lower())), 0j)
        logit = self.bias + (total.real / total.imag if total.imag else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def _features(sample: DataFrame) -> DataFrame:
    """The subword buckets of each sampled text with their shares of the average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        none = np.zeros(0, np.int32)
        for batch in batches:
            ids, shares = [], []
            for text in texts(batch.column(1)):
                counted = Counter(WORD.findall(text.lower()))
                for word in counted:
                    if word not in seen:
                        seen[word] = np.array(subwords(word), np.int32)
                found = [seen[w] for w in counted]
                times = np.repeat(np.fromiter(counted.values(), np.float64, len(counted)), [len(x) for x in found])
                bucket, place = np.unique(np.concatenate([none, *found]), return_inverse=True)
                total = np.bincount(place, times, len(bucket))
                ids.append(bucket.tobytes())
                shares.append((total / max(1.0, total.sum())).astype(np.float32).tobytes())
                if len(seen) > FEATURES_REMEMBERED:
                    seen.clear()
            release_memory()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["toxic", "doc_id", "ids", "shares"])

    return sample.select("toxic", "text", "doc_id").mapInArrow(run, "toxic int, doc_id long, ids binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_each: int = SAMPLE_EACH, sample_bytes: int = SAMPLE_BYTES, size: int = 16, passes: int = 8, seed: int = 7) -> SubwordModel:
    """Fit on the labelled rows where ``train`` (a condition on doc_id) holds.

    Each class gives its ``sample_each`` rows with the least hash of the id at most, and of
    these as many, in that order, as begin within ``sample_bytes`` of features. It weighs
    as all its rows do.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train)
    counted = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counted) < 2:
        return _prior(counted)
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(sample_each).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(sample_each))
    made = cut_lineage(_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")))
    # the window sees sample_each rows of a class, without their features
    sizes = made.select("toxic", "doc_id", F.xxhash64("ids", "shares").alias("h"), (F.length("ids") + F.length("shares")).alias("n"))
    before = Window.partitionBy("toxic").orderBy(order, "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < sample_bytes).select("toxic", "doc_id", "h").distinct()
    rows = made.withColumn("h", F.xxhash64("ids", "shares")).join(F.broadcast(within), ["toxic", "doc_id", "h"]).select("toxic", "ids", "shares").toArrow().to_pandas()
    if rows["toxic"].nunique() < 2:  # labels of documents that aren't there
        return _prior(counted)
    rows = rows.sort_values(["toxic", "ids"], ignore_index=True)  # the order of rows is not to matter
    return _train([np.frombuffer(x, np.int32) for x in rows["ids"]], [np.frombuffer(x, np.float32) for x in rows["shares"]], rows["toxic"].to_numpy(), counted, size, passes, seed)


def _prior(counted: dict[int, int]) -> SubwordModel:
    """A model that gives every text the share of label 1."""
    share = counted.get(1, 0) / sum(counted.values()) if counted else 0.5
    bias = np.log(share / (1 - share)) if 0 < share < 1 else 50 * (2 * share - 1)
    return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.clip(bias, -50, 50)))


def loss_and_gradients(mixed: np.ndarray, vectors: np.ndarray, top: np.ndarray, bias: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The weighted cross-entropy of the texts (rows of ``mixed``, shares of subwords) and its gradients by vectors, softmax and bias."""
    hidden = mixed @ vectors
    logits = hidden @ top + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    rows, w = np.arange(len(toxic)), weight / len(toxic)
    loss = -float((np.log(p[rows, toxic]) * w).sum())
    p[rows, toxic] -= 1
    p *= w[:, None]
    return loss, (mixed.T @ (p @ top.T), hidden.T @ p, p.sum(0))


def _train(ids: list[np.ndarray], shares: list[np.ndarray], toxic: np.ndarray, counted: dict[int, int], size: int, passes: int, seed: int) -> SubwordModel:
    """Minibatches with adaptive moments over vectors (buckets x size) and softmax (size x 2)."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (size, 2)).astype(np.float32), np.log(np.array([counted[0], counted[1]], np.float32) / sum(counted.values()))
    weight = np.where(toxic == 1, counted[1] / max(1, (toxic == 1).sum()), counted[0] / max(1, (toxic == 0).sum()))
    weight = (weight / weight.mean()).astype(np.float32)
    scale = np.float32(30.0)  # an average over a whole text is small; this is undone at the end
    m, v = np.zeros_like(vectors), np.zeros_like(vectors)
    small = [np.zeros_like(top), np.zeros_like(top), np.zeros_like(bias), np.zeros_like(bias)]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            lengths = np.array([len(ids[r]) for r in rows])
            flat, part = np.concatenate([ids[r] for r in rows]), np.concatenate([shares[r] for r in rows]) * scale
            of = np.repeat(np.arange(len(rows)), lengths)
            seen, back = np.unique(flat, return_inverse=True)
            mixed = np.zeros((len(rows), len(seen)), np.float32)  # a share of each subword in each text
            mixed[of, back] = part
            _, (g, g_top, g_bias) = loss_and_gradients(mixed, vectors[seen], top, bias, toxic[rows], weight[rows])
            g = g + 1e-6 * vectors[seen]
            step += 1
            rate = 0.02 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            m[seen] = 0.9 * m[seen] + 0.1 * g
            v[seen] = 0.999 * v[seen] + 0.001 * g * g
            for x, gx, mx, vx in ((top, g_top, small[0], small[1]), (bias, g_bias, small[2], small[3])):
                mx *= 0.9
                mx += 0.1 * gx
                vx *= 0.999
                vx += 0.001 * gx * gx
                x -= (rate * mx / (np.sqrt(vx) + 1e-8)).astype(np.float32)
            vectors[seen] -= (rate * m[seen] / (np.sqrt(v[seen]) + 1e-8)).astype(np.float32)
    weights = (vectors @ (top[:, 1] - top[:, 0])) * scale
    return SubwordModel(weights.astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and the score of each document."""
    model = SubwordModel(model.weights, model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def toxic(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield column.fillna("").map(model.score).astype("float64")
        model.clear()
        release_memory()

    return docs.where(toxic(F.col("text")) < threshold)
