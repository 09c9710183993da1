"""Language identification by nearest centroid.

A text's letters give hashed counts of characters, pairs and triples, damped by a square
root, weighted by inverse document frequency (counted by Spark over all training rows) and
normalised. Each language has several centroids, found by spherical k-means on the driver
over a bounded sample of the training rows. The language of the centroid with the largest
cosine wins; a text whose cosine is below what nearly all training rows of that language
reach is marked as rejected.

Defined results: null, empty and letterless texts are ``und`` with score 0 and rejected;
ties go to the language that sorts first; rows with a null lang are never learned from; if
nothing could be learned every text is ``und``; repeated rows are alike, and rows of one
doc_id each train with their own text and lang.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tables import texts

SIZE = 2048
UNKNOWN = "und"
#: Training rows that the centroids are fitted on, at most (or one a language); languages share them evenly.
SAMPLE = 6000
SALTS = 64
#: Code points taken together; longer texts are counted piece by piece.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: a number for a letter, 0 for all else."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of letters, pairs and triples (word edges count as a character); None without a letter."""
    total = np.zeros(SIZE, np.int64)
    any_letter = False
    table = _letters()
    lowered = text.lower()
    for at in range(0, len(lowered), PIECE):
        codes = np.frombuffer(lowered[at : at + PIECE + 2].encode("utf-32-le", "replace"), np.uint32)
        x = table[codes]
        letter = x > 0
        any_letter = any_letter or bool(letter.any())
        here = slice(0, PIECE)
        for n in (1, 2, 3):
            h, keep = np.zeros(max(0, len(x) - n + 1), np.uint32), np.zeros(max(0, len(x) - n + 1), bool)
            for k in range(n):
                part = slice(k, k + len(h))
                h = h * np.uint32(0x01000193) + x[part] + np.uint32(n)
                keep |= letter[part]
            if n == 3:
                keep &= letter[1 : 1 + len(h)]  # the middle one is a letter, so no triple lies over two words
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(21)
            total += np.bincount(h[here][keep[here]], minlength=SIZE)
    return total if any_letter else None


def _weighted(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(total) * idf
    return (v / max(1e-12, float(np.linalg.norm(v)))).astype(np.float32)


@dataclass(frozen=True)
class CentroidModel:
    langs: tuple[str, ...]
    #: the language (an index of ``langs``) of each centroid
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    #: by language: the cosine below which a text is rejected
    least: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        total = counts(text) if self.langs else None
        if total is None:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ _weighted(total, self.idf)
        best = int(np.argmax(cosine))
        return self.langs[self.owner[best]], float(np.clip(cosine[best], 0, 1)), bool(cosine[best] < self.least[self.owner[best]])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts with a letter there are, and how many of them have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                total = counts(text)
                if total is not None:
                    have += total > 0
                    n += 1
        # one row a task and feature; the feature SIZE counts the texts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(np.append(have, n))], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    have = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        have[r["feature"]] = r["n"]
    return int(have[SIZE]), have[:SIZE]


def _sample(train: DataFrame, size: int) -> DataFrame:
    """(doc_id, lang, text_hash): each language's rows with the least hashes, ``size // languages`` (one at least).

    So there are ``size`` rows at most, or one a language if there are more languages. A
    language's rows fall into ``SALTS`` parts by hash that are ranked apart; each hands on a
    few times its share, and what they hand on is ranked together. So a language with most
    of the rows isn't ranked in one task.
    """
    each = max(1, size // max(1, train.select("lang").distinct().count()))
    key = [F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*key))
    salted = train.select("doc_id", "lang", "text_hash", F.pmod(key[0], F.lit(SALTS)).alias("_salt"))
    apart = salted.withColumn("_r", rank("lang", "_salt")).where(F.col("_r") <= min(each, 2 * each // SALTS + 32))
    return apart.withColumn("_r", rank("lang")).where(F.col("_r") <= each).select("doc_id", "lang", "text_hash").distinct()


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE, clusters: int = 4, rounds: int = 10, rejected: float = 0.002, seed: int = 5) -> CentroidModel:
    """Learn from the rows with a lang where ``train`` holds."""
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash")).where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    n, have = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + have)) + 1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts(batch.column(1)):
                total = counts(text)
                out.append(None if total is None else _weighted(total, idf).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "vector"])

    chosen = _sample(rows, sample)
    held = rows.join(F.broadcast(chosen), ["doc_id", "lang", "text_hash"]).dropDuplicates(["doc_id", "lang", "text_hash"])
    got = held.select("lang", "text").mapInArrow(run, "lang string, vector binary").where("vector is not null").toArrow().to_pandas()
    got = got.sort_values(["lang", "vector"], ignore_index=True)
    langs, owner, centroids, least = tuple(sorted(got["lang"].unique())), [], [], []
    rng = np.random.default_rng(seed)
    for k, lang in enumerate(langs):
        x = np.stack([np.frombuffer(v, np.float16) for v in got.loc[got["lang"] == lang, "vector"]]).astype(np.float32)
        c = x[rng.permutation(len(x))[: min(clusters, len(x))]]
        for _ in range(rounds):
            nearest = (x @ c.T).argmax(1)
            c = np.stack([x[nearest == j].sum(0) if (nearest == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
        owner += [k] * len(c)
        centroids.append(c)
        least.append(float(np.quantile((x @ c.T).max(1), rejected)))
    return CentroidModel(langs, np.array(owner, int), np.concatenate(centroids) if centroids else np.zeros((0, SIZE), np.float32), idf, np.array(least))


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in texts(batch.column(1))]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
