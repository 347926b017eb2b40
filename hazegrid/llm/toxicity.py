"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import map_texts

BUCKETS = 1 << 20
# The classifier is fitted on at most so many labelled rows, chosen by the hash of their ids.
TRAIN_ROWS = 12_000
EPOCHS = 4
# Bytes of a word's stem.
STEM = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.5

# ASCII other than letters and digits separates words.
_separate = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ONE, _TWO, _LEFT, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the text's words, their stems (so that inflected forms share what is learnt), pairs of
    neighbours, and pairs with one word between; lower case, with repeats."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_separate).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    stems = np.fromiter(map(crc32, [w[:STEM] for w in words if len(w) > STEM]), np.uint64)
    keys = [h * _ONE, stems * _LEFT + _SKIP]
    if len(h) > 1:
        keys.append((h[:-1] * _LEFT) ^ (h[1:] * _TWO))
    if len(h) > 2:
        keys.append((h[:-2] * _SKIP) ^ (h[2:] * _ONE) ^ _LEFT)
    joined = np.concatenate(keys)
    return ((joined ^ joined >> np.uint64(31)) * _TWO >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """One z and n per bucket; a weight is zero until its z exceeds L1, so that few buckets end with one."""

    def __init__(self, buckets: int = BUCKETS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.bias, self.bias_n = 0.0, 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a document's distinct buckets: each coordinate has its own rate, by the gradients it has seen."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= self.alpha * g / (self.beta + np.sqrt(self.bias_n))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5. Such rows teach nothing."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias; empty if there are no labels.

    At most `rows` labelled rows outside the held-out fifth are joined with their texts. Of texts under one id the smallest is learnt, once
    for each label of the id, so that the sample is bounded however often an id repeats. It is learnt in order of a hash of the ids, in one task."""
    chosen = (labels.select(F.col(f"`{id_col}`").alias("l"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("l").isNotNull() & ~held_out(F.col("l")))
              .orderBy(F.xxhash64("l"), "l", "label").limit(rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("d"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # at most `rows` pairs of numbers, so broadcasting them is safe
    sample = texts.join(F.broadcast(chosen), F.col("d") == F.col("l")).groupBy("d", "label").agg(F.min("text").alias("text"))

    def learn(batches):
        seen = []
        for b in batches:
            seen += zip(b.column("order").to_pylist(), map(lambda t: np.unique(features(t)), b.column("text").to_pylist()),
                        b.column("label").to_pylist())
        seen.sort(key=lambda x: (x[0], x[2]))
        model = Ftrl()
        for _ in range(epochs if seen else 0):
            for _, at, label in seen:
                model.learn(at, label)
        used = np.flatnonzero(np.abs(model.z) > model.l1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(model.weights(used), model.bias))], names=["bucket", "weight"])

    # texts of one id meet per task first; then at most `rows` of them go to one task
    model = (sample.withColumn("order", F.xxhash64("d")).select("order", "text", "label").repartition(1)
             .mapInArrow(learn, "bucket long, weight double").collect())
    model.sort()
    at, w = np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model], np.float64)
    return at[1:], w[1:], float(w[0]) if len(w) else float("-inf")


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """A function that makes the scoring of a task. At most BUCKETS weights go to each."""
    at, weights, bias = model

    def make():
        dense = np.zeros(BUCKETS)
        dense[at] = weights

        def scores(texts):
            sums = np.empty(len(texts))
            for i, t in enumerate(texts):
                found = features(t)
                found = found[dense[found] != 0]
                sums[i] = dense[np.unique(found)].sum() + bias if len(found) else bias
            return [1 / (1 + np.exp(-np.clip(sums, -700, 700))) if np.isfinite(bias) else np.zeros(len(texts))]
        return scores

    return make


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row, without a shuffle."""
    scored = map_texts(df, {id_col: "doc_id"}, text_col, "score double", scorer(model))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `df`. Runs the training job.

    Texts alone are features. Null and empty texts score the bias; without labels every score is 0. A null id counts as an empty one and is
    held out. Labels that are null or no 0 or 1 are not learnt. Whole texts are scored, one at a time, however long. Repeated rows give
    repeated rows, an empty table an empty result; other columns are ignored."""
    return score(df, fit(df, labels, id_col, text_col, label_col, rows), id_col, text_col)


def reject_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows that score below 0.5, with all their columns, without a shuffle. Runs the training job."""
    model = fit(df, labels, id_col, text_col, label_col, rows)
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    scored = map_texts(df, names, text_col, "score double", scorer(model))
    return scored.where("score < 0.5").select(*[F.col(n).alias(c) for c, n in names.items()])
