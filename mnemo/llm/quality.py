"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax.

Every word, every byte 3-gram and 4-gram within a word (its boundary included) and the pair of a
word with itself has a learned vector, found by hashing. A document is the mean of its vectors; a softmax over a linear layer
gives the class probabilities. Stochastic gradient descent in numpy fits vectors and layer on at
most ``2 * per_class`` labelled documents, which one task can hold; scoring is a map over all
texts. As the layer is linear, a feature's vector enters a score only through its product with
the layer, so the fitted model ships as one row of class weights per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from mnemo.llm.common import WordHash, per_text, spaced, utf8

CLASSES = 2


@dataclass(frozen=True)
class QualityConfig:
    #: The fit sees at most this many labelled documents of each class, those of least hash.
    per_class: int = 4000
    bits: int = 16
    dim: int = 16
    epochs: int = 4
    rate: float = 0.5
    seed: int = 17


class Features:
    """Bucket numbers of a text, repeats included."""

    def __init__(self, bits: int, seed: int):
        self.shift, self.words = bits, WordHash(seed)

    def __call__(self, text: bytes):
        low, high = np.uint32(32 - self.shift), np.uint64(64 - self.shift)
        for a in spaced(text):
            wide = a.astype(np.uint32)
            inner = a != 32
            three = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            four = (three[:-1] << np.uint32(8)) | wide[3:]
            three = three[inner[1:-1]] * np.uint32(0x9E3779B1)
            four = (four[inner[1:-2] & inner[2:-1]] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA77)
            yield three >> low
            yield four >> low
            words = self.words(a)
            yield (words >> high).astype(np.uint32)
            # A word pair of two equal words is one feature, whatever the word.
            again = np.count_nonzero(words[1:] == words[:-1])
            yield np.zeros(again, np.uint32)


def counted(text: bytes, features: Features, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(buckets, np.int64)
    for ids in features(text):
        total += np.bincount(ids, minlength=buckets)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.float32)


def descend(labels, ids, counts, config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Fit by stochastic gradient descent: class weights per bucket, and the bias."""
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1, 1, (1 << config.bits, config.dim)).astype(np.float32) / config.dim
    layer = np.zeros((config.dim, CLASSES), np.float32)
    bias = np.zeros(CLASSES, np.float32)
    total, step = config.epochs * len(labels), 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(labels)):
            rate = np.float32(config.rate * (1 - step / total))
            step += 1
            if not len(ids[i]):
                continue
            share = counts[i] / counts[i].sum()
            own = vectors[ids[i]]
            mean = share @ own
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            # Features of long texts have small shares; the root keeps their steps from vanishing.
            pull = rate * np.float32(np.sqrt(len(ids[i]))) * share
            vectors[ids[i]] = own - pull[:, None] * back[None, :]
    return vectors @ layer, bias


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> bytes:
    """The fitted model of ``labels`` (doc_id, label 0 or 1) over ``docs`` (doc_id, text).

    A document with two different labels, another label than 0 or 1, or a null id teaches
    nothing. At most ``per_class`` documents per class are read, in one task; the class sizes of
    all labels set the prior. Without any label both classes are equally likely.
    """
    one = (
        labels.select("doc_id", F.col("label").cast("int").alias("label"))
        .filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most").drop("most")
    )
    sizes = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [one.filter(F.col("label") == c).orderBy(*order).limit(config.per_class) for c in range(CLASSES)]
    # Both sides are bounded by per_class rows of 12 bytes.
    sample = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "label", "text")

    def encode(batches):
        features = Features(config.bits, config.seed)
        for batch in batches:
            keys, classes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, label, text in zip(keys, classes, utf8(batch.column(2))):
                ids, counts = counted(text, features, 1 << config.bits)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([key], pa.int64()), "label": pa.array([label], pa.int32()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "counts": pa.array([counts.tobytes()], pa.binary()),
                })

    def train(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["doc_id"], r["label"], r["ids"], r["counts"]))
        weights, bias = descend(
            [r["label"] for r in rows], [np.frombuffer(r["ids"], np.int32) for r in rows],
            [np.frombuffer(r["counts"], np.float32) for r in rows], config,
        )
        # The sample is balanced; the bias takes the true sizes back in.
        taken = np.array([sum(r["label"] == c for r in rows) for c in range(CLASSES)], float)
        true = np.array([sizes.get(c, 0) for c in range(CLASSES)], float)
        bias = bias + np.log((true + 1) / (taken + 1))
        yield pa.RecordBatch.from_pydict({"model": [
            np.vstack([weights, bias[None, :]]).astype(np.float32).tobytes()
        ]})

    encoded = rows.mapInArrow(encode, "doc_id long, label int, ids binary, counts binary")
    return encoded.repartition(1).mapInArrow(train, "model binary").first()["model"] or b""


def probability(text: Column, model: bytes, config: QualityConfig = QualityConfig()) -> Column:
    """Probability of class 1 of each whole text; null and empty texts get the prior's."""
    def compute(texts):
        table = np.frombuffer(model, np.float32).reshape(-1, CLASSES)
        margin, start = table[:-1, 1] - table[:-1, 0], float(table[-1, 1] - table[-1, 0])
        features, out = Features(config.bits, config.seed), []
        for text in texts:
            total, n = 0.0, 0
            for ids in features(text):
                total, n = total + float(margin[ids].sum(dtype=np.float64)), n + len(ids)
            out.append(float(1 / (1 + np.exp(-np.clip(start + total / max(n, 1), -700, 700)))))
        return out

    return per_text(DoubleType(), compute)(text)


def score(docs: DataFrame, model: bytes, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, score and predicted; every row is scored."""
    out = docs.select("doc_id", probability(F.col("text"), model, config).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
