"""Quality classifier: similarity-weighted voting of nearest labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

#: Hashed byte pairs, byte-class triples, and bins of repetition measures.
PAIRS, TRIPLES, BINS = 768, 192, 64
FEATURES = PAIRS + TRIPLES + BINS
#: The most labelled rows that the fit takes: its bounded sample.
MAX_LABELLED = 4096
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 4
BLOCK = 256
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, line feed, beyond ASCII, and each mark its own."""
    kind = np.arange(256) % 40 + 6
    kind[[*range(97, 123)]], kind[[*range(65, 91)]], kind[[*range(48, 58)]] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10], kind[128:] = 3, 4, 5
    return kind.astype(np.int64)


CLASSES = _classes()


def features(text: str) -> np.ndarray:
    """Log-scaled term rates of one whole text; zero for a text without words.

    Terms are hashed byte pairs, hashed triples of byte classes, and bins of how much of the text
    repeats the word before, the word before that, or any word.
    """
    out = np.zeros(FEATURES, np.float32)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    n, pairs, triples = len(data), np.zeros(PAIRS), np.zeros(TRIPLES)
    for at in range(0, n, 1 << 20):  # long texts in pieces that overlap by two bytes
        b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.int64)
        c = CLASSES[b]
        pairs += np.bincount((b[:-1][: 1 << 20] * 31 + b[1:][: 1 << 20] * 257) % PAIRS, minlength=PAIRS)
        triples += np.bincount((c[:-2] * 2209 + c[1:-1] * 47 + c[2:]) % TRIPLES, minlength=TRIPLES)
    out[:PAIRS] = np.log1p(1000.0 * pairs / n)
    out[PAIRS : PAIRS + TRIPLES] = np.log1p(1000.0 * triples / n)
    m = len(words)
    again = [sum(map(bytes.__eq__, words, words[k:])) / max(1, m - k) for k in (1, 2)]
    again.append(1.0 - len(set(words)) / m if m >= 20 else 0.0)
    for k, share in enumerate(again):
        out[PAIRS + TRIPLES + 16 * k + min(15, int(share * 16))] = 6.0
    return out


@dataclass
class Model:
    weight: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # features x rank
    vectors: np.ndarray  # labelled documents in the latent space, unit length
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.weight) @ self.basis
        size = np.linalg.norm(y, axis=1, keepdims=True)
        return (y / np.where(size > 0, size, 1.0)).astype(np.float32)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted vote of the nearest labelled vectors; the prior where nothing is similar."""
        cosines = self.latent(x) @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        if not k:
            return np.full(len(x), self.prior)
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, axis=1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((cosines == least).sum(axis=1) > 1):  # ties for the last place
            near[i] = np.argsort(-cosines[i], kind="stable")[:k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1).astype(float), 0.0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1.0)
        return np.clip(np.where(total > 0, vote, self.prior), 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Latent-semantic vectors: inverse-document-frequency weights and the leading right singular vectors."""
    if not len(x):
        return Model(np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    weight = np.log((1.0 + len(x)) / (1.0 + (x > 0).sum(axis=0))) + 0.1
    y = (x * weight).astype(np.float64)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    values, basis = np.linalg.eigh(y.T @ y)
    model = Model(weight, basis[:, ::-1][:, :rank], np.zeros((0, rank), np.float32), labels.astype(float), float(labels.mean()))
    model.vectors = model.latent(x)
    return model


def labelled_sample(labels: DataFrame, name: str, most: int) -> DataFrame:
    """(doc_id, label): at most `most` labelled ids in the order of a hash; of repeated ids the smallest label."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
    one = rows.groupBy("doc_id").agg(F.min(name).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, name: str = "quality", usable: Callable | None = None) -> Model:
    """Fit on at most `most` labelled ids, whose features (4 KB each) come to the driver.

    Of rows that repeat a labelled id one teaches: the least by its features.
    """
    chosen = labels if usable is None else labels.filter(usable(F.col("doc_id")))
    sample = F.broadcast(labelled_sample(chosen, name, most))  # at most `most` rows of two numbers
    rows = docs.select(docs["doc_id"], docs["text"]).join(sample.select("doc_id"), "doc_id", "left_semi")

    def make():
        return lambda texts: {"x": [features(t).tobytes() for t in texts]}

    got = map_texts(rows, make, {"x": pa.binary()}, "x binary").groupBy("doc_id").agg(F.min("x").alias("x"))
    got = got.join(sample, "doc_id").select("label", "x").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    labels_ = np.asarray(got.column("label").to_pylist(), int)
    order = np.lexsort([*x[:, :8].T, labels_])  # the rows arrive in any order
    return fit(x[order], labels_[order])


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted): one row per row of docs, from the text alone.

    The labelled vectors (at most MAX_LABELLED x RANK floats) are broadcast; every document is compared with
    all of them in blocks. Null and empty texts are similar to nothing and get the prior, the labelled share
    of good rows. Long texts count whole. Of neighbours that tie for the last place the first in the model's order
    votes. Repeated rows stay repeated, other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def run(texts: list[str]) -> dict:
            scores = [own.score(np.stack([features(t) for t in texts[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)]
            every = np.concatenate(scores) if scores else np.zeros(0)
            return {"score": every, "predicted": (every >= threshold).astype(np.int32)}

        return run

    return map_texts(docs, make, {"score": pa.float64(), "predicted": pa.int32()}, "score double, predicted int")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; rows that are held out teach nothing."""
    model = train(docs, labels, usable=lambda doc_id: ~held_out(doc_id))
    out = classify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
