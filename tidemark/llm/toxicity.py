"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, bounded, map_texts, pieces, text_of
from tidemark.llm.quality import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
#: Hashed features: words and their beginnings of these lengths.
SPACE_BITS = 20
PREFIXES = (4, 5, 6, 7)
#: The most labelled rows that the fit takes (its bounded sample), and the features kept.
MAX_LABELLED = 6144
KEPT = 2048
#: Grades above 0: labelled rows are split among them by how much of the text speaks for the label.
GRADES = 3
REJECT = 0.5
#: Words whose features a worker remembers; then it starts anew.
REMEMBER = 150_000


def word_features(word: str) -> set[int]:
    """Hashed features of one lower-case word."""
    own = {"=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)}
    return {zlib.crc32(x.encode()) & ((1 << SPACE_BITS) - 1) for x in own}


def counts(text: str, features_of) -> Counter:
    """How often each feature occurs in the whole text. features_of maps a word to its features."""
    total: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in features_of(word):
            total[f] += n
    return total


@dataclass
class Model:
    weights: dict[int, float]
    cuts: np.ndarray  # ordered thresholds, one for each grade above 0

    def chances(self, total: Counter) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= GRADES): one score, shared weights, ordered thresholds."""
        score = sum(self.weights[f] * np.log1p(n) for f, n in total.items())
        return 1.0 / (1.0 + np.exp(-np.clip(score - self.cuts, -500, 500)))


def _fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, width: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of P(y <= g) = logistic(cut_g - w x) by Adam steps over the whole sample.

    The cuts are kept in order as a first cut and positive gaps.
    """
    n, levels = len(grades), GRADES
    w, raw = np.zeros(width), np.array([2.0, *([0.0] * (levels - 1))])
    state = [np.zeros(width + levels), np.zeros(width + levels)]
    for step in range(1, steps + 1):
        cuts = np.cumsum([raw[0], *np.exp(raw[1:])])
        score = np.bincount(rows, vals * w[cols], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        hi, lo = edge[grades + 1] - score, edge[grades] - score
        p_hi, p_lo = np.where(np.isinf(hi), 1.0, sig(hi)), np.where(np.isinf(lo), 0.0, sig(lo))
        mass = np.maximum(p_hi - p_lo, 1e-9)
        d_hi, d_lo = p_hi * (1 - p_hi) / mass, p_lo * (1 - p_lo) / mass
        to_score = (d_hi - d_lo) / n  # of the negative log likelihood
        g_w = np.bincount(cols, vals * to_score[rows], width) + ridge * w
        g_cut = np.array([((grades == k + 1) * d_lo - (grades == k) * d_hi).sum() / n for k in range(levels)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(raw[1:])])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, raw = w - move[:width], raw - move[width:]
    return w, np.cumsum([raw[0], *np.exp(raw[1:])])


def fit(rows: np.ndarray, feats: np.ndarray, times: np.ndarray, toxic: np.ndarray, kept: int = KEPT, ridge: float = 1e-4, steps: int = 300) -> Model:
    """Cells (row, feature, count) of labelled rows; toxic: 0 or 1 for each row.

    Features are ranked by how far their document rate among toxic rows exceeds that among the others.
    Severity grades of toxic rows are equal parts by the count of such features relative to all features.
    """
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    width = 1 << SPACE_BITS
    speaks = toxic[rows] == 1
    pos, neg = (np.bincount(feats[m], minlength=width) for m in (speaks, ~speaks))
    del speaks
    p, q = pos / n_pos, neg / n_neg
    good = np.flatnonzero((pos >= 3) & (p > q))
    if not len(good):
        return Model({}, np.full(GRADES, 6.0) + np.arange(GRADES))
    worth = (p[good] - q[good]) ** 2 / (p[good] + q[good])
    chosen = good[np.lexsort((good, -worth))][:kept]
    index = np.full(width, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    col = index[feats]
    strong = (col >= 0) & (col < max(1, len(chosen) // 16))
    n = len(toxic)
    share = np.bincount(rows[strong], times[strong], n) / np.maximum(1, np.bincount(rows, times, n))
    grades = np.zeros(n, int)
    at = np.flatnonzero(toxic == 1)
    rank = np.empty(len(at), int)
    rank[np.lexsort((at, share[at]))] = np.arange(len(at))
    grades[at] = 1 + rank * GRADES // max(1, len(at))
    own = col >= 0
    w, cuts = _fit(rows[own], col[own], np.log1p(times[own]), grades, len(chosen), ridge, steps)
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, cuts)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, name: str = "toxic") -> Model:
    """Fit on at most `most` labelled ids; their feature counts come to the driver, a few KB each.

    Of rows that repeat a labelled id one teaches: the least by its features.
    """
    sample = F.broadcast(labelled_sample(labels, name, most))  # at most `most` rows of two numbers
    rows = docs.select(docs["doc_id"], docs["text"]).join(sample.select("doc_id"), "doc_id", "left_semi")

    def make():
        known: dict[str, tuple] = {}

        def of(word: str) -> tuple:
            if word not in known:
                if len(known) > REMEMBER:
                    known.clear()
                known[word] = tuple(word_features(word))
            return known[word]

        def run(texts: list[str]) -> dict:
            made = [sorted(counts(t, of).items()) for t in texts]
            return {name: [np.array([x[k] for x in c], np.int32).tobytes() for c in made] for k, name in enumerate("fn")}

        return run

    one = F.min(F.struct("f", "n")).alias("x")
    got = map_texts(rows, make, {"f": pa.binary(), "n": pa.binary()}, "f binary, n binary").groupBy("doc_id").agg(one)
    got = got.join(sample, "doc_id").orderBy("doc_id").select("label", "x.f", "x.n").toArrow().combine_chunks()
    feats, sizes = _flat(got.column("f"))
    times, _ = _flat(got.column("n"))
    toxic = got.column("label").to_numpy().astype(int)
    return fit(np.repeat(np.arange(len(toxic), dtype=np.int32), sizes), feats, times, toxic)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's 32-bit numbers, one row after the other without a copy, and how many each row has."""
    if not column.num_chunks or not len(column):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    own = column.chunk(0)
    _, offsets, data = own.buffers()
    kind = np.int64 if pa.types.is_large_binary(own.type) else np.int32
    ends = np.frombuffer(offsets, kind)[own.offset : own.offset + len(own) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(np.int32), np.diff(ends) // 4


def weighed(model: Model):
    """A function from a word to those of its features that have a weight, with a bounded memory."""
    known: dict[str, tuple] = {}

    def of(word: str) -> tuple:
        got = known.get(word)
        if got is None:
            if len(known) > REMEMBER:
                known.clear()
            got = known[word] = tuple(f for f in word_features(word) if f in model.weights)
        return got

    return of


def grade(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic): one row per row of docs, from the whole text.

    severity is the expected grade, the sum of P(grade >= g); grade the most probable; toxic is whether
    P(grade >= 1) reaches `reject`; of grades that tie the lowest counts. Null and empty texts have no features and
    get the base chances; of a long text every word counts. Repeated rows stay repeated, other columns are ignored,
    an empty table gives an empty result. The model has at most KEPT weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = weighed(shared.value)

        def run(texts: list[str]) -> dict:
            p = np.array([shared.value.chances(counts(t, of)) for t in texts]).reshape(len(texts), GRADES)
            each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
            return {"severity": p.sum(axis=1), "grade": each.argmax(axis=1).astype(np.int32), "p_toxic": p[:, 0], "toxic": p[:, 0] >= reject}

        return run

    types = {"severity": pa.float64(), "grade": pa.int32(), "p_toxic": pa.float64(), "toxic": pa.bool_()}
    return map_texts(docs, make, types, "severity double, grade int, p_toxic double, toxic boolean")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return grade(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs without the rows that grade() calls toxic; columns, of whatever name, unchanged.

    The decision is made on the way through, so no text is shuffled. Null and empty texts have no features and stay,
    rows that repeat share their fate, long texts are taken apart one at a time, a chance of exactly `reject` goes,
    an empty table stays empty. Without toxic labels nothing goes.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    known: list = []  # a worker's memory of words, made when first asked

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not known:
            begin()
            known.append(weighed(model.value))
        out: list[bool] = []
        for batch in pieces(pa.RecordBatch.from_arrays([texts], names=["text"])):
            out += [bool(model.value.chances(counts(t, known[0]))[0] < reject) for t in batch.column(0).to_pylist()]
        return pa.array(out, pa.bool_())

    return bounded(docs).filter(clean(text_of(docs)))
