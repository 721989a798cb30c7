"""Quality scores by positive-unlabelled learning.

A small network on text measurements minimises the non-negative unbiased risk: of trusted positives
(labelled rows with quality 1), of unlabelled web text, and of a class prior. The prior is estimated
from the same two samples: where a classifier of positives against unlabelled text is surest, nearly
all unlabelled rows are positive, so the least ratio of the two samples' shares above a threshold
bounds the prior. Labelled negatives take no part.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, plain, texts, tune

#: Rows of each kind, positive and unlabelled, that the model is fitted on at most.
SAMPLE_ROWS = 6_000
#: The score at the decision boundary, and how steeply scores leave it.
BOUNDARY, STEEPNESS = 0.7, 3.0
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 512, 0.01
#: What a text is measured by.
FEATURES = (
    "upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "symbol", "bar", "other_mark", "high",
    "log_words", "word_bytes", "repeat_next", "distinct", "repeat_line", "packed",
)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 10, np.int64)
    for k, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"#*$%&<>", b"|")):
        for c in chars:
            kind[c] = k
    kind[128:] = 11
    return kind


_KIND = _byte_classes()


def measure(text: str | None) -> np.ndarray:
    """The FEATURES of a whole text; all zero for null, empty and wordless texts."""
    out = np.zeros(len(FEATURES), np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:12] = np.sqrt(np.bincount(_KIND, weights=counts, minlength=12) / len(data))
    n = len(words)
    out[12] = np.log1p(n) / 10
    out[13] = min(sum(map(len, words)) / n, 40) / 10
    out[14] = np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n)
    out[15] = len(set(words)) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[16] = np.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0
    out[17] = min(1.5, len(zlib.compress(data, 1)) / len(data)) if len(data) > 64 else 0.5
    return out


class Model:
    """One hidden layer; w holds mean, scale, weights and biases."""

    def __init__(self, w: tuple):
        self.w = w

    def margin(self, x: np.ndarray) -> np.ndarray:
        mean, scale, a, b, c, d = self.w
        return np.tanh(np.clip((x - mean) / scale, -6, 6) @ a + b) @ c + d

    def score(self, found: list[str | None]) -> np.ndarray:
        x = np.array([measure(t) for t in found], np.float64).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(STEEPNESS * self.margin(x) + np.log(BOUNDARY / (1 - BOUNDARY)), -30, 30)))


def _halves(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    at = rng.permutation(len(x))
    return x[at[::2]], x[at[1::2]]


def _direction(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression of p against u, both given the same weight; a few Newton steps."""
    x = np.concatenate([p, u])
    x = np.column_stack([x, np.ones(len(x))])
    y = np.repeat([1.0, 0.0], [len(p), len(u)])
    weight = np.repeat([0.5 / len(p), 0.5 / len(u)], [len(p), len(u)])
    w = np.zeros(x.shape[1])
    for _ in range(12):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (s - y)) + 1e-3 * w
        w = w - np.linalg.solve((x * (weight * s * (1 - s) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(w)), slope)
    return w


def least_ratio(p: np.ndarray, u: np.ndarray) -> float:
    """The share of u over that of p above the threshold where the ratio, with room for chance in both, is least."""
    room = np.sqrt(np.log(20) / 2 / len(u)) + np.sqrt(np.log(20) / 2 / len(p))
    at = np.unique(p)
    above = lambda x: 1 - np.searchsorted(np.sort(x), at, side="left") / len(x)
    in_p, in_u = above(p), above(u)
    best = int(((in_u + room) / in_p).argmin())
    return float(in_u[best] / in_p[best])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives in the unlabelled sample, between 0.02 and 0.98; each half of the samples is scored by the other's classifier."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    (p1, p2), (u1, u2) = (_halves(np.clip((x - mean) / scale, -6, 6), rng) for x in (positive, unlabelled))
    found = []
    for (p, u), (q, v) in (((p1, u1), (p2, u2)), ((p2, u2), (p1, u1))):
        if len(p) and len(u) and len(q) and len(v):
            w = _direction(p, u)
            found.append(least_ratio(q @ w[:-1] + w[-1], v @ w[:-1] + w[-1]))
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> tuple | None:
    """Minimises the non-negative risk prior E_p l(g) + max(0, E_u l(-g) - prior E_p l(-g)) with the sigmoid loss l.

    A mini-batch whose second part is negative steps the other way on it, so that the network
    can't win by fitting the sample. None if either sample is empty.
    """
    if not len(positive) or not len(unlabelled):
        return None
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m1, m2, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0

    def gradients(x: np.ndarray, outer: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(x @ w[0] + w[1])
        back = outer[:, None] * w[2] * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ outer, outer.sum()]

    for _ in range(EPOCHS):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        rounds = max(1, max(len(p), len(u)) // BATCH)
        for k in range(rounds):
            xp, xu = p[np.take(pi, range(k * BATCH, (k + 1) * BATCH), mode="wrap")], u[np.take(ui, range(k * BATCH, (k + 1) * BATCH), mode="wrap")]
            sp, su = (1 / (1 + np.exp(-np.clip(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3], -30, 30))) for x in (xp, xu))
            # l(g) = 1 - s, l(-g) = s; ds/dg = s (1 - s)
            dp, du = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
            if su.mean() - prior * sp.mean() >= 0:
                grads = [a + b for a, b in zip(gradients(xp, -2 * prior * dp), gradients(xu, du))]
            else:
                grads = [a + b for a, b in zip(gradients(xp, prior * dp), gradients(xu, -du))]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * w[i]
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return mean, scale, *w


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [measure(t).tolist() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float32()))], names=["kind", "doc_id", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple | None:
    """Fits the model on at most `rows` positives and `rows` documents of the training fold, whatever their labels.

    The second sample is the unlabelled one: labels are ignored, so it is there however many documents
    are labelled, and a document may be in both. Only rows whose crc32 of doc_id modulo 4 is not 2 are
    used; of rows that repeat a doc_id one counts. The samples are the smallest hashes of doc_id; ids
    alone are sampled, and the at most 2 * rows found are broadcast against docs.
    """
    tune(docs.sparkSession)
    place = F.xxhash64(F.col("doc_id"), F.lit("quality sample"))
    marked = labels.where("doc_id is not null and quality = 1").where(bucket("doc_id", 4) != 2).select("doc_id").distinct()
    positive = marked.select("doc_id", F.lit(1).alias("kind"), place.alias("h")).orderBy("h", "doc_id").limit(rows)
    ids = plain(docs).select("doc_id").where("doc_id is not null").where(bucket("doc_id", 4) != 2).distinct()
    free = ids.select("doc_id", F.lit(0).alias("kind"), place.alias("h")).orderBy("h", "doc_id").limit(rows)
    picked = positive.unionByName(free).select("doc_id", "kind").collect()
    chosen = docs.sparkSession.createDataFrame(pd.DataFrame({"p_id": [r.doc_id for r in picked], "kind": [r.kind for r in picked]}), "p_id long, kind int")
    found = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("p_id")).select("kind", "doc_id", "text").mapInArrow(_measured, "kind int, doc_id long, x array<float>")
    one = found.groupBy("kind", "doc_id").agg(F.min("x").alias("x"))  # of rows that repeat a doc_id, one
    found = one.collect()
    x = np.array([r.x for r in found], np.float32).reshape(-1, len(FEATURES))
    kind = np.array([r.kind for r in found])
    order = np.lexsort([*x.T, kind])  # the fit doesn't depend on the order of arrival
    x, kind = x[order], kind[order]
    good, free = x[kind == 1], x[kind == 0]
    return fit(good, free, estimated_prior(good, free)) if len(good) and len(free) else None


def scorer(w: tuple | None):
    """A column function text -> score. Without a fitted model every score is 0.5."""
    packed = None if w is None else tuple(np.asarray(x) for x in w)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None if packed is None else Model(packed)
        for text in batches:
            yield pd.Series(np.full(len(text), 0.5) if model is None else model.score(text.tolist()), dtype="float64")

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= BOUNDARY) of each row's whole text.

    Null, empty and wordless texts get the score of a text without measurements. Repeated rows give
    equal rows. A row without a doc_id has no fold: held_out is null. Without labelled positives to
    learn from every score is 0.5.
    """
    score = scorer(learn(docs, labels))
    return texts(docs).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), score("text").alias("score")).withColumn("predicted", F.when(F.col("score") >= BOUNDARY, 1).otherwise(0).cast("int"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score reaches BOUNDARY. All columns stay. Without a model every row stays."""
    w = learn(docs, labels)
    return docs if w is None else plain(docs).where(scorer(w)(F.col("text").cast("string")) >= BOUNDARY).toDF(*docs.columns)
