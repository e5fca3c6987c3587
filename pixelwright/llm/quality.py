"""Quality classifier by positive-unlabelled learning.

A small network is fitted by minimising the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

on trusted positives (texts labelled 1) and unlabelled web text (any text of the training
rows). The class prior is estimated from the same two samples: a network that tells positives
from unlabelled texts is fitted to one half of them, and over the thresholds on its score the
least ratio of unlabelled to positive texts above, on the other half, bounds the share of
positives among the unlabelled; the threshold is the one with the best upper confidence bound.
No text is used as a negative example, and no label but 1 is read. The fit takes at most
FIT_POSITIVE and FIT_UNLABELLED rows (those with the smallest hashes of their ids); scoring
reads every whole text.

Features are shares of byte-class transitions and word statistics of the whole text: they have
no upper length and need one pass.

Cases: null = empty text, which has zero features and is scored like any other; without
trusted positives or unlabelled texts there is no model and every score is 0.5; equal texts
have equal scores; a document with several labels is a positive if one of them is 1; of rows with
one id the least text is learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_sample, lean, pick, table, text_parts, utf8

FIT_POSITIVE = 8000
FIT_UNLABELLED = 16000
THRESHOLD = 0.7
HIDDEN = 16
STEPS = 600
#: The estimated prior stays within these bounds.
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.98
#: Steps of the network behind the prior, and the chance that its confidence bound is wrong.
PRIOR_STEPS, PRIOR_DOUBT = 200, 0.1
CHUNK = 1 << 20

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other ASCII, 7 beyond ASCII, lead byte, 8 continuation.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8
CLASSES = 9
SIZE = CLASSES * CLASSES + 6


def words_of(data: bytes) -> tuple[int, int, int]:
    """Words, words equal to the one before, and distinct words (by hash where the text has several parts)."""
    n = repeated = 0
    last, seen = None, []
    for part in text_parts(data):
        words = part.lower().split()
        if not words:
            continue
        n += len(words)
        repeated += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
        last = words[-1]
        seen.append(set(words))
    if len(seen) <= 1:
        return n, repeated, len(seen[0]) if seen else 0
    hashes = [np.fromiter(map(hash, s), np.int64, len(s)) for s in seen]
    return n, repeated, len(np.unique(np.concatenate(hashes)))


def features(data: bytes) -> np.ndarray:
    """SIZE numbers about a whole text."""
    out = np.zeros(SIZE, np.float32)
    if not data:
        return out
    moves = np.zeros(CLASSES * CLASSES, np.int64)
    for start in range(0, len(data), CHUNK):
        c = _CLASS[np.frombuffer(data[max(0, start - 1) : start + CHUNK], np.uint8)].astype(np.intp)
        moves += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(moves / max(1, moves.sum()))
    n, repeated, distinct = words_of(data)
    if n:
        lines = data.split(b"\n")
        out[CLASSES * CLASSES :] = (
            np.sqrt(repeated / n),
            np.log1p(n) / 10,
            np.log(distinct) / np.log(n) if n > 1 else 1.0,
            min(len(data) / n, 40) / 20,
            1 - len(set(lines)) / len(lines),
            np.log1p(n / len(lines)) / 8,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, vectors: np.ndarray) -> np.ndarray:
        hidden = np.tanh((vectors - self.mean) * self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))


def _forward(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ params[0] + params[1])
    return hidden, np.clip(hidden @ params[2] + params[3], -30, 30)


def risk(params: list[np.ndarray], x: np.ndarray, n: int, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the unbiased risk; the first n rows are positives, the others unlabelled."""
    _, g = _forward(params, x)
    negative = np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean()
    return float(prior * np.logaddexp(0, -g[:n]).mean()), float(negative)


def risk_slope(params: list[np.ndarray], x: np.ndarray, n: int, prior: float) -> list[np.ndarray]:
    """The gradient that a step goes down: the risk's, or, while its negative part is below zero, that part's, turned round."""
    hidden, g = _forward(params, x)
    s = 1 / (1 + np.exp(-g))  # derivative of loss(-g) = softplus(g); that of loss(g) is s - 1
    d = np.empty(len(g))
    if np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean() >= 0:
        d[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
        d[n:] = s[n:] / (len(g) - n)
    else:  # overfitted: climb back out of the negative part
        d[:n] = prior * s[:n] / n
        d[n:] = -s[n:] / (len(g) - n)
    return _backward(params, x, hidden, d)


def _backward(params: list[np.ndarray], x: np.ndarray, hidden: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    back = np.outer(d, params[2]) * (1 - hidden**2)
    return [x.T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()])]


def _descend(slope: Callable[[list[np.ndarray]], list[np.ndarray]], steps: int) -> list[np.ndarray]:
    """Adam from a fixed start, with a small ridge on the weights."""
    rng = np.random.default_rng(11)
    params = [rng.normal(0, 0.2, (SIZE, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        for p, gr, m, v, ridge in zip(params, slope(params), first, second, (1e-4, 0, 1e-4, 0)):
            gr = gr + ridge * p
            m += 0.1 * (gr - m)
            v += 0.001 * (gr * gr - v)
            p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), 1 / (both.std(axis=0) + 0.02)
    return (both - mean) * scale, mean, scale


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = PRIOR_STEPS) -> float:
    """The share of positives among the unlabelled vectors."""
    x, mean, scale = _scaled(positive[::2], unlabelled[::2])
    n = len(positive[::2])
    weight = np.concatenate([np.full(n, 0.5 / n), np.full(len(x) - n, 0.5 / (len(x) - n))])
    is_positive = np.arange(len(x)) < n

    def slope(params: list[np.ndarray]) -> list[np.ndarray]:
        hidden, g = _forward(params, x)
        return _backward(params, x, hidden, weight * (1 / (1 + np.exp(-g)) - is_positive))

    params = _descend(slope, steps)
    held = [part[1::2] if len(part) > 1 else part for part in (positive, unlabelled)]
    p, u = (np.sort(_forward(params, (part - mean) * scale)[1]) for part in held)
    share_p = 1 - np.arange(len(p)) / len(p)  # of positives at or above each positive's score
    share_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    doubt = sum(np.sqrt(np.log(4 / PRIOR_DOUBT) / (2 * len(part))) for part in (p, u))
    best = int(((share_u + 1.01 * doubt) / share_p).argmin())
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, share_u[best] / share_p[best])))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Non-negative risk minimisation with the logistic loss, full batch."""
    x, mean, scale = _scaled(positive, unlabelled)
    params = _descend(lambda p: risk_slope(p, x, len(positive), prior), steps)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Model | None:
    """Fit on bounded samples of ``labels`` joined to ``docs``; both hold training rows only."""
    trusted = labels.where(F.col(label) == 1).select(F.col(key).alias("_key")).where("_key is not null")
    every = docs.select(F.col(key).alias("_key"), utf8(text).alias("_bytes")).where("_key is not null")
    keys = every.select("_key")
    positive = {r[0] for r in hash_sample(trusted, "_key", FIT_POSITIVE, trusted.count()).collect()}
    unlabelled = {r[0] for r in hash_sample(keys, "_key", FIT_UNLABELLED, keys.count()).collect()}
    if not positive or not unlabelled:
        return None
    chosen = docs.sparkSession.createDataFrame([(k, k in positive, k in unlabelled) for k in sorted(positive | unlabelled, key=str)], "_key " + dict(every.dtypes)["_key"] + ", p boolean, u boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [features(x.as_py()).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.binary())], names=["p", "u", "v"])

    rows = every.join(F.broadcast(chosen), "_key").groupBy("_key", "p", "u").agg(F.min("_bytes").alias("_bytes"))
    got = sorted((bytes(v), p, u) for p, u, v in rows.select("p", "u", "_bytes").mapInArrow(run, "p boolean, u boolean, v binary").collect())
    np.random.default_rng(5).shuffle(got)  # halves are taken by place
    vectors = {kind: np.array([np.frombuffer(r[0], np.float32) for r in got if r[kind]]) for kind in (1, 2)}
    if not len(vectors[1]) or not len(vectors[2]):
        return None
    return fit(vectors[1], vectors[2], estimate_prior(vectors[1], vectors[2]))


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    texts = [v.as_py() for v in column]
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    # one row at a time through the network, so that equal texts have bit-equal scores in any batch
    return np.array([float(model.score(features(t or b"")[None, :])[0]) for t in texts])


def score(df: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """Per row: key, score."""
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)), pa.float64())], names=[key, "score"])

    return df.select(key, utf8(text).alias("_bytes")).mapInArrow(run, f"{key} {kind}, score double")


def held_out(key: str = "doc_id"):
    return crc_mod(key, 4) == 2


def _corpus_model(spark, sf_dir: str) -> Model | None:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    return train(docs.where(~held_out()), labels.where(~held_out()), "doc_id", "text", "quality")


def op3(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = score(docs, "doc_id", "text", _corpus_model(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop documents scored below THRESHOLD; the model is op3's."""
    lean(spark)
    return filtered(docs, _corpus_model(spark, sf_dir))


def filtered(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns kept; without a model, all rows."""
    if model is None:
        return docs
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, batch.column(at).cast(pa.binary()))
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, fields)
