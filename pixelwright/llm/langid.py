"""Language identification with error-correcting output codes.

Each language has a codeword; one binary linear classifier per bit, on hashed byte n-grams of
lower-cased text, predicts whether the text's language has that bit. Decoding is loss-weighted:
a language's loss is the sum over bits of log(1 + exp(-bit * margin)), and the codeword of least
loss is chosen. ``score`` is its share exp(-loss) among all codewords; a text whose runner-up's
share is at least AMBIGUOUS of the winner's is flagged ``ambiguous``, however many languages there are.

The classifiers are fitted by gradient descent on at most FIT_ROWS labelled texts (those with
the smallest hashes of their ids, at most FIT_ROWS / languages of each of at most FIT_LANGUAGES
languages, the most frequent). Only the hashed n-gram counts of these rows reach the driver, and
one scan finds them for all languages. Prediction reads every whole text.

Cases: null text or a text without a letter is ``und`` with score 0 and is flagged; with no
labelled row every text is ``und``; one learned language is predicted for every text with
letters and never flagged; ties between codewords go to the language first in alphabetical order
and are flagged; of labelled rows with one id and language the least text is learned from; equal
texts get equal results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, lean, pick, table, utf8

UNKNOWN = "und"
#: Hash buckets of n-grams; n-gram lengths in bytes.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
LENGTHS = (1, 2, 3, 4)
#: At most so many labelled rows, and languages, are used to fit the classifiers.
FIT_ROWS = 2400
FIT_LANGUAGES = 1000
STEPS = 300
#: A text is ambiguous if the runner-up has so much of the best language's share.
AMBIGUOUS = 0.8
#: Bytes of a text handled at once, so that memory stays bounded for very long texts.
CHUNK = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of lower-cased bytes, chunk by chunk."""
    data = data.lower()
    for start in range(0, len(data), CHUNK):
        before = min(start, max(LENGTHS) - 1)
        b = np.frombuffer(data[start - before : start + CHUNK], np.uint8).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * _PRIMES[0] + b[n - 1 :] * _PRIMES[1] + np.uint32(n)
            if n in LENGTHS:
                x = h[max(0, before - n + 1) :]
                yield (x ^ (x >> np.uint32(15))) * _PRIMES[2] >> np.uint32(32 - BUCKET_BITS)


def counts(data: bytes) -> np.ndarray:
    """Share of each bucket among a text's n-grams, square-rooted, of length 1."""
    total = np.zeros(BUCKETS, np.float64)
    for x in grams(data):
        total += np.bincount(x, minlength=BUCKETS)
    n = total.sum()
    return np.sqrt(total / n).astype(np.float32) if n else total.astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """One row of -1/+1 bits per language.

    Up to five languages: all distinct splits of the languages into two sets (an exhaustive
    code). More: log-many random splits from a fixed seed, plus one against the rest each.
    """
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    random = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (n, 4 * int(np.ceil(np.log2(n)))))
    random = random[:, np.abs(random.sum(axis=0)) < n]
    return np.concatenate([random, 2 * np.eye(n, dtype=np.int8) - 1], axis=1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x buckets
    bias: np.ndarray

    def margins(self, data: bytes) -> np.ndarray:
        return self.weights @ counts(data) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """The language, its share, and whether the runner-up comes close."""
        loss = np.logaddexp(0, -self.code * margins).sum(axis=1)
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        runner_up = np.delete(share, best).max(initial=0.0)
        return self.languages[best], float(share[best] / share.sum()), bool(runner_up >= AMBIGUOUS)


def fit(vectors: np.ndarray, labels: list[str]) -> Model:
    """One logistic classifier per bit, all by the same full-batch descent."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]].astype(np.float32)
    weights, bias = np.zeros((code.shape[1], BUCKETS), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) > 1:
        speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(STEPS):
            g = -y / (1 + np.exp(np.clip(y * (vectors @ weights.T + bias), -30, 30)))
            speed_w = 0.9 * speed_w - 2.0 * (g.T @ vectors / len(y) + 1e-5 * weights)
            speed_b = 0.9 * speed_b - 2.0 * g.mean(axis=0)
            weights, bias = weights + speed_w, bias + speed_b
    return Model(languages, code, weights, bias)


def _pack(v: np.ndarray) -> bytes:
    """The non-zero entries of a vector: their places, then their values in half precision."""
    at = np.flatnonzero(v)
    return at.astype(np.uint16).tobytes() + v[at].astype(np.float16).tobytes()


def _unpack(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), BUCKETS), np.float32)
    for row, data in zip(out, packed):
        at, values = np.frombuffer(data, np.uint16).reshape(2, -1)
        row[at] = values.view(np.float16)
    return out


def train(labelled: DataFrame, key: str, text: str, language: str, rows: int = FIT_ROWS) -> Model | None:
    """Fit on a bounded sample of ``labelled``; rows without text or language don't count."""
    known = labelled.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(language).alias("_lang")).where("_text is not null and _lang is not null")
    present = known.groupBy("_lang").agg(F.approx_count_distinct("_key"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_lang").limit(min(rows, FIT_LANGUAGES)).collect()
    if not present:
        return None
    each = rows // len(present)
    spark = labelled.sparkSession
    # a threshold on the hash leaves about twice the wanted ids of each language, and some more, before anything is ranked
    bounds = spark.createDataFrame([(r[0], min(2**63 - 1, int((2.0 * each + 20) / max(1, r[1]) * 2**64) - 2**63)) for r in present], "_lang string, _most long")
    near = known.select("_lang", "_key", F.xxhash64("_key").alias("_h")).join(F.broadcast(bounds), "_lang").where("_h <= _most").select("_lang", "_h", "_key").distinct()
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_key")))
    ids = ranked.where(F.col("_rank") <= each).select("_lang", "_key").collect()
    chosen = spark.createDataFrame([tuple(r) for r in ids], known.select("_lang", "_key").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [_pack(counts(v.as_py())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["lang", "v"])

    kept = known.join(F.broadcast(chosen), ["_lang", "_key"]).groupBy("_lang", "_key").agg(F.min(utf8("_text")).alias("_bytes"))
    got = kept.select("_lang", "_bytes").mapInArrow(run, "lang string, v binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    return fit(_unpack([bytes(r[1]) for r in got]), [r[0] for r in got])


SCHEMA = "lang_pred string, score double, ambiguous boolean"


def predict(df: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """Per row: key, lang_pred, score, ambiguous."""
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for value in batch.column(1):
                data = value.as_py()
                found = UNKNOWN, 0.0, True
                if model is not None and _LETTER.search(data.decode("utf-8", "replace")):
                    found = model.decode(model.margins(data))
                for column, item in zip(out, found):
                    column.append(item)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())],
                names=[key, "lang_pred", "score", "ambiguous"],
            )

    return df.select(key, utf8(text).alias("_bytes")).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def held_out(key: str = "doc_id"):
    return crc_mod(key, 3) == 1


def op10(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = train(docs.where(~held_out()), "doc_id", "text", "lang")
    found = predict(docs, "doc_id", "text", model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop documents without a known language or with an ambiguous one.

    The model learns from the corpus's own documents table, by the same split as op10.
    """
    lean(spark)
    corpus = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = train(corpus.where(~held_out()), "doc_id", "text", "lang")
    return filtered(docs, model)


def filtered(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language is known and clear, all columns kept."""
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = []
            for value in batch.column(at):
                text = value.as_py() or ""
                clear = model is not None and _LETTER.search(text) is not None
                keep.append(clear and not model.decode(model.margins(text.encode()))[2])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, fields)
