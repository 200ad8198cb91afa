"""Language of texts: multinomial logistic regression on TF-IDF of character n-grams.

Character 1- to 3-grams of the whole lower-cased text are hashed into ``SIZE`` features.
Document frequencies come from all training rows. The weights are learned by
follow-the-regularised-leader with an elastic-net penalty, which leaves most of them at
zero, on a bounded, seeded sample of labelled rows (``sample`` rows, about); a fifth of it
is kept out to set the temperature that makes the probabilities honest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.frames import added, append, quoted, without
from stockyard.llm.words import seeded, slices

SIZE = 1 << 14
SAMPLE = 4000
# Fewest rows of a label in the sample, where it has as many.
LEAST_OF_LABEL = 100
EPOCHS = 3
UNKNOWN = "und"

_ALPHA, _BETA, _L1, _L2 = 2.0, 1.0, 0.02, 0.0005
_LETTER = re.compile(r"[^\W\d_]")
_U64 = np.uint64
# Code points that are no letters of ASCII count as blanks.
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_SEEDS = seeded(21, 4)


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points).astype(_U64)
    grams = []
    for n in (1, 2, 3):
        if len(points) < n:
            break
        value = points[: len(points) - n + 1].copy()
        for k in range(1, n):
            value = (value << _U64(21)) | points[k : len(points) - n + 1 + k]
        grams.append(((value ^ _SEEDS[n]) * (_SEEDS[0] | _U64(1))) >> _U64(64 - SIZE.bit_length() + 1))
    if not grams:
        return np.zeros(SIZE, np.int64)
    return np.bincount(np.concatenate(grams).astype(np.int64), minlength=SIZE)


@dataclass
class Model:
    """Weights of the languages in ``names``, ready to score whole texts."""

    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> np.ndarray:
        values = np.log1p(counts) * self.idf
        return values / np.maximum(np.sqrt((values * values).sum(-1, keepdims=True)), 1e-12)

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its probability."""
        letters = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        for start in range(0, len(letters) if self.names else 0, 64):
            some = letters[start : start + 64]
            counts = np.stack([gram_counts(texts[i]) for i in some]).astype(np.float32)
            odds = softmax((self.features(counts) @ self.weights + self.bias) / self.temperature)
            for i, p in zip(some, odds):
                best = int(np.argmax(p))
                out[i] = (self.names[best], float(p[best]))
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(-1, keepdims=True))
    return grown / grown.sum(-1, keepdims=True)


def learn(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int = SIZE) -> np.ndarray:
    """FTRL-proximal over sparse rows (indices, values, class); the last weight is the bias."""
    pull, seen = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(z, n):
        rate = (_BETA + np.sqrt(n)) / _ALPHA + _L2
        return np.where(np.abs(z) <= _L1, 0.0, -(z - np.sign(z) * _L1) / rate)

    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            index, value, label = rows[i]
            index, value = np.append(index, size), np.append(value, 1.0)
            z, n = pull[index], seen[index]
            w = weights(z, n)
            error = softmax(value @ w)
            error[label] -= 1.0
            slope = value[:, None] * error
            grown = n + slope * slope
            pull[index] = z + slope - (np.sqrt(grown) - np.sqrt(n)) / _ALPHA * w
            seen[index] = grown
    return weights(pull, seen)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest."""

    def loss(log_t: float) -> float:
        odds = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(odds[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high = np.log(0.02), np.log(20.0)
    ratio = (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += gram_counts(text or "") > 0
                rows += 1
        gram = np.flatnonzero(seen)
        yield pa.record_batch(
            {
                "gram": pa.array([*gram, -1], pa.int32()),
                "n": pa.array([*seen[gram], rows], pa.int64()),
            }
        )

    found = texts.mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # One row per feature at most.
    counts = dict(found.collect())
    rows = counts.pop(-1, 0)
    out = np.zeros(SIZE)
    out[list(counts)] = list(counts.values())
    return out, rows


def _drawn(rows: DataFrame, sample: int, seed: int) -> DataFrame:
    """Rows of each label with small seeded draws, about twice as many as its ``quota``.

    A label gets its share of the sample, ``LEAST_OF_LABEL`` at least. Draws hang on key and
    text, so copies of a text are drawn one by one. Of more than ``2 * sample`` labels the
    most frequent take part.
    """
    span = 1 << 30
    draws = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "key", "text"), F.lit(span)))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    quota = F.greatest(F.ceil(F.col("n") * sample / whole), F.lit(LEAST_OF_LABEL))
    wanted = counts.select(
        "label", quota.alias("quota"), F.least(F.lit(span), F.ceil(2 * quota / F.col("n") * span)).alias("limit")
    )
    # A row per label, of which the most frequent are learned: no text is shuffled by its label.
    wanted = F.broadcast(wanted.orderBy(F.desc("quota"), "label").limit(2 * sample))
    return draws.join(wanted, "label").where("draw < limit").select("text", "label", "draw", "quota")


def train(
    df: DataFrame,
    training: Column,
    text: str = "text",
    label: str = "lang",
    sample: int = SAMPLE,
    seed: int = 3,
    key: str = "doc_id",
) -> Model:
    """A model from the rows of ``df`` for which ``training`` holds and the label is not null.

    Frequencies come from all of them, the weights from a sample of at most ``2 * sample``
    rows. Without a column ``key`` rows are drawn by their text alone.
    """
    rows = df.where(training & F.col(quoted(label)).isNotNull()).select(
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
        F.col(quoted(label)).cast("string").alias("label"),
        (F.col(quoted(key)).cast("string") if key in df.columns else F.lit("")).alias("key"),
    )
    seen, total = _document_frequencies(rows.select("text"))
    if not total:
        return Model([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0))
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    shape = Model([], idf, np.zeros((SIZE, 0)), np.zeros(0))

    def sparse(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                index, value = [], []
                for one in piece.column("text").to_pylist():
                    counts = gram_counts(one)
                    at = np.flatnonzero(counts)
                    index.append(at.astype("<u2").tobytes())
                    value.append(shape.features(counts)[at].astype("<f4").tobytes())
                yield pa.record_batch(
                    {
                        "label": piece.column("label").cast(pa.string()),
                        "draw": piece.column("draw"),
                        "quota": piece.column("quota"),
                        "index": pa.array(index, pa.binary()),
                        "value": pa.array(value, pa.binary()),
                    }
                )

    schema = "label string, draw bigint, quota bigint, index binary, value binary"
    near = _drawn(rows, sample, seed).mapInArrow(sparse, schema)
    # The smallest draws of each label, and never more than twice the sample in all.
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "index"))
    found = near.withColumn("rank", rank).where("rank <= quota").orderBy("draw", "label", "index").limit(2 * sample)
    picked = found.collect()
    names = sorted({r["label"] for r in picked})
    data = [
        (
            np.frombuffer(r["index"], "<u2").astype(np.int64),
            np.frombuffer(r["value"], "<f4").astype(float),
            names.index(r["label"]),
        )
        for r in picked
    ]
    # Draws are seeded hashes, so every fifth row in their order is any row.
    held = data[::5] if len(data) >= 50 else []
    fitted = [d for i, d in enumerate(data) if not held or i % 5]
    learned = learn(fitted, len(names))
    model = Model(names, idf, learned[:-1].astype(np.float32), learned[-1])
    if held:
        scores = np.stack([v @ learned[i] + learned[-1] for i, v, _ in held])
        model.temperature = temperature(scores, np.array([c for _, _, c in held]))
    return model


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, replacing such columns.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the
    model has learned from no row. Equal texts get equal answers.
    """
    df = without(df, "lang_pred", "score")

    def predict(batches):
        for batch in batches:
            for piece in slices(batch, text):
                found = model.predict(piece.column(text).to_pylist())
                names, scores = zip(*found) if found else ((), ())
                yield append(
                    piece, lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64())
                )

    return df.mapInArrow(predict, added(df, "lang_pred string, score double"))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).cast("binary")) % divisor
