"""Quality of a text: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

Features are n-grams (1 to 2) of words and symbol runs, and n-grams (1 to 3) of their
forms: a word's form says whether it is in lower case, capitalised, in capitals or holds
a digit, and whether it repeats the word before; a symbol run is its own form. Each
kind of n-gram counts as a share of the text's n-grams of that kind, so a score is a
sparse dot product of shares and weights, whatever the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import crc32_of_id, keyed_text, lean, slices, text_bytes, text_hash
from .packing import CHUNK, mix
from .words import Words

BITS = 18
#: Labelled rows that are learnt from (a sample by hash of the id where there are more).
SAMPLE_ROWS = 6000
KINDS = 5


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, share) of every n-gram occurrence."""
    w = Words(body, offsets)
    capital = np.concatenate(([0], np.cumsum((body >= 65) & (body <= 90))))
    digit = np.concatenate(([0], np.cumsum((body >= 48) & (body <= 57))))
    n_capital, length = capital[w.stop] - capital[w.start], w.stop - w.start
    form = np.where(n_capital == 0, 1, np.where(n_capital == length, 2, np.where((n_capital == 1) & (body[w.start] >= 65) & (body[w.start] <= 90), 3, 4)))
    form = form + 5 * (digit[w.stop] > digit[w.start]) if len(w.start) else form
    again = np.zeros(len(w.start), np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    shape = np.where(w.kind == 2, w.hash, mix((form + 16 * again).astype(np.uint64)))
    texts, found, shares = [], [], []
    salt = 0
    for unit, longest in ((w.hash, 2), (shape, 3)):
        gram = np.zeros(len(unit), np.uint64)
        for n in range(1, longest + 1):
            salt += 1
            gram = mix(gram[:len(unit) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + unit[n - 1:] + np.uint64(salt)) if len(unit) >= n else unit[:0]
            inside = w.text[:len(gram)] == w.text[n - 1:] if len(gram) else np.zeros(0, bool)
            text = w.text[:len(gram)][inside]
            count = np.bincount(text, minlength=len(offsets) - 1)
            texts.append(text)
            found.append((gram[inside] >> np.uint64(64 - BITS)).astype(np.int64))
            shares.append(1.0 / count[text])
    return np.concatenate(texts), np.concatenate(found), np.concatenate(shares)


class Model:
    """FTRL-proximal with one learning rate for each weight."""

    def __init__(self, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        """One row; ``at`` without repetition. The last weight is the intercept."""
        at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        gradient = (p - label) * value
        step = (np.sqrt(self.n[at] + gradient ** 2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * w
        self.n[at] += gradient ** 2


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled row its features without repetition."""
    for whole in batches:
        for batch in slices([whole], "text", CHUNK):
            text, found, share = features(*text_bytes(batch.column("text")))
            pair, back = np.unique(text << BITS | found, return_inverse=True)
            total = np.bincount(back, share, len(pair)) if len(pair) else np.zeros(0)
            ends = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1)).astype(np.int32)
            at = pa.array((pair & ((1 << BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), at),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(total.astype(np.float32)))], names=["key", "label", "at", "share"])


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, passes: int = 4) -> np.ndarray:
    """Weights from labelled rows (label 0 or 1; others are left out), at most about ``sample_rows`` of them.

    The sample is a function of the ids alone. What reaches the driver are the sparse
    features of the sample. Without labelled rows all weights are 0.
    """
    known = rows.filter(F.col(label).isin(0, 1))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 24)) < int((1 << 24) * sample_rows / n))
    picked = keyed_text(known, key, text).select("key", "text").withColumn("label", F.lit(0)) if n == 0 else known.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    got = picked.mapInArrow(lean(_sparse), "key long, label int, at array<int>, share array<float>").toArrow()
    at, share, labels = (got.column(c).combine_chunks() if got.num_rows else [] for c in ("at", "share", "label"))
    model = Model()
    order = sorted(range(got.num_rows), key=lambda i: (labels[i].as_py(), got.column("key")[i].as_py() or 0, len(at[i])))
    lists = [(at[i].values.to_numpy(zero_copy_only=False), share[i].values.to_numpy(zero_copy_only=False).astype(np.float64), labels[i].as_py()) for i in order]
    for turn in range(passes):  # another order each time, the same in every run
        for i in np.random.default_rng(turn).permutation(len(lists)):
            model.learn(*lists[i])
    return model.weights().astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", twin: bool = False) -> DataFrame:
    """(key, score) of every row: the probability of label 1. A null or empty text has the intercept's score. ``twin``: also the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text", CHUNK):
                body, offsets = text_bytes(batch.column("text"))
                of, found, share = features(body, offsets)
                dot = np.bincount(of, weights[found] * share, len(offsets) - 1) + weights[-1]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *([batch.column("twin")] if twin else []), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], names=names)

    names = ["key", "twin", "score"] if twin else ["key", "score"]
    rows = keyed_text(df, key, text)
    rows = rows.withColumn("twin", text_hash("text")) if twin else rows
    return rows.mapInArrow(lean(run), f"key long, {'twin long, ' * twin}score double").withColumnRenamed("key", key)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5,
             held_out: int = 0, accept: float = 0.3, sample_rows: int = SAMPLE_ROWS, twin: bool = False) -> DataFrame:
    """(key, held_out, score, predicted) of every row; with ``twin`` also the hash of its text.

    Labels of rows whose crc32(key as text) modulo ``folds`` is ``held_out`` are never
    learnt from. Only the text is an input of the score. Repeated rows get equal scores; a
    null label counts as none; an empty table gives an empty table; further columns are
    ignored.
    """
    aside = F.pmod(crc32_of_id(key), F.lit(folds)) == held_out
    known = labels.select(F.col(key), F.col(label).alias("label")).filter(F.col("label").isNotNull() & ~aside)
    rows = df.select(F.col(key), F.col(text).alias("text")).join(known, key)
    weights = train(rows, key, "text", "label", sample_rows)
    return score(df, weights, key, text, twin).select(key, *["twin"] * twin, aside.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
