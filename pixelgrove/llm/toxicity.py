"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled rows (see ``training``, whole
texts) in one task, in an order that follows from a hash of the ids, and keeps
per-coordinate learning rates; the L1 term leaves few weights other than zero.
These are all that is broadcast: at most 2^``bits`` pairs, in practice some
thousands. Scoring is one pass over all rows without a shuffle.

Cases: null or empty text gets the score of the bias alone; a null doc_id is
carried as null; repeated rows are scored each; an empty table gives no rows;
labels that are null or belong to no row are ignored, and of several labels of
one id the largest counts; without labels of both kinds every score is that of the
plain rate, or 0 without any label. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelgrove.llm.words import WordHashes

SAMPLE_ROWS, BITS, EPOCHS = 20_000, 22, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
#: Lower case for A-Z, a space for the other ASCII characters that are neither letters nor digits.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))
#: Odd multipliers that tell unigrams, bigrams, skip-grams with one and two words between, and stems apart.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")
#: Bytes of a word that stand for its stem in a further unigram.
STEM = 4


def features(text: str | None, known: WordHashes, bits: int = BITS) -> np.ndarray:
    """Feature numbers of a text, with repeats."""
    words = (text or "").encode().translate(FOLD).split()
    h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    stems = np.fromiter(map(known.__getitem__, [w[:STEM] for w in words]), "u8", len(words))
    parts = [h * MIX[0], stems * MIX[4]] + [(h[:-gap] * MIX[0] + h[gap:]) * MIX[gap] for gap in (1, 2, 3) if len(h) > gap]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype("i8")


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """(numbers, weights, bias) of the weights other than zero, from (distinct feature numbers, label)."""
    rate = float(np.clip(np.mean([y for _, y in rows]), 1e-6, 1 - 1e-6)) if rows else 1e-6
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, squares = np.log(rate / (1 - rate)), 1.0
    for _ in range(epochs if len({y for _, y in rows}) > 1 else 0):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            more = nx + g * g
            z[x] = zx + g - (np.sqrt(more) - root) / alpha * w
            n[x] = more
            squares += g * g
            bias -= 0.3 * g / np.sqrt(squares)
    kept = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[kept]) * l1 - z[kept]) / ((beta + np.sqrt(n[kept])) / alpha + l2)
    return kept, w.astype("f4"), float(bias)


def train(sample: DataFrame, bits: int = BITS, **settings: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on (doc_id, text, label) in one task; only the weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = WordHashes(), []
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                rows.append((np.unique(features(text.as_py(), known, bits)).astype("i4"), int(label)))
        kept, w, bias = fit(rows, bits, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype("<i8").tobytes()]), pa.array([w.astype("<f4").tobytes()]), pa.array([bias])], ["numbers", "weights", "bias"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(29)), "doc_id", "text")
    found = one.mapInArrow(run, "numbers binary, weights binary, bias double").collect()
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "f4"), -35.0
    return np.frombuffer(found[0].numbers, "<i8"), np.frombuffer(found[0].weights, "<f4"), found[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weights, bias = held.value
        dense, known = np.zeros(1 << bits, "f4"), WordHashes()
        dense[numbers] = weights
        for batch in batches:
            sums = []
            for text in batch.column("text"):
                x = features(text.as_py(), known, bits)
                x = np.unique(x[dense[x] != 0])
                sums.append(bias + float(dense[x].sum(dtype="f8")))
            out = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
