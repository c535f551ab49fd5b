"""Quality by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from mercato.llm.labelled import labelled_sample

#: Labelled texts that the model is fitted on; bounds the fit's memory on the driver.
FIT_ROWS = 4_000
#: Hashed word features, then hashed word shapes, then the share of words that repeat the word before.
WORDS, SHAPES = 1 << 16, 1 << 12
DIMENSIONS = WORDS + SHAPES + 1
STEPS, RATE, RIDGE = 150, 0.3, 1e-5


class Vocabulary(dict):
    """Word to its two hashed features; emptied when it holds a million words, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", word)))
        pair = crc32(word.lower().encode()) % WORDS * SHAPES + crc32(b"shape" + shape.encode()) % SHAPES
        self[word] = pair
        return pair


def hashed(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """A number per word that holds its word feature and its shape feature."""
    words = text.split()
    return np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))


def repeats(pairs: np.ndarray) -> float:
    """The share of words whose features are those of the word before."""
    return float((pairs[1:] == pairs[:-1]).mean()) if len(pairs) > 1 else 0.0


def vector(text: str, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one text: shares of its words, so that length plays no part."""
    pairs = hashed(text, vocabulary)
    if not len(pairs):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    index, count = np.unique(np.concatenate([pairs // SHAPES, WORDS + pairs % SHAPES]), return_counts=True)
    index = np.append(index, DIMENSIONS - 1).astype(np.int32)
    return index, np.append(count / len(pairs), repeats(pairs)).astype(np.float32)


@dataclass
class CumulativeLink:
    """P(grade >= k) = logistic(weights . x - thresholds[k - 1]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, raw: np.ndarray) -> np.ndarray:
        """A column per threshold: the probability of that grade or a higher one."""
        return 1.0 / (1.0 + np.exp(-np.clip(raw[:, None] - self.thresholds[None, :], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int) -> CumulativeLink:
    """Maximum likelihood with a ridge by Adam over all rows; thresholds are a first one plus positive gaps, so they stay ordered."""
    # The empty array first gives texts without words, and no texts at all, the right types.
    index = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r[0], np.int32) for r in rows)])
    value = np.concatenate([np.zeros(0, np.float32), *(np.asarray(r[1], np.float32) for r in rows)])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    weights = np.zeros(DIMENSIONS)
    base = np.concatenate([[0.0], np.zeros(top - 1)])
    thresholds = lambda b: b[0] + np.concatenate([[0.0], np.cumsum(np.exp(b[1:]))])
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, base)]
    n = max(len(rows), 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1 if rows else 1):
        raw = np.bincount(owner, value * weights[index], minlength=n)
        edges = thresholds(base)
        tail = np.column_stack([np.ones(n), sigmoid(raw[:, None] - edges[None, :]), np.zeros(n)])
        at = np.arange(n)
        upper, lower = tail[at, grades], tail[at, grades + 1]
        likely = np.maximum(upper - lower, 1e-9)
        slope = tail * (1 - tail)
        to_raw = -(slope[at, grades] - slope[at, grades + 1]) / likely / n
        # A threshold enters the grade above it as its lower edge and the grade below it as its upper edge.
        to_edge = np.array(
            [
                (np.where(grades == k, slope[:, k] / likely, 0.0) - np.where(grades == k - 1, slope[:, k] / likely, 0.0)).sum() / n
                for k in range(1, top + 1)
            ]
        )
        later = np.cumsum(to_edge[::-1])[::-1]
        to_base = np.concatenate([[later[0]], later[1:] * np.exp(base[1:])])
        to_weights = np.bincount(index, value * to_raw[owner], minlength=DIMENSIONS) + RIDGE * weights
        for p, g, (m, v) in zip((weights, base), (to_weights, to_base), moment, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CumulativeLink(weights, thresholds(base))


def learn(docs: DataFrame, labels: DataFrame, grade: Column, top: int, rows: int = FIT_ROWS) -> CumulativeLink:
    """Fit on at most ``rows`` rated texts; grades run from 0 to ``top``. Without ratings every grade is as likely as the start values say."""
    sample = labelled_sample(docs, labels, grade, rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [vector(t, vocabulary) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([crc32(t.encode()) for t in texts], pa.int64()),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.float32())),
                    batch.column("label"),
                ],
                names=["at", "index", "value", "label"],
            )

    fetched = sample.mapInArrow(vectors, "at long, index array<int>, value array<float>, label int").toPandas()
    fetched = fetched.sort_values(["at", "label"], kind="stable")
    grades = np.clip(fetched["label"].to_numpy(dtype=np.int64), 0, top)
    return fit(list(zip(fetched["index"], fetched["value"], strict=True)), grades, top)


def score(docs: DataFrame, model: CumulativeLink, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``expected_grade`` and ``tails`` (the probability of grade 1, 2, ... or higher).

    Cases: null and empty texts have no features and get the model's start point; nulls in other columns pass through; repeated rows are scored
    alike. No rows in, no rows out. Input columns named like a result column are replaced.
    """
    kept = docs.select(*(c for c in docs.columns if c not in ("expected_grade", "tails")))
    added = [StructField("expected_grade", DoubleType()), StructField("tails", ArrayType(DoubleType()))]
    schema = StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        by_word, by_shape, by_repeat = model.weights[:WORDS], model.weights[WORDS:-1], model.weights[-1]
        for batch in batches:
            raw = np.zeros(len(batch))
            for i, t in enumerate(batch.column(text)):
                pairs = hashed(t.as_py() or "", vocabulary)
                if len(pairs):
                    raw[i] = (by_word[pairs // SHAPES] + by_shape[pairs % SHAPES]).mean() + by_repeat * repeats(pairs)
            tails = model.tails(raw)
            # The other columns pass through untouched, whatever their types and nulls.
            yield batch.append_column("expected_grade", pa.array(tails.sum(axis=1))).append_column(
                "tails", pa.array(list(tails), pa.list_(pa.float64()))
            )

    return kept.mapInArrow(run, schema)
