"""Toxicity from a weighted lexicon that is matched by Aho-Corasick."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from mercato.llm.common import whole
from mercato.llm.labelled import labelled_sample

#: Labelled texts that the lexicon and its calibration are learned from.
FIT_ROWS = 20_000
#: Terms of the lexicon, texts that a term must occur in, and its least log-odds.
TERMS, LEAST_TEXTS, LEAST_WEIGHT = 2_000, 8, 2.0
#: Lengths of word beginnings that can be terms, for families of words with one stem.
STEMS = (4, 5, 6)

# Letters of other scripts and signs that look like Latin letters, and digits that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ս": "u", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ꜱ": "s",
    "0": "o", "2": "z", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}
# Signs that stand for one of several letters, which are told apart only by the term that they are compared with.
AMBIGUOUS = {"1": "il", "6": "bg", "9": "gq"}
#: Letters that share a sign as one class, for the automaton.
CLASS = str.maketrans("l1bq69", "iigggg")
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "killer whale", "dummy variable")

BLANK = {c: " " for c in map(chr, range(128)) if not c.isalnum()}
FOLD = BLANK | {c: " " for c in "«»„“”‘’…–—¿¡·•   "} | LOOKALIKES | {c: "" for c in "­​‌‍⁠﻿"}
FOLD = str.maketrans(FOLD | {chr(0xFF01 + i): FOLD.get(c, c) for i, c in enumerate(map(str.lower, map(chr, range(0x21, 0x7F))))})
#: "!" and "|" end a word, and before more of a word they are also read as "1".
INNER = re.compile(r"[!|！｜](?=[\w@$€])")


def folded(text: str) -> str:
    """Lower case with look-alikes and digits folded to letters or ambiguous signs, punctuation as blanks, a blank at both ends."""
    return f" {text.lower().translate(FOLD)} "


def readings(text: str) -> list[str]:
    """The folded text, and if "!" or "|" can be letters in it, the text with them as such; both have the same places."""
    inner = INNER.sub("1", text)
    return [folded(text)] if inner == text else [folded(text), folded(inner)]


def terms_of(text: str) -> set[str]:
    """Whole words and word beginnings of one text; a blank marks a word's edge."""
    found = set()
    listed = {word for line in readings(text) for word in line.split()}
    # An ambiguous sign counts as either of its letters.
    for word in {word.translate({ord(c): of[i] for c, of in AMBIGUOUS.items()}) for word in listed for i in (0, 1)}:
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


@dataclass
class Lexicon:
    """Terms with weights, exception phrases and the calibration of the score."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    calibration: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    def matcher(self):
        """An automaton over all terms and exception phrases."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        classes: dict[str, list] = {}
        for term, weight in [*self.weights.items(), *((folded(phrase), None) for phrase in self.exceptions)]:
            classes.setdefault(term.translate(CLASS), []).append((term, weight))
        for term, members in classes.items():
            automaton.add_word(term, members)
        if len(automaton):
            automaton.make_automaton()
        return automaton


def fits(part: str, term: str) -> bool:
    """Whether a part of a folded text is the term, with each ambiguous sign as one of its letters."""
    return part == term or all(a == b or b in AMBIGUOUS.get(a, "") for a, b in zip(part, term, strict=True))


def evidence(text: str, automaton) -> tuple[float, int, int]:
    """Summed weights, matched words and words of one text.

    Of the terms that match at one word the heaviest counts; a word inside an exception phrase does not count.
    """
    lines = readings(text)
    at_word: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for line in lines if len(automaton) else ():
        for start, end, weight in (
            (end - len(term) + 1, end, weight)
            for end, members in automaton.iter(line.translate(CLASS))
            for term, weight in members
            if fits(line[end - len(term) + 1 : end + 1], term)
        ):
            if weight is None:
                spared.append((start, end))
            else:
                at_word[start] = max(weight, at_word.get(start, 0.0))
    for first, last in spared:
        for start in [s for s in at_word if first <= s < last]:
            del at_word[start]
    return sum(at_word.values()), len(at_word), len(lines[0].split())


def measures(weight: float, words: int) -> tuple[float, float]:
    """Evidence on a log scale, whole and per hundred words."""
    return math.log1p(weight), math.log1p(100.0 * weight / max(words, 1))


def probability(points: np.ndarray, calibration: Sequence[float]) -> np.ndarray:
    raw = calibration[0] + points @ np.asarray(calibration[1:])
    return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Log-odds of the terms that mark toxic texts; counts are summed per task and then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
                (toxic if label.as_py() == 1 else clean).update(terms_of(text.as_py()))
        names = list(toxic.keys() | clean.keys())
        sums = [pa.array([c[n] for n in names], pa.int64()) for c in (toxic, clean)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *sums], names=["term", "toxic", "clean"])

    sizes = sample.agg(F.count(F.when(F.col("label") == 1, 1)).alias("t"), F.count(F.when(F.col("label") != 1, 1)).alias("c")).first()
    counted = sample.mapInArrow(count, "term string, toxic long, clean long")
    odds = F.log((F.col("toxic") + 0.5) / (sizes["t"] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes["c"] + 1.0))
    listed = (
        counted.groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("weight", odds)
        .where((F.col("toxic") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term")
        .limit(TERMS)
        .collect()
    )
    return {r["term"]: r["weight"] for r in listed}


def calibrate(points: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (labels - p) - ridge * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, label: Column, rows: int = FIT_ROWS, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled texts; without any, an empty one that scores every text alike."""
    sample = labelled_sample(docs, labels, label, rows).persist()
    lexicon = Lexicon(learn_terms(sample), exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            found = [measures(w, n) for w, _, n in (evidence(t.as_py(), automaton) for t in batch.column("text"))]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], names=["a", "b", "label"])

    # At most ``rows`` rows of three numbers; grouped, as most texts have no evidence at all.
    points = sample.mapInArrow(measure, "a double, b double, label int").groupBy("a", "b", "label").count().toPandas()
    sample.unpersist()
    if len(points):
        repeated = points.loc[points.index.repeat(points["count"])]
        lexicon.calibration = calibrate(repeated[["a", "b"]].to_numpy(), (repeated["label"] == 1).to_numpy().astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted, matched words and words.

    Cases: null and empty texts have no evidence and get the score of such texts; a null id stays null; repeated rows get one row each. No rows
    in, no rows out. Only the id and the text are read.
    """
    rows = docs.select(F.col(key), whole(text).alias("text"))
    schema = rows.select(key).schema
    for name, kind in (("score", DoubleType()), ("matched", LongType()), ("words", LongType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            found = [evidence(t.as_py(), automaton) for t in batch.column("text")]
            points = np.array([measures(w, n) for w, _, n in found]).reshape(-1, 2)
            columns = [
                batch.column(0),
                pa.array(probability(points, lexicon.calibration)),
                pa.array([m for _, m, _ in found], pa.int64()),
                pa.array([n for _, _, n in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "score", "matched", "words"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
