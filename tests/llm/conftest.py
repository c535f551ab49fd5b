from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SMALL = "/root/testdata/sf0.001"
#: Names that operators use for their own columns, as extra columns of the input.
CLASHING = (
    "size", "shard", "slot", "copies", "taken", "target", "keep_id", "kept", "class_id", "label", "node", "bucket", "key", "text_hash",
    "contaminated", "items", "coverage", "score", "predicted", "tails", "expected_grade", "words", "tokens", "length", "at", "window",
)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """A frame of documents from (doc_id, text, source) rows, with extra columns that clash."""

    def build(rows, extra=CLASHING):
        names = ["doc_id", "text", "source"]
        schema = "doc_id long, text string, source string"
        return spark.createDataFrame([tuple(r) for r in rows], schema).selectExpr(
            *names, *(f"concat('x', doc_id) as `{c}`" for c in extra)
        )

    return build


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
#: Null ids, texts and sources, empty and blank texts, one very long text, copies, a repeated row, one-word texts.
MESSY = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, LONG, "b"),
    (5, LONG, "b"),
    (5, LONG, "b"),
    (None, "plain words of a text without an id here", None),
    (None, None, None),
    (6, "word", "c"),
    (7, "word", "a"),
    (8, "Ünïcode «words» … ǂp ˑ 12.5 kg, 🙂 " + "ß" * 300, "c"),
    (9, "plain words of a text without an id here", "b"),
]


@pytest.fixture(scope="session")
def messy(make):
    return make(MESSY)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
