import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import hard_negatives as module
from mercato.llm import oracle, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, number string, id string, block string, x string"


@pytest.fixture(scope="module")
def vectors(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)

    return build


def brute(rows, every):
    """The contract over all pairs."""
    usable = [
        (i, label, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    found = []
    for i, label, x in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in usable)
        positives = [(-s, j) for s, j, other in scored if other == label and j != i][:5]
        for ps, p in positives:
            window = [(-s, j) for s, j, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            found += [(i, p, rank, j, ps, s) for rank, (s, j) in enumerate(window, 1)]
    return sorted(found)


def result(docs, every):
    return sorted(tuple(r) for r in module.mine(docs, F.col("vec_id") % every == 0, F.col("label")).collect())


def clustered(n, dims, seed):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + draw.gauss(0, 0.3) for c in draw.choice(centres)], draw.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1024, 256, 2048), (7, 3, 5)])
def test_against_brute_force(vectors, monkeypatch, sizes):
    """Once in one block, once in many blocks, pages and slices of anchors, where bounds leave blocks out."""
    for name, value in zip(("BLOCK", "PAGE", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(module, name, value)
    rows = clustered(240, 5, 1)
    assert result(vectors(rows).repartition(6), 8) == brute(rows, 8)


def test_ties_copies_incomplete_and_short_vectors(vectors, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 5)
    same = [(i, [0.5, 0.25, 0.0], i % 3) for i in range(60)]
    less = [(100 + i, [0.25, 0.125, 0.0], i % 4) for i in range(40)]
    broken = [(70, None, 1), (71, [0.5, None, 0.0], 1), (72, [math.nan, 0.0, 0.0], 1), (73, [math.inf, 0.0, 0.0], 2)]
    odd = [(74, [0.5, 0.25, 0.0], None), (None, [0.5, 0.25, 0.0], 1), (75, [0.5], 1), (76, [], 2)]
    rows = same + less + broken + odd
    assert result(vectors(rows), 10) == brute(rows, 10)


def test_negative_and_zero_scores(vectors):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [-0.5, 0.0], 2)]
    assert result(vectors(rows), 100) == brute(rows, 100) == [(0, 2, 1, 3, 0, 0)]


def test_repeated_ids_count_one_by_one(vectors):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (2, [0.5], 2)]
    found = result(vectors(rows), 100)
    assert found == sorted([(0, 1, rank, 2, 65536, 32768) for rank in (1, 2)] * 2)


def test_nothing_to_mine(vectors):
    for rows in ([], [(0, None, 1)], [(5, [1.0], 1), (6, [1.0], 2)], [(0, [1.0], 1)]):
        found = module.mine(vectors(rows), F.col("vec_id") % 100 == 0, F.col("label"))
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert found.collect() == []


def test_huge_entries_are_exact(vectors):
    rows = [(0, [4e6, 1.0], 1), (1, [4e6, 3.0], 1), (2, [2e6, 5.0], 2), (3, [2e6, 4.0], 2), (4, [1e30, 0.0], 2)]
    kept = [r for r in result(vectors(rows), 100) if r[3] != 4]
    assert kept == brute(rows[:4], 100)


def test_bounds_hold_for_every_vector_of_a_block():
    draw = np.random.default_rng(2)
    anchors, block = draw.normal(size=(30, 8)) * 200, np.floor(draw.normal(size=(50, 8)) * 200)
    least, most = module.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = anchors @ block.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()


def test_the_curve_visits_neighbours():
    """Consecutive places differ by one step in one dimension, and every cell is visited once."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        places = module.hilbert(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        walked = cells[np.argsort(places)]
        assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_far_blocks_are_not_read(vectors, spark, monkeypatch):
    """In well-parted clusters most blocks cannot reach the floor that the first ones set."""
    monkeypatch.setattr(module, "BLOCK", 10)
    read = []
    save = module.Stored.save
    monkeypatch.setattr(module.Stored, "save", lambda self, df: read.append(save(self, df)) or read[-1])
    draw = random.Random(4)
    rows = [(i, [50.0 * (i % 8 == k) + draw.random() for k in range(8)], i % 2) for i in range(400)]
    assert result(vectors(rows), 100) == brute(rows, 100)
    pairs = [df.count() for df in read if "block" in df.columns and "number" in df.columns]
    blocks = next(df.count() for df in read if "label_of" in df.columns)
    assert sum(pairs[:2]) < 4 * blocks / 2


def test_sql_on_the_given_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    found = queries.op12_hard_negatives(spark, SMALL)
    expected = con.execute(oracle.ORACLE_SQL["op12_hard_negatives"])
    assert [d[0] for d in expected.description] == found.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected.fetchall())
