import math
import random

import numpy as np
import pytest

from mercato.llm import whitening as module

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, index string"


@pytest.fixture(scope="module")
def vectors(spark):
    def build(rows, schema=SCHEMA):
        return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], schema)

    return build


def plain(rows):
    """Kept ids, whole-number vectors and their covariance, by the definition."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n = len(x)
    over_n = n * x - x.sum(axis=0)
    centred = (over_n / n).astype(float)
    return [i for i, _ in kept], over_n, centred, centred.T @ centred / n


def check(rows, docs):
    ids, over_n, centred, covariance = plain(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = module.whiten(docs).collect()
    kept = min(32, (values > 1e-11 * values[0]).sum())
    assert len(found) == len(ids) * kept
    deviation = dict(zip(ids, (over_n * over_n).sum(axis=1).tolist(), strict=True))
    z = np.full((len(ids), kept), np.nan)
    place = {i: k for k, i in enumerate(ids)}
    for r in found:
        assert (r["n"], r["deviation"]) == (len(ids), deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        z[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    true = centred @ (vectors[:, :kept] / np.sqrt(values[:kept]))
    true *= np.sign((true * z).sum(axis=0))
    assert np.abs(true - z).max() < 1e-7
    error = np.abs(z.T @ z / len(ids) - np.eye(kept)).max()
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]}
    assert found[0]["identity_error"] == pytest.approx(error, abs=1e-9) and error < 1e-4


def drawn(n, dims, seed=1):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 1 + k % 3) + (draw.random() if k else 0) for k in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "rows"), [(300, 6, 1024), (300, 40, 16), (97, 3, 1)])
def test_against_numpy(vectors, monkeypatch, n, dims, rows):
    monkeypatch.setattr(module, "ROWS", rows)
    data = drawn(n, dims)
    check(data, vectors(data).repartition(5))


def test_incomplete_vectors_null_and_repeated_keys(vectors):
    data = drawn(50, 4)
    broken = [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [1.0, float("nan"), 0.0, 0.0]), (63, [float("inf")] * 4), (64, [-float("inf")] * 4)]
    check(data + broken, vectors(data + broken))
    twice = module.whiten(vectors([*data, data[0], (None, data[1][1])])).collect()
    assert len(twice) == 52 * 4 and sum(r["vec_id"] is None for r in twice) == 4
    same = [r["whitened"] for r in twice if r["vec_id"] == 0 and r["component"] == 1]
    assert len(same) == 2 and same[0] == same[1]


def test_nothing_to_whiten(vectors):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0])] * 5, [(1, [])]):
        found = module.whiten(vectors(rows))
        assert found.columns == names and found.collect() == []


def test_dependent_directions_have_no_component(vectors):
    data = [(i, [float(v), 2.0 * v, 1.0, float(w)]) for i, (v, w) in enumerate((v, v * v % 7) for v in range(40))]
    found = module.whiten(vectors(data)).collect()
    assert {r["component"] for r in found} == {1, 2}
    assert sum(r["explained"] for r in found) == pytest.approx(len(data))


def test_short_vectors_are_filled_up(vectors):
    data = drawn(30, 3)
    ragged = [(i, v[:2] if i % 5 == 0 else v) for i, v in data]
    check([(i, (v + [0.0])[:3]) for i, v in ragged], vectors(ragged))


def test_huge_entries_are_exact_or_null(vectors):
    found = module.whiten(vectors([(1, [1e30]), (2, [-1e30]), (3, [3e15])])).collect()
    assert len(found) == 3 and all(math.isfinite(r["whitened"]) for r in found)
    assert [r["deviation"] for r in found if r["vec_id"] == 1] == [None]
