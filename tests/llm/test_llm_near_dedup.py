import math
import random
from collections import Counter

import numpy as np
import pytest

from mercato.llm import near_dedup as module


def brute(rows):
    """Class of each row: equal texts and all pairs with enough similarity, joined."""
    hashes = module.WordHashes()
    sets = [module.shingles(t or "", hashes) for _, t in rows]
    found = Counter()
    for h, _ in sets:
        found.update(h.view(np.int64).tolist())
    least = max(2, math.ceil(module.COMMON * len(rows)))
    weights = module.Weights([(h, n) for h, n in found.items() if n >= least], len(rows))
    weighed = [(h, weights.of(h, n).astype(np.float32)) for h, n in sets]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(weighed[i][0]) and module.similarity(weighed[i], weighed[j]) >= module.SIMILAR - 1e-6):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    sizes = Counter(root(i) for i in range(len(rows)))
    return Counter((rows[i][0], ids.get(root(i)), sizes[root(i)]) for i in range(len(rows)))


def result(docs):
    return Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in module.near_dedup(docs).collect())


def varied(count, length, changes, seed=1):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(4000)}" for _ in range(length)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(draw.randrange(changes + 1)):
            words[draw.randrange(length)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


# Rooms of a few members split every bucket into many parts.
@pytest.mark.parametrize("room", [1024, 5])
def test_against_brute_force(make, monkeypatch, room):
    monkeypatch.setattr(module, "ROOM", room)
    texts = varied(60, 150, 3) + varied(30, 400, 25, 2) + varied(10, 60, 1, 3) + varied(12, 6, 0, 4) + [None, "", "a b", "a b"]
    rows = list(enumerate(texts))
    assert result(make([(i, t, "a") for i, t in rows])) == brute(rows)


def test_cases(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    # Texts of white space alone have no shingles, so only equal texts meet.
    assert result(messy) == brute(rows)
    assert module.near_dedup(nothing).count() == 0
    found = module.near_dedup(messy)
    assert len(found.columns) == len(set(found.columns)) and "node" in found.columns


def test_stored_shingles_round_trip(spark):
    texts = ["", "a b", "a b c d e " * 40 + "f g h", " ".join(f"w{i % 700}" for i in range(5000)), "One two THREE four five six"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "node string, text string")
    found = {r["node"]: module.shingle_counts(r["hashes"], r["repeats"]) for r in module.cut_texts(rows).collect()}
    for i, t in enumerate(texts):
        hashes, counts = module.shingles(t, module.WordHashes())
        assert (found[str(i)][0] == hashes).all() and (found[str(i)][1] == counts).all()


def test_common_shingles_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(module, "COMMON", 1 / 8)
    texts = varied(40, 30, 6) + varied(20, 30, 0, 2) + varied(60, 20, 20, 3)
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "node string, text string").repartition(7)
    hashes, wanted = module.WordHashes(), Counter()
    for t in texts:
        wanted.update(module.shingles(t, hashes)[0].view(np.int64).tolist())
    least = math.ceil(len(texts) / 8)
    assert dict(module.common_shingles(module.cut_texts(rows), len(texts))) == {h: n for h, n in wanted.items() if n >= least}


def test_sampling_estimates_weighted_jaccard():
    draw = np.random.default_rng(3)
    agree, exact = [], []
    for _ in range(60):
        hashes = np.sort(draw.choice(2**62, 300, replace=False)).astype(np.uint64)
        w = draw.integers(1, 6, 300).astype(float)
        v = np.where(draw.random(300) < 0.3, draw.integers(1, 6, 300), w).astype(float)
        start = np.array([0])
        agree.append((module.samples(hashes, w, start) == module.samples(hashes, v, start)).mean())
        exact.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert np.mean(agree) == pytest.approx(np.mean(exact), abs=0.03)


def test_chain_of_links(spark):
    from mercato.llm.common import Stored

    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", "901")], "a string, b string")
    labels = {r["node"]: r["label"] for r in module.components(links, Stored(spark)).collect()}
    assert {labels[f"{i:03}"] for i in range(41)} == {"000"} and labels["901"] == "900"
