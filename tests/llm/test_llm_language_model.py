import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import language_model as module
from mercato.llm.common import remainder_of_id


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def brute(rows, order):
    """Score of each row by plain dictionaries."""
    counts = Counter()
    training = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    for text in training:
        line = ["<s>", *tokens(text)]
        for n in range(1, order + 1):
            counts.update(tuple(line[k - n + 1 : k + 1]) for k in range(max(1, n - 1), len(line)))
    total, types = sum(c for g, c in counts.items() if len(g) == 1), sum(1 for g in counts if len(g) == 1)
    counts[("<s>",)] = len(training)

    def p(line, k, n):
        if n == 1:
            return (counts[(line[k],)] + 1) / (total + types + 1)
        shorter = p(line, k, n - 1)
        if k < n - 1 or not counts[tuple(line[k - n + 1 : k])]:
            return shorter
        strength = module.STRENGTH[n]
        return (counts[tuple(line[k - n + 1 : k + 1])] + strength * shorter) / (counts[tuple(line[k - n + 1 : k])] + strength)

    out = []
    for i, text in rows:
        line = ["<s>", *tokens(text)]
        at = range(1, len(line))
        out.append(
            (
                i,
                len(at),
                sum(counts[(line[k],)] > 0 for k in at),
                total,
                sum(math.log10(p(line, k, 1)) for k in at),
                sum(math.log10(p(line, k, order)) for k in at),
            )
        )
    return out


def run(docs, order):
    found = module.score(docs, remainder_of_id("doc_id", 7) != 2, order)
    return [tuple(r) for r in found.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], round(r[-1], 6)))


@pytest.mark.parametrize(("order", "block"), [(2, 1 << 20), (2, 3000), (3, 3000)])
def test_against_brute_force(small, messy, monkeypatch, order, block):
    # Small blocks, so that counts come from many of them.
    monkeypatch.setattr(module, "BLOCK_TOKENS", block)
    monkeypatch.setattr(module, "GROUP_KEYS", 5000)
    for docs in (small.limit(60), messy):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got, want = by_key(run(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), order)), by_key(brute(rows, order))
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-6)


@pytest.mark.parametrize("numbered", [2, 40])
def test_numbers_of_common_words_change_nothing(small, monkeypatch, numbered):
    """With no or few numbered words nearly every n-gram is named by its hash."""
    monkeypatch.setattr(module, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(module, "NUMBERED", numbered)
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").limit(30).collect()]
    docs = small.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got, want = by_key(run(docs, 3)), by_key(brute(rows, 3))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-6)


def test_groups_hold_ascending_keys_that_meet_again():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    by, edges = module.grouped(keys, 7)
    assert edges[0] == 0 and edges[-1] == len(keys) and np.diff(edges).min() > 500
    assert all((np.diff(keys[by[a:b]].astype(float)) >= 0).all() for a, b in zip(edges, edges[1:], strict=False))
    some, inner = module.grouped(keys[:100], 7)
    for g in range(7):
        assert set(keys[:100][some[inner[g] : inner[g + 1]]]) <= set(keys[by[edges[g] : edges[g + 1]]])


def test_empty_table_and_no_training(nothing, messy):
    assert module.score(nothing, F.lit(True)).count() == 0
    assert all(r["n_known"] == 0 for r in module.score(messy, F.lit(False)).collect())


def test_better_than_words_alone(small):
    held = module.score(small, remainder_of_id("doc_id", 7) != 2).where("not training").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


def test_order_of_the_query_and_beyond(small, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_TOKENS", 3000)
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").limit(30).collect()]
    docs = small.sparkSession.createDataFrame(rows, "doc_id long, text string")
    found = module.score(docs, remainder_of_id("doc_id", 7) != 2).select("score").collect()
    assert sorted(r[0] for r in found) == pytest.approx(sorted(r[-1] for r in brute(rows, 3)), abs=1e-6)
    got, want = by_key(run(docs, 5)), by_key(brute(rows, 5))
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=1e-6)


def test_counts_beyond_32_bits():
    keys = [np.array([1, 2**63 + 5, 2**64 - 1], np.uint64), np.array([2**63 + 5], np.uint64), np.array([], np.uint64)]
    answers, types = module.summed(keys, [np.array([1, 3_000_000_000, 0]), np.array([3_000_000_001]), np.array([], int)])
    assert [module.unpack(module.pack(a)).tolist() for a in answers] == [[1, 6_000_000_001, 0], [6_000_000_001], []] and types == 2
    assert all((module.unpack_ascending(module.pack_ascending(k)) == k).all() for k in keys)
