import hashlib
from collections import Counter, defaultdict

import pytest

from mercato.llm import exact_dedup as module


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out, taken = [], set()
    for doc_id, text, *_ in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        kept = doc_id == keep and (text or "") not in taken
        if kept:
            taken.add(text or "")
        out.append((doc_id, keep, len(groups[text or ""]), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def result(docs):
    found = module.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return Counter(tuple(r) for r in found.collect())


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# A filter of 64 bits sends nearly all rows on; a limit of 2 deals every group over the salts.
@pytest.mark.parametrize(("bits", "hot"), [(1 << 26, 10_000), (64, 10_000), (1 << 26, 2)])
def test_against_brute_force(small, messy, monkeypatch, bits, hot):
    monkeypatch.setattr(module, "FILTER_BITS", bits)
    monkeypatch.setattr(module, "HOT", hot)
    for docs in (small, messy):
        assert result(docs) == expected(rows_of(docs))


@pytest.mark.parametrize("hot", [10_000, 2])
def test_one_row_of_each_text_stays(make, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT", hot)
    rows = [(1, "x", "a"), (1, "x", "b"), (None, None, "a"), (None, "", "a"), (2, "y", "a"), (3, "y", "a"), (3, "y", "a"), (4, "z", "a")] * 5
    docs = make(rows).repartition(7).checkpoint()
    assert result(docs) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert module.exact_dedup(docs).where("kept").count() == 4


def test_unique_rows_do_not_shuffle(small):
    plan = module.exact_dedup(small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("Union") == 1


def test_columns_and_empty_table(messy, nothing):
    assert module.exact_dedup(nothing).count() == 0
    found = module.exact_dedup(messy)
    assert len(set(found.columns)) == len(found.columns) and "bucket" in found.columns
