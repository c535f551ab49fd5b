import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from mercato.llm import simhash as module
from mercato.llm.common import Stored

BLANKS = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    """The definition word by word, without arrays."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in BLANKS:
        text = text.replace(blank, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Sets of prints that are joined by pairs of at most four differing bits, over all pairs."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


def expected(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    tops = classes(prints)
    least = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[tops[p]] = min(doc_id, least.get(tops[p], doc_id))
    return sorted(((d, f"{p:016x}", least.get(tops[p])) for (d, _), p in zip(rows, prints, strict=True)), key=str)


def result(docs):
    return sorted((tuple(r) for r in module.simhash_components(docs).collect()), key=str)


def test_against_brute_force(make, spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(400)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{draw.randrange(99)}" for _ in range(draw.randrange(9)))) for i in range(40)]
    docs = make([(d, t, None) for d, t in rows])
    assert result(docs) == expected(rows)
    assert len({c for _, _, c in result(docs)}) < 80


def test_nulls_long_texts_copies_and_clashing_columns(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    found = result(messy)
    assert found == expected(rows)
    assert {c for d, p, c in found if p == "0" * 16} == {1}


def test_only_null_keys_and_no_rows(make, nothing):
    assert result(make([(None, "alone here", None)])) == [(None, f"{plain_fingerprint('alone here'):016x}", None)]
    assert module.simhash_components(nothing).columns == ["doc_id", "fingerprint", "component_id"]
    assert result(nothing) == []


def test_shingles_in_parts(monkeypatch):
    text = " ".join(f"w{i % 313}" for i in range(5000))
    whole = module.fingerprint(text.encode())
    monkeypatch.setattr(module, "CHUNK", 7)
    assert module.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("longest", [1 << 14, 2])
def test_lists_of_any_length_lose_no_link(spark, monkeypatch, longest):
    """A dense cloud of prints around a few centres: with lists of two, every list is split down to its last level."""
    monkeypatch.setattr(module, "LIST", longest)
    draw = random.Random(11)
    prints = set()
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(40):
            p = centre
            for bit in draw.sample(range(64), draw.randrange(7)):
                p ^= 1 << bit
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in module.links(frame, Stored(spark)).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {p: top(p) for p in prints} == classes(prints)


def test_every_pair_shares_a_list_at_every_level():
    """Down any way of splitting, two prints of four differing bits stay together in some list."""
    draw = random.Random(3)
    for _ in range(30):
        x = sum(1 << bit for bit in draw.sample(range(64), 4))
        masks = [m for m in module.finer(0) if x & m == 0]
        for _ in range(5):
            assert masks
            masks = [m for mask in masks for m in module.finer(mask) if x & m == 0]


def test_the_fingerprint_is_stored_once_and_lists_carry_no_texts(make):
    plan = module.fingerprints(make([(1, "a b c d e", None)]))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    assert module.fingerprints(make([(1, "a", None)])).select(F.col("print")).columns == ["print"]
