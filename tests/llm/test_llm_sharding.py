import random
import zlib
from collections import defaultdict

import pytest

from mercato.llm import sharding as module


def best(sizes, shards):
    """Smallest capacity by trying every sum of consecutive groups."""
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})

    def needs(capacity):
        used, left = 1, capacity
        for s in sizes:
            if s > capacity:
                return shards + 1
            if s > left:
                used, left = used + 1, capacity
            left -= s
        return used

    return next(c for c in sums if needs(c) <= shards)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(spark, seed, monkeypatch):
    # Few bits per step, so that ranges are split again and again.
    monkeypatch.setattr(module, "FIRST_BITS", 2)
    monkeypatch.setattr(module, "MORE_BITS", 3)
    draw = random.Random(seed)
    rows = [(draw.randrange(-(2**63), 2**63), draw.randrange(1, 9) ** 3) for _ in range(40)]
    rows += [(rows[0][0], 50)] * draw.randrange(0, 40)
    groups = defaultdict(int)
    for k, s in rows:
        groups[k] += s
    shards = draw.randrange(2, 9)
    capacity, cuts = module.minimax_cuts(spark.createDataFrame(rows, "key long, size long"), shards)
    ordered = [groups[k] for k in sorted(groups)]
    assert capacity == best(ordered, shards)
    loads = defaultdict(int)
    for k, s in groups.items():
        loads[sum(k >= c for c in cuts)] += s
    assert max(loads.values()) == capacity and len(cuts) < shards


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    found = module.shard(docs).select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(found) == len(rows)
    slots, shards_of = defaultdict(list), defaultdict(set)
    for r in found:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
        shards_of[data].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards_of.values())
    return found


def test_shards(small, messy, nothing):
    found = check(small)
    loads = defaultdict(int)
    for r in found:
        loads[r["shard"]] += r["size"]
    largest = max(r["size"] for r in found)
    assert max(loads.values()) <= sum(loads.values()) / 16 + largest * 3
    check(messy)
    assert module.shard(nothing).count() == 0


def test_written_shards(spark, small, tmp_path):
    module.write_shards(small, str(tmp_path / "shards"), shards=4, files_per_shard=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == small.count()
    assert {r["shard"] for r in back.select("shard").distinct().collect()} <= set(range(4))
