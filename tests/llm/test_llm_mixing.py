from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from mercato.llm import mixing as module
from mercato.llm.oracle import OP1
from mercato.llm.queries import op1_mix_sources

SMALL = "/root/testdata/sf0.001"


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare by weight until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def words(text):
    return len((text or "").encode().split())


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    want = shares(sizes)
    found = module.mix(docs).select("doc_id", "source", "text", "size", "source_size", "target", "copies", "taken").collect()
    assert len(found) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = r["source"]
        assert r["size"] == words(r["text"]) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s] + 1
    return found


def test_mix(small, messy, nothing):
    check(small)
    check(messy)
    assert module.mix(nothing).count() == 0


def test_reruns_and_partitions_agree(small):
    pick = lambda d: sorted(tuple(r) for r in module.mix(d).select("doc_id", "copies").collect())
    assert pick(small) == pick(small.repartition(7, F.rand(3)))


def test_hot_source_is_summed_in_parts(make):
    docs = make([(i, "one two three", "hot") for i in range(500)] + [(1000 + i, "one", f"s{i}") for i in range(5)])
    check(docs)


def test_emitted_copies(small):
    mixed = module.mix(small)
    total = mixed.agg(F.sum("copies")).first()[0]
    out = module.emit(mixed, small.columns)
    assert out.columns == small.columns and out.count() == total


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute(OP1).fetchall()
    names = [c[0] for c in con.description]
    got = [tuple(r) for r in op1_mix_sources(spark, SMALL).select(*names).collect()]
    rounded = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert rounded(got) == rounded(want)


def test_ids_of_any_type(small):
    texts = small.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    sources = module.mix(texts).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).collect()
    assert sources and all(abs(r["taken"] - r["target"]) <= 2 * r["size"] for r in sources)
