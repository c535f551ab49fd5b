from collections import Counter

import corpus_pipeline
from mercato.llm.common import Stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, small):
    stored, docs, kept = Stored(spark), small, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored.save(stage(spark, docs, SMALL))
        kept[name] = docs
        assert name == "cut_shards" or docs.columns == small.columns
    ids = {name: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for name, d in kept.items()}
    good, unique, clean, mixed, placed = ids.values()
    assert set(mixed) <= set(clean) <= set(unique) <= set(good) <= {r["doc_id"] for r in small.select("doc_id").collect()}
    assert max(clean.values()) == 1 and max(mixed.values()) == 2 and mixed == placed
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rated = [(i in good, labels[i]) for i in labels]
    assert sum(k == bool(q) for k, q in rated) / len(rated) > 0.9
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(t in r["text"] for r in kept["drop_benchmark"].collect() for t in items)
    texts = [r["text"] for r in kept["drop_near_copies"].collect()]
    assert len(texts) == len(set(texts))


def test_run(spark, small):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == [*small.columns, "shard", "slot"] and found.count() > 0


def test_messy_rows_pass_through(spark, messy, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "an item that is nowhere to be found in these few texts")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    docs = messy
    stored = Stored(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored.save(stage(spark, docs, folder))
    assert "slot" in docs.columns


def test_one_row_of_each_class_of_near_copies(spark, make):
    body = " ".join(f"w{i}" for i in range(80))
    rows = [(5, body), (5, body), (5, body), (5, body + " more"), (7, body), (None, "no id at all here"), (None, "no id at all here")]
    rows += [(None, None), (None, ""), (8, "alone in its class"), (None, "a"), (9, "a"), (9, "a")]
    found = corpus_pipeline.drop_near_copies(spark, make([(i, t, "a") for i, t in rows]).repartition(3), SMALL).collect()
    ids = Counter(r["doc_id"] for r in found)
    assert ids == {5: 1, None: 2, 8: 1, 9: 1}
    assert {(r["text"] or "")[:5] for r in found if r["doc_id"] is None} == {"no id", ""}
