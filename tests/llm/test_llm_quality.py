import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import quality as module
from mercato.llm.queries import grade_of_labels, quality_scores


def test_fit_recovers_ordered_grades():
    draw = np.random.default_rng(5)
    rows, grades = [], []
    for _ in range(600):
        share = draw.random()
        rows.append((np.array([3, 9], np.int32), np.array([share, 1 - share], np.float32)))
        grades.append(int(np.digitize(share + draw.normal(0, 0.05), [0.33, 0.66])))
    model = module.fit(rows, np.array(grades), 2)
    assert (np.diff(model.thresholds) > 0).all()
    raw = np.array([v @ model.weights[i] for i, v in rows])
    tails = model.tails(raw)
    assert (tails[:, 0] >= tails[:, 1]).all()
    guess = (tails >= 0.5).sum(axis=1)
    assert (guess == np.array(grades)).mean() > 0.85


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = module.learn(docs.where("doc_id % 5 != 0"), labels, grade_of_labels(), top=2)
    found = module.score(docs.where("doc_id % 5 = 0"), model).join(labels, "doc_id")
    right = found.select(((F.col("tails")[0] >= 0.5).cast("int") == F.col("quality")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.98


def test_cases(spark, messy, nothing, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(
        [(1, None, None), (None, 1, 1), (5, 0, 1), (4, 1, None), (9, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    found = quality_scores(spark, messy, folder)
    rows = found.select("doc_id", "tails", "expected_grade", "kept").collect()
    assert len(rows) == messy.count() and set(messy.columns) <= set(found.columns)
    for r in rows:
        assert 1 >= r["tails"][0] >= r["tails"][1] >= 0 and r["expected_grade"] == pytest.approx(sum(r["tails"]))
    assert quality_scores(spark, nothing, folder).count() == 0
    empty = module.learn(messy, spark.createDataFrame([], "doc_id long, quality int, toxic int"), grade_of_labels(), top=2)
    assert module.score(messy, empty).count() == messy.count()
