import duckdb
from pyspark.sql import functions as F

from mercato.llm import toxicity as module
from mercato.llm.queries import op10_toxicity_lexicon


def test_folding_and_exceptions():
    lexicon = module.Lexicon({" idiot ": 3.0, " lowe": 2.0, " trash ": 4.0})
    automaton = lexicon.matcher()
    count = lambda t: module.evidence(t, automaton)
    assert count("You IDIOT!")[:2] == (3.0, 1)
    assert count("1d10t, іdіоt and ｉｄｉｏｔ")[1] == 3
    assert count("loweish lowes")[1] == 2 and count("fellowes")[1] == 0
    assert count("the trash can is full of trash")[:2] == (4.0, 1)
    assert count("") == (0.0, 0, 0)


def test_signs_inside_words():
    lexicon = module.Lexicon({" idiot ": 3.0, " worthless ": 2.0, " bugger ": 2.0, " zombie ": 1.0, " fall ": 1.0})
    matched = lambda t: module.evidence(t, lexicon.matcher())[:2]
    for text in ("id!ot", "You !diot!", "ｉｄ！ｏｔ", "1d|ot", "idiot!you", "such an idiot!"):
        assert matched(text) == (3.0, 1), text
    for text in ("worth1ess", "worth|ess", "wor7h1e55", "6u99er", "8ugger", "2om6ie", "fa11", "f4l!l"):
        assert matched(text)[1] == (text != "f4l!l"), text
    assert matched("fail, worthiess, bog and zomgie") == (0.0, 0)
    assert {" worthless ", " worthiess "} <= module.terms_of("worth1ess")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = op10_toxicity_lexicon(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    counts = found.agg(
        F.count(F.when((F.col("toxic") == 1) & (F.col("predicted") == 1), 1)).alias("hit"),
        F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"),
        F.count(F.when((F.col("toxic") == 0) & (F.col("predicted") == 1), 1)).alias("wrong"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    ).first()
    assert counts["hit"] / counts["toxic"] > 0.85 and counts["wrong"] <= 5
    assert 0 <= counts["low"] <= counts["high"] <= 1


def test_cases(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (none, labels):
        lexicon = module.learn(messy, table, F.col("toxic"))
        assert module.score(nothing, lexicon).count() == 0
        found = module.score(messy, lexicon).collect()
        assert len(found) == messy.count() and all(0 <= r["score"] <= 1 for r in found)
        empty = {r["score"] for r in found if r["words"] == 0}
        assert len(empty) == 1
    assert module.learn(nothing, labels, F.col("toxic")).weights == {}
