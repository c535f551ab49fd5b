import re
from collections import Counter

from mercato.llm import licenses as module

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    listed = words_of(text)
    places = [(i, label) for p, label in BASE.items() for i in range(len(listed)) if tuple(listed[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    return len(listed), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(docs):
    want = Counter((r["doc_id"], *base(r["text"])) for r in docs.select("doc_id", "text").collect())
    found = module.scan(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found)
    assert got == want
    for r in found:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    return {r["doc_id"]: r for r in found}


def test_against_brute_force(small, messy, nothing):
    check(small)
    check(messy)
    assert module.scan(nothing).count() == 0


def test_places_labels_and_cases(make):
    found = check(
        make(
            [
                (1, "CC BY cc by: Cc-By; all rights\nreserved. All Rights. Reserved", "a"),
                (2, "the GENERAL PUBLIC LICENSE general public license general public", "a"),
                (3, "Released under the MIT License.", "a"),
                (4, "x " * 50 + "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated "
                    "documentation files, to deal in the Software without restriction", "a"),
                (5, "permission to deal in copies of the software is not granted", "a"),
                (6, "Kcc by Écc by", "a"),
            ]
        )
    )
    assert found[1]["n_base"] == 5 and found[1]["labels"] == "cc-by,reserved" and found[1]["score"] == 1.0
    assert found[2]["n_base"] == 2 and found[2]["last_word"] == 4
    assert found[3]["labels"] == "mit" and found[3]["base_labels"] == ""
    # One word put in moves the rest of the template to the next diagonal; both are one span.
    assert found[4]["labels"] == "mit" and found[4]["score"] > 0.9
    assert found[5]["labels"] == ""


def test_spans(make):
    docs = make([(1, "one two Released under the MIT License three", "a")])
    span = [r for r in module.spans(docs).collect() if r["label"] == "mit"][0]
    assert (span["start"], span["stop"], span["coverage"]) == (2, 7, 1.0)


def test_native_plan(small):
    plan = module.scan(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
