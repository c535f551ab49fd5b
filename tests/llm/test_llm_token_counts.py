import tiktoken
from collections import Counter

from mercato.llm import token_counts as module
from mercato.llm.queries import op3_token_lengths

SMALL = "/root/testdata/sf0.001"


def encoding():
    ranks = module.read_vocabulary(module.VOCABULARY)
    return tiktoken.Encoding("test", pat_str=module.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_lengths_are_those_of_the_tokenizer(small, messy):
    own = encoding()
    for docs in (small, messy):
        want = Counter((r["doc_id"], len(own.encode_ordinary(r["text"] or ""))) for r in docs.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in module.lengths(docs).collect()) == want


def test_sums_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(module, "SPAN", 100)
    sizes = [r["tokens"] for r in module.lengths(small).collect()]
    sums = op3_token_lengths(spark, SMALL).cache()
    for r in sums.collect():
        x = r["length"]
        assert r["documents"] == sizes.count(x) and r["docs_from"] == sum(s >= x for s in sizes)
        assert r["tokens_from"] == sum(s for s in sizes if s >= x) and r["docs_to"] == sum(s <= x for s in sizes)
        assert r["truncated_total"] == sum(min(s, x) for s in sizes)
        assert (r["total_documents"], r["total_tokens"]) == (len(sizes), sum(sizes))
    limits = [0, 1, 100, 512, 10**9]
    assert {r["context"]: (r["documents_cut"], r["tokens"]) for r in module.truncated_totals(sums, limits).collect()} == {
        c: (sum(s > c for s in sizes), sum(min(s, c) for s in sizes)) for c in limits
    }
    ordered = sorted(sizes)
    shares = [0.01, 0.5, 0.9, 1.0]
    assert {r["share"]: r["length"] for r in module.quantiles(sums, shares).collect()} == {
        q: next(x for i, x in enumerate(ordered, 1) if i >= q * len(sizes)) for q in shares
    }


def test_empty_table(nothing):
    sums = module.suffix_sums(module.histogram(module.lengths(nothing)))
    assert sums.count() == 0
    assert module.truncated_totals(sums, [10]).first()["tokens"] == 0
