import pytest

from mercato.llm import decontaminate as module

ITEM = (
    "A baker sells bread to Anna and Bob every morning. If she sells 12 loaves at 3 dollars each to Anna and 7 loaves to Bob, how much money "
    "does she earn from Anna in 12 days?"
)
CHANGED = (
    "A baker sells bread to Clara and Dieter every morning. If she sells 15 loaves at 4 euros each to Clara and 9 loaves to Dieter, how much "
    "money does she earn from Clara in 15 days?"
)
#: Names and numbers of the item do not map one to one.
MUDDLED = (
    "A baker sells bread to Clara and Clara every morning. If she sells 15 loaves at 15 dollars each to Emil and 15 loaves to Clara, how much "
    "money does she earn from Frida in 99 days?"
)
FILLER = "the weather was mild and the streets were quiet all through the long autumn evening . " * 5


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "One sentence without any slot but with enough words to be found again."), (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_reparameterised_items(make, benchmark):
    docs = make(
        [
            (1, FILLER + ITEM + FILLER, "a"),
            (2, FILLER + CHANGED, "a"),
            (3, FILLER + MUDDLED, "a"),
            (4, FILLER, "a"),
            (6, "x, one sentence without any slot but with enough words to be found again!", "a"),
            (7, " ".join(ITEM.split()[:9]) + FILLER, "a"),
        ]
    )
    found = {r["doc_id"]: r for r in module.decontaminate(docs, benchmark).collect()}
    assert [found[i]["items"] for i in (1, 2, 3, 4, 6, 7)] == [[1], [1], [], [], [4], []]
    assert found[2]["contaminated"] and found[2]["coverage"] > 0.95
    detail = {(r["key"], r["item_id"]): r for r in module.matches(docs, benchmark).collect()}
    assert detail[(2, 1)]["consistency"] >= module.CONSISTENT and (3, 1) not in detail


def test_planted_passages(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    for r in module.decontaminate(small, bench).collect():
        held = [i for i, t in items.items() if t in (r["text"] or "")]
        assert set(held) <= set(r["items"]) and r["contaminated"] == bool(r["items"])


def test_cases(messy, nothing, benchmark):
    found = module.decontaminate(messy, benchmark)
    assert found.count() == messy.count() and found.where("contaminated").count() == 0
    assert module.decontaminate(nothing, benchmark).count() == 0
    assert module.decontaminate(messy, benchmark.limit(0)).where("contaminated").count() == 0


def test_repeated_rows_share_a_verdict(make, benchmark):
    docs = make([(1, ITEM, "a"), (1, ITEM, "a"), (None, ITEM, "a"), (1, "other text", "a")])
    assert sorted((r["doc_id"] or 0, r["items"]) for r in module.decontaminate(docs, benchmark).collect()) == [
        (0, [1]), (1, []), (1, [1]), (1, [1])
    ]


def test_native_plan(small, benchmark):
    plan = module.decontaminate(small, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def found_items(make, spark, text, *docs):
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    frame = make([(i, d, "a") for i, d in enumerate(docs)])
    return [bool(r["items"]) for r in sorted(module.decontaminate(frame, benchmark).collect(), key=lambda r: r["doc_id"])]


def test_every_diagonal_is_read(make, spark):
    longer = CHANGED.replace("Clara", "Mary Ann").replace("15", "twenty five")
    # Two words more in two places: no single diagonal holds half of the item.
    added = CHANGED.replace("every morning", "early every single morning").replace("how much money", "how very much money")
    assert found_items(make, spark, ITEM, FILLER + MUDDLED + " " + FILLER + ITEM, longer, added, MUDDLED) == [True, True, True, False]


def test_short_items_and_sentence_initial_names(make, spark):
    short = "Which river crosses the desert?"
    assert found_items(make, spark, short, FILLER + short + " " + FILLER, short, FILLER + "Which river crosses the plain?") == [True, True, False]
    assert found_items(make, spark, "Paris", FILLER + "in Paris " + FILLER, "in London") == [True, False]
    names = "{} has 12 apples. {} has 7 pears.\n{} has 3 plums. {} buys 5 figs. {} sells 2 nuts."
    item = names.format("Anna", "Bob", "Carl", "Anna", "Bob")
    copy = names.format("Dora", "Emil", "Fritz", "Dora", "Emil").replace("12", "8")
    capitals = names.format("DORA", "EMIL", "FRITZ", "DORA", "EMIL")
    muddled = names.format("Dora", "Emil", "Fritz", "Gerd", "Hans")
    assert found_items(make, spark, item, item, FILLER + "Said Tom. " + copy, capitals, muddled) == [True, True, True, False]


def test_values_may_become_equal(make, spark):
    item = "A farmer sells 3 sheep on the first market day and 5 sheep on the second one, then walks home over the hills"
    half = ITEM[: ITEM.index("and 7 loaves")] + "while the 99 neighbours slept , 12 geese and Anna waited to 12 what 4 euros and the birds sang from 98 hours"
    assert found_items(make, spark, item, item.replace("3", "4").replace("5", "4")) == [True]
    assert found_items(make, spark, ITEM, FILLER + half) == [True]


#: Pairs of one build and different words: capitalised nouns are no names.
CLEAN = [
    (
        "Der Hund liegt am Abend neben dem Ofen und der Mann liest die Zeitung in der Küche.",
        "Der Minister liegt am Montag neben dem Berg und der Vertrag liest die Rolle in der Stadt.",
    ),
    (
        "Eine alte Frau kauft jeden Morgen frisches Brot und ein kleines Kind trinkt die warme Milch im Garten.",
        "Eine alte Bank kauft jeden Sommer frisches Geld und ein kleines Werk trinkt die warme Suppe im Norden.",
    ),
    (
        "The River Thames flows past London and Oxford while Big Ben and Tower Bridge stand near Westminster and Lambeth.",
        "The Hotel Astor flows past Paris and Lyon while Big Sur and Golden Gate stand near Berkeley and Oakland.",
    ),
    (
        "Le garçon lit un livre dans le jardin et sa soeur chante une chanson près de la maison.",
        "Le soldat voit un navire dans le brouillard et sa mère écrit une lettre près de la fenêtre.",
    ),
    (
        "El niño come una manzana en la cocina y su hermana bebe un vaso de agua cerca de la puerta.",
        "El barco cruza una tormenta en la noche y su capitán mira un mapa de estrellas cerca de la vela.",
    ),
]
#: Items whose numbers, names and units change, as they are and as templates.
CHANGING = [
    "{a} buys {n} apples at the market and gives {m} of them to {b} , how many {u} does it take until {a} has eaten the rest after {m} {u} ?",
    "{a} kauft {n} Äpfel auf dem Markt und gibt {b} davon {m} Stück , wie viele hat {a} nach {m} {u} noch übrig wenn keiner mehr verkauft wird ?",
    "{a} achète {n} pommes au marché et donne {m} fruits à {b} , combien de pommes reste-t-il à {a} après {m} {u} de voyage en train ?",
    "{a} compra {n} manzanas en el mercado y regala {m} piezas a {b} , cuántas manzanas le quedan a {a} tras {m} {u} de viaje en tren ?",
]
VALUES = [
    dict(a="Anna", b="Tom", n="12", m="5", u="days"), dict(a="Clara", b="Emil", n="31", m="7", u="hours"),
    dict(a="Lucie", b="Hugo", n="18", m="zwei", u="Stunden"), dict(a="Marta", b="Pablo", n="nueve", m="14", u="semanas"),
    dict(a="Ines", b="Karl", n="1,250", m="trois", u="jours"),
]


def test_texts_of_one_build_are_clean(make, spark):
    for item, other in CLEAN:
        assert found_items(make, spark, item, FILLER + other, other, FILLER + item) == [False, False, True], item


def test_reparameterised_items_in_four_languages(make, spark):
    items = [(i, t.format(**VALUES[0])) for i, t in enumerate(CHANGING)]
    docs = [(10 * i + j, f"{FILLER} {t.format(**v)} {FILLER}", "a") for i, t in enumerate(CHANGING) for j, v in enumerate(VALUES)]
    found = module.decontaminate(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    held = [r["doc_id"] for r in found if r["doc_id"] // 10 in r["items"]]
    assert len(held) >= 0.9 * len(docs), sorted({d for d, *_ in docs} - set(held))
    assert all(set(r["items"]) <= {r["doc_id"] // 10} for r in found)
