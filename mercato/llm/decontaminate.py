"""Benchmark decontamination by template windows with typed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import whole

#: Tokens of a template window; an item with fewer tokens is one window as a whole.
WINDOW = 8
#: Part of an item's template that a document must have, and part of its slots that one substitution must explain.
COVERED, CONSISTENT = 0.5, 0.9
#: Distinct names that changed, per word that is the same in the matched windows: with more, two sentences have no more in common than their build.
RENAMED = 0.5
#: Diagonals of one match are at most this far apart, and at most a quarter of the item.
DRIFT = 8
#: A benchmark with more windows than this is joined by shuffling instead of being broadcast.
BROADCAST_WINDOWS = 1_000_000
#: A letter that opens a slot's mark; it survives the cut into tokens.
MARK = "ǂ"
#: Joins the parts of a decimal number into one token.
POINT = "ˑ"
#: ASCII, Latin-1 and general punctuation parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\u2000-\u206F\u3000-\u303F]+"

# Units that follow a number, in English, German, French and Spanish.
UNITS = (
    "kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "lb", "lbs", "oz", "l", "ml", "s", "min", "h", "hr", "hrs", "mph", "kmh",
    "kilograms", "kilogram", "grams", "gram", "kilometers", "kilometer", "kilometres", "meters", "meter", "metres", "centimeters",
    "miles", "mile", "feet", "foot", "inches", "inch", "yards", "pounds", "ounces", "liters", "liter", "litres", "gallons",
    "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year",
    "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "points",
    "kilogramm", "gramm", "pfund", "zentimeter", "sekunden", "sekunde", "minuten", "stunden", "stunde", "tage", "tagen", "tag", "wochen", "woche",
    "monate", "monaten", "monat", "jahre", "jahren", "jahr", "prozent", "grad",
    "kilogrammes", "grammes", "kilos", "kilo", "mètres", "kilomètres", "secondes", "heures", "heure", "jours", "jour", "semaines", "semaine", "mois",
    "ans", "années", "degrés",
    "kilogramos", "gramos", "metros", "kilómetros", "litros", "segundos", "minutos", "horas", "hora", "días", "día", "semanas", "semana", "meses", "mes",
    "años", "año", "grados",
)
# Numbers written as words in these languages, without those that are another word in one of them.
NUMBER_WORDS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
    "million", "billion",
    "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn",
    "achtzehn", "neunzehn", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig", "hundert", "tausend",
    "deux", "trois", "quatre", "cinq", "sept", "huit", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente", "quarante",
    "cinquante", "soixante", "mille",
    "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "doce", "trece", "catorce", "quince", "veinte", "treinta", "cuarenta",
    "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "ciento",
)
# German words before a noun; other languages have names there rarely.
DETERMINERS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "im", "am", "ins", "ans", "zum", "zur", "vom", "beim",
    "kein", "keine", "keinen", "keinem", "keiner", "jede", "jeder", "jedes", "jeden", "jedem", "diese", "dieser", "dieses", "diesen", "diesem",
    "mein", "meine", "meinen", "meinem", "meiner", "sein", "seine", "seinen", "seinem", "seiner", "ihr", "ihre", "ihren", "ihrem", "ihrer",
    "unser", "unsere", "unseren", "unserem", "unserer",
)

# Words that begin sentences and are no names.
STARTERS = (
    "The", "An", "If", "How", "What", "When", "Where", "Which", "Who", "Why", "In", "On", "At", "By", "For", "From", "To", "Of", "And", "But", "Or",
    "So", "As", "It", "Its", "He", "She", "We", "You", "They", "His", "Her", "Their", "Our", "My", "Your", "This", "That", "These", "Those", "There",
    "Then", "Than", "After", "Before", "Each", "Every", "All", "Some", "Many", "Most", "One", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Can",
    "Could", "Will", "Would", "Should", "Has", "Have", "Had", "Let", "Given", "Find", "Suppose", "With", "While", "Not", "No", "Yes", "Now", "Here",
    "Der", "Die", "Das", "Ein", "Eine", "Es", "Er", "Sie", "Wir", "Ich", "Und", "Aber", "Wenn", "Wie", "Was", "Wer", "Wo", "Im", "Am", "Ist",
    "Le", "La", "Les", "Un", "Une", "Il", "Elle", "On", "Nous", "Vous", "Si", "Et", "Mais", "Que", "Qui", "Dans", "En", "El", "Los", "Las", "Una", "Unos",
    "Pero", "Cuando", "Como", "Quand", "Comment", "Dem", "Den", "Des", "Einen", "Einem", "Einer", "Kein", "Keine", "Jede", "Jeder", "Jedes", "Diese",
    "Dieser", "Dieses", *(w.capitalize() for w in NUMBER_WORDS),
)
_EDGE, _GAP = r"(?![\p{L}\p{N}])", r"[^\p{L}\p{N}]{1,3}"
#: After a determiner, or one and a declined adjective, stands a noun. 'I am' is no determiner.
_NOUN = (
    rf"(?<![^\p{{L}}\p{{N}}](?!am (?<=I am ))(?i:{'|'.join(DETERMINERS)}) (?:\p{{Ll}}{{2,16}}(?:e|en|em|er|es) )?)"
    rf"(?<!^(?i:{'|'.join(DETERMINERS)}) (?:\p{{Ll}}{{2,16}}(?:e|en|em|er|es) )?)"
)
#: Where a name begins; see :func:`tokens`.
NAME = (
    r"(?=\p{Lu}\p{L})(?<![\p{L}\p{N}])(?:"
    rf"(?=.\p{{Ll}}){_NOUN}(?:(?<=[\p{{L}}\p{{N}},;] )|(?!(?:{'|'.join(dict.fromkeys(STARTERS))}){_EDGE}))"
    rf"|(?=\p{{Lu}}{{2}})(?:(?<!\p{{Lu}}{{2}}{_GAP})(?=\p{{Lu}}{{2,}}{_EDGE}(?:{_GAP}\p{{Lu}}{{2,}}{_EDGE})?+(?!{_GAP}\p{{Lu}}{{2}}))"
    rf"|(?<=(?:^|[^\p{{Lu}}]){_GAP}\p{{Lu}}{{2,20}}{_GAP}|^\p{{Lu}}{{2,20}}{_GAP})(?=\p{{Lu}}{{2,}}{_EDGE}(?!{_GAP}\p{{Lu}}{{2}}))))"
)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text; names and units carry a mark.

    A name is a capitalised word: any after a word or a comma on the same line, and elsewhere (at the start of a sentence, a line or a quotation)
    any but ``STARTERS``, in both cases not after a German article or pronoun, where a noun stands. Of words in capitals, at most two in a row are names; more are shouted text. A unit follows a number.
    """
    # Each pattern begins with what is rare, so most characters are passed over at once.
    joined = F.regexp_replace(text, r"[.,](?<=[0-9].)(?=[0-9])", POINT)
    named = F.regexp_replace(joined, NAME, f"{MARK}p")
    measured = F.regexp_replace(named, rf"([0-9]) ?(?=(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))", f"$1 {MARK}u")
    return F.filter(F.split(F.lower(measured), SEPARATORS), lambda w: w != "")


def shape_of(word: Column) -> Column:
    """A token, or the type of the slot that it fills: name, unit or number."""
    return (
        F.when(word.startswith(MARK), F.substring(word, 1, 2))
        .when(((word >= "0") & (word < ":")) | word.isin(*NUMBER_WORDS), f"{MARK}n")
        .otherwise(word)
    )


def shape_of_value(value: Column) -> Column:
    """The shape of a value of :func:`collapsed`: that of its first word."""
    return shape_of(F.substring_index(value, " ", 1))


def collapsed(rows: DataFrame) -> DataFrame:
    """``words`` (at least one) as ``values``: a run of slots of one type is one value, so 'Mary Ann' has the place of 'Anna'."""
    others = [c for c in rows.columns if c != "words"]
    typed = rows.withColumn("types", F.transform("words", shape_of))
    goes_on = lambda i: F.get("types", i).startswith(MARK) & (F.get("types", i) == F.get("types", i - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | ~F.coalesce(goes_on(i), F.lit(False)))
    return typed.select(*others, "words", starts.alias("starts")).select(
        *others,
        F.transform(
            "starts",
            lambda s, j: F.array_join(
                F.slice("words", s + 1, F.coalesce(F.get("starts", j + 1), F.size("words")) - s), " "
            ),
        ).alias("values"),
    )


def windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Template windows of the given lengths of every row's ``words``: the other columns, ``at`` and ``window`` (a hash)."""
    others = [c for c in rows.columns if c != "words"]
    slots = [F.xxhash64(F.lit(f"{MARK}{t}")) for t in "pun"]
    hashed = rows.select(*others, F.transform("words", lambda w: F.xxhash64(shape_of(w))).alias("h"))
    # A run of slots of one type is one token, as in :func:`collapsed`.
    hashed = hashed.select(*others, F.filter("h", lambda x, i: (i == 0) | (x != F.get("h", i - 1)) | ~x.isin(*slots)).alias("g"))
    # As many places for each length; a window that would pass the end is null. A filter on the size would have Spark cut the text twice.
    begins = F.when(F.size("g") > 0, F.sequence(F.lit(1), F.size("g")))
    of_length = lambda n: F.transform(
        begins, lambda i: F.when(i + n - 1 <= F.size("g"), F.xxhash64(F.slice("g", i, F.lit(n))))
    )
    rolled = [of_length(n) for n in lengths]
    listed = hashed.select(*others, F.size("g").alias("places"), F.posexplode(F.concat(*rolled)).alias("at", "window"))
    return listed.select(*others, (F.col("at") % F.col("places")).alias("at"), "window")


def consistency_of(pairs: Column) -> Column:
    """Part of the distinct pairs (a: the item's value, b: the document's) that one substitution explains."""
    distinct = F.size(F.array_distinct(pairs))
    against = distinct - F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(1 - against / distinct)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents that hold an item, whatever its numbers, names and units: key, text_hash, item_id, coverage, consistency.

    Runs of slots of one type are one token. Windows of template tokens (the whole item, if it is shorter than WINDOW) meet by hash, and every
    diagonal (place in the document minus place in the item) with a window is read token by token: ``coverage`` is the part of the item's template
    found there, and ``consistency`` the part of the slots in matched windows that fit one substitution, by which equal values of the item become
    equal values in the document; different ones may become equal. Diagonals up to DRIFT and a quarter of the item apart are also taken together, by
    their matched windows, which lets words be added or left out. What is verified counts, and the best of it is reported.

    An item of slots alone must be there with its own values. With more than RENAMED changed names per literal word in the matched windows, two texts share
    a build and no more, and do not match: of a very short item, one name at most may have changed.
    """
    source = docs.select(F.col(key).alias("key"), F.xxhash64(whole(text)).alias("text_hash"), whole(text).alias("text"))
    items = (
        benchmark.where(F.col("item_id").isNotNull())
        .select("item_id", tokens(whole()).alias("words"))
        .distinct()
        .where(F.size("words") > 0)
        # Items of one id with different texts are told apart by their words.
        .withColumn("item_hash", F.xxhash64("words"))
    )
    items = collapsed(items).select(
        "item_id", "item_hash", F.col("values").alias("item"), F.transform("values", shape_of_value).alias("item_shape")
    )
    items = items.withColumn("n", F.size("item_shape")).withColumn("span", F.least(F.lit(WINDOW), "n"))
    spans = items.groupBy("span").agg(F.sum(F.col("n") - F.col("span") + 1).alias("windows")).collect()
    lengths = sorted(r["span"] for r in spans) or [WINDOW]
    hashes = items.select("item_id", "item_hash", "n", "span", F.transform("item_shape", lambda w: F.xxhash64(w)).alias("h"))
    rolled = F.transform(
        F.sequence(F.lit(1), F.col("n") - F.col("span") + 1), lambda i: F.xxhash64(F.slice("h", i, F.col("span")))
    )
    known = hashes.select("item_id", "item_hash", "n", "span", F.posexplode(rolled).alias("place", "window"))
    if sum(r["windows"] for r in spans) <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    found = windows(source.select("key", "text_hash", tokens(F.col("text")).alias("words")), lengths).join(known, "window")
    of = ["key", "text_hash", "item_id", "item_hash"]
    diagonals = found.groupBy(*of, "n", "span", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )
    candidates = diagonals.groupBy("key", "text_hash").agg(
        F.collect_list(F.struct("item_id", "item_hash", "n", "span", "diagonal", "places")).alias("listed")
    )

    # Only the texts of candidates are cut into tokens again, once for all their diagonals.
    texts = source.withColumnsRenamed({"key": "k", "text_hash": "t"})
    met = candidates.join(texts, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("t")))
    met = collapsed(met.select("key", "text_hash", "listed", tokens(F.col("text")).alias("words")))
    # The stretch of the document that lies under the item, as far as the text goes.
    first = lambda c: F.greatest(c["diagonal"], F.lit(0))
    reach = lambda c: F.least(c["diagonal"] + c["n"], F.size("values")) - first(c)
    cut = F.transform("listed", lambda c: F.struct(c.alias("c"), F.slice("values", first(c) + 1, reach(c)).alias("there")))
    read = (
        met.select("key", "text_hash", F.explode(cut).alias("x"))
        .select("key", "text_hash", "x.c.*", "x.there")
        # Repeated rows give the same stretch.
        .groupBy(*of, "n", "span", "diagonal")
        .agg(F.first("places").alias("places"), F.first("there").alias("there"))
        .join(items.drop("n", "span"), ["item_id", "item_hash"])
    )
    under = lambda i: F.get("there", i - F.greatest(-F.col("diagonal"), F.lit(0)))
    same = F.transform("item_shape", lambda w, i: F.coalesce(w == shape_of_value(F.when(i + F.col("diagonal") >= 0, under(i))), F.lit(False)))
    matched = lambda i: F.exists("places", lambda v: (v <= i) & (i < v + F.col("span")))
    cells = F.filter(
        F.transform("item", lambda a, i: F.when(matched(i), F.struct(i.alias("place"), a.alias("a"), under(i).alias("b")))),
        lambda c: c.isNotNull(),
    )
    read = read.select(
        *of,
        "n",
        "diagonal",
        (F.size(F.filter(same, lambda x: x)) / F.col("n")).alias("coverage"),
        F.exists("item_shape", lambda w: ~w.startswith(MARK)).alias("worded"),
        cells.alias("cells"),
    )
    near = Window.partitionBy(*of).orderBy("diagonal").rangeBetween(0, DRIFT)
    read = read.withColumn("near", F.collect_list(F.struct(F.size("cells").alias("held"), "diagonal", "cells")).over(near))
    # A place that several diagonals hold counts where most is held.
    close = F.filter("near", lambda d: d["diagonal"] - F.col("diagonal") <= F.col("n") / 4)
    joined = F.aggregate(
        F.reverse(F.array_sort(close)),
        F.filter("cells", lambda c: F.lit(False)),
        lambda all_, d: F.concat(all_, F.filter(d["cells"], lambda c: ~F.exists(all_, lambda x: x["place"] == c["place"]))),
    )
    alone = F.struct("coverage", F.col("cells").alias("cells"))
    together = F.struct((F.size("joined") / F.col("n")).alias("coverage"), F.col("joined").alias("cells"))
    read = read.withColumn("joined", joined).select(*of, "n", "worded", F.explode(F.array(alone, together)).alias("x"))
    words_in = lambda value: F.size(F.split(value, " "))
    # At an edge of the item, a slot of the text around it may have run into the item's.
    ran_in = lambda c: ((c["place"] == 0) | (c["place"] == F.col("n") - 1)) & (words_in(c["b"]) > words_in(c["a"]))
    slots = F.filter("x.cells", lambda c: shape_of_value(c["a"]).startswith(MARK) & ~ran_in(c))
    own = F.forall("x.cells", lambda c: F.concat(F.lit(" "), c["b"], F.lit(" ")).contains(F.concat(F.lit(" "), c["a"], F.lit(" "))))
    pairs = F.transform(slots, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b")))
    literal = F.size(F.filter("x.cells", lambda c: ~c["a"].startswith(MARK) & (c["a"] == c["b"])))
    is_name = lambda c: c["a"].startswith(f"{MARK}p") & (c["a"] != c["b"]) & ~ran_in(c)
    renamed = F.size(F.array_distinct(F.transform(F.filter("x.cells", is_name), lambda c: c["a"])))
    alike = (renamed <= 1) | (renamed <= RENAMED * literal)
    return (
        read.where((F.col("x.coverage") >= COVERED) & (F.col("worded") | own) & alike)
        .select(*of, F.col("x.coverage").alias("coverage"), pairs.alias("pairs"))
        .select(*of, "coverage", consistency_of(F.col("pairs")).alias("consistency"))
        .where(F.col("consistency") >= CONSISTENT)
        .groupBy("key", "text_hash", "item_id")
        .agg(F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``contaminated``, ``items`` (ascending item ids) and ``coverage`` (of the best item, else 0).

    Cases: null and empty texts are clean; a text of any length is read whole; items that match a document equally well are all listed; an item of few tokens is found wherever its whole template is; a null id is matched like any other; items
    without an id or without a token are left out; rows that repeat an id and a text share a verdict. No rows in, no rows out; an empty benchmark leaves all clean. Input columns named
    like a result column are replaced.
    """
    verdicts = (
        matches(docs, benchmark, text, key)
        .groupBy(F.col("key").alias("__k"), F.col("text_hash").alias("__t"))
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    )
    ours = ("contaminated", "items", "coverage")
    names = [c for c in docs.columns if c not in ours]
    return (
        docs.select(*names, F.xxhash64(whole(text)).alias("__hash"))
        .join(verdicts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__t")), "left")
        .withColumn("contaminated", F.col("__t").isNotNull())
        .withColumn("items", F.coalesce("items", F.array().cast(benchmark.select(F.array("item_id")).schema[0].dataType)))
        .withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
        .select(*names, *ours)
    )
