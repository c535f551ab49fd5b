"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from mercato.llm.common import blank_words, whole

#: Expected copies are whole multiples of 2**-FRACTION, so prefix sums are exact.
FRACTION = 24
#: Rows of one source and size are summed in so many parts.
PARTS = 64


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with ``target``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes by weight. A target stops at ``most`` times its
    source; what is over goes to the others by weight. Filling in the order of limit by weight finds the level in one pass: one row per
    source is sorted, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1
    )
    rows = sizes.withColumn("__weight", weight).withColumn("__limit", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("__limit") / F.col("__weight"), F.col("source").isNull(), "source")
    earlier, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn(
        "__level", (budget - F.coalesce(F.sum("__limit").over(earlier), F.lit(0.0))) / F.sum("__weight").over(rest)
    ).withColumn("__full", F.col("__limit") <= F.col("__weight") * F.col("__level"))
    # The first source that is not full has the level that holds for all after it.
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("__limit") / F.col("__weight"), "__level"))).over(everything)
    return rows.withColumn(
        "target", F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__weight") * level["__level"])
    ).drop("__weight", "__limit", "__level", "__full")


def offset(source: Column, seed: str) -> Column:
    """A fixed draw from 0 to 2**FRACTION - 1 for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, FRACTION // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size).

    Each document of a source is expected ``target / source_size`` times. Within a source, documents are ordered by size; the running sum of the
    expected copies plus one draw per source crosses whole numbers, and a document is emitted once for each crossing. The order by
    size keeps the taken words within one document's size of the target. Sums run over (source, size) counts, then over the parts of such a
    group, then over its rows, so no task sums a whole source.

    Cases: a null text has size 0 and is mixed with its source; a null source is one source, placed last. A source without words has
    target 0 and is not taken. A text of any length is one document, ids may be of any type, and rows that repeat an id are rows of their own. Rows of
    one size are ordered by id and text; rows equal in both are alike, so it does not matter which of them is taken. No rows in, no rows out. Input columns named like a result column
    are replaced.
    """
    ours = ("size", "source_size", "target", "copies", "taken")
    number = F.col(key) if isinstance(docs.schema[key].dataType, IntegralType) else F.xxhash64(key)
    rows = docs.select(
        *(c for c in docs.columns if c not in ours),
        F.size(blank_words(whole(text))).cast("long").alias("size"),
        F.coalesce(F.pmod(number, F.lit(PARTS)), F.lit(0)).cast("int").alias("__part"),
        F.col("source").alias("__source"),
    )
    parts = rows.groupBy("__source", "size", "__part").agg(F.count("*").alias("__n"))
    counts = parts.groupBy("__source", "size").agg(F.sum("__n").alias("__n"))
    sources = targets(
        counts.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("size") * F.col("__n")).alias("source_size")),
        weights,
        share,
        most,
    ).withColumnRenamed("source", "__named")
    sum_before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = counts.withColumn("__before", sum_before(Window.partitionBy("__source").orderBy("size"))).drop("__n")
    by_size = by_size.join(sources, F.col("__source").eqNullSafe(F.col("__named"))).drop("__named")
    by_part = parts.withColumn("__in", sum_before(Window.partitionBy("__source", "size").orderBy("__part"))).drop("__n")
    a, b = by_part.alias("a"), by_size.alias("b")
    starts = a.join(b, F.expr("a.__source <=> b.__source and a.size = b.size")).select(
        F.col("a.__source").alias("__s"),
        F.col("a.size").alias("__z"),
        F.col("a.__part").alias("__p"),
        (F.col("__before") + F.col("__in")).alias("__start"),
        "source_size",
        "target",
    )
    own = Window.partitionBy("__source", "size", "__part").orderBy(key, F.xxhash64(whole(text)))
    unit = 1 << FRACTION
    expected = F.when(
        F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * unit).cast("long")
    ).otherwise(F.lit(0).cast("long"))
    numbered = rows.withColumn("__at", F.row_number().over(own).cast("long"))
    joined = numbered.join(
        starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("__part") == F.col("__p"))
    )
    after = (F.col("__start") + F.col("__at")) * expected + offset(F.col("__source"), seed)
    crossed = F.call_function("shiftright", after, F.lit(FRACTION)) - F.call_function(
        "shiftright", after - expected, F.lit(FRACTION)
    )
    return (
        joined.withColumn("copies", crossed.cast("int"))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .drop("__source", "__part", "__at", "__s", "__z", "__p", "__start")
    )


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The documents of :func:`mix`, each as often as it is taken."""
    times = F.sequence(F.lit(1), F.col("copies"))
    return mixed.where("copies > 0").select(*columns, F.explode(times).alias("__copy")).drop("__copy")
