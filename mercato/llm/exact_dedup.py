"""Exact duplicates by two passes over a Bloom filter of text hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import whole

#: Bits of the filter. It reaches the tasks as at most FILTER_BITS / 64 rows of two words, so its broadcast is bounded by 2**20 rows.
FILTER_BITS = 1 << 26
#: A slot that this many documents share is dealt over SALTS tasks.
HOT, SALTS = 10_000, 256


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Pass one counts documents per filter slot (one number per document moves, and is summed on the map side first) and sets the bits of the
    slots hit more than once. Pass two tests each document against that filter: those that miss are unique and pass straight
    through; only the others shuffle and are grouped by SHA-256, so a false positive costs a shuffled row and never a wrong answer. A filter
    too small for its corpus therefore degrades to grouping all digests.

    Cases: a null text equals the empty text; a text of any length is hashed whole. Of equal texts exactly one row stays, the one with the largest
    id; a null id is the smallest. Where several rows repeat that id with the text, or none has an id, any one of them stays, and all count in
    ``group_size``. No rows in, no rows out. Input columns that have the name of a result column are replaced by it.
    """
    text_col = whole(text)
    slot = F.pmod(F.xxhash64(text_col), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(__slot & 63 as int))")
    marked = docs.withColumn("__slot", slot).withColumn("__word", F.expr("shiftright(__slot, 6)"))
    repeated = (
        marked.groupBy("__slot", "__word")
        .agg(F.count("*").alias("__n"))
        .where("__n > 1")
        .groupBy("__word")
        .agg(
            F.bit_or(bit).alias("__bits"),
            F.bit_or(F.when(F.col("__n") >= HOT, bit).otherwise(F.lit(0).cast("long"))).alias("__hot_bits"),
        )
    )
    tested = marked.join(F.broadcast(repeated), "__word", "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(bit), F.lit(0)) != 0
    hot = F.coalesce(F.col("__hot_bits").bitwiseAND(bit), F.lit(0)) != 0

    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    ours = ["keep_id", "group_size", "kept", "text_sha256"]
    unique = tested.where(~maybe).select(
        *names,
        F.col(key).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.sha2(text_col, 256).alias("text_sha256"),
    )
    salt = F.when(hot, F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    digest = F.sha2(text_col, 256).alias("text_sha256")
    candidates = tested.where(maybe).select(*names, digest, salt.alias("__salt"), hot.alias("__hot"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    groups = (
        candidates.groupBy("text_sha256", F.col(key).alias("__id"))
        .agg(F.count("*").alias("__n"), F.max("__hot").alias("__hot"))
        .groupBy("text_sha256")
        .agg(
            F.max("__id").alias("keep_id"),
            F.sum("__n").alias("group_size"),
            # Rows with the id that stays: as many as the text has if none has an id.
            F.coalesce(F.max_by("__n", "__id"), F.sum("__n")).alias("__tied"),
            F.max("__hot").alias("__hot"),
        )
        .withColumn("__salt", F.explode(copies.otherwise(F.array(F.lit(0).cast("long")))))
        .drop("__hot")
    )
    stays = F.col(key).eqNullSafe(F.col("keep_id"))
    repeats = candidates.join(groups, ["text_sha256", "__salt"]).withColumn("kept", stays)
    single = repeats.where(~F.col("kept") | (F.col("__tied") == 1)).select(*names, *ours)
    # Rows that tie: the first of each task that read some, and of these the first.
    tied = candidates.withColumn("__part", F.spark_partition_id()).join(groups.where("__tied > 1"), ["text_sha256", "__salt"])
    tied = tied.where(stays)
    of_part = Window.partitionBy("text_sha256", "__part").orderBy("group_size")
    tied = tied.withColumn("__first", F.row_number().over(of_part) == 1)
    of_firsts = Window.partitionBy("text_sha256", F.when(~F.col("__first"), F.col("__part"))).orderBy("__part")
    one = tied.withColumn("kept", F.col("__first") & (F.row_number().over(of_firsts) == 1)).select(*names, *ours)
    return unique.unionByName(single).unionByName(one)
