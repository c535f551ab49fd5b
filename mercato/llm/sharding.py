"""Contiguous shards with the smallest possible largest shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import Stored, whole

#: Key bits of the first survey and of each refinement. The driver holds at most 2**FIRST_BITS ranges, plus 2**MORE_BITS for each range that a
#: cut can fall into (about shards**2 of them).
FIRST_BITS, MORE_BITS = 16, 8
#: Parts of a shard that are numbered on their own.
PARTS = 1024
LOWEST = -(1 << 63)


class Ranges:
    """Consecutive ranges of the key space with the bytes in each; ``single`` ranges hold one group and cannot be cut."""

    def __init__(self, low: np.ndarray, bits: np.ndarray, size: np.ndarray, single: np.ndarray):
        order = np.argsort(low, kind="stable")
        self.low, self.bits, self.size, self.single = low[order], bits[order], size[order], single[order]
        self.ends = np.cumsum(self.size)

    def fill(self, capacity: int, start: int, whole_ranges: bool) -> int:
        """The furthest byte that a shard from byte ``start`` reaches: whole ranges only, or any byte outside single ranges."""
        target = start + capacity
        at = int(np.searchsorted(self.ends, target, side="right"))
        if at == len(self.ends):
            return int(self.ends[-1])
        begin = int(self.ends[at] - self.size[at])
        return begin if whole_ranges or self.single[at] else target

    def fits(self, capacity: int, shards: int, whole_ranges: bool) -> bool:
        """Greedy check: fill shard after shard as far as the capacity allows."""
        at, total = 0, int(self.ends[-1])
        for _ in range(shards):
            reach = self.fill(capacity, at, whole_ranges)
            if reach >= total:
                return True
            if reach <= at:
                return False
            at = reach
        return False

    def smallest(self, shards: int, whole_ranges: bool) -> int:
        low, high = -(-int(self.ends[-1]) // shards), int(self.ends[-1])
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards, whole_ranges):
                high = middle
            else:
                low = middle + 1
        return low

    def open_to_cuts(self, least: int, most: int, shards: int) -> np.ndarray:
        """Indexes of divisible ranges in which a cut can fall for some capacity from ``least`` to ``most``."""
        found, total = set(), int(self.ends[-1])
        early = late = 0
        for _ in range(shards):
            early = max(early, self.fill(least, early, True))
            late = min(total, late + most)
            first = int(np.searchsorted(self.ends, early, side="right"))
            last = int(np.searchsorted(self.ends, late, side="left"))
            found.update(range(first, min(last, len(self.ends) - 1) + 1))
        return np.array([i for i in sorted(found) if not self.single[i] and self.bits[i] > 0], dtype=np.int64)


def survey(groups: DataFrame, bits: Column, within: Column | None = None) -> DataFrame:
    """Bytes, smallest and largest key of each range of 2**bits keys."""
    rows = groups if within is None else groups.where(within)
    return rows.groupBy(F.call_function("shiftright", F.col("key"), bits).alias("range")).agg(
        F.sum("size").alias("size"), F.min("key").alias("least"), F.max("key").alias("most")
    )


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` contiguous shards need, and the first key of each shard but the first.

    ``groups`` has rows of ``key`` (long) and ``size``; equal keys are one atomic group. The driver never holds the groups: it searches over ranges
    of keys, once with every range taken as atomic (an upper bound) and once with divisible ranges (a lower bound), and splits only
    the ranges that a cut can fall into until both bounds meet, which makes the result exact.
    """
    width = 64 - FIRST_BITS
    found = survey(groups, F.lit(width)).collect()
    if not found:
        return 0, []
    ranges = Ranges(
        np.array([r["range"] << width for r in found], dtype=np.int64),
        np.full(len(found), width),
        np.array([r["size"] for r in found], dtype=np.int64),
        np.array([r["least"] == r["most"] for r in found]),
    )
    while True:
        least, most = ranges.smallest(shards, False), ranges.smallest(shards, True)
        split = ranges.open_to_cuts(least, most, shards) if least < most else ()
        if not len(split):
            break
        bits = int(max(ranges.bits[i] for i in split))
        chosen = [i for i in split if ranges.bits[i] == bits]
        finer = max(0, bits - MORE_BITS)
        parents = [int(ranges.low[i]) >> bits for i in chosen]
        inside = F.call_function("shiftright", F.col("key"), F.lit(bits)).isin(parents)
        parts = survey(groups, F.lit(finer), inside).collect()
        keep = np.ones(len(ranges.low), dtype=bool)
        keep[chosen] = False
        ranges = Ranges(
            np.concatenate([ranges.low[keep], np.array([r["range"] << finer for r in parts], dtype=np.int64)]),
            np.concatenate([ranges.bits[keep], np.full(len(parts), finer)]),
            np.concatenate([ranges.size[keep], np.array([r["size"] for r in parts], dtype=np.int64)]),
            np.concatenate([ranges.single[keep], np.array([r["least"] == r["most"] for r in parts])]),
        )
    cuts, at, total = [], 0, int(ranges.ends[-1])
    while (at := ranges.fill(most, at, True)) < total:
        cuts.append(int(ranges.low[int(np.searchsorted(ranges.ends, at, side="right"))]))
    return most, cuts


def shard(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Documents are ordered by the hash of their text; equal texts are one atomic group. The largest shard is as small as contiguous shards of
    whole groups allow (:func:`minimax_cuts`); a shard is then a range of hashes, found without a join. Slots number a
    shard's rows from 0: rows are dealt over ``PARTS`` parts of each shard by id, numbered there, and shifted by the parts before, so that a
    shard with a third of all rows is still numbered by many tasks.

    Cases: a null text is empty and has size 1. Groups larger than an even share get a shard of their own size; later shards may then be empty. Rows
    that repeat an id get slots of their own. No rows in, no rows out. Input columns named like a result column are replaced.
    """
    text_col = whole(text)
    ours = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rows = docs.select(
        *(c for c in docs.columns if c not in ours),
        (F.octet_length(text_col) + 1).cast("long").alias("size"),
        F.crc32(text_col.cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col).alias("__key"),
    )
    stored = Stored(docs.sparkSession)
    groups = stored.save(rows.select(F.col("__key").alias("key"), "size"))
    _, cuts = minimax_cuts(groups, shards)
    stored.drop(groups)
    index = F.lit(0)
    for cut in cuts:
        index = index + F.when(F.col("__key") >= F.lit(cut).cast("long"), 1).otherwise(0)
    placed = rows.withColumn("shard", index.cast("int")).withColumn(
        "__part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("shard", "__part")
        .agg(F.count("*").alias("__n"))
        .select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    own = Window.partitionBy("shard", "__part").orderBy(key, "__key")
    return (
        placed.withColumn("__at", F.row_number().over(own) - 1)
        .join(shifts, ["shard", "__part"])
        .withColumn("slot", (F.col("__shift") + F.col("__at")).cast("long"))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("__key", "__part", "__at", "__shift")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, files_per_shard: int = 64) -> None:
    """Write documents into folders ``shard=N``; a shard is cut into files of slots, so that no task writes a whole shard."""
    placed = shard(docs, shards)
    dealt = placed.repartition("shard", F.pmod("slot", F.lit(files_per_shard)))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
