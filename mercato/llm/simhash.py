"""Near duplicates by SimHash: fingerprints meet in an inverted index of their bytes and are counted, filtered and verified there."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import Stored, whole
from mercato.llm.near_dedup import components

#: Words of a shingle, seed of its XXH64, and the most differing bits of two linked fingerprints.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Shingles of one text that are counted together.
CHUNK = 1 << 16
#: A list of the index is compared as a whole up to this size; a longer one is split by further positions first.
LIST = 1 << 14
#: Postings that one task compares at a time, on average.
ROOM = 1 << 15
#: Positions that one fingerprint has in a round of splitting, and how many of them two linked fingerprints share at least.
POSITIONS, SHARED = 8, 8 - DISTANCE

U64 = np.uint64


def fingerprint(text: bytes) -> int:
    """SimHash of a text in UTF-8: a bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    # Only A-Z has a lower case among bytes, and only ASCII white space parts them.
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(SHINGLE, len(words))
    stops = ends[width - 1 :]
    starts = np.concatenate([[0], ends[: len(stops) - 1] + 1])
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id`` and ``print`` (the fingerprint as a signed number) of every document; whole texts, null as empty."""
    rows = docs.select(F.col(key).alias("id"), whole(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], names=["id", "print"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, print long")


def covering(units: list[int], shared: int, known: int) -> list[int]:
    """Sets of units (as masks) such that whoever shares ``shared`` of all units, ``known`` of them settled, shares a whole set.

    ``units`` are the masks of the units that are not settled yet. With none settled, three groups of units are formed: of four shared ones two lie
    in one group, so the pairs within groups do. After that, all but ``shared - known - 1`` single units are enough.
    """
    if known == 0:
        groups = [units[:3], units[3:6], units[6:]]
        return [a | b for group in groups for a, b in itertools.combinations(group, 2)]
    return units[: len(units) - (shared - known) + 1]


@cache
def finer(mask: int) -> tuple[int, ...]:
    """Masks of the lists into which the list of fingerprints with equal bits under ``mask`` is split; none if it is as fine as can be.

    Two fingerprints of a link share at least four of eight bytes. When four bytes are settled, the differing bits lie in the
    other four, so the pair shares at least four of their eight half-bytes, and the list is split by those in the same way. What is left then is 16 bits.
    """
    byte_units = [0xFF << (8 * i) for i in range(POSITIONS)]
    settled = sum(mask & u == u for u in byte_units)
    if settled < SHARED:
        free = [u for u in byte_units if mask & u != u]
        return tuple(mask | more for more in covering(free, SHARED, settled))
    # Settled bytes beyond the first four can come from half-bytes; the bytes that were settled as such are the four lowest full ones.
    whole_bytes = [u for u in byte_units if mask & u == u]
    halves = [h for u in byte_units if u not in whole_bytes for h in (u & 0x0F0F0F0F0F0F0F0F, u & 0xF0F0F0F0F0F0F0F0)]
    halves += [h for u in whole_bytes[SHARED:] for h in (u & 0x0F0F0F0F0F0F0F0F, u & 0xF0F0F0F0F0F0F0F0)]
    done = sum(mask & h == h for h in halves)
    if done >= SHARED:
        return ()
    return tuple(mask | more for more in covering([h for h in halves if mask & h != h], SHARED, done))


def signed(mask: int) -> int:
    return int(np.array(mask, U64).view(np.int64))


def shared_bytes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of their eight bytes two fingerprints share, position by position."""
    x = left ^ right
    x |= x >> U64(4)
    x |= x >> U64(2)
    x |= x >> U64(1)
    return POSITIONS - np.bitwise_count(x & U64(0x0101010101010101))


def forest(prints: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Places of linked fingerprints, as many pairs as join what is linked.

    ``stops`` has the end of each place's list. Places are compared with those one, two, three ... further on in their list, all lists at
    once: shared bytes are tallied, pairs with enough of them are verified bit by bit, and those that are not yet connected are kept.
    """
    parent = list(range(len(prints)))
    root = np.arange(len(prints))
    found = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    gap, left = 1, np.flatnonzero(stops - root > 1)
    while len(left):
        right = left + gap
        apart = left[shared_bytes(prints[left], prints[right]) >= SHARED]
        apart = apart[root[apart] != root[apart + gap]]
        apart = apart[np.bitwise_count(prints[apart] ^ prints[apart + gap]) <= DISTANCE]
        for i in apart.tolist():
            a, b = top(i), top(i + gap)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i, i + gap))
        if len(apart):
            root = np.array(parent)
            while (root != root[root]).any():
                root = root[root]
        gap += 1
        left = left[left + gap < stops[left]]
    return found


def compared(room: pa.Table) -> pa.Table:
    """Links of one room: the lists that fell into it, each compared within itself."""
    prints = room.column("print").to_numpy().view(U64)
    masks = room.column("mask").to_numpy().view(U64)
    parts = prints & masks
    order = np.lexsort((prints, parts, masks))
    prints, masks, parts = prints[order], masks[order], parts[order]
    new = np.ones(len(prints), bool)
    new[1:] = (masks[1:] != masks[:-1]) | (parts[1:] != parts[:-1])
    bounds = np.append(np.flatnonzero(new), len(prints))
    pairs = forest(prints, np.repeat(bounds[1:], np.diff(bounds)))
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({name: pa.array(prints[ends[:, k]].view(np.int64)) for k, name in enumerate(("a", "b"))})


def split(postings: DataFrame) -> DataFrame:
    """Each posting (``print``, ``mask``) under the finer masks of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("mask").to_numpy().view(U64)
            more = [finer(int(m)) for m in masks]
            prints = np.repeat(batch.column("print").to_numpy(), [len(m) for m in more])
            flat = np.fromiter(itertools.chain.from_iterable(more), U64, len(prints)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(flat)], names=["print", "mask"])

    return postings.select("print", "mask").mapInArrow(run, "print long, mask long")


def links(prints: DataFrame, stored: Stored) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints ``print`` that join all that are DISTANCE or fewer bits apart.

    The index lists fingerprints under pairs of byte positions, chosen such that two linked ones share a list. Lists of more than LIST are
    split by a further position, again such that no link is lost, until they are short or as fine as can be (16 open bits). Lists are then dealt
    into rooms; in a room each list is compared within itself.
    """
    part = F.col("print").bitwiseAND(F.col("mask"))
    masks = F.array(*[F.lit(signed(m)) for m in finer(0)])
    postings, short = prints.select("print", F.explode(masks).alias("mask")), []
    # Two bytes, three, four; then half-bytes likewise.
    final = 5
    for level in range(final + 1):
        size = postings.groupBy("mask", part.alias("part")).agg(F.count("*").alias("n"))
        long = stored.save(size.where(F.col("n") > LIST).select("mask", "part"))
        if level == final or not long.limit(1).count():
            short.append(postings)
            break
        placed = postings.withColumn("part", part)
        short.append(placed.join(long, ["mask", "part"], "left_anti").select("print", "mask"))
        # A fingerprint can come to a finer list on several ways.
        postings = stored.save(split(placed.join(long, ["mask", "part"], "left_semi")).distinct())
    listed = short[0]
    for more in short[1:]:
        listed = listed.union(more)
    rooms = max(1, listed.count() // ROOM)
    dealt = listed.withColumn("room", F.pmod(F.xxhash64("mask", part), F.lit(rooms)))
    return stored.save(dealt.groupBy("room").applyInArrow(lambda _, room: compared(room), "a long, b long").distinct())


def simhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fingerprint`` (16 lower-case hex digits) and ``component_id`` of every row of ``docs``.

    Two documents are linked if their fingerprints differ in DISTANCE bits or fewer; ``component_id`` is the least key that can be reached. Equal
    fingerprints are one node from the start, so a group of copies is one row of the index however large it is.

    Cases: null, empty and blank texts have no words and fingerprint zero, which links like any other; texts of fewer than four words are one
    shingle; a long text is read whole, its shingles in parts. Repeated rows each get a row. A null key is never a component's id unless all its keys are
    null; then that is null. Ties cannot arise, as the least key is unique. No rows in, no rows out. Other columns are not read, whatever their names.
    """
    stored = Stored(docs.sparkSession)
    marked = stored.save(fingerprints(docs, text, key))
    nodes = stored.save(marked.groupBy("print").agg(F.min("id").alias("least")))
    found = links(nodes.select("print"), stored)
    labels = components(found, stored)
    named = nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    named = stored.save(named)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = stored.save(named.select("print", "label").join(least, "label").select("print", "component_id"))
    for done in (nodes, found, labels, named):
        stored.drop(done)
    return marked.join(by_print, "print").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
