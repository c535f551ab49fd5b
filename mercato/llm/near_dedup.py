"""Near duplicates by consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import Stored, whole

#: Parts over which the rows that repeat a kept row are dealt.
PARTS = 256
#: Words of a shingle and the least weighted Jaccard similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Samples per text: BANDS bands of ROWS. At similarity 0.8 all bands miss with probability (1 - 0.8**3)**12 < 0.0002.
BANDS, ROWS = 12, 3
#: A pair goes on to exact verification if this many samples agree; at similarity 0.8 fewer do with probability 0.0001.
AGREEING = 19
#: Members of a bucket that one task compares with as many others.
ROOM = 1024
#: Document frequencies above this share lower a shingle's weight; all rarer ones weigh alike. At most (shingles per text) / COMMON are above it.
COMMON = 1 / 256
#: Hash buckets of the first counting pass; their mean load stays below COMMON for texts of up to BUCKETS * COMMON shingles on average.
BUCKETS = 1 << 18
#: The most common shingles weigh 1, the rare ones 1 + DAMPING: a group of near copies that holds a third of all texts stays above the threshold.
DAMPING = 0.5
#: Shingles that are sampled together.
CHUNK = 1 << 14
#: Shingles of a batch that a task hands on, and rows of a batch that it reads at once.
BATCH, SLICE = 1 << 18, 512

U64 = np.uint64


class WordHashes(dict):
    """64-bit hashes of words; emptied at half a million words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def rolled_shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Shingle hashes in their order; a text of fewer words is one shingle, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    width = min(SHINGLE, len(h))
    rolled = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        rolled = rolled * U64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return mixed(rolled + U64(width))


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    return np.unique(rolled_shingles(text, hashes), return_counts=True)


def cut_texts(rows: DataFrame) -> DataFrame:
    """``node`` with its distinct shingles as ``hashes`` (64 bits each) and ``repeats``: (position, count) of those that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = WordHashes(), ["node", "hashes", "repeats"]
        nodes, hashes, repeats, size = [], [], [], 0
        for batch in batches:
            for node, text in zip(batch.column("node"), batch.column("text"), strict=True):
                h, n = shingles(text.as_py(), words)
                often = np.flatnonzero(n > 1)
                nodes.append(node.as_py())
                hashes.append(h.tobytes())
                repeats.append(np.stack([often, n[often]]).tobytes())
                size += len(h)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(hashes, pa.binary()), pa.array(repeats, pa.binary())], names=names)
                    nodes, hashes, repeats, size = [], [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(hashes, pa.binary()), pa.array(repeats, pa.binary())], names=names)

    return rows.select("node", "text").mapInArrow(run, "node string, hashes binary, repeats binary")


def shingle_counts(hashes: bytes, repeats: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`shingles` gave, read back from a row of :func:`cut_texts`."""
    found = np.frombuffer(hashes, U64)
    counts = np.ones(len(found), np.int64)
    at, often = np.frombuffer(repeats, np.int64).reshape(2, -1)
    counts[at] = often
    return found, counts


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ``hashes`` of a few rows after another, as one array each."""
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            yield np.frombuffer(b"".join(batch.column("hashes").slice(start, SLICE).to_pylist()), U64)


class Weights:
    """TF-IDF weight of shingles: the count times a damped inverse document frequency."""

    def __init__(self, common: list[tuple[int, int]], documents: int):
        order = sorted(common)
        self.hashes = np.array([h for h, _ in order], np.int64).view(U64)
        by = np.argsort(self.hashes)
        self.hashes = self.hashes[by]
        share = np.array([n for _, n in order], float)[by] / max(documents, 1)
        self.idf = 1.0 + DAMPING * np.log(1.0 / np.maximum(share, COMMON)) / math.log(1.0 / COMMON)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(hashes), 1.0 + DAMPING)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
            idf[found] = self.idf[at[found]]
        return counts * idf


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: a row of BANDS * ROWS samples for each text, whose shingles begin at ``starts``.

    For each shingle and sample, r and c are gamma(2, 1) and b is uniform, all fixed by the shingle. With t = floor(ln w / r + b) and
    ln y = r (t - b) the sample is the shingle with the least ln a = ln c - ln y - r. That value depends on (shingle, t) alone, so two
    texts have the same one just when they drew the same sample; it is kept as a fixed-point number.
    """
    log_weight = np.log(weights).astype(np.float32)
    out = np.empty((len(starts), BANDS * ROWS), np.int32)
    low, scale = U64((1 << 21) - 1), np.float32(2.0**-21)
    half = np.float32(0.5)
    for k in range(BANDS * ROWS):
        z = mixed(hashes + U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        u1 = ((z & low).astype(np.float32) + half) * scale
        u2 = (((z >> U64(21)) & low).astype(np.float32) + half) * scale
        b = (z >> U64(43)).astype(np.float32) * scale
        z = mixed(z)
        u3 = ((z & low).astype(np.float32) + half) * scale
        u4 = (((z >> U64(21)) & low).astype(np.float32) + half) * scale
        r = -np.log(u1 * u2)
        c = -np.log(u3 * u4)
        log_a = np.log(c) - r * (np.floor(log_weight / r + b) - b + np.float32(1.0))
        out[:, k] = np.floor(np.minimum.reduceat(log_a, starts) * np.float32(65536.0))
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit value per band."""
    parts = signatures.astype(np.int64).astype(U64).reshape(len(signatures), BANDS, ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for i in range(ROWS):
        value = mixed(value * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return value.view(np.int64)


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights): the sum of the smaller weights over that of the larger."""
    _, a, b = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    both = np.minimum(left[1][a], right[1][b]).sum()
    total = left[1].sum() + right[1].sum() - both
    return float(both / total) if total else 0.0


def common_shingles(cut: DataFrame, documents: int) -> list[tuple[int, int]]:
    """Shingles that more than COMMON of all documents have, with their document counts; ``cut`` is a stored :func:`cut_texts`.

    Pass one counts documents' shingles per hash bucket; a common shingle makes its bucket heavy, as that holds all its documents. Pass two
    counts the documents of each shingle of the heavy buckets. Both passes sum per task before they shuffle and cover all documents;
    what reaches the driver is bounded by BUCKETS bits and by (shingles per document) / COMMON rows.
    """
    least = max(2, math.ceil(COMMON * documents))

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for found in in_slices(batches):
            counts += np.bincount((found & U64(BUCKETS - 1)).view(np.int64), minlength=BUCKETS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(counts[full])], names=["bucket", "n"])

    totals = cut.select("hashes").mapInArrow(by_bucket, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    heavy = np.zeros(BUCKETS, bool)
    heavy[[r["bucket"] for r in totals.where(F.col("n") >= least).select("bucket").collect()]] = True

    def by_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A document has each of its shingles once here, so occurrences are documents.
        for found in in_slices(batches):
            known, counts = np.unique(found[heavy[(found & U64(BUCKETS - 1)).view(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "n"]
            )

    counted = cut.select("hashes").mapInArrow(by_shingle, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return [(r["shingle"], r["n"]) for r in counted.where(F.col("n") >= least).collect()]


def signatures(cut: DataFrame, weights: Weights) -> DataFrame:
    """``node`` with its ``bands`` and ``samples`` for every row of a stored :func:`cut_texts` that has a shingle."""

    def flush(nodes: list, parts: list) -> pa.RecordBatch:
        sizes = np.array([len(h) for h, _ in parts])
        starts = np.cumsum(sizes) - sizes
        drawn = samples(np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts]), starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(nodes, pa.string()),
                pa.array(list(band_hashes(drawn)), pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in drawn], pa.binary()),
            ],
            names=["node", "bands", "samples"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, parts, size = [], [], 0
        for batch in batches:
            for node, hashes, repeats in zip(*(batch.column(c) for c in ("node", "hashes", "repeats")), strict=True):
                h, n = shingle_counts(hashes.as_py(), repeats.as_py())
                if not len(h):
                    continue
                nodes.append(node.as_py())
                parts.append((h, weights.of(h, n)))
                size += len(h)
                if size >= CHUNK:
                    yield flush(nodes, parts)
                    nodes, parts, size = [], [], 0
        if nodes:
            yield flush(nodes, parts)

    return cut.mapInArrow(run, "node string, bands array<long>, samples binary")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b`` with both ``samples``) that enough samples agree on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("left", "right"))
                same = (left == right).reshape(len(batch), -1).sum(axis=1) >= AGREEING
                yield batch.select(["a", "b"]).filter(pa.array(same))

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a string, b string")


def shingle_sets(
    needed: DataFrame, rows: DataFrame, keepers: DataFrame, weights: Weights, stored: Stored
) -> DataFrame:
    """Shingle hashes and weights of the needed nodes, cut from one text each."""
    chosen = rows.join(needed.join(keepers, "node"), ["node", "id_text"], "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), hashes) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([h.tobytes() for h, _ in found], pa.binary()),
                    pa.array([weights.of(h, n).astype(np.float32).tobytes() for h, n in found], pa.binary()),
                ],
                names=["node", "hashes", "weights"],
            )

    return stored.save(
        chosen.select("node", "text").mapInArrow(cut, "node string, hashes binary, weights binary").dropDuplicates(["node"])
    )


def verified(pairs: DataFrame, rows: DataFrame, keepers: DataFrame, weights: Weights, stored: Stored) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity reaches SIMILAR.

    Only texts that a pair needs are cut into shingles again, once per distinct text. A pair then gets the shingles of its ``b`` and of its ``a`` by
    plain joins, so Spark can split a text with very many pairs.
    """
    sets = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), rows, keepers, weights, stored)
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("ha", "wa", "hb", "wb")]
            near = [
                similarity((np.frombuffer(ha, U64), np.frombuffer(wa, np.float32)), (np.frombuffer(hb, U64), np.frombuffer(wb, np.float32)))
                >= SIMILAR - 1e-6
                for ha, wa, hb, wb in zip(*(c.to_pylist() for c in columns), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    links = stored.save(pairs.join(right, "b").join(left, "a").mapInArrow(compare, "a string, b string"))
    stored.drop(sets)
    return links


def rooms(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that are not one class yet, dealt into rooms of at most about 2 * ROOM members.

    Links can only be missing between members of different labels, so only members outside a bucket's largest label (``minor``) need to
    be compared: part i of them meets part j of all members in room (bucket, i, j). Pairs with the pivot are done. A bucket's members reach its
    row in as many salts as it has parts.
    """
    labelled = placed.where("node != pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    salts = F.ceil(F.col("members") / ROOM)
    labelled = labelled.withColumn("draw", F.xxhash64("node")).withColumn("salt", F.pmod("draw", salts)).withColumn("salts", salts)
    by_label = labelled.groupBy("bucket", "salts", "label").agg(F.count("*").alias("n"))
    mixed_ = (
        by_label.groupBy("bucket", "salts")
        .agg(F.max(F.struct("n", "label")).alias("largest"), F.sum("n").alias("members"))
        .where("members > largest.n")
        .select(
            "bucket",
            F.col("largest.label").alias("largest"),
            F.ceil(F.col("members") / ROOM).alias("parts"),
            F.ceil((F.col("members") - F.col("largest.n")) / ROOM).alias("minor_parts"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        )
    )
    met = labelled.drop("members", "salts").join(mixed_, ["bucket", "salt"]).withColumn("minor", F.col("label") != F.col("largest"))
    rest = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = F.transform(rest("minor_parts"), lambda i: F.struct(i.alias("i"), F.pmod("draw", "parts").alias("j"), F.lit(False).alias("asks")))
    as_minor = F.transform(rest("parts"), lambda j: F.struct(F.pmod("draw", "minor_parts").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    both = F.when(F.col("minor"), F.concat(as_member, as_minor)).otherwise(as_member)
    return met.select("bucket", "band", "node", "label", F.explode(both).alias("at")).select(
        "bucket", "band", "node", "label", "at.*"
    )


def askers_and_members(room: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row of a room, the member rows that enough samples agree with and that no earlier band has brought together."""
    asks = np.array(room.column("asks").to_pylist(), dtype=bool)
    drawn = np.frombuffer(b"".join(room.column("samples").to_pylist()), np.int32).reshape(len(asks), -1)
    labels, nodes = np.array(room.column("label").to_pylist()), np.array(room.column("node").to_pylist())
    band = room.column("band")[0].as_py()
    members = np.flatnonzero(~asks)
    for x in np.flatnonzero(asks):
        same = drawn[members] == drawn[x]
        met_before = same.reshape(len(members), BANDS, ROWS)[:, :band].all(axis=2).any(axis=1)
        good = (same.sum(axis=1) >= AGREEING) & ~met_before & (labels[members] != labels[x]) & (nodes[members] != nodes[x])
        if good.any():
            yield x, members[good]


def linked_in_rooms(
    dealt: DataFrame, drawn: DataFrame, rows: DataFrame, keepers: DataFrame, weights: Weights, stored: Stored
) -> DataFrame:
    """Links between labels that the rooms hold, verified exactly; a pair of labels that a room has joined is not asked for again there."""
    key = ["bucket", "i", "j"]

    def survey(room: pa.Table) -> pa.Table:
        wanted = set()
        for x, near in askers_and_members(room):
            wanted.add(x)
            wanted.update(near.tolist())
        return room.take(pa.array(sorted(wanted), pa.int64()))

    kinds = "bucket long, band int, node string, label string, i long, j long, asks boolean, samples binary"
    with_drawn = dealt.join(drawn, "node").select("bucket", "band", "node", "label", "i", "j", "asks", "samples")
    kept = stored.save(with_drawn.groupBy(*key).applyInArrow(survey, kinds))
    sets = shingle_sets(kept.select("node").distinct(), rows, keepers, weights, stored)

    def verify(room: pa.Table) -> pa.Table:
        label, parent = room.column("label").to_pylist(), {}
        node = room.column("node").to_pylist()
        own = [
            (np.frombuffer(h.as_py(), U64), np.frombuffer(w.as_py(), np.float32))
            for h, w in zip(room.column("hashes"), room.column("weights"), strict=True)
        ]

        def root(x: str) -> str:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for x, near in askers_and_members(room):
            for m in near.tolist():
                if root(label[x]) != root(label[m]) and similarity(own[x], own[m]) >= SIMILAR - 1e-6:
                    parent[root(label[x])] = root(label[m])
                    found.append((node[x], node[m]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string())})

    links = stored.save(kept.join(sets, "node").groupBy(*key).applyInArrow(verify, "a string, b string"))
    stored.drop(sets)
    stored.drop(kept)
    return links


def components(links: DataFrame, stored: Stored) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for every node with a link.

    Labels travel along links and then jump to the label of their label, until none changes; every round is stored.
    """
    both = stored.save(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = stored.save(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        after = met.join(jump, "best", "left").select(
            "node", F.least("best", F.coalesce("further", "best")).alias("label"), F.col("label").alias("was")
        )
        stepped = stored.save(after)
        changed = stepped.where("label != was").limit(1).count()
        stored.drop(labels)
        labels = stepped.drop("was")
        if not changed:
            return labels


def classes(docs: DataFrame, stored: Stored, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their ``node`` (a digest of the text), and for each linked node its ``label``; see :func:`near_dedup`."""
    text_col = whole(text)
    marked = docs.withColumn("__node", F.md5(text_col.cast("binary")))
    rows = marked.select(
        F.col("__node").alias("node"), text_col.alias("text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id_text")
    )
    # Texts are cut once; both counting passes and the sampling read the stored shingles.
    cut = stored.save(cut_texts(rows))
    documents = cut.count()
    weights = Weights(common_shingles(cut, documents), documents)
    signed = stored.save(signatures(cut, weights).dropDuplicates(["node"]))
    stored.drop(cut)
    # One row of each text stands for its copies.
    keepers = rows.groupBy("node").agg(F.min("id_text").alias("id_text"))
    buckets = signed.select("node", F.posexplode("bands").alias("band", "bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    placed = stored.save(buckets.join(pivots, "bucket"))
    drawn = signed.select("node", "samples")
    candidates = placed.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(stored.save(agreeing(with_samples(candidates, drawn))), rows, keepers, weights, stored)
    labels = components(links, stored)
    # A bucket whose members are not yet in one class can hold links between members other than its pivot.
    dealt = stored.save(rooms(placed.where("members > 2"), labels))
    more = linked_in_rooms(dealt, drawn, rows, keepers, weights, stored)
    if more.limit(1).count():
        stored.drop(labels)
        labels = components(links.union(more), stored)
    for done in (signed, placed, dealt, links, more):
        stored.drop(done)
    return marked, labels


def with_samples(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """Both texts' samples beside each pair."""
    left = drawn.select(F.col("node").alias("a"), F.col("samples").alias("left"))
    right = drawn.select(F.col("node").alias("b"), F.col("samples").alias("right"))
    return pairs.join(right, "b").join(left, "a")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``class_id``, ``class_size`` and ``kept``.

    Two documents are linked if their texts are equal or the weighted Jaccard similarity of their TF-IDF shingles is at least SIMILAR; a class is a
    connected set of documents, named by its least id, which is the one that is kept. Equal texts are one node from the start. Nodes that
    share a band meet in a bucket; all members are verified against the bucket's least node. Where a bucket is not one class after that, the
    members outside its largest class are compared with all others in rooms of bounded size, until the classes are joined or every pair of
    different classes has been looked at, so no class is left apart because its bucket is large.

    Cases: null and empty texts are equal to each other and to nothing else; texts of fewer than five words are one shingle. A null id is never a
    class id unless its class has no other. One row of each class is kept: of texts with the class id the one of least digest, and of rows that
    repeat both, any. No rows in, no rows out. Input columns named like a result column are replaced.
    """
    stored = Stored(docs.sparkSession)
    marked, labels = classes(docs, stored, text, key)
    ours = ("class_id", "class_size", "kept")
    names = [c for c in docs.columns if c not in ours]
    # Node by node: how its class is named. Both tables are stored, so the joins below are plain and can be split.
    by_id = marked.groupBy("__node", F.col(key).alias("__id")).agg(F.count("*").alias("n"))
    # ``copies``: rows of the node that have its least id, or all if none has an id.
    nodes = by_id.groupBy("__node").agg(
        F.min("__id").alias("least"), F.coalesce(F.min_by("n", "__id"), F.sum("n")).alias("copies"), F.sum("n").alias("n")
    )
    named = nodes.join(labels.withColumnRenamed("node", "__node"), "__node", "left").withColumn(
        "label", F.coalesce("label", "__node")
    )
    named = stored.save(named)
    stored.drop(labels)
    keeper = F.min(F.struct(F.col("least").isNull(), "least", "__node", "copies"))
    totals = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), keeper.alias("keeper"))
    totals = stored.save(
        totals.select("label", "class_id", "class_size", F.col("keeper.__node").alias("__keeper"), F.col("keeper.copies").alias("__copies"))
    )
    by_node = stored.save(named.select("__node", "label").join(totals, "label").drop("label"))
    stored.drop(named)
    found = (
        marked.select(*names, "__node")
        .join(by_node, "__node")
        .withColumn("kept", F.col(key).eqNullSafe(F.col("class_id")) & (F.col("__node") == F.col("__keeper")))
    )
    if not totals.where("__copies > 1").limit(1).count():
        return found.select(*names, *ours)
    # Rows that repeat the kept id and text: first one of each part stays, then one of all parts.
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    repeats = marked.select(*names, "__node", part.alias("__part")).join(by_node.where("__copies > 1 and __node = __keeper"), "__node")
    repeats = repeats.where(F.col(key).eqNullSafe(F.col("class_id")))
    number = F.row_number().over(Window.partitionBy("__node", "__part").orderBy("class_size"))
    numbered = repeats.withColumn("__first", number == 1)
    firsts = F.row_number().over(Window.partitionBy("__node", F.when(~F.col("__first"), F.col("__part"))).orderBy("__part"))
    one = numbered.withColumn("kept", F.when(F.col("__first"), firsts == 1).otherwise(False))
    return found.where("not kept or __copies = 1").select(*names, *ours).unionByName(one.select(*names, *ours))
