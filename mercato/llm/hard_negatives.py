"""Hard negatives by inner product: blocks along a Hilbert curve, chosen by bounds from the range of every dimension."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import Stored
from mercato.llm.vectors import as_matrix, column_sums, complete, dimensions, scaled

#: Entries become floor(SCALE * x), kept within MOST in size.
SCALE, MOST = 256, (1 << 31) - 1
#: The curve runs through the dimensions of largest variance, this many at most, cut into 2**CURVE_BITS steps each.
CURVE_DIMS, CURVE_BITS = 15, 4
#: Vectors of a block, blocks of a page of zone maps, and anchors that are compared with one page or block at a time, on average.
BLOCK, PAGE, SLICE = 1024, 256, 2048
#: Blocks of every page that a window reads first, to learn which of the others it needs.
FIRST = 2
#: Positives of an anchor, negatives of a window, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90

LONG = (1 << 63) - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (``bits`` bits a dimension, at most 63 in all).

    By the transposition of axes: from the highest bit down, a dimension whose bit is set inverts the lower bits of the first one, others swap
    them with it; a Gray code then turns the result into the curve's bits, the first dimension's first.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            flip = (x[i] >> bit & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (x[i] >> bit & 1)
    return place


def curve(rows: DataFrame, dims: int, n: int, sums: list[int], squares: list[float]) -> DataFrame:
    """``id``, ``label``, ``anchor``, ``x`` (32-bit numbers as bytes) and ``curve`` of every row."""
    means = np.array(sums, float) / max(n, 1)
    spread = np.sqrt(np.maximum(np.array(squares) / max(n, 1) - means**2, 0))
    widest = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMS])
    steps = 1 << CURVE_BITS
    # Steps of equal width over two standard deviations to both sides; the outermost take what lies beyond.
    origin, width = (means - 2 * spread)[widest], np.maximum(4 * spread / steps, 1e-300)[widest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(as_matrix(batch.column("vector"), dims), SCALE, MOST)
            with np.errstate(over="ignore"):
                cells = np.clip(np.floor((x[:, widest] - origin) / width), 0, steps - 1)
            at = hilbert(cells, CURVE_BITS) if len(widest) else np.zeros(len(x), np.int64)
            flat = x.astype("<i4").tobytes()
            packed = [flat[i : i + 4 * dims] for i in range(0, len(flat), 4 * dims)] if dims else [b""] * len(x)
            columns = [batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(packed, pa.binary()), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "anchor", "x", "curve"])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, x binary, curve long")


def numbers(column: pa.ChunkedArray | pa.Array, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def blocks(candidates: DataFrame, dims: int) -> DataFrame:
    """The candidates in the order of the curve, a row per block: its vectors, the labels in it, and the range of each dimension (its zone map).

    ``block`` and ``page`` number the blocks of a task one after the other, so a page holds neighbours on the curve. Vectors of one place on the
    curve are told apart by id and a draw, so that equal ones can be dealt to many tasks.
    """
    draw = F.xxhash64("id", F.monotonically_increasing_id())
    ordered = candidates.withColumn("draw", draw).repartitionByRange("curve", "id", "draw").sortWithinPartitions("curve", "id", "draw")

    def cut(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        x = numbers(table.column("x"), "<i4").reshape(len(ids), dims)
        # By id, so that equal scores are in their order within the block.
        by = np.argsort(ids, kind="stable")
        ids, labels, x = ids[by], labels[by], x[by]
        task = TaskContext.get().partitionId() << 32
        return pa.RecordBatch.from_pydict(
            {
                "page": pa.array([task + number // PAGE]),
                "block": pa.array([task + number]),
                "low": pa.array([x.min(axis=0).astype("<i4").tobytes()], pa.binary()),
                "high": pa.array([x.max(axis=0).astype("<i4").tobytes()], pa.binary()),
                "labels": pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "label_of": pa.array([labels.astype("<i8").tobytes()], pa.binary()),
                "x": pa.array([x.tobytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, number = [], 0, 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK - size)
                batch = batch.slice(len(part))
                waiting.append(part)
                size += len(part)
                if size == BLOCK:
                    yield cut(waiting, number)
                    waiting, size, number = [], 0, number + 1
        if size:
            yield cut(waiting, number)

    return ordered.select("id", "label", "x").mapInArrow(
        run, "page long, block long, low binary, high binary, labels array<long>, ids binary, label_of binary, x binary"
    )


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each anchor can have with a vector of each block.

    Interval arithmetic: a positive entry is least at the dimension's minimum and greatest at its maximum, a negative one the other way round.
    Bounds are widened by what doubles can lose, so none is too narrow.
    """
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    slack = 1e-13 * anchors.shape[1] * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def choose(same: bool, first: bool, dims: int) -> Callable:
    """For one page and one slice of anchors: the blocks that the anchors' windows must read, an anchor's row for each.

    A block is needed if it holds a label that counts, its least score is not above a window and its greatest reaches the window's floor (the score
    that is to be beaten). With ``first`` only the FIRST needed blocks are taken whose middle score is nearest to the window's upper end.
    """

    def run(_: tuple, zones: pa.Table, anchors: pa.Table) -> pa.Table:
        low, high = (numbers(zones.column(c), "<i4").reshape(len(zones), dims).astype(float) for c in ("low", "high"))
        x = numbers(anchors.column("x"), "<i4").reshape(len(anchors), dims).astype(float)
        least, most = bounds(x, low, high)
        own = anchors.column("label").to_numpy()
        held = [np.array(h, np.int64) for h in zones.column("labels").to_pylist()]
        if same:
            usable = np.stack([np.isin(own, h) for h in held], axis=1)
        else:
            usable = np.stack([(own != h[0]) | (len(h) > 1) for h in held], axis=1)
        highs, floors = anchors.column("highs").to_pylist(), anchors.column("floors").to_pylist()
        wanted = np.zeros(usable.shape, bool)
        for w in range(max(map(len, highs), default=0)):
            has = np.array([len(h) > w for h in highs])
            top = np.array([float(h[w]) if len(h) > w else 0.0 for h in highs])[:, None]
            floor = np.array([float(f[w]) if len(f) > w else 0.0 for f in floors])[:, None]
            needed = usable & has[:, None] & (least <= top) & (most >= floor) & (floor <= top)
            if first:
                distance = np.where(needed, np.abs((least + most) / 2 - np.minimum(top, most.max(axis=1, keepdims=True))), np.inf)
                nearest = np.argsort(distance, axis=1, kind="stable")[:, :FIRST]
                picked = np.zeros_like(needed)
                np.put_along_axis(picked, nearest, True, axis=1)
                needed &= picked
            wanted |= needed
        who, where = np.nonzero(wanted)
        chosen = anchors.select(["number", "id", "label", "x", "highs", "floors"]).take(pa.array(who))
        return chosen.append_column("block", zones.column("block").take(pa.array(where)))

    return run


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold every whole number that can arise, else in whole numbers of any size within a long."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(anchors.shape[1], 1)
    if most < 1 << 53:
        return (anchors.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return anchors @ vectors.T
    return np.clip((anchors.astype(object) @ vectors.T.astype(object)), -LONG, LONG).astype(np.int64)


def read(same: bool, dims: int, k: int) -> Callable:
    """For one block and one slice of anchors: the first ``k`` rows of the block in each window, at or above the window's floor."""

    def run(_: tuple, block: pa.Table, anchors: pa.Table) -> pa.Table:
        found: dict[str, list] = {name: [] for name in ("number", "window", "id", "score")}
        if len(block):
            ids, labels = (numbers(block.column(c)) for c in ("ids", "label_of"))
            vectors = numbers(block.column("x"), "<i4").reshape(len(ids), dims).astype(np.int64)
            x = numbers(anchors.column("x"), "<i4").reshape(len(anchors), dims).astype(np.int64)
            score = scores(x, vectors)
            own, who = anchors.column("label").to_numpy()[:, None], anchors.column("id").to_numpy()[:, None]
            usable = (labels == own) & (ids != who) if same else labels != own
            highs, floors = anchors.column("highs").to_pylist(), anchors.column("floors").to_pylist()
            number = anchors.column("number").to_numpy()
            for w in range(max(map(len, highs), default=0)):
                # An anchor without this window gets one that holds nothing.
                top = np.array([h[w] if len(h) > w else -LONG for h in highs])[:, None]
                floor = np.array([f[w] if len(f) > w else LONG for f in floors])[:, None]
                row, column = np.nonzero(usable & (score <= top) & (score >= floor))
                value = score[row, column]
                # Columns are in the order of ids, so a stable sort leaves ties to the smaller one.
                order = np.lexsort((column, -value, row))
                row, column, value = row[order], column[order], value[order]
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
                place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
                kept = place < k
                found["number"].append(number[row[kept]])
                found["window"].append(np.full(kept.sum(), w))
                found["id"].append(ids[column[kept]])
                found["score"].append(value[kept])
        return pa.table({name: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()) for name, parts in found.items()})

    return run


def leading(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window; Spark cuts each task's rows to as many before they shuffle."""
    place = F.row_number().over(Window.partitionBy("number", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(anchors: DataFrame, stored_blocks: DataFrame, same: bool, dims: int, k: int, stored: Stored) -> DataFrame:
    """The first ``k`` rows (``rank``, ``id``, ``score``) of each window: best score first, then least id, with the anchor's label or any other.

    ``anchors`` have ``number``, ``id``, ``label``, ``x`` and the windows' ends ``floors`` and ``highs``. Every window first reads a few blocks of
    each page. The score of its k-th row there is a floor for the rest: only blocks that can hold a better one are read then.
    """
    count = anchors.count()
    slices = max(1, count // SLICE)
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    dealt = lambda df: df.withColumn("slice", F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int"))
    zones = stored_blocks.select("page", "block", "low", "high", "labels", F.explode(every).alias("slice"))
    # Named anew, as both sides of a cogroup come from the same table.
    renamed = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names)).distinct()
    pages = renamed(zones, "page", "slice")
    wanted = "number long, id long, label long, x binary, highs array<long>, floors array<long>, block long"
    rows = "number long, window long, id long, score long"

    def chosen(windows: DataFrame, first: bool) -> DataFrame:
        met = dealt(windows.select("number", "id", "label", "x", "highs", "floors")).join(pages, "slice")
        pairs = zones.groupBy("page", "slice").cogroup(met.groupBy("page", "slice"))
        return dealt(pairs.applyInArrow(choose(same, first, dims), wanted))

    def found(pairs: DataFrame) -> DataFrame:
        needed = renamed(pairs, "block", "slice")
        content = stored_blocks.select("block", "ids", "label_of", "x").join(needed, "block")
        both = content.groupBy("block", "slice").cogroup(pairs.groupBy("block", "slice"))
        return leading(both.applyInArrow(read(same, dims, k), rows), k)

    first = stored.save(chosen(anchors, first=True))
    best = stored.save(found(first))
    full = best.groupBy("number", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
    reached = full.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("window", "last"))).alias("reached"))
    beaten = lambda f, w: F.coalesce(F.col("reached")[w.cast("long")], f)
    raised = anchors.join(reached, "number", "left").withColumn("floors", F.transform("floors", beaten)).drop("reached")
    # Blocks that were read are known by name: bounds that another machine rounds otherwise cannot make a block fall between both rounds.
    rest = chosen(raised, first=False).join(first.select("block", "number"), ["block", "number"], "left_anti")
    more = stored.save(found(stored.save(rest)))
    return leading(best.drop("rank").unionByName(more.drop("rank")), k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    vector: str = "embedding",
    key: str = "vec_id",
) -> DataFrame:
    """Hard negatives of every anchor: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A row's score is its inner product with the anchor, in whole numbers floor(SCALE * x). An anchor's positives are the first POSITIVES other rows of
    its label; for each of them the negatives are the first NEGATIVES rows of other labels whose score lies between LOW and HIGH hundredths of the
    positive's. Both are searches over windows of scores (see :func:`search`): candidates lie in Parquet blocks along a Hilbert curve, with the range of
    each dimension beside them, and interval arithmetic tells which blocks a window must read. Nothing is approximate.

    Cases: rows with a null id, label or vector, or with a null or non-finite entry take no part. Ties go to the smaller id. A row is another one than the
    anchor if its id is; rows that repeat an id count one by one, as anchors too. Shorter vectors are filled up with zeros; entries beyond 32 bits
    count as the largest that fit, scores beyond a long likewise. A positive score of zero or less leaves at most scores of zero. Anchors without
    positives, and tables without anchors or rows, give no rows. Other columns are not read, whatever their names. Labels are whole numbers.
    """
    spark, stored = rows.sparkSession, Stored(rows.sparkSession)
    marked = rows.where(complete(vector)).select(
        F.col(key).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(vector).alias("vector"),
    )
    usable = marked.where("id is not null and label is not null")
    dims = dimensions(usable, "vector")
    n, sums, squares = column_sums(usable, "vector", dims, SCALE, MOST)
    named = {"anchor_id": "long", "positive_id": "long", "rank": "int", "negative_id": "long", "positive_score": "long", "negative_score": "long"}
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in named.items()))
    candidates = stored.save(curve(usable, dims, n, sums, squares))
    cut = stored.save(blocks(candidates, dims))
    ends = F.array(F.lit(-LONG)).alias("floors"), F.array(F.lit(LONG)).alias("highs")
    own = candidates.where("anchor").select(F.monotonically_increasing_id().alias("number"), "id", "label", "x")
    anchors = stored.save(own.select("*", *ends))
    positives = stored.save(search(anchors, cut, same=True, dims=dims, k=POSITIVES, stored=stored))

    hundredth = lambda share: F.col("score").cast("decimal(38,0)") * share / 100
    ends = positives.withColumns({"floor": F.ceil(hundredth(LOW)).cast("long"), "high": F.floor(hundredth(HIGH)).cast("long")})
    listed = F.sort_array(F.collect_list(F.struct("rank", "floor", "high")))
    windows = ends.groupBy("number").agg(listed.alias("w")).select("number", F.col("w.floor").alias("floors"), F.col("w.high").alias("highs"))
    asked = stored.save(anchors.drop("floors", "highs").join(windows, "number"))
    negatives = search(asked, cut, same=False, dims=dims, k=NEGATIVES, stored=stored)

    chosen = positives.select("number", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("number", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("number", F.col("id").alias("anchor_id"))
    result = found.join(chosen, ["number", "window"]).join(ids, "number")
    return result.select(*(F.col(c).cast(t).alias(c) for c, t in named.items()))
