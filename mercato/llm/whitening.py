"""Whitening of embeddings with MLlib's distributed block matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mercato.llm.common import Stored
from mercato.llm.vectors import as_matrix, column_sums, complete, dimensions, scaled

#: Entries become floor(SCALE * c), kept within MOST in size so that they are exact in a double. A common shift of all entries changes no result.
SCALE, MOST = 64, 1 << 52
#: Rows of a block, in tables of up to 2^28 rows.
ROWS = 1024
#: The most components that a row is projected on.
COMPONENTS = 32
#: An eigenvalue below this share of the largest counts as zero: its direction holds rounding only and cannot be whitened.
RANK = 1e-11


@dataclass
class Whitening:
    """``values`` and ``vectors`` (a column each) of the components kept, and the trace of the covariance."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def block_rows(n: int) -> int:
    """Rows of a block: MLlib holds one pair of numbers per block on the driver, so blocks grow once there are 2^18 of them."""
    return min(max(ROWS, n >> 18), 64 * ROWS)


#: A block of a matrix as Spark's writers and MLlib's reader know it.
CELL = T.StructType(
    [
        T.StructField("at", T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])),
        T.StructField("block", MatrixUDT()),
    ]
)


def cell(values: np.ndarray) -> dict:
    """A dense block, row by row."""
    empty = {"colPtrs": None, "rowIndices": None, "isTransposed": True, "type": 1}
    return empty | {"numRows": values.shape[0], "numCols": values.shape[1], "values": values.reshape(-1)}


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(n * x - S) / n, rounded once, and each row's sum of the squares of n * x - S, null where that does not fit a long."""
    # Longs where nothing can overflow, whole numbers of any size elsewhere.
    fits = (int(np.abs(x).max(initial=0)) + 1) * n + max([abs(s) for s in sums], default=0) < 1 << 63
    over_n = x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)
    top = int(np.abs(over_n).max(initial=0))
    squares = over_n * over_n if top * top * max(x.shape[1], 1) < 1 << 63 else over_n.astype(object) ** 2
    return (over_n / n).astype(float), [int(d) if d < 1 << 63 else None for d in squares.sum(axis=1).tolist()]


def centred_blocks(rows: DataFrame, dims: int, n: int, sums: list[int], stored: Stored) -> DataFrame:
    """Blocks of centred rows: ``at`` (block number, 0), ``block``, and the rows' ``ids`` and ``deviations``.

    A row's index is its place within its task plus the number of rows in the tasks before; of each task one count is broadcast. The numbers of tasks
    and places are stored with the rows, so a task that runs again cannot number them in another way. Rows shuffle once, as they are, by block.
    """
    numbered = stored.save(rows.withColumn("number", F.monotonically_increasing_id()))
    task = F.shiftright("number", 33)
    sizes = sorted((r["task"], r["n"]) for r in numbered.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for number, size in sizes:
        starts.append((number, before))
        before += size
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "task long, first long"))
    index = F.col("first") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    size = block_rows(n)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("index")
        x = scaled(as_matrix(group.column("vector").combine_chunks(), dims), SCALE, MOST)
        values, deviations = centred(x, n, sums)
        at = {"_1": key[0].as_py(), "_2": 0}
        ids = group.column("id").to_pylist()
        return pa.Table.from_pylist([{"at": at, "block": cell(values), "ids": ids, "deviations": deviations}], schema=arrow)

    id_type = rows.schema["id"].dataType
    kinds = T.StructType([*CELL, T.StructField("ids", T.ArrayType(id_type)), T.StructField("deviations", T.ArrayType(T.LongType()))])
    arrow = arrow_schema(kinds)
    placed = numbered.withColumn("task", task).join(first, "task").select("id", "vector", index.alias("index"))
    made = placed.groupBy(F.floor(F.col("index") / size).alias("group")).applyInArrow(build, kinds)
    saved = stored.save(made)
    stored.drop(numbered)
    return saved


def arrow_schema(kinds: T.StructType) -> pa.Schema:
    plain = [T.StructField(f.name, f.dataType.sqlType() if isinstance(f.dataType, T.UserDefinedType) else f.dataType) for f in kinds]
    return to_arrow_schema(T.StructType(plain))


def block_matrix(cells: DataFrame, rows: int, dims: int, height: int, width: int) -> BlockMatrix:
    """A block matrix from the ``at`` and ``block`` of a DataFrame; blocks that a DataFrame holds stay in the JVM."""
    java = callMLlibFunc("createBlockMatrix", cells.select("at", "block"), rows, dims, height, width)
    return BlockMatrix(java, rows, dims)


def scatter(cells: DataFrame, n: int, dims: int) -> np.ndarray:
    """Transposed rows times rows, of stored blocks one below the other.

    The product is one block, which would be one task. MLlib cuts the inner dimension into splits, multiplies within each, and adds the small products.
    """
    size = block_rows(n)
    blocks = -(-n // size)
    java = block_matrix(cells, size, dims, n, dims)._java_matrix_wrapper._java_model
    parallel = 4 * cells.sparkSession.sparkContext.defaultParallelism
    splits = max(1, min(blocks, max(parallel, blocks // 64)))
    return BlockMatrix(java.transpose().multiply(java, splits), dims, dims).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int = COMPONENTS) -> Whitening:
    """The first ``most`` principal directions whose eigenvalue is not zero."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK * max(values.max(initial=0.0), 0.0)]
    return Whitening(values[order], vectors[:, order], float(np.trace(covariance)))


def projected(cells: DataFrame, n: int, matrix: np.ndarray) -> DataFrame:
    """The blocks times the whitening matrix, with the same ``at``.

    MLlib deals a product's blocks out as a square grid, so a tall and narrow product would get only the root of its partitions. The
    blocks of rows are therefore put side by side as panels (block i becomes row i / p of panel i % p) and multiplied by the block-diagonal matrix that has
    the whitening matrix for every panel. The products are the same, no block is copied, and the grid is square.
    """
    size, (dims, kept) = block_rows(n), matrix.shape
    blocks = -(-n // size)
    side = max(1, math.isqrt(blocks))
    i = F.col("at._1")
    moved = cells.select(F.struct(F.floor(i / side), i % side).alias("at"), "block")
    wide = block_matrix(moved, size, dims, -(-blocks // side) * size, side * dims)
    weights = DenseMatrix(dims, kept, matrix.ravel(order="F").tolist())
    context = cells.sparkSession.sparkContext
    diagonal = context.parallelize([((p, p), weights) for p in range(side)], min(side, context.defaultParallelism))
    product = wide.multiply(BlockMatrix(diagonal, dims, kept, side * dims, side * kept))
    out = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("at", "block")
    return out.select(F.struct((F.col("at._1").cast("long") * side + F.col("at._2")).alias("_1"), F.lit(0).cast("long").alias("_2")).alias("at"), "block")


def unpacked(blocks: DataFrame, id_type: T.DataType) -> DataFrame:
    """``id``, ``deviation``, ``component`` and ``whitened`` of every row and component of blocks that come with their ``ids`` and ``deviations``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, deviations in zip(*(batch.column(c) for c in ("block", "ids", "deviations")), strict=True):
                shape = (block["numRows"].as_py(), block["numCols"].as_py())
                order = "C" if block["isTransposed"].as_py() else "F"
                # The last block may have been filled up.
                values = block["values"].values.to_numpy().reshape(shape, order=order)[: len(ids)]
                rows = pa.array(np.repeat(np.arange(len(ids)), shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(rows),
                        deviations.values.take(rows),
                        pa.array(np.tile(np.arange(1, shape[1] + 1, dtype=np.int32), len(ids))),
                        pa.array(np.ascontiguousarray(values).reshape(-1)),
                    ],
                    names=["id", "deviation", "component", "whitened"],
                )

    kind = id_type.simpleString()
    return blocks.select("block", "ids", "deviations").mapInArrow(run, f"id {kind}, deviation long, component int, whitened double")


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``, a row per vector and component.

    Every complete vector is fitted and projected. The centred rows become a block matrix, its transpose times itself the covariance; that is
    decomposed on the driver (as many rows as dimensions) and the block matrix is multiplied by the eigenvectors over the roots
    of their eigenvalues. ``identity_error`` is measured on the projected rows by a second product.

    Cases: rows with a null vector or a null or non-finite entry are left out, of null, repeated and other keys alike; each row counts by itself. Shorter vectors
    are filled up with zeros. Directions without variance have no component, so equal rows, a single row and no rows give no rows. Equal
    eigenvalues leave the choice of directions within their space to the decomposition, the same for all rows. ``deviation`` is null where it
    does not fit a long, and scaled entries are kept within 2^52 in size. Other columns are not read, whatever their names; long tables are
    never in one task.
    """
    spark, stored = rows.sparkSession, Stored(rows.sparkSession)
    fit = rows.where(complete(vector)).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    dims = dimensions(fit, "vector")
    n, sums, _ = column_sums(fit, "vector", dims, SCALE, MOST)
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not dims:
        return spark.createDataFrame([], schema)
    blocks = centred_blocks(fit, dims, n, sums, stored)
    model = components(scatter(blocks, n, dims) / n)
    kept = len(model.values)
    if not kept:
        return spark.createDataFrame([], schema)
    white = stored.save(projected(blocks, n, model.matrix))
    error = float(np.abs(scatter(white, n, kept) / n - np.eye(kept)).max())
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    named = blocks.select(F.col("at._1").alias("number"), "ids", "deviations")
    both = white.select(F.col("at._1").alias("number"), "block").join(named, "number")
    return unpacked(both, kind).select(
        F.col("id").alias(key),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
