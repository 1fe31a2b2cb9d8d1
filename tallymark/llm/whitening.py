"""Whitening of embeddings with distributed block matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, finite

#: Numbers in a block of the row matrix: 2 MB. Blocks are made where rows lie, without a shuffle.
BLOCK = 1 << 18
#: Integers beyond this count as this, so that sums of four billion rows fit into 64 bits.
FARTHEST = 2**31
#: Components with less of the largest variance than this have none.
FLAT = 1e-13


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``; the side they share is summed in ``splits`` tasks before it meets in one block."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


_BLOCKS = T.StructType(
    [T.StructField("at", T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])), T.StructField("m", MatrixUDT())]
)


def _into_blocks(height: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (index, numbers), rising in index and with no block in two tasks, to matrix blocks; absent rows are zero."""

    def block(number: int, values: np.ndarray) -> pa.RecordBatch:
        at = pa.StructArray.from_arrays([pa.array([number], pa.int64()), pa.array([0], pa.int64())], ["i", "j"])
        none = pa.array([None], pa.list_(pa.int32()))
        ends = pa.array([0, values.size], pa.int32())
        parts = {
            "type": pa.array([1], pa.int8()), "numRows": pa.array([len(values)], pa.int32()), "numCols": pa.array([width], pa.int32()),
            "colPtrs": none, "rowIndices": none, "values": pa.ListArray.from_arrays(ends, pa.array(values.ravel())), "isTransposed": pa.array([True]),
        }
        return pa.RecordBatch.from_arrays([at, pa.StructArray.from_arrays(list(parts.values()), list(parts))], ["at", "m"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, values, last = -1, np.zeros((height, width)), 0
        for batch in batches:
            index = batch.column(0).to_numpy()
            numbers = batch.column(1).flatten().to_numpy().reshape(len(index), width)
            for number in np.unique(index // height).tolist():
                if number != current:
                    if current >= 0:
                        yield block(current, values[: last + 1])
                    current, values = number, np.zeros((height, width))
                own = index // height == number
                places = index[own] % height
                values[places] = numbers[own]
                last = int(places.max())
        if current >= 0:
            yield block(current, values[: last + 1])

    return work


def _out_of_blocks(height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of one block column to rows (index, numbers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, columns = m["numRows"].as_py(), m["numCols"].as_py()
                order = "C" if m["isTransposed"].as_py() else "F"
                values = m["values"].values.to_numpy().reshape((rows, columns), order=order)
                index = pa.array(np.arange(rows) + next(iter(at.values())) * height)
                ends = pa.array(np.arange(rows + 1, dtype=np.int32) * columns)
                yield pa.RecordBatch.from_arrays([index, pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel()))], ["index", "white"])

    return work


def whiten(
    vectors: DataFrame,
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Vectors on their first principal components, each scaled to unit variance.

    Entries become integers x = floor(scale * c) + shift. All rows are the fit list:
    centred rows are indexed into the blocks of a distributed matrix, its
    transpose times itself is the scatter, whose eigenvectors are found on the
    driver (a square of a vector's length), and the matrix times the whitening
    matrix gives the projected rows. Rows are centred before anything is
    multiplied, from exact sums.

    Returns per row ``id`` (type as given), ``n`` (rows of the fit list), ``deviation``
    (decimal: sum over dimensions of (n x - S)^2, exact, S their sums),
    ``whitened`` (up to ``components`` numbers, by falling eigenvalue), ``explained``
    (shares of the variance, an array of the same length) and ``identity_error``
    (largest entry by which their covariance differs from the identity).

    Rows whose vector is null, empty, or holds null or non-finite entries are
    dropped, and so are those of another length than most vectors have (of equally
    frequent ones the longest). Integers beyond 2^31 either way count as 2^31;
    deviations of over 38 digits are null. Ids may be null or repeat. A component
    without variance, as all are of one row or of equal rows, has null ``whitened``
    and does not count in ``identity_error``; without any variance ``explained`` is
    null too. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    out = (
        f"id {kind}, n bigint, deviation decimal(38,0), whitened array<double>, "
        "explained array<double>, identity_error double"
    )
    numbers = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), numbers.alias("v")).where(finite(F.col("v")))

    def whole(c):
        return F.floor(F.greatest(F.least(F.floor(c * scale) + shift * 1.0, F.lit(float(FARTHEST))), F.lit(float(-FARTHEST))))

    # The number of a row: its partition's first, and its place in it; read from what is written, so it stays.
    rows = cut(rows.select("id", F.size("v").alias("width"), F.transform("v", whole).alias("x"), F.monotonically_increasing_id().alias("place")))
    usual = rows.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if usual is None:
        return spark.createDataFrame([], out)
    width, n = usual["width"], usual["n"]
    rows = rows.where(F.col("width") == width)
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    sums = sorted(sums.collect())  # one row per dimension
    mean = [row["s"] // n for row in sums]
    rest = [row["s"] - n * m for row, m in zip(sums, mean)]
    span = max(max(row["high"] - m, m - row["low"]) for row, m in zip(sums, mean))

    y = F.zip_with("x", F.array(*[F.lit(m).cast("bigint") for m in mean]), lambda x, m: x - m)
    rows = rows.withColumn("y", y).withColumn("part", F.shiftright("place", 33))
    height = max(1, BLOCK // width)
    blocks, starts = 0, []
    for part, least, most in rows.groupBy("part").agg(F.min("place"), F.max("place")).orderBy("part").collect():  # one row per task
        starts.append((part, blocks * height - least))
        blocks += -(-(most - least + 1) // height)
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, "part bigint, first bigint")), "part")
    rows = rows.withColumn("index", F.col("first") + F.col("place"))
    centred = F.zip_with("y", F.array(*[F.lit(t / n) for t in rest]), lambda y, t: y - t)
    numbered = rows.select("index", centred.alias("centred")).mapInArrow(_into_blocks(height, width), _BLOCKS)
    java = callMLlibFunc("createBlockMatrix", numbered, height, width, blocks * height, width)
    matrix = BlockMatrix(java, height, width).persist(StorageLevel.MEMORY_AND_DISK)
    splits = max(1, min(blocks, 16 * spark.sparkContext.defaultParallelism))
    covariance = _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray() / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(components, width)
    lively = [bool(v > FLAT * values[0] and v > 0) for v in values[:kept]]
    weights = directions[:, :kept] * [v**-0.5 if real else 0.0 for v, real in zip(values, lively)]
    block = spark.sparkContext.parallelize([((0, 0), Matrices.dense(width, kept, weights.ravel("F")))], 1)
    projected = _product(matrix, BlockMatrix(block, width, kept), 1)
    error = np.abs(_product(projected.transpose(), projected, splits).toLocalMatrix().toArray() / n - np.eye(kept))
    error = float(error[np.ix_(lively, lively)].max(initial=0.0))
    spread = float(values.sum())
    explained = [float(v) / spread if spread > 0 else None for v in values[:kept]]

    found = callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model).toDF("at", "m")
    found = found.mapInArrow(_out_of_blocks(height), "index bigint, white array<double>")
    real = F.array(*[F.lit(is_real) for is_real in lively])
    whitened = F.zip_with("white", real, lambda w, is_real: F.when(is_real, w))
    return (
        rows.select("id", "index", _deviation(n, rest, width * span * max(span, n)).alias("deviation"))
        .join(found, "index")
        .select(
            "id", F.lit(n).cast("bigint").alias("n"), "deviation", whitened.alias("whitened"),
            F.array(*[F.lit(e).cast("double") for e in explained]).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def _deviation(n: int, rest: list[int], bound: int) -> Column:
    """Sum of (n y - T)^2 over the column ``y``, T being ``rest``: two sums a row, in 64 bits where ``bound`` fits."""
    sized = "bigint" if bound < 2**62 else "decimal(38,0)"

    def added(numbers: Column) -> Column:
        total = F.aggregate(numbers, F.lit(0).cast(sized), lambda a, b: (a + b).cast(sized))
        return total.cast("decimal(38,0)")

    def exact(number: int) -> Column:
        return F.lit(str(number)).cast("decimal(38,0)")

    squares = added(F.transform("y", lambda y: (y.cast(sized) * y.cast(sized)).cast(sized)))
    parts = F.array(*[F.lit(str(t)).cast(sized) for t in rest])
    crossed = added(F.zip_with("y", parts, lambda y, t: (y.cast(sized) * t).cast(sized)))
    inner = F.try_subtract(F.try_multiply(exact(n), squares), F.try_multiply(exact(2), crossed))
    return F.try_add(F.try_multiply(exact(n), inner), exact(sum(t * t for t in rest))).cast("decimal(38,0)")
