"""Embedding whitening by principal components, with MLlib's BlockMatrix.

Vectors become integers, floor(scale * c). The fit list is each distinct integer vector once. Its rows, centred, are indexed
and cut into distributed blocks; the transpose times the blocks gives the scatter, of which the driver takes the
eigenvectors (its size is the square of the vectors' width, whatever the number of rows). A further
block product with the whitening matrix projects the rows, which are joined back to all vectors.

The scatter's product is split along the rows, so that no task sums up more than its share of the blocks.

Nulls: vectors that are null, or hold a null or a non-finite entry, are left out, as are empty ones and those whose width
is not the commonest (of equally common widths the smaller). Repeated vectors count once in the fit and are rows of the
result each; ids may be null, repeated or of any type. Ties: components of equal eigenvalue span a plane in which the
axes are arbitrary. Components without variance (an eigenvalue below a 1e-12th of the largest) can't be scaled and are
left out, so equal vectors alone give an empty result, as does an empty table. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise, prefix_sum, rows_per_bucket

#: Rows of a block.
BLOCK_ROWS = 1024
#: Eigenvalues below this share of the largest are no variance.
NO_VARIANCE = 1e-12


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = vectors.select("vec_id", "embedding").where((F.size("embedding") > 0) & finite)
    common = whole.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return whole.where(F.size("embedding") == (common["width"] if common else 0)).select("vec_id", integers(F.col("embedding"), scale).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` (x, all distinct) with ``index``, gapless from 0."""
    hashed = materialise(rows.withColumn("h", F.xxhash64("x")), "distinct-vectors")
    n = hashed.count()
    buckets = max(1, n // rows_per_bucket(n))
    placed = hashed.select("x", "h", F.lit(0).alias("k"), F.pmod("h", F.lit(buckets)).alias("b"), F.lit(1).cast("long").alias("one"))
    return materialise(prefix_sum(placed, ["k"], "b", ["h", "x"], "one", "index").select("index", "x"), "indexed-vectors")


def block_matrix(rows: DataFrame, vector: Column, width: int) -> BlockMatrix:
    """The rows (index, ...) as a matrix of blocks of ``BLOCK_ROWS`` rows and the whole width."""
    dense = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(dense).toBlockMatrix(BLOCK_ROWS, width)


def scatter(m: BlockMatrix, splits: int) -> np.ndarray:
    """m' m, summed in ``splits`` tasks first. The Python class offers no number of splits, the Java one does."""
    own = m._java_matrix_wrapper._java_model
    product = BlockMatrix(own.transpose().multiply(own, splits), m.colsPerBlock, m.colsPerBlock)
    return product.toLocalMatrix().toArray()


def whitening(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding): a row for
    each vector and each of the first ``components`` components.

    ``deviation`` is the sum over dimensions of (n x - S)^2, exact; ``explained`` the component's share of all variance;
    ``identity_error`` the largest entry of the whitened fit list's covariance minus the identity.
    """
    kept = materialise(usable(vectors, scale), "integer-vectors")
    fit = indexed(kept.select("x").distinct())
    sums = sorted(fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect())
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not sums:
        return empty
    n, width = sums[0]["n"], len(sums)
    total = F.array(*[F.lit(int(r["s"])) for r in sums])
    mean = F.array(*[F.lit(r["s"] / n) for r in sums])
    m = block_matrix(fit, F.zip_with(F.col("x").cast("array<double>"), mean, lambda c, a: c - a), width)
    splits = max(1, min(-(-n // BLOCK_ROWS), spark.sparkContext.defaultParallelism * 4))
    covariance = scatter(m, splits) / n
    value, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [i for i in np.argsort(-value, kind="stable")[:components] if value[i] > NO_VARIANCE * value[-1]]
    if not order or value[-1] <= 0:
        return empty
    # one sign for each axis: its largest entry is positive
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(axis=0), order])
    matrix = DenseMatrix(width, len(order), (axes / np.sqrt(value[order])).ravel(order="F").tolist())
    blocks = spark.sparkContext.parallelize([((0, 0), matrix)], 1)
    projected = m.multiply(BlockMatrix(blocks, width, len(order)))
    error = float(np.abs(scatter(projected, splits) / n - np.eye(len(order))).max())
    frame = projected.toIndexedRowMatrix()._java_matrix_wrapper
    rows = _rows(spark, frame)
    gap = F.zip_with("x", total, lambda c, s: (F.lit(int(n)) * c - s).cast("decimal(19,0)"))
    deviation = F.aggregate(gap, F.lit(0).cast("decimal(38,0)"), lambda t, g: (t + g * g).cast("decimal(38,0)")).cast("long")
    scored = fit.select("index", "x", deviation.alias("deviation")).join(rows, "index").select("x", "deviation", F.posexplode("w").alias("p", "whitened"))
    share = F.array(*[F.lit(float(value[i] / value.sum())) for i in order])
    return kept.join(scored, "x").select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, (F.col("p") + 1).cast("int")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _rows(spark, frame) -> DataFrame:
    """(index, w) of a matrix of indexed rows."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.common import callMLlibFunc

    found = callMLlibFunc("getIndexedRows", frame._java_model)
    return found.select("index", vector_to_array(F.col("vector")).alias("w"))
