"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.graph import components, forest
from ..sources.scratch import materialise, shared_dir

__all__ = ["WORD", "components", "forest", "held_out", "materialise", "prefix_sum", "row_hashes", "rows_per_bucket", "shared_dir", "table"]

#: A word of the contracts: a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's whole contents, 128 bits together, whatever its columns' names and types."""
    every = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        # maps and variants can't be hashed; hashes pass over nulls, so what is null is hashed too
        plain = not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
        every += [c.isNull(), c if plain else F.to_json(F.struct(c.alias("c")))]
    return F.xxhash64(F.lit(1), *every), F.xxhash64(F.lit(2), *every)


def rows_per_bucket(rows: int, least: int = 2048) -> int:
    """Size of the buckets of ``prefix_sum``: the root of the number of rows, so that a key has about
    as many buckets as a bucket has rows and neither level outgrows a task."""
    return max(least, math.isqrt(rows))


def prefix_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` in the order (``bucket``, ``order``).

    Two levels: sums of (key, bucket) are scanned first, so that no task ever holds more than one bucket of a key.
    Keys and bucket hold no nulls; ``bucket`` sorts as ``order`` does.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(starts, [*keys, bucket])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__start")
    )
