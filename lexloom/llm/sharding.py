"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that must stay together. Groups, largest first, go to the least-loaded shard
through a heap. Groups above ``1/(shards * fine)`` of all bytes, which are at most ``shards * fine`` many, are
scheduled one by one; the smaller ones are first gathered by hash into ``shards * fine`` bundles, and the bundles are
scheduled as jobs. The heap therefore never holds more than a fixed number of jobs, whatever the corpus.

Nulls: a null text has no bytes and forms a group with other null texts; a null id is kept. Empty texts form a group.
Repeated rows are in one group. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise, prefix_sum, rows_per_bucket


def group_key(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def schedule(jobs: list[tuple[int, str]], shards: int) -> list[tuple[str, int]]:
    """(job, shard): jobs of (size, name), longest first, to the least-loaded shard; ties by name and shard number."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, name in sorted(jobs, key=lambda j: (-j[0], j[1])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        out.append((name, s))
    return out


def assign_shards(docs: DataFrame, shards: int = 16, fine: int = 512, least_per_bucket: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... within the shard) of every document."""
    text = F.col("text")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit("").cast("binary"))).alias("text_crc32"),
        group_key(text).alias("__group"),
    )
    slim = materialise(slim, "groups")
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = slim.groupBy("__group").agg(F.sum("size").alias("__bytes"))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("__group"), F.lit(shards * fine)).cast("string"))
    job = F.when(F.col("__bytes") * shards * fine > total, F.col("__group")).otherwise(bundle)
    jobs = materialise(groups.groupBy(job.alias("__job")).agg(F.sum("__bytes").alias("__bytes")), "jobs")
    # At most 2 * shards * fine rows: bundles, and groups of which no more fit into all bytes.
    planned = schedule([(r[1], r[0]) for r in jobs.collect()], shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame(planned or [("", 0)], "__job string, shard int")
    heavy = plan.where(~F.col("__job").startswith("b") | (F.length("__job") > 20)).withColumnRenamed("__job", "__group")
    light = plan.where(F.col("__job").startswith("b") & (F.length("__job") <= 20)).withColumnRenamed("shard", "__light")
    placed = (
        slim.withColumn("__job", bundle)
        .join(F.broadcast(heavy), "__group", "left")
        .join(F.broadcast(light), "__job", "left")
        .withColumn("shard", F.coalesce("shard", "__light"))
    )
    buckets = max(16, rows // (shards * rows_per_bucket(rows // shards, least_per_bucket)) + 1)
    placed = placed.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))).withColumn("__one", F.lit(1))
    slotted = prefix_sum(placed, ["shard"], "__bucket", ["doc_id", "text_crc32", "size"], "__one", "slot")
    return slotted.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
