"""Batch changes: tables of changes in, the new version of a table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import materialise

SALTS = 64


def accept_unique(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``new`` with a column ``reason``: null if accepted, else ``exists: key`` or ``repeated: key``. A null key is free; rows
    with one are dealt to ``SALTS`` groups, since they may be most of all."""
    out, reason = new, F.lit(None).cast("string")
    for k in keys:
        held = existing.select(F.col(k).alias(f"__{k}"), F.lit(0).alias(f"__s_{k}")).where(F.col(f"__{k}").isNotNull()).distinct()
        out = out.withColumn("__salt", F.when(F.col(k).isNull(), F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")).otherwise(0))
        out = out.join(held, (F.col(k) == F.col(f"__{k}")) & (F.col("__salt") == F.col(f"__s_{k}")), "left")
        rank = F.row_number().over(W.partitionBy(k, "__salt").orderBy(order))
        out = out.withColumn(f"__r_{k}", rank)
        why = F.when(F.col(f"__{k}").isNotNull(), F.lit(f"exists: {k}")).when(F.col(k).isNotNull() & (F.col(f"__r_{k}") > 1), F.lit(f"repeated: {k}"))
        reason = F.coalesce(reason, why)
    return out.withColumn("reason", reason).select(*new.columns, "reason")


def replace_links(links: DataFrame, changes: DataFrame, targets: DataFrame, owner: str, target: str, locked: DataFrame | None = None) -> DataFrame:
    """(owner, target): owners named in ``changes`` lose their links and get the wanted ones whose target exists.

    ``changes`` (owner, target); a null target only clears. Owners in ``locked`` stay as they are.
    """
    asked = changes if locked is None else changes.join(F.broadcast(locked.select(owner).distinct()), owner, "left_anti")
    kept = links.select(owner, target).join(asked.select(owner).distinct(), owner, "left_anti")
    valid = asked.select(owner, target).join(targets.select(F.col("id").alias(target)), target, "left_semi").select(owner, target).distinct()
    return kept.unionByName(valid)


def patch(table: DataFrame, changes: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Non-null values of ``changes`` win; ``updated_at`` of a changed row is ``as_of``. One change for each key."""
    fields = [c for c in changes.columns if c != key and c in table.columns]
    c = changes.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = table.join(c, table[key] == c["__key"], "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"__{f}"), F.col(f)))
    if "updated_at" in table.columns:
        out = out.withColumn("updated_at", F.when(F.col("__key").isNotNull(), as_of).otherwise(F.col("updated_at")))
    return out.select(*table.columns)


def apply_results(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Status, chunk counts and metadata of processed documents; those being processed or completed are left alone.

    ``results`` (id, ok, chunks, error, meta map). Synonyms ``processed`` and ``error`` become ``completed`` and ``failed``.
    """
    status = F.when(F.col("d.status") == "processed", "completed").when(F.col("d.status") == "error", "failed").otherwise(F.col("d.status"))
    takes = F.col("r.id").isNotNull() & ~status.isin("processing", "completed")
    meta = F.map_concat(F.coalesce("d.meta_data", F.create_map().cast("map<string,string>")), F.coalesce("r.meta", F.create_map().cast("map<string,string>")))
    d, r = documents.alias("d"), results.alias("r")
    return d.join(r, F.col("d.id") == F.col("r.id"), "left").select(
        F.col("d.id"),
        F.when(takes, F.when(F.col("r.ok"), "completed").otherwise("failed")).otherwise(status).alias("status"),
        F.when(takes & F.col("r.ok"), F.col("r.chunks")).otherwise(F.col("d.total_chunks")).alias("total_chunks"),
        F.when(takes, F.col("r.error")).otherwise(F.col("d.processing_error")).alias("processing_error"),
        F.when(takes, meta).otherwise(F.col("d.meta_data")).alias("meta_data"),
    )


def retry(rows: DataFrame, attempt: Callable[[DataFrame], DataFrame], key: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(succeeded, dead letters): ``attempt`` adds ``error`` to each row, null for success; failures are tried again.

    Every attempt is written before it is looked at, so each row is tried once in it and both results tell the same.
    """
    done, todo = None, rows
    for n in range(1, most + 1):
        tried = materialise(attempt(todo).withColumn("attempts", F.lit(n)), "attempt")
        good = tried.where("error is null")
        done = good if done is None else done.unionByName(good)
        failed = tried.where("error is not null")
        if n < most and failed.isEmpty():
            break
        todo = rows.join(failed.select(key), key, "left_semi")
    return done.drop("error"), failed
