"""Writers: chunks, events and vectors; cascading deletes; collection checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists, materialise, remove


def nested_results(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Completed documents with their chunks in order as an array."""
    c = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content", "page_number", "section_title"))).alias("chunks"))
    return documents.where("status = 'completed'").join(c, "document_id", "left")


def flat_results(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows for CSV: line ends in contents become blanks, carriage returns go."""
    done = documents.where("status = 'completed'").select("document_id")
    line = F.regexp_replace(F.regexp_replace("content", "\r", ""), "\n", " ")
    return chunks.join(done, "document_id", "left_semi").select("chunk_id", "chunk_index", line.alias("content"), "page_number", "section_title")


def write_results(documents: DataFrame, chunks: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        nested_results(documents, chunks).write.mode("overwrite").json(path)
    elif kind == "csv":
        flat_results(documents, chunks).write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "txt":
        flat_results(documents, chunks).select("content").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def export_events(events: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "json":
        events.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in events.dtypes]
        events.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def bucket_of(document: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document), F.lit(buckets)).cast("int")


def vector_rows(chunks: DataFrame, vectors: DataFrame, buckets: int = 64) -> DataFrame:
    """Rows of the vector table: id ``document_chunk``, content, embedding, metadata as JSON of strings, and the bucket to
    partition by. Raises when the job runs if a chunk has no vector or a vector no chunk."""
    joined = chunks.join(vectors.withColumn("__v", F.lit(1)), ["document_id", "chunk_index"], "full")
    both = F.col("content").isNotNull() & F.col("__v").isNotNull()
    checked = F.when(both, F.concat_ws("_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))).otherwise(F.raise_error(F.lit("chunks and vectors differ")))
    meta = F.to_json("metadata") if "metadata" in chunks.columns else F.lit("{}")
    return joined.select(checked.alias("id"), "document_id", "chunk_index", "content", "embedding", meta.alias("metadata"), bucket_of(F.col("document_id"), buckets).alias("bucket"))


class VectorTable:
    """A table of ``vector_rows`` under ``path`` whose documents can be replaced and deleted.

    Rows lie in buckets of documents. A change writes new versions of the buckets that it touches beside the old ones,
    and then one small file that names them; what no such file names isn't read, so a write that was cut short
    isn't seen, and readers that began before go on reading what they began with until ``vacuum``. Changes are for one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> dict[int, int]:
        """The version of each bucket, of which there are as many as ``vector_rows`` was told."""
        if not exists(self.spark, f"{self.path}/commits"):
            return {}
        commits = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/commits")
        return {r["bucket"]: r["v"] for r in commits.groupBy("bucket").agg(F.max("version").alias("v")).collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame | None:
        """Rows of the given buckets; other folders aren't read."""
        by_version: dict[int, list[int]] = {}
        for bucket, v in versions.items():
            by_version.setdefault(v, []).append(bucket)
        if not by_version:
            return None
        own = functools.reduce(Column.__or__, [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in by_version.items()])
        return self.spark.read.parquet(f"{self.path}/rows").where(own).drop("version")

    def rows(self) -> DataFrame | None:
        """The table as it is now; None before the first write."""
        return self._read(self._versions())

    def _replace(self, documents: DataFrame, rows: DataFrame | None, buckets: list[int]) -> None:
        versions = self._versions()
        version = max(versions.values(), default=0) + 1
        old = self._read({b: v for b, v in versions.items() if b in buckets})
        kept = None if old is None else old.join(documents, "document_id", "left_anti")
        parts = [x for x in (kept, rows) if x is not None]
        if not buckets or not parts:
            return
        new = functools.reduce(lambda a, b: a.unionByName(b), parts).withColumn("version", F.lit(version))
        # a version that was cut short before it was named may lie there
        ordered = new.repartition("bucket").sortWithinPartitions("bucket", "document_id", "chunk_index")
        remove(self.spark, f"{self.path}/rows/version={version}")
        ordered.write.mode("append").partitionBy("version", "bucket").parquet(f"{self.path}/rows")
        named = self.spark.createDataFrame([(b, version) for b in buckets], "bucket int, version int")
        named.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def upsert(self, rows: DataFrame) -> None:
        """``rows`` (of ``vector_rows``) take the place of all rows of their documents. A document without an id is new each
        time."""
        rows = materialise(rows, "vectors")
        buckets = [r[0] for r in rows.select("bucket").distinct().collect()]
        self._replace(rows.select("document_id").distinct(), rows, buckets)

    def delete(self, documents: DataFrame, buckets: int = 64) -> None:
        """Rows of ``documents`` (document_id) go."""
        doomed = materialise(documents.select("document_id").distinct(), "doomed")
        touched = [r[0] for r in doomed.select(bucket_of(F.col("document_id"), buckets)).distinct().collect()]
        self._replace(doomed, None, [b for b in touched if b in self._versions()])

    def vacuum(self) -> None:
        """Delete the versions that no bucket has any more."""
        versions = set(self._versions().values())
        for v in range(1, max(versions, default=0)):
            if v not in versions:
                remove(self.spark, f"{self.path}/rows/version={v}")


def cascade_delete(parents: DataFrame, doomed: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(new versions by name, (name, deleted) counts): rows of ``doomed`` (id) go from the parents and, by their foreign
    key, from each child table."""
    ids = doomed.select(F.col(key).alias("__id")).distinct()
    kept = {"parents": parents.join(ids, parents[key] == ids["__id"], "left_anti")}
    counts = parents.join(ids, parents[key] == ids["__id"], "left_semi").agg(F.count("*").alias("deleted")).select(F.lit("parents").alias("name"), "deleted")
    for name, (table, foreign) in children.items():
        kept[name] = table.join(ids, table[foreign] == ids["__id"], "left_anti")
        gone = table.join(ids, table[foreign] == ids["__id"], "left_semi").agg(F.count("*").alias("deleted"))
        counts = counts.unionByName(gone.select(F.lit(name).alias("name"), "deleted"))
    return kept, counts


def collection_stats(items: DataFrame, column: str = "embedding", width: int | None = None) -> DataFrame:
    """Rows, smallest and largest width, vectors of another width, vectors with a component that is no number."""
    c = F.col(column)
    wrong = F.count_if(F.size(c) != width) if width is not None else F.lit(0).cast("long")
    return items.agg(F.count("*").alias("n"), F.min(F.size(c)).alias("min_width"), F.max(F.size(c)).alias("max_width"), wrong.alias("wrong_width"), F.count_if(F.exists(c, lambda x: F.isnan(x))).alias("with_nan"))
