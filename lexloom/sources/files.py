"""Raw files: listing, decoding, validation, fingerprints, and the manifest of what has been processed."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise

# Formats, types and encodings.
FORMATS = {".pdf": "pdf", ".docx": "word", ".doc": "word", ".txt": "text", ".md": "text", ".markdown": "text", ".rst": "text", ".log": "text"}
MIME_KINDS = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word", "application/msword": "word", "text/plain": "text", "text/markdown": "text"}
MIME_TYPES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".txt": "text/plain",
    ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".json": "application/json", ".csv": "text/csv", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".zip": "application/zip",
}
TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".rst", ".log", ".csv", ".json", ".xml", ".html", ".htm")
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp")
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin1", "ascii")
LARGEST = 50 * 1024 * 1024


def extension(path: Column) -> Column:
    """Lower case, with the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, extension) of the files under ``folder`` that match ``pattern``, recursively, without
    reading contents; empty files too, hidden ones (``_name``, ``.name``) not.

    Folders are listed by tasks, one level of the tree after another, so neither names nor folders gather on the
    driver; one task holds the names of one folder, without those below it. Tasks reach local files
    and the stores that Arrow knows; any other store, and a ``folder`` with a pattern in it, is listed through Spark.
    A folder that isn't there is an error."""
    store = None if re.search(r"[*?\[{]", folder) else _store(folder)
    found = _indexed(spark, folder, pattern) if store is None else _walked(spark, *store).where(F.regexp_extract("path", "([^/]*)$", 1).rlike(_glob(pattern)))
    return found.withColumn("extension", extension(F.col("path")))


def _open(scheme: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if scheme == "file:" else fs.FileSystem.from_uri(scheme)[0]


def _store(folder: str) -> tuple[str, str] | None:
    """(prefix, path): what Spark writes before a path of this store, and the path as Arrow takes it; None if Arrow
    doesn't know the store."""
    local = re.fullmatch("(?:file:)?/*(/.*)", folder)
    if local:
        return "file:", local[1].rstrip("/") or "/"
    try:
        _, path = fs.FileSystem.from_uri(folder.rstrip("/"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return (folder.rstrip("/").removesuffix(path), path) if folder.rstrip("/").endswith(path) else None


def _walked(spark: SparkSession, prefix: str, root: str) -> DataFrame:
    """(path, size, modified) of the files below ``root``."""
    top = _open(prefix if prefix == "file:" else prefix + root).get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(prefix + root)
    shape = "path string, size long, ms long, is_folder boolean"

    def entries(batches):
        names = ["path", "size", "ms", "is_folder"]
        for batch in batches:
            for folder in batch["path"].to_pylist():
                store, rows = _open(prefix if prefix == "file:" else prefix + folder), []
                for info in store.get_file_info(fs.FileSelector(folder)):
                    if info.type in (fs.FileType.File, fs.FileType.Directory) and not _hidden(info.base_name):
                        rows.append((info.path, info.size, info.mtime_ns and info.mtime_ns // 1_000_000, info.type == fs.FileType.Directory))
                for i in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[i : i + 10_000]))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=names)

    first = [(root, top.size, top.mtime_ns and top.mtime_ns // 1_000_000, top.type == fs.FileType.Directory)]
    level = spark.createDataFrame(first, shape)
    levels = []
    while True:
        levels.append(level.where("not is_folder"))
        folders = level.where("is_folder").select("path")
        if folders.isEmpty():
            break
        # dealt out anew at each level, since one folder may hold most of the next
        level = materialise((folders if len(levels) == 1 else folders.repartition("path")).mapInArrow(entries, shape), "listing")
    every = reduce(DataFrame.unionAll, levels)
    return every.select(F.concat(F.lit(prefix), "path").alias("path"), "size", F.timestamp_millis("ms").alias("modified"))


def _hidden(name: str) -> bool:
    """As Spark skips them: partition folders such as ``_k=1`` are none."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _glob(pattern: str) -> str:
    """A file name pattern (``*``, ``?``, ``[abc]``, ``[!abc]``, ``{one,other}``) as a regular expression."""
    special = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    parts = re.findall(r"\[[!^]?[^\]]+\]|\{[^{}]*\}|.", pattern, re.S)

    def one(p):
        if p.startswith("[") and len(p) > 1:
            return "[" + re.sub("^[!^]", "^", p[1:-1]).replace("\\", "\\\\") + "]"
        if p.startswith("{") and len(p) > 1:
            return "".join(special.get(c) or re.escape(c) for c in p)
        return special[p] if p in "*?" else re.escape(p)

    return "(?s)^" + "".join(one(p) for p in parts) + "$"


def _indexed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, size, modified) through Spark's file index, which holds the names on the driver. Spark plans no split for an
    empty file; such files are added from the index."""
    files = read_files(spark, folder, pattern)
    found = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    plain = lambda c: F.regexp_replace(F.try_url_decode(c), "^([a-z]+):/+", "$1:/")
    names = spark.createDataFrame([(n,) for n in files.inputFiles()], "name string")
    empty = names.join(found.select(plain(F.regexp_replace("path", "\\+", "%2B")).alias("listed")), plain(F.regexp_replace("name", "\\+", "%2B")) == F.col("listed"), "left_anti")
    jvm, conf, rows = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for r in empty.collect():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["name"]))
        status = path.getFileSystem(conf).getFileStatus(path)
        rows.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    more = spark.createDataFrame(rows, "path string, size long, ms long").select("path", "size", F.timestamp_millis("ms").alias("modified"))
    return found.unionByName(more)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def decode(content: Column, encodings: tuple[str, ...] = ENCODINGS) -> Column:
    """Struct (encoding, text): the first encoding that reads the bytes strictly, else the first with replacements."""

    @F.pandas_udf("encoding string, text string")
    def read(values: pd.Series) -> pd.DataFrame:
        def one(b):
            if b is None:
                return None, None
            for e in encodings:
                try:
                    return e, bytes(b).decode(e)
                except UnicodeDecodeError:
                    continue
            return encodings[0], bytes(b).decode(encodings[0], "replace")

        return pd.DataFrame([one(b) for b in values], columns=["encoding", "text"])

    return read(content)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.coalesce(key, F.lit("")))


def file_kind(filename: Column, mime: Column | None = None) -> Column:
    """pdf, word, text or null; the MIME type goes before the extension."""
    by_name = _lookup(FORMATS, extension(filename))
    return by_name if mime is None else F.coalesce(_lookup(MIME_KINDS, mime), by_name)


def validate(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``files`` (filename, size[, mime]) with ``outcome`` valid, invalid or unsupported, and ``reason``."""
    kind = file_kind(F.col("filename"), F.col("mime") if "mime" in files.columns else None)
    reason = F.when(F.col("size").isNull(), "no size").when(F.col("size") <= 0, "empty").when(F.col("size") > largest, "too large")
    out = files.withColumn("kind", kind).withColumn("reason", F.when(F.col("kind").isNull(), "unsupported format").otherwise(reason))
    return out.withColumn("outcome", F.when(F.col("kind").isNull(), "unsupported").when(F.col("reason").isNotNull(), "invalid").otherwise("valid"))


def content_hash(content: Column, algorithm: str = "md5") -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm in ("sha1", "sha256"):
        return F.sha1(content) if algorithm == "sha1" else F.sha2(content, 256)
    raise ValueError(f"unknown hash {algorithm!r}")


def fingerprint(path: Column, size: Column, modified: Column) -> Column:
    return F.md5(F.concat_ws("|", path, size.cast("string"), F.unix_micros(modified).cast("string")).cast("binary"))


def unprocessed(files: DataFrame, manifest: DataFrame, as_of: Column, ttl: int = 3600) -> DataFrame:
    """Files whose ``fingerprint`` isn't in the manifest (fingerprint, processed_at), or only with an entry out of date."""
    fresh = manifest.where(F.unix_seconds(as_of) - F.unix_seconds("processed_at") < ttl).select("fingerprint")
    return files.join(fresh, "fingerprint", "left_anti")


def manifest_stats(manifest: DataFrame, as_of: Column, ttl: int = 3600) -> DataFrame:
    age = F.unix_seconds(as_of) - F.unix_seconds("processed_at")
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(age >= ttl).alias("expired"))


def drop_expired(manifest: DataFrame, as_of: Column, ttl: int = 3600) -> DataFrame:
    return manifest.where(F.unix_seconds(as_of) - F.unix_seconds("processed_at") < ttl)


def mime_type(filename: Column) -> Column:
    return F.coalesce(_lookup(MIME_TYPES, extension(filename)), F.lit("application/octet-stream"))


def is_text_file(filename: Column) -> Column:
    return extension(filename).isin(*TEXT_EXTENSIONS)


def is_archive_file(filename: Column) -> Column:
    return extension(filename).isin(*ARCHIVE_EXTENSIONS)


def is_image_file(filename: Column) -> Column:
    return extension(filename).isin(*IMAGE_EXTENSIONS)


def line_count(text: Column) -> Column:
    """Lines as a reader of the file counts them: a last line end begins no line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))
