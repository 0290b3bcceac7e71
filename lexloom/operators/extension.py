"""Pluggable parts by name, file processors by extension and MIME type, and chunkers as table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf

from ..sources import files
from . import chunk


def _decoded(content: Column) -> Column:
    return files.decode(content)["text"]


#: parts by kind and name; plain text files have a processor from the start
_PARTS: dict[tuple[str, str], Callable] = {
    **{("processor", name): _decoded for name, kind in files.FORMATS.items() if kind == "text"},
    **{("mime", name): _decoded for name, kind in files.MIME_KINDS.items() if kind == "text"},
}


def _register(kind: str, name: str, f: Callable) -> None:
    if not callable(f):
        raise TypeError(f"{kind} {name!r} can't be called")
    _PARTS[kind, name] = f


def register_chunker(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """``f`` takes (document_id, text) and returns chunks; ``chunker(name)`` and ``chunk.dispatch`` take it."""
    _register("chunker", name, f)


def register_embedder(name: str, f: Callable[[list[str]], list[list[float]]]) -> None:
    _register("embedder", name, f)


def register_tokenizer(name: str, f: Callable) -> None:
    """``f`` takes a text column and returns an array column."""
    _register("tokenizer", name, f)


def unregister(kind: str, name: str) -> None:
    _PARTS.pop((kind, name), None)


def part(kind: str, name: str) -> Callable:
    if (kind, name) not in _PARTS:
        raise ValueError(f"no {kind} {name!r}")
    return _PARTS[kind, name]


def chunkers() -> dict[str, Callable]:
    return {n: f for (kind, n), f in _PARTS.items() if kind == "chunker"}


def register_processor(extension: str, f: Callable[[Column], Column], mime: str | None = None) -> None:
    """``f`` turns a column of file contents into a column of text, for files named with ``extension`` (``.md``) or of the
    MIME type; in either case of letters. It replaces what was registered so before."""
    if not extension.startswith("."):
        raise ValueError(f"an extension begins with a dot: {extension!r}")
    _register("processor", extension.lower(), f)
    if mime:
        _register("mime", mime.lower(), f)


def unregister_processor(extension: str, mime: str | None = None) -> None:
    unregister("processor", extension.lower())
    if mime:
        unregister("mime", mime.lower())


def supported_formats() -> dict[str, list[str]]:
    return {title: sorted(n for kind, n in _PARTS if kind == key) for title, key in (("extensions", "processor"), ("mime_types", "mime"))}


def process(rows: DataFrame) -> DataFrame:
    """``rows`` (filename, content[, mime]) with ``processor``, the extension or MIME type whose processor takes the file,
    and ``text``, what it makes of the content. The MIME type goes before the extension; a file that nothing is
    registered for has null in both. A null content is handed on, and a processor written in Python sees nulls
    where files are others' work. All in one pass."""
    formats = supported_formats()
    mime = F.lower("mime") if "mime" in rows.columns else F.lit(None)
    suffix = files.extension(F.col("filename"))
    known = F.when(mime.isin(formats["mime_types"]), mime).when(suffix.isin(formats["extensions"]), suffix)
    owners: dict[Callable, list[str]] = {}
    for (kind, name), f in _PARTS.items():
        if kind in ("processor", "mime"):
            owners.setdefault(f, []).append(name)
    text = F.lit(None).cast("string")
    for f, names in owners.items():
        own = F.col("processor").isin(names)
        made = f(F.when(own, F.col("content")))
        if not isinstance(made, Column):
            raise TypeError(f"the processor of {names[0]!r} gives no column")
        text = F.when(own, made.cast("string")).otherwise(text)
    return rows.withColumn("processor", known).withColumn("text", text)


def _sentences(text: str | None) -> list[str]:
    return [s for p in re.findall("[^。!?\n]*[。!?\n]|[^。!?\n]+", text or "") if (s := p.strip())]


def _chunk_batch(batch: pa.RecordBatch, cut: Callable[[str], list[str]]) -> pa.RecordBatch:
    """Chunks of a batch of documents; ids are taken as they stand in it, of whatever type."""
    made = [cut(t) if t else [] for t in batch["text"].to_pylist()]
    of = pa.array([i for i, c in enumerate(made) for _ in c], pa.int32())
    index = pa.array([k for c in made for k in range(len(c))], pa.int32())
    return pa.record_batch([batch["document_id"].take(of), index, pa.array([x for c in made for x in c], pa.string())], names=["document_id", "chunk_index", "content"])


def register_table_functions(spark: SparkSession, id_type: str = "long") -> None:
    """Chunkers for SQL. For lateral calls, row by row: ``recursive_chunks(text, size, overlap)`` and
    ``semantic_chunks(text, most)``. For whole tables (document_id, text), in Arrow batches and without a shuffle:
    ``recursive_chunk_table(table(t), size, overlap)`` and ``semantic_chunk_table(table(t), most)``, where
    ``document_id`` has the type ``id_type``, since such functions can't take it from the table."""

    class Recursive:
        def eval(self, text: str, size: int, overlap: int):
            for i, c in enumerate(chunk.split_recursively(text, size, overlap) if text else []):
                yield i, c

    class Semantic:
        def eval(self, text: str, most: int):
            yield from enumerate(chunk.pack_greedily(_sentences(text), most))

    class RecursiveTable:
        def eval(self, documents: pa.RecordBatch, size: pa.Array, overlap: pa.Array):
            if documents.num_rows:
                most, shared = size[0].as_py(), overlap[0].as_py()
                yield _chunk_batch(documents, lambda t: chunk.split_recursively(t, most, shared))

    class SemanticTable:
        def eval(self, documents: pa.RecordBatch, most: pa.Array):
            if documents.num_rows:
                longest = most[0].as_py()
                yield _chunk_batch(documents, lambda t: chunk.pack_greedily(_sentences(t), longest))

    shape = "chunk_index int, content string"
    spark.udtf.register("recursive_chunks", udtf(Recursive, returnType=shape))
    spark.udtf.register("semantic_chunks", udtf(Semantic, returnType=shape))
    spark.udtf.register("recursive_chunk_table", arrow_udtf(RecursiveTable, returnType=f"document_id {id_type}, {shape}"))
    spark.udtf.register("semantic_chunk_table", arrow_udtf(SemanticTable, returnType=f"document_id {id_type}, {shape}"))
