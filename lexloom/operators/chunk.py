"""Chunking: documents (document_id, text) in, chunks (document_id, chunk_index, content, section_title, ...) out.

Documents that are null or empty give no chunk. Chunk indices are 0, 1, ... within a document.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.slices import slices
from ..functions.text import is_heading, is_legal, strip
from ..sources.scratch import shared_dir

# Patterns and titles.
CLAUSE_STARTS = (r"^第[一二三四五六七八九十]+条", r"^第[0-9]+条", r"^[一二三四五六七八九十]、", r"^[0-9]+\.", r"^[一二三四五六七八九十](?U:\s)")
SIMPLE_CLAUSE_STARTS = (r"^第[一二三四五六七八九十]+条", r"^第[0-9]+条", r"^[一二三四五六七八九十]、", r"^[0-9]+\.")
CHAPTERS = (r"^第[一二三四五六七八九十]+章", r"^第[0-9]+章", r"^(?i:CHAPTER)(?U:\s+)[IVXLCDMivxlcdm]+", r"^(?i:Chapter)(?U:\s+)[0-9]+")
PREAMBLE = "前言"
SEPARATORS = ("\n\n", "\n", "。", "！", "？", " ", "")
STRATEGIES = {".md": "markdown", ".markdown": "markdown", ".pdf": "pages", ".docx": "paragraphs", ".doc": "paragraphs"}


def _windows(size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(size - overlap))).cast("int")


def fixed_size_places(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(document_id, chunk_index) of ``fixed_size``, for which no text is cut."""
    held = docs.where(F.length("text") > 0)
    return held.select("document_id", F.explode(F.sequence(F.lit(0), _windows(size, overlap) - 1)).alias("chunk_index"))


def fixed_size(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters, each ``overlap`` into the one before; stops at the end of the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step, n = size - overlap, F.col("chars")
    docs = docs.where(F.length("text") > 0).withColumns({"chars": F.length("text"), "windows": _windows(size, overlap)})

    def windows(content) -> Column:
        one = lambda i: F.struct(content(i).alias("content"), (i * step).alias("start"), F.least(i * step + size, n).alias("finish"))
        return F.transform(F.sequence(F.lit(0), F.col("windows") - 1), one)

    cut = windows(lambda i: F.substring(F.col("text"), i * step + 1, F.lit(size)))
    if overlap <= step:  # substring() and length() count from the text's start each time, so pieces are cut at one go
        head = lambda i: F.coalesce(F.substring(F.get("pieces", i), 1, overlap), F.lit(""))
        cut = F.when(F.is_valid_utf8("text"), windows(lambda i: F.concat(F.get("pieces", i), head(i + 1)))).otherwise(cut)
        docs = docs.withColumn("pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    rows = docs.select("document_id", F.posexplode(cut).alias("chunk_index", "c"))
    return rows.select("document_id", "chunk_index", "c.content", "c.start", "c.finish")


def pack_greedily(parts: list[str], most: int, joiner: str = " ", least: int = 0, keep_tail: bool = True, slack: int = 1) -> list[str]:
    """Join parts while the length plus ``slack`` stays within ``most``; a chunk below ``least`` goes on growing."""
    out, now = [], ""
    for part in parts:
        if len(now) + len(part) + slack <= most or len(now) < least:
            now = now + joiner + part if now else part
        else:
            if now:
                out.append(now)
            now = part
    if now and (keep_tail or len(now) >= least):
        out.append(now)
    return out


def _helper(docs: DataFrame, cut: Callable[[str], list]) -> DataFrame:
    """Chunks of a row-local helper: ``cut`` gives contents, or (content, section_title) pairs, of one text."""

    id_type = to_arrow_type(docs.schema["document_id"].dataType)
    schema = pa.schema([("document_id", id_type), ("chunk_index", pa.int32()), ("content", pa.string()), ("section_title", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame in slices(batch.select(["text"]).append_column("at", pa.array(np.arange(batch.num_rows))), "text"):
                rows = []
                for at, text in zip(frame["at"], frame["text"]):
                    for i, c in enumerate(cut(text) if text else []):
                        rows.append((at, i, *(c if isinstance(c, tuple) else (c, None))))
                at, index, content, title = zip(*rows) if rows else ((),) * 4
                ids = batch["document_id"].take(pa.array(at, pa.int64())).cast(id_type)
                yield pa.record_batch([ids, pa.array(index, pa.int32()), pa.array(content, pa.string()), pa.array(title, pa.string())], schema=schema)

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, chunk_index int, content string, section_title string")


def semantic(docs: DataFrame, most: int = 1000, least: int = 200, ends: str = "。！？!?\n", keep_tail: bool = False) -> DataFrame:
    """Sentences packed to ``most``; a chunk under ``least`` grows past it; a tail under ``least`` is dropped by default."""
    split = re.compile(f"[{re.escape(ends)}]")
    return _helper(docs, lambda t: pack_greedily([s for p in split.split(t) if (s := p.strip())], most, least=least, keep_tail=keep_tail))


def plain_semantic(docs: DataFrame, most: int = 1000, ends: str = "。!?\n") -> DataFrame:
    """Sentences with their marks packed to ``most``; the tail is kept."""
    sentence = re.compile(f"[^{re.escape(ends)}]*[{re.escape(ends)}]|[^{re.escape(ends)}]+")
    return _helper(docs, lambda t: pack_greedily([s for p in sentence.findall(t) if (s := p.strip())], most))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.posexplode(F.transform(F.split("text", "\n"), strip)).alias("line_no", "line")).where("line <> ''")


def _matches(patterns) -> Column:
    return F.col("line").rlike("|".join(f"(?:{p})" for p in patterns))


def _islands(lines: DataFrame, opens: Column) -> DataFrame:
    """Consecutive lines of a document from one that opens to the next, as (document_id, island, content, first)."""
    numbered = lines.withColumn("island", F.sum(opens.cast("int")).over(W.partitionBy("document_id").orderBy("line_no")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return numbered.groupBy("document_id", "island").agg(ordered.alias("l"), *([F.max("chapter").alias("chapter")] if "chapter" in lines.columns else []))


def _indexed(chunks: DataFrame, order: list[str]) -> DataFrame:
    return chunks.withColumn("chunk_index", (F.row_number().over(W.partitionBy("document_id").orderBy(*order)) - 1).cast("int"))


def legal_islands(docs: DataFrame, clauses=CLAUSE_STARTS, chapters=CHAPTERS, compat: bool = False) -> DataFrame:
    """(document_id, island, content, section_title, chapter) of clauses of any length.

    A chapter heading closes a clause and is no content. ``compat`` stamps a clause that a heading closes with that
    heading's chapter, as the reference does.
    """
    w = W.partitionBy("document_id").orderBy("line_no")
    marked = _lines(docs).withColumn("is_chapter", _matches(chapters))
    title = F.when(F.col("is_chapter"), F.col("line"))
    marked = marked.withColumn("chapter_no", F.sum(F.col("is_chapter").cast("int")).over(w)).withColumn("before", F.coalesce(F.last(title, True).over(w), F.lit("")))
    if compat:
        closing = F.first(title, True).over(w.rowsBetween(1, W.unboundedFollowing))
        marked = marked.withColumn("closing", closing)
    body = marked.where(~F.col("is_chapter"))
    opens = _matches(clauses) | (F.lag("chapter_no", 1, -1).over(w) != F.col("chapter_no"))
    body = body.withColumn("opens", opens)
    numbered = body.withColumn("island", F.sum(F.col("opens").cast("int")).over(w))
    agg = [F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), F.max("before").alias("before"), F.max("chapter_no").alias("chapter_no")]
    if compat:
        agg.append(F.max_by("closing", "line_no").alias("closing"))
    grouped = numbered.groupBy("document_id", "island").agg(*agg)
    last = F.lead("chapter_no").over(W.partitionBy("document_id").orderBy("island"))
    chapter = F.when((last != F.col("chapter_no")), F.col("closing")).otherwise(F.col("before")) if compat else F.col("before")
    return grouped.select("document_id", "island", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"), F.col("l")[0]["line"].alias("section_title"), chapter.alias("chapter"))


def split_long_clause(text: str, title: str, most: int) -> list[tuple[str, str]]:
    """(content, section_title): paragraphs joined by blank lines within ``most``; an oversize paragraph is cut into
    groups of sentences only if nothing is pending, else it passes whole after what was pending."""
    out: list[tuple[str, str]] = []
    pending = ""

    def emit(content, kind):
        out.append((content, f"{title} - {kind}{len(out) + 1}"))

    for paragraph in filter(None, (p.strip() for p in text.split("\n"))):
        if len(pending) + len(paragraph) + 2 <= most:
            pending = f"{pending}\n\n{paragraph}" if pending else paragraph
        elif pending:
            emit(pending, "分段")
            pending = paragraph
        else:
            for group in pack_greedily([s for p in re.split("[。！？!?]", paragraph) if (s := p.strip())], most):
                emit(group, "句子组")
    if pending:
        emit(pending, "分段")
    return out


def legal(docs: DataFrame, most: int = 1200, compat: bool = False, **patterns) -> DataFrame:
    """Legal clauses; those over ``most`` characters are split. Short clauses stay in the JVM."""
    islands = legal_islands(docs, compat=compat, **patterns)
    short = islands.where(F.length("content") <= most).withColumn("piece", F.lit(0))
    kind = docs.schema["document_id"].dataType.simpleString()

    id_type = to_arrow_type(docs.schema["document_id"].dataType)
    schema = pa.schema([("document_id", id_type), ("island", pa.int64()), ("content", pa.string()), ("section_title", pa.string()), ("chapter", pa.string()), ("piece", pa.int32())])

    def run(batches):
        for batch in batches:
            for frame in slices(batch.select(["island", "content", "section_title", "chapter"]).append_column("at", pa.array(np.arange(batch.num_rows))), "content"):
                rows = [
                    (r.at, r.island, c, t, "" if compat else r.chapter, i)
                    for r in frame.itertuples()
                    for i, (c, t) in enumerate(split_long_clause(r.content, r.section_title, most))
                ]
                at, *rest = zip(*rows) if rows else ((),) * 6
                ids = batch["document_id"].take(pa.array(at, pa.int64())).cast(id_type)
                yield pa.record_batch([ids, *(pa.array(x, f.type) for x, f in zip(rest, list(schema)[1:]))], schema=schema)

    long = islands.where(F.length("content") > most).select("document_id", "island", "content", "section_title", "chapter").mapInArrow(run, f"document_id {kind}, island long, content string, section_title string, chapter string, piece int")
    both = _indexed(short.unionByName(long), ["island", "piece"])
    return both.select("document_id", "chunk_index", "content", "section_title", "chapter")


def simple_legal(docs: DataFrame, clauses=SIMPLE_CLAUSE_STARTS) -> DataFrame:
    """Clauses without chapters or a largest size; what comes before the first is the preamble."""
    lines = _lines(docs).withColumn("opens", _matches(clauses))
    grouped = _islands(lines, F.col("opens"))
    first = F.col("l")[0]["line"]
    title = F.when(F.col("island") == 0, F.lit(PREAMBLE)).otherwise(first)
    chunks = grouped.select("document_id", "island", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"), title.alias("section_title"))
    return _indexed(chunks, ["island"]).select("document_id", "chunk_index", "content", "section_title")


def markdown(docs: DataFrame, mark: str = "\n# ") -> DataFrame:
    """Sections at level-one headings; sections with a blank body are dropped."""
    parts = docs.select("document_id", F.posexplode(F.split("text", mark)).alias("part", "section"))
    head = F.when(F.col("part") == 0, F.lit(PREAMBLE)).otherwise(strip(F.regexp_extract("section", "^([^\n]*)", 1)))
    body = F.when(F.col("part") == 0, F.col("section")).otherwise(F.regexp_extract("section", "(?s)^[^\n]*\n(.*)$", 1))
    chunks = parts.select("document_id", "part", body.alias("content"), head.alias("section_title")).where(strip(F.col("content")) != "")
    return _indexed(chunks, ["part"]).select("document_id", "chunk_index", "content", "section_title")


def split_page(text: str, most: int) -> list[str]:
    """A page within ``most`` is one chunk; else paragraphs are packed, and oversize ones cut into sentences."""
    if len(text) <= most:
        return [text] if text.strip() else []
    out, pending = [], ""
    for paragraph in filter(None, (p.strip() for p in text.split("\n"))):
        if len(pending) + len(paragraph) + 1 <= most:
            pending = f"{pending}\n{paragraph}" if pending else paragraph
            continue
        if pending:
            out.append(pending)
        pending = paragraph if len(paragraph) <= most else ""
        if len(paragraph) > most:
            out += pack_greedily([s for p in re.split("(?<=[。！？!?.])", paragraph) if (s := p.strip())], most)
    return [*out, pending] if pending else out


def pages(docs: DataFrame, most: int = 1000, mark: str = r"--- 第(\d+)页 ---") -> DataFrame:
    """Chunks of page-marked text with ``page_number``; text before the first mark is page 1's."""
    pattern = re.compile(mark)

    id_type = to_arrow_type(docs.schema["document_id"].dataType)
    schema = pa.schema([("document_id", id_type), ("chunk_index", pa.int32()), ("content", pa.string()), ("page_number", pa.int32())])

    def run(batches):
        for batch in batches:
            for frame in slices(batch.select(["text"]).append_column("at", pa.array(np.arange(batch.num_rows))), "text"):
                rows = []
                for at, text in zip(frame["at"], frame["text"]):
                    found, n = pattern.split(text or ""), 0
                    for number, body in [(1, found[0]), *zip(found[1::2], found[2::2])]:
                        for c in split_page(body.strip(), most):
                            rows.append((at, n, c, int(number) if str(number).isdigit() else n + 1))
                            n += 1
                at, *rest = zip(*rows) if rows else ((),) * 4
                ids = batch["document_id"].take(pa.array(at, pa.int64())).cast(id_type)
                yield pa.record_batch([ids, *(pa.array(x, f.type) for x, f in zip(rest, list(schema)[1:]))], schema=schema)

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, chunk_index int, content string, page_number int")


def paragraphs(docs: DataFrame, most: int = 1000, table_mark: str = "[表格]") -> DataFrame:
    """Paragraph groups of word-processor text: a heading or a table begins a group, which is cut hard at ``most``;
    ``section_title`` is the heading above."""
    lines = _lines(docs).withColumn("heading", is_heading(F.col("line")))
    opens = F.col("heading") | F.col("line").startswith(table_mark)
    w = W.partitionBy("document_id").orderBy("line_no")
    titled = lines.withColumn("title", F.last(F.when(F.col("heading"), F.col("line")), True).over(w)).withColumn("island", F.sum(opens.cast("int")).over(w))
    grouped = titled.groupBy("document_id", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), F.max("title").alias("section_title"))
    whole = grouped.select("document_id", "island", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"), "section_title")
    n = F.greatest(F.ceil(F.length("t") / most), F.lit(1)).cast("int")
    cut = whole.select("document_id", "island", "section_title", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), i * most + 1, F.lit(most)))).alias("piece", "content"), (n > 1).alias("is_truncated"))
    return _indexed(cut, ["island", "piece"]).select("document_id", "chunk_index", "content", "section_title", "is_truncated")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, the separator kept before the piece that follows; pieces still too long
    go on with the next; neighbours are merged up to ``size`` and share up to ``overlap`` characters."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep in separators else ()
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    run: deque[str] = deque()
    held = 0  # characters in the run

    def flush(keep: bool):
        nonlocal held
        if run and (joined := "".join(run).strip()):
            out.append(joined)
        if not keep:
            run.clear()
            held = 0

    for part in parts:
        if len(part) > size and finer:
            flush(keep=False)
            out.extend(split_recursively(part, size, overlap, finer))
            continue
        if run and held + len(part) > size:
            flush(keep=True)
            while run and (held > overlap or held + len(part) > size):
                held -= len(run.popleft())
        run.append(part)
        held += len(part)
    flush(keep=False)
    return out


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, separators=SEPARATORS) -> DataFrame:
    return _helper(docs, lambda t: split_recursively(t, size, overlap, tuple(separators)))


def choose_strategy(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``strategy`` by the extension of ``filename``, by the text, else ``semantic``."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    by_name = F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])
    return docs.withColumn("strategy", F.coalesce(F.try_element_at(by_name, ext), F.when(is_legal(F.col("text")), "legal").otherwise("semantic")))


def dispatch(docs: DataFrame, chunkers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, strategy: str | None = None) -> DataFrame:
    """Chunks of documents with a column ``strategy``, each by its own chunker; a fixed ``strategy`` for all may be given.
    ``hybrid`` is its primary strategy, ``legal``. Each document goes to one branch."""
    known = {"legal": legal, "hybrid": legal, "langchain": recursive, "semantic": plain_semantic, "markdown": markdown, "pages": pages, "paragraphs": paragraphs, "fixed": fixed_size} | (chunkers or {})
    if strategy is not None and strategy not in known:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    if strategy is not None:
        return known[strategy](docs).withColumn("strategy", F.lit(strategy))
    names = ("legal", "langchain", "semantic", "markdown", "pages", "paragraphs", *(chunkers or {}))
    # written once by strategy, so that each branch reads its own documents and no others
    path = f"{shared_dir(docs.sparkSession)}/lexloom/dispatch-{uuid.uuid4().hex}"
    docs.where(F.col("strategy").isin(*names)).write.partitionBy("strategy").parquet(path)
    dealt, out = docs.sparkSession.read.schema(docs.schema).parquet(path), None
    for name in names:
        part = known[name](dealt.where(F.col("strategy") == name)).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_metadata(chunks: DataFrame, documents: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Chunks whose ``metadata`` map is overridden by the document's; with images, ordered urls of the chunk's page, the
    first as ``primary_image``."""
    docs = documents.select("document_id", F.col("metadata").alias("__meta"))
    empty = F.create_map().cast("map<string,string>")
    own, over = F.coalesce("metadata", empty), F.coalesce("__meta", empty)
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)
    out = chunks.join(docs, "document_id", "left").withColumn("metadata", merged).drop("__meta")
    if images is None:
        return out
    urls = images.groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("image_index", "url"))), lambda x: x["url"]).alias("image_urls"))
    return out.join(urls, ["document_id", "page_number"], "left").withColumn("primary_image", F.try_element_at("image_urls", F.lit(1)))


def image_boxes(images: DataFrame) -> DataFrame:
    """Boxes from ``bbox`` or the four coordinates, clipped to the page; empty ones go. Adds the object key."""
    part = lambda i, name: F.coalesce(F.try_element_at("bbox", F.lit(i)), F.col(name))
    box = images.select(
        "document_id", "page_number", "image_index",
        F.greatest(part(1, "x0"), F.lit(0.0)).alias("x0"), F.greatest(part(2, "y0"), F.lit(0.0)).alias("y0"),
        F.least(part(3, "x1"), F.col("width")).alias("x1"), F.least(part(4, "y1"), F.col("height")).alias("y1"),
    )
    key = F.format_string("images/%s/page_%s_%s.png", F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("image_index").cast("string"))
    return box.where("x0 < x1 and y0 < y1").withColumn("object_key", key)
