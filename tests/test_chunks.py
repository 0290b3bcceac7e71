"""Chunkers against plain restatements, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import chunk as C
from lexloom.operators import extension as X


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document_id long, text string")


def contents(df, i=0):
    return [r["content"] for r in df.where(F.col("document_id") == i).orderBy("chunk_index").collect()]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (7, 6)])
def test_fixed_size(spark, size, overlap):
    texts = ["", None, "x", "a" * size, "b" * (size + 1), "c" * overlap, "0123456789" * 5 + "z"]
    df = C.fixed_size(docs(spark, *texts), size, overlap)
    for i, t in enumerate(texts):
        want, at = [], 0
        while t:
            want.append(t[at : at + size])
            if at + size >= len(t):
                break
            at += size - overlap
        assert contents(df, i) == want
    with pytest.raises(ValueError):
        C.fixed_size(docs(spark, "x"), 5, 5)


def naive_pack(parts, most, least, keep):
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(p) + 1 > most and len(now) >= least:
            out.append(now)
            now = p
        else:
            now = f"{now} {p}" if now else p
    return out + ([now] if now and (keep or len(now) >= least) else [])


@pytest.mark.parametrize("seed", range(5))
def test_packing(seed):
    random.seed(seed)
    parts = ["x" * random.randrange(1, 40) for _ in range(60)]
    for most, least in ((50, 0), (50, 20), (10, 5)):
        for keep in (True, False):
            assert C.pack_greedily(parts, most, least=least, keep_tail=keep) == naive_pack(parts, most, least, keep)


def test_semantic(spark):
    text = "甲" * 150 + "。" + "乙" * 100 + "！" + "丙" * 900 + "？" + "丁" * 30
    df = C.semantic(docs(spark, text, "短。", None))
    assert contents(df) == ["甲" * 150 + " " + "乙" * 100, "丙" * 900 + " " + "丁" * 30] and contents(df, 1) == []
    assert contents(C.plain_semantic(docs(spark, "甲。乙!丙", None), most=5)) == ["甲。 乙!", "丙"]


LAW = "序言\n第一章 总则\n第一条 甲\n正文一\n第二条 乙\n第二章 分则\n前文\n第三条 丙\n第一百条 丁"


def test_legal(spark):
    df = C.legal(docs(spark, LAW, "", None)).orderBy("chunk_index").collect()
    assert [(r["content"], r["section_title"], r["chapter"]) for r in df] == [
        ("序言", "序言", ""), ("第一条 甲\n正文一", "第一条 甲", "第一章 总则"), ("第二条 乙", "第二条 乙", "第一章 总则"), ("前文", "前文", "第二章 分则"), ("第三条 丙\n第一百条 丁", "第三条 丙", "第二章 分则"),
    ]
    compat = [r["chapter"] for r in C.legal(docs(spark, LAW), compat=True).orderBy("chunk_index").collect()]
    assert compat == ["第一章 总则", "第一章 总则", "第二章 分则", "第二章 分则", "第二章 分则"]
    assert contents(C.simple_legal(docs(spark, LAW))) == ["序言\n第一章 总则", "第一条 甲\n正文一", "第二条 乙\n第二章 分则\n前文", "第三条 丙\n第一百条 丁"]


def test_long_clauses(spark):
    long = "第一条 " + "长" * 30 + "。" + "句" * 30 + "。\n" + "段" * 20 + "\n" + "大" * 90
    got = C.split_long_clause(long, "t", 50)
    assert got == [("第一条 " + "长" * 30, "t - 句子组1"), ("句" * 30, "t - 句子组2"), ("段" * 20, "t - 分段3"), ("大" * 90, "t - 分段4")]
    df = C.legal(docs(spark, long), most=50).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in df] == [0, 1, 2, 3] and df[2]["section_title"].endswith("分段3")


def test_sections_and_pages(spark):
    assert contents(C.markdown(docs(spark, "前\n# 一\n正文\n# 空\n# 二\n文", None))) == ["前", "正文", "文"]
    text = "封面\n--- 第2页 ---\n" + "甲" * 8 + "\n" + "乙。" * 10 + "\n丙\n--- 第9页 ---\n尾"
    rows = C.pages(docs(spark, text, None), most=10).orderBy("chunk_index").collect()
    assert [r["page_number"] for r in rows] == [1] + [2] * (len(rows) - 2) + [9]
    assert "".join(r["content"] for r in rows).replace(" ", "") == "封面" + "甲" * 8 + "乙。" * 10 + "丙尾"
    assert max(len(r["content"]) for r in rows) <= 10


def test_paragraphs(spark):
    rows = C.paragraphs(docs(spark, "第一章\n" + "甲" * 25 + "\n[表格] x\n第二节\n乙"), most=20).orderBy("chunk_index").collect()
    assert [(r["section_title"], r["is_truncated"]) for r in rows] == [("第一章", True), ("第一章", True), ("第一章", False), ("第二节", False)]


@pytest.mark.parametrize("size,overlap", [(30, 0), (30, 10), (5, 2)])
def test_recursive(size, overlap):
    random.seed(size)
    text = "".join(random.choice("ab 。\n\n！") for _ in range(600))
    got = C.split_recursively(text, size, overlap)
    assert all(0 < len(c) <= size for c in got) and all(c in text for c in got)
    assert set("".join(got)) >= set(text) - set(" \n")
    if not overlap:
        squeeze = lambda t: "".join(t.split())
        assert squeeze("".join(got)) == squeeze(text)


def test_dispatch(spark):
    df = spark.createDataFrame([(1, "a.md", "前\n# 一\n文"), (2, "b.txt", "第一条 甲\n第二条 乙"), (3, "c.txt", "plain. text"), (4, "d.pdf", "--- 第1页 ---\nx")], "document_id long, filename string, text string")
    got = C.dispatch(C.choose_strategy(df)).groupBy("strategy").count().collect()
    assert {r[0]: r[1] for r in got} == {"markdown": 2, "legal": 2, "semantic": 1, "pages": 1}
    assert {r[0] for r in C.dispatch(df, strategy="hybrid").select("strategy").collect()} == {"hybrid"}
    with pytest.raises(ValueError):
        C.dispatch(df, strategy="none")


def test_metadata_and_boxes(spark):
    chunks = spark.createDataFrame([(1, 0, 1, {"a": "c", "b": "c"})], "document_id long, chunk_index int, page_number int, metadata map<string,string>")
    owners = spark.createDataFrame([(1, {"a": "d"})], "document_id long, metadata map<string,string>")
    images = spark.createDataFrame([(1, 1, 2, "u2"), (1, 1, 1, "u1")], "document_id long, page_number int, image_index int, url string")
    r = C.with_metadata(chunks, owners, images).first()
    assert r["metadata"] == {"a": "d", "b": "c"} and r["image_urls"] == ["u1", "u2"] and r["primary_image"] == "u1"
    boxes = spark.createDataFrame([(1, 1, 1, [-5.0, 0.0, 20.0, 9.0], None, None, None, None, 10.0, 10.0), (1, 1, 2, None, 3.0, 3.0, 3.0, 9.0, 10.0, 10.0)], "document_id long, page_number int, image_index int, bbox array<double>, x0 double, y0 double, x1 double, y1 double, width double, height double")
    got = C.image_boxes(boxes).collect()
    assert [(g["x0"], g["x1"], g["object_key"]) for g in got] == [(0.0, 10.0, "images/1/page_1_1.png")]


def test_extension(spark):
    X.register_chunker("halves", lambda d: C.fixed_size(d, 5, 0))
    df = docs(spark, "0123456789").withColumn("strategy", F.lit("halves"))
    assert contents(C.dispatch(df, X.chunkers())) == ["01234", "56789"]
    assert X.part("chunker", "halves")
    X.unregister("chunker", "halves")
    with pytest.raises(ValueError):
        X.part("chunker", "halves")
    with pytest.raises(TypeError):
        X.register_embedder("none", None)
    X.register_table_functions(spark)
    docs(spark, "甲。乙。", None).createOrReplaceTempView("d")
    rows = spark.sql("select document_id, c.* from d, lateral semantic_chunks(text, 3) c").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "甲。"), (0, 1, "乙。")]


def test_table_functions(spark):
    texts = ["", None, "一二三。" * 40 + "\n\n" + "x" * 30, "a b " * 300]
    for ids, kind in ((["p", None, "q", "q"], "string"), ([1, 2, 3, 4], "long")):
        df = spark.createDataFrame(list(zip(ids, texts)), f"document_id {kind}, text string")
        X.register_table_functions(spark, kind)
        df.repartition(3).createOrReplaceTempView("d")
        got = spark.sql("select * from recursive_chunk_table(table(d), 60, 10)")
        assert got.schema.simpleString() == f"struct<document_id:{'bigint' if kind == 'long' else kind},chunk_index:int,content:string>"
        want = spark.sql("select document_id, c.* from d, lateral recursive_chunks(text, 60, 10) c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
        assert "Exchange" not in spark.sql("select * from recursive_chunk_table(table(select document_id, text from d where text <> ''), 60, 10)")._jdf.queryExecution().optimizedPlan().toString()
        got = spark.sql("select * from semantic_chunk_table(table(d), 50)")
        want = spark.sql("select document_id, c.* from d, lateral semantic_chunks(text, 50) c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3
    spark.createDataFrame([], "document_id long, text string").createOrReplaceTempView("d")
    assert spark.sql("select * from recursive_chunk_table(table(d), 60, 10)").count() == 0


def test_processors(spark):
    rows = [("a.TXT", b"t", None), ("b.md", "文".encode("gbk"), "application/unknown"), ("c.xyz", b"x", None), ("d.xyz", b"x", "TEXT/plain"), ("e", b"n", None), ("f.txt", None, None), (None, b"n", None), ("g.bin", b"y", "x/y")]
    df = spark.createDataFrame(rows, "filename string, content binary, mime string")
    X.register_processor(".XYZ", lambda c: F.concat(F.lit("!"), c.cast("string")), "X/Y")
    assert ".xyz" in X.supported_formats()["extensions"] and "x/y" in X.supported_formats()["mime_types"]
    got = [(r["filename"], r["processor"], r["text"]) for r in X.process(df).collect()]
    assert got == [
        ("a.TXT", ".txt", "t"), ("b.md", ".md", "文"), ("c.xyz", ".xyz", "!x"), ("d.xyz", "text/plain", "x"), ("e", None, None), ("f.txt", ".txt", None), (None, None, None), ("g.bin", "x/y", "!y"),
    ]
    assert {r["processor"] for r in X.process(df.drop("mime")).collect()} == {".txt", ".md", ".xyz", None}
    X.unregister_processor(".xyz", "x/y")
    assert X.process(df).where("processor in ('.xyz', 'x/y')").count() == 0
    X.register_processor(".bad", lambda c: "text")
    try:
        with pytest.raises(TypeError):
            X.process(df)
    finally:
        X.unregister_processor(".bad")
    with pytest.raises(ValueError):
        X.register_processor("xyz", F.upper)


def test_long_texts_are_cut_in_linear_time(spark):
    """One text of many windows takes about as long as the same characters in many texts."""
    import time

    def took(texts, size):
        df = docs(spark, "x").select("document_id", F.explode(F.array_repeat(F.repeat(F.lit("abé "), size // 4), texts)).alias("text"))
        best = []
        for _ in range(3):
            began = time.time()
            assert C.fixed_size(df).agg(F.sum(F.length("content"))).first()[0] > size * texts
            best.append(time.time() - began)
        return min(best)

    took(1, 4000)
    assert took(1, 4_000_000) < 5 * took(100, 40_000) + 1
