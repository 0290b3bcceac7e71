"""Cleaning and extraction on inline Chinese texts."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import extract as E
from lexloom.functions import text as T


def one(spark, f, *texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_preprocess(spark):
    got = one(spark, T.preprocess, "　甲，乙。\r\n\r\n\r\n\r\n  丙 \t 丁；\r戊\x1f己  ", None, "", " \n ")
    assert got == ["甲,乙.\n\n丙 丁;\n戊 己", None, "", ""]


def test_clean(spark):
    assert one(spark, T.clean, "第 3 页\n共 9 页 甲，乙。丙---\x07 丁！ 　戊", "甲 页眉: 全部\n没有", None) == ["甲, 乙. 丙 丁! 戊", "甲", None]
    assert one(spark, T.clean_legal, "第 四十 条 甲方，第 5 条") == ["第四十条 甲方, 第5条"]


def test_half_width_and_noise(spark):
    assert one(spark, T.half_width, "（甲）＃“乙”‘丙’　") == ["(甲)#\"乙\"'丙' "]
    assert one(spark, T.remove_noise, "正文\n第 1/20 页\n© 2024 某\n版权所有\nhttp://a.b/c 见 x.y@z.com 完") == ["正文\n\n\n\n 见  完"]
    assert one(spark, T.normalise_punctuation, "甲 ，乙。丙？《法》") == ["甲, 乙. 丙? <法>"]
    assert one(spark, T.drop_special, "a\x00é甲\nb") == ["a甲b"]
    assert one(spark, T.clean_for_analysis, "<p>甲， 乙</p>  a-1") == ["甲 乙 a1"]


def test_markdown_and_code(spark):
    text = "# 头\n> 引\n- 项\n```\n# code\n```\n文"
    assert one(spark, T.flatten_markdown, text, None) == ["标题: 头\n引用: 引\n• 项\n# code\n文", None]
    assert one(spark, T.is_markdown, text, "无", "x" * 1000 + "# ") == [True, False, False]
    assert one(spark, T.mark_code, "def f(): pass", "无") == ["代码文件内容:\ndef f(): pass", "无"]


def test_predicates(spark):
    assert one(spark, T.is_legal, "本条", "x" * 500 + "第", "none") == [True, False, False]
    assert one(spark, T.is_heading, "第一章", "TITLE", "Title", "A" * 60, "AB", "1.x") == [True, True, False, False, False, True]
    rows = [("a", [["x", None], ["", " "], ["y", "z"]])]
    df = spark.createDataFrame(rows, "k string, r array<array<string>>")
    assert df.select(T.table_text(F.col("r")), T.table_text(F.col("r"), False)).first() == ("x | \ny | z", "x | \n |  \ny | z")


def test_names_and_labels(spark):
    assert one(spark, T.safe_filename, 'a<b>:c"/d.txt', "x" * 300 + ".pdf") == ["a_b__c__d.txt", "x" * 251 + ".pdf"]
    assert one(spark, T.file_size_label, 0, 512, 2048, 3 * 1024**3, kind="long") == ["0 B", "512.00 B", "2.00 KB", "3.00 GB"]
    assert one(spark, T.split_path, "/a/b.c/d.tar.gz", "name") == [("/a/b.c", "d.tar", ".gz"), ("", "name", "")]
    assert one(spark, T.valid_path, "a/b", "a|b", "x" * 300) == [True, False, False]
    assert one(spark, T.preview, "a" * 201, "b") == ["a" * 200 + "...", "b"]
    assert one(spark, T.duration_label, 59.9, 60.0, 1440.0, kind="double") == ["59分钟", "1小时", "1天"]


def test_size_labels_round_half_to_even(spark):
    """As ``f"{x:.2f}"`` does; Java's formatter rounds halves up."""
    sizes = [1152, 1408, 1664, 1920, 1536, 60113, 1024 * 1152, 1024**3 * 9 // 8, 1024**5 * 3 // 1024 // 8 * 3, 127, 1]
    units = ("B", "KB", "MB", "GB", "TB")
    want = [f"{n / 1024**i:.2f} {units[i]}" for n in sizes for i in [min(4, (n.bit_length() - 1) // 10)]]
    assert one(spark, T.file_size_label, *sizes, kind="long") == want and want[0] == "1.12 KB"


def test_citations(spark):
    text = "依《劳动法》第四十条和《民法典》第5条。"
    got = one(spark, E.citations, text, None, "无")
    assert [(c["group1"], c["group2"], c["begin"], c["finish"]) for c in got[0]] == [("劳动法", "四十", 1, 10), ("民法典", "5", 11, 19)]
    assert got[1:] == [[], []]
    assert len(one(spark, lambda c: E.citations(c, compat=True), text)[0]) == 3
    for c in got[0]:
        assert text[c["begin"] : c["finish"]] == c["text"]


def test_spans_are_finditer(spark):
    text = "aa1 bb22 cc333 " * 20
    got = one(spark, lambda c: E.spans(c, (r"([a-c]+)(\d+)", r"(\d)3")), text)[0]
    want = [(m.group(), m.start()) for p in (r"([a-c]+)(\d+)", r"(\d)3") for m in re.finditer(p, text)]
    assert [(g["text"], g["begin"]) for g in got] == want


def test_terms_overlap(spark):
    docs = spark.createDataFrame([(1, "被上诉人与上诉人的合同"), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(t, "") for t in E.LEGAL_TERMS], "term string, definition string")
    assert {(r["term"], r["n"]) for r in E.term_counts(docs, terms).collect()} == {("被上诉人", 1), ("上诉人", 2), ("合同", 1)}


def test_large_dictionaries(spark, monkeypatch):
    """Ten thousand terms and odd ones, whole and in parts, against a search for each."""
    words = [f"w{i:x}" for i in range(0, 30_000, 3)] + ["aa", "a", "", "a w", "字", "字字"]
    texts = [" ".join(f"w{i:x}" for i in range(k, k + 40)) + " aaaa字字字" for k in range(0, 400, 40)] + [None, "", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([(t, f"d{t}") for t in words] + [("aa", "later"), (None, "x")], "term string, definition string")
    want = {(i, t, m.start(), m.end()) for i, text in enumerate(texts) if text for t in words if t and t in text for m in re.finditer(re.escape(t), text)}
    for size in (E.TERMS_PER_AUTOMATON, 3000):
        monkeypatch.setattr(E, "TERMS_PER_AUTOMATON", size)
        rows = E.term_occurrences(docs, terms).collect()
        assert len(rows) == len(want) and {(r["doc_id"], r["term"], r["begin"], r["finish"]) for r in rows} == want
        assert all(r["definition"] == ("later" if r["term"] == "aa" else f"d{r['term']}") for r in rows)
        counts = {(r["doc_id"], r["term"]): r["n"] for r in E.term_counts(docs, terms).collect()}
        assert sum(counts.values()) == len(want)


def test_structure(spark):
    text = "前言\n第一条 独立\n第一章 总则\n第二条 甲\n正文\n第三条 乙\n\n第2章 附则"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = E.structure(docs).orderBy("section").collect()
    assert [(r["type"], r["title"], r["start_line"], [a["title"] for a in r["articles"]]) for r in rows] == [("article", "独立", 1, []), ("chapter", "总则", 2, ["甲", "乙"]), ("chapter", "附则", 7, [])]


def test_phrases_and_entities(spark):
    assert one(spark, E.key_phrases, "甲应当付款。乙不得拒绝，承担违约责任。") == [["应当付款", "不得拒绝，承担违约责任", "承担违约责任"]]
    got = one(spark, E.entities, "2024年1月2日 向 13812345678 付 100万 a@b.cn 11010119900101123X 某某公司", None)
    kinds = {(e["entity_type"], e["entity_value"]) for e in got[0]}
    assert {("date", "2024年1月2日"), ("phone", "13812345678"), ("money", "100万"), ("email", "a@b.cn"), ("id_card", "11010119900101123X"), ("company", "某某公司")} <= kinds and got[1] == []
    assert one(spark, E.legal_elements, "公司违约，支付违约金", None) == [["公司", "违约", "支付", "违约金", "主体", "行为", "权利", "义务"], []]
    assert spark.range(1).select(E.merge_entities(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0] == ["a", "a", "b"]


def test_replies(spark):
    good = 'So: {"is_legal_related": true, "legal_category": "labor", "confidence": 1.7, "suggested_topics": ["1","2","3","4","5","6"]} end'
    got = one(spark, E.parse_intent, good, "{broken", None, '{"is_legal_related": "false", "confidence": 0.9}', '{"suggested_topics": "x"}')
    assert tuple(got[0]) == (True, "劳动", 1.0, ["1", "2", "3", "4", "5"], "")
    assert tuple(got[1]) == (True, "other", 0.5, [], "") and got[3]["is_legal_related"] is False and got[4]["suggested_topics"] == []
    df = spark.createDataFrame([("{bad", "公司违约"), ('{"core_issue": "x"}', "q")], "r string, q string")
    a = [r[0] for r in df.select(E.parse_analysis(F.col("r"), F.col("q"))).collect()]
    assert a[0]["core_issue"] == "公司违约" and a[0]["legal_elements"] == ["公司", "违约", "主体", "行为"] and a[1]["query_for_retrieval"] == "q"
    assert one(spark, E.question_type, "如何理解合同", "办理的流程", "有什么区别", "你好") == ["concept_explanation", "procedure_guidance", "comparison", "general"]


@pytest.mark.parametrize("f", [T.preprocess, T.clean, T.half_width, T.remove_noise, T.clean_legal, T.flatten_markdown])
def test_no_python_in_cleaning(spark, f):
    plan = spark.createDataFrame([("a",)], "t string").select(f(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_slices_are_bounded_by_text(monkeypatch):
    """A batch of many rows is worked on a few texts at a time; an oversize text stands alone, nulls and empty ones cost nothing."""
    import pyarrow as pa

    from lexloom.functions import slices as S

    monkeypatch.setattr(S, "SLICE_BYTES", 10)
    texts = ["x" * 4, "é" * 3, None, "y" * 50, "", "z" * 10, "w"] * 3
    parts = list(S.slices(pa.record_batch({"text": pa.array(texts, pa.string()), "at": pa.array(range(21))}), "text"))
    assert [i for p in parts for i in p["at"]] == list(range(21))
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p["text"]) <= 10 for p in parts) and len(parts) >= 9
