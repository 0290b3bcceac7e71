"""Extraction and classification of texts: columns in, columns or exploded rows out.

Null and empty texts give empty arrays or no rows.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .slices import slices
from .text import strip

# Patterns, terms and codes.
CITATIONS = (
    "《([^》]+)》第([零一二三四五六七八九十百千万0-9]+)条",
    "《([^》]+)》第([0-9]+)条",
    r"([A-Za-z\s]+)法第([零一二三四五六七八九十百千万0-9]+)条",
    r"([A-Za-z\s]+)法第([0-9]+)条",
)
LEGAL_TERMS = ("原告", "被告", "上诉人", "被上诉人", "诉讼", "仲裁", "合同", "侵权", "违约责任", "刑事责任", "行政处罚")
CHAPTER_TITLES = (r"^第[一二三四五六七八九十]+章(?U:\s*)(.+)$", r"^第[0-9]+章(?U:\s*)(.+)$", r"^CHAPTER(?U:\s+)[IVXLCDM]+(?U:\s*)(.+)$", r"^Chapter(?U:\s+)[0-9]+(?U:\s*)(.+)$")
ARTICLE_TITLES = (r"^第[一二三四五六七八九十]+条(?U:\s*)(.+)$", r"^第[0-9]+条(?U:\s*)(.+)$", r"^Article(?U:\s+)[0-9]+(?U:\s*)(.+)$")
KEY_PHRASES = ("应当[^。]*", "不得[^。]*", "可以[^。]*", "必须[^。]*", "禁止[^。]*", "承担[^。]*责任", "处以[^。]*处罚", "赔偿[^。]*损失", "追究[^。]*责任")
ENTITIES = {
    "date": r"(?U)\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?|\d{1,2}[-/]\d{1,2}[-/]\d{4}|今年|前年|本月|上个月|去年|明天|后天|下周",
    "money": r"(?U)\d+(\.\d+)?[万元千]|¥\d+(\.\d+)?|\$\d+(\.\d+)?|\d+元",
    "phone": r"(?U)1[3-9]\d{9}",
    "email": r"(?U)\w+@\w+\.\w+",
    "id_card": r"(?U)\d{17}[\dXx]",
    "company": r"(?U)\S{2,20}(公司|集团|有限公司|股份有限公司|企业)",
}
LEGAL_KEYWORDS = {
    "主体": ("公司", "企业", "个人", "自然人", "法人", "用人单位", "劳动者", "雇主", "员工"),
    "客体": ("财产", "房屋", "土地", "货物", "服务", "知识产权", "股权", "债券"),
    "行为": ("签订", "解除", "违约", "侵权", "欺诈", "拖欠", "拒绝", "逃避"),
    "权利": ("赔偿", "补偿", "支付", "履行", "违约金", "利息", "分红"),
    "义务": ("支付", "交付", "保密", "竞业禁止", "通知"),
    "法律关系": ("劳动关系", "合同关系", "买卖关系", "租赁关系", "合作关系"),
    "法律文书": ("合同", "协议", "遗嘱", "委托书", "授权书", "通知书"),
}
CATEGORIES = {
    "civil": "民事", "criminal": "刑事", "commercial": "商事", "administrative": "行政", "intellectual_property": "知识产权", "labor": "劳动",
    "family": "婚姻家庭", "real_estate": "房地产", "tort": "侵权", "contract": "合同", "other": "其他",
}
QUESTION_TYPES = (
    ("concept_explanation", "如何理解|是什么意思|法律含义"),
    ("case_analysis", "案例分析|如何处理.*情况|法律后果"),
    ("procedure_guidance", "流程|步骤|如何办理"),
    ("comparison", "区别|对比|不同"),
)
INTENT_SCHEMA = "is_legal_related boolean, legal_category string, confidence double, reasoning string, suggested_topics array<string>"
ANALYSIS_SCHEMA = "core_issue string, legal_elements array<string>, key_entities array<string>, query_for_retrieval string, missing_info array<string>"

#: Terms of one automaton; a larger dictionary is searched part by part.
TERMS_PER_AUTOMATON = 200_000


def spans(text: Column, patterns, distinct: bool = True) -> Column:
    """Array of (text, group1, group2, begin, finish, pattern): matches of each pattern, one pattern after another.

    Spark's expressions give no places, so this is a vectorised helper. ``distinct`` drops a span found before.
    """
    compiled = [re.compile(p.replace("(?U)", "")) for p in patterns]

    @F.pandas_udf("array<struct<text:string,group1:string,group2:string,begin:int,finish:int,pattern:int>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            out, seen = [], set()
            for k, p in enumerate(compiled):
                for m in p.finditer(t or ""):
                    if not (distinct and m.span() in seen):
                        seen.add(m.span())
                        g = m.groups() + (None, None)
                        out.append({"text": m.group(), "group1": g[0], "group2": g[1], "begin": m.start(), "finish": m.end(), "pattern": k})
            return out

        return texts.map(one, na_action=None)

    return find(text)


def citations(text: Column, compat: bool = False) -> Column:
    """Legal citations; ``compat`` keeps those that two patterns find."""
    return spans(text, CITATIONS, distinct=not compat)


def _automaton(shared):
    """The automaton of a broadcast list of terms, built once a process."""
    if shared.id not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for t in shared.value:
            found.add_word(t, t)
        found.make_automaton()
        _built[shared.id] = found
    return _built[shared.id]


_built: dict = {}


class _Terms(NamedTuple):
    id: str
    broadcast: object

    @property
    def value(self):
        return self.broadcast.value


def _shards(terms: DataFrame):
    """The distinct terms, ``TERMS_PER_AUTOMATON`` at a time, each broadcast."""
    listed = terms.select("term").where("term <> ''").distinct()
    n = max(1, -(-listed.count() // TERMS_PER_AUTOMATON))
    for i in range(n):
        part = listed if n == 1 else listed.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i)
        yield _Terms(uuid.uuid4().hex, terms.sparkSession.sparkContext.broadcast(sorted(r[0] for r in part.collect())))


def _matches(text: str, automaton) -> Iterator[tuple[str, int, int]]:
    """(term, begin, finish) in one pass; terms overlap each other but not themselves."""
    free: dict[str, int] = {}
    for last, term in automaton.iter(text):
        begin = last + 1 - len(term)
        if begin >= free.get(term, 0):
            free[term] = last + 1
            yield term, begin, last + 1


def _with_terms(docs: DataFrame, terms: DataFrame, kind: str, of) -> DataFrame:
    """(doc_id, s): what ``of`` makes of each text's matches, for each shard of the dictionary."""

    fields = [f.split(":") for f in kind.split(",")]
    id_field = docs.schema["doc_id"]
    schema = pa.schema([("doc_id", to_arrow_type(id_field.dataType)), *((name, {"string": pa.string(), "int": pa.int32()}[t]) for name, t in fields)])

    def one(shared):
        def find(batches):
            automaton = _automaton(shared) if shared.value else None
            for batch in batches if automaton else ():
                texts = batch.select(["text"]).append_column("at", pa.array(np.arange(batch.num_rows)))
                for frame in slices(texts, "text"):
                    rows = [(at, *m) for at, t in zip(frame["at"], frame["text"]) if t for m in of(_matches(t, automaton))]
                    at, *rest = zip(*rows) if rows else ((),) * len(schema)
                    ids = batch["doc_id"].take(pa.array(at, pa.int64())).cast(schema.field(0).type)
                    yield pa.record_batch([ids, *(pa.array(x, f.type) for x, f in zip(rest, list(schema)[1:]))], schema=schema)

        found = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {id_field.dataType.simpleString()}, {', '.join(f'{n} {t}' for n, t in fields)}")
        return found.select("doc_id", F.struct(*[n for n, _ in fields]).alias("s"))

    return functools.reduce(DataFrame.unionByName, [one(shared) for shared in _shards(terms)])


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term, n): overlapping terms all count. ``terms`` (term, definition) is a dictionary; each text is read
    once for ``TERMS_PER_AUTOMATON`` of its terms, however many there are. Null and empty terms and texts have none."""
    counted = _with_terms(docs, terms, "term:string,n:int", lambda found: list(Counter(t for t, _, _ in found).items()))
    return counted.select("doc_id", "s.term", "s.n")


def term_occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term, definition, begin, finish) of every occurrence of a dictionary's terms (term, definition); terms
    that overlap are all found. Of several definitions of a term the last in order counts."""
    found = _with_terms(docs, terms, "term:string,begin:int,finish:int", list).select("doc_id", "s.term", "s.begin", "s.finish")
    defined = terms.groupBy("term").agg(F.max("definition").alias("definition"))
    return found.join(defined, "term").select("doc_id", "term", "definition", "begin", "finish")


def structure(docs: DataFrame, chapters=CHAPTER_TITLES, articles=ARTICLE_TITLES) -> DataFrame:
    """(doc_id, section, type, title, start_line, articles): chapters with their articles; an article before any chapter,
    or after such an article, is a section of its own. Lines are counted from 0."""

    def title(patterns):
        found = F.lit(None).cast("string")
        for p in reversed(patterns):
            found = F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)).otherwise(found)
        return found

    lines = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), strip)).alias("line_no", "line")).where("line <> ''")
    marked = lines.withColumn("chapter", title(chapters)).withColumn("article", title(articles)).where("chapter is not null or article is not null")
    before = W.partitionBy("doc_id").orderBy("line_no")
    last_chapter = F.sum(F.col("chapter").isNotNull().cast("int")).over(before)
    opens = F.col("chapter").isNotNull() | (last_chapter == 0)
    placed = marked.withColumn("opens", opens).withColumn("section", F.sum(F.col("opens").cast("int")).over(before) - 1)
    inside = F.filter(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line_no", F.trim("article").alias("title"))))), lambda x: x.isNotNull())
    return placed.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("opens"), F.when(F.col("chapter").isNotNull(), "chapter").otherwise("article"))).alias("type"),
        F.max(F.when(F.col("opens"), F.trim(F.coalesce("chapter", "article")))).alias("title"),
        F.min("line_no").alias("start_line"),
        inside.alias("articles"),
    )


def key_phrases(text: Column, patterns=KEY_PHRASES) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])


def entities(text: Column, patterns: dict[str, str] = ENTITIES) -> Column:
    """Array of (entity_type, entity_value, confidence), by type in order."""
    t = F.coalesce(text, F.lit(""))
    def typed(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity_value"), F.lit(0.8).alias("confidence")))

    return F.concat(*[typed(k, p) for k, p in patterns.items()])


def legal_elements(text: Column, keywords: dict = LEGAL_KEYWORDS) -> Column:
    """Keywords found, first seen first, then the names of their categories."""
    every = list(dict.fromkeys(k for group in keywords.values() for k in group))
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.array(*[F.lit(k) for k in every]), lambda k: F.contains(t, k))
    names = [F.when(F.exists(F.array(*[F.lit(k) for k in g]), lambda k: F.contains(t, k)), F.lit(n)) for n, g in keywords.items()]
    return F.concat(words, F.array_compact(F.array(*names)))


def merge_entities(first: Column, second: Column) -> Column:
    return F.concat(first, F.array_except(second, first))


def _json_part(reply: Column) -> Column:
    part = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(part == "", reply).otherwise(part)


def parse_intent(reply: Column) -> Column:
    """Struct (is_legal_related, legal_category, confidence, suggested_topics, reasoning) of a model's reply; a reply that
    is no JSON gives (true, "other", 0.5, [], "")."""
    text = _json_part(reply)
    ok = F.try_parse_json(text).isNotNull() & text.startswith("{")
    j = F.from_json(F.when(ok, text), INTENT_SCHEMA)
    names = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    good = F.struct(
        F.coalesce(j["is_legal_related"], F.lit(False)).alias("is_legal_related"),
        F.try_element_at(names, F.coalesce(j["legal_category"], F.lit(""))).alias("legal_category"),
        F.least(F.greatest(F.coalesce(j["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.slice(F.coalesce(j["suggested_topics"], F.array().cast("array<string>")), 1, 5).alias("suggested_topics"),
        F.coalesce(j["reasoning"], F.lit("")).alias("reasoning"),
    )
    none = F.array().cast("array<string>")
    default = F.struct(F.lit(True).alias("is_legal_related"), F.lit("other").alias("legal_category"), F.lit(0.5).alias("confidence"), none.alias("suggested_topics"), F.lit("").alias("reasoning"))
    return F.when(ok, good).otherwise(default)


def parse_analysis(reply: Column, query: Column) -> Column:
    """Struct of a model's question analysis; what is missing falls back to the query and the rule-based elements."""
    text = _json_part(reply)
    ok = F.coalesce(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.lit(False))
    j = F.from_json(F.when(ok, text), ANALYSIS_SCHEMA)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(j["core_issue"], query).alias("core_issue"),
        F.when(ok, F.coalesce(j["legal_elements"], none)).otherwise(legal_elements(query)).alias("legal_elements"),
        F.coalesce(j["key_entities"], none).alias("key_entities"),
        F.coalesce(j["query_for_retrieval"], query).alias("query_for_retrieval"),
        F.coalesce(j["missing_info"], none).alias("missing_info"),
    )


def is_legal_query(intent: Column, threshold: float = 0.7) -> Column:
    return intent["is_legal_related"] & (intent["confidence"] > threshold)


def question_type(text: Column, types=QUESTION_TYPES) -> Column:
    found = F.lit("general")
    for name, pattern in reversed(types):
        found = F.when(text.rlike(f"(?i)(?:{pattern})"), F.lit(name)).otherwise(found)
    return found
