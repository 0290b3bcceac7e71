"""After retrieval: deduplication, reranking, quality, context and prompts, per query.

Hits are rows (query_id, id, rank, score, content, ...); ranks start at 1 and are total.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import materialise
from .vectors import candidates, typed_hits

# Texts and phrases of answers.
NO_CONTEXT = "未检索到相关法律资料。"
SENSITIVE = ("具体投资建议", "医疗诊断", "政治敏感话题", "具体个案判决", "未经证实的法律解释")
ABSOLUTE = ("我建议你", "你应该", "必须", "绝对", "肯定", "百分之百", "毫无疑问")
MOST_HITS = 1000
DISCLAIMERS = ("仅供参考", "不构成法律建议", "具体案件请咨询专业律师", "以官方文件为准", "建议咨询专业人士")


def dedup_exact(hits: DataFrame) -> DataFrame:
    """The first of equal contents of a query."""
    first = F.row_number().over(W.partitionBy("query_id", F.sha2("content", 256)).orderBy("rank"))
    return hits.withColumn("__n", first).where("__n = 1").drop("__n")


def similar_texts(a: str, b: str, threshold: float) -> bool:
    """Ratio, longest common run over the shorter text (at 0.8 of the threshold), or word overlap reaches the threshold."""
    wa, wb = set(a.split()), set(b.split())
    if (len(wa & wb) / len(wa | wb) if wa | wb else 1.0) >= threshold:
        return True
    m = difflib.SequenceMatcher(None, a, b)
    # a run that is long enough covers the middle of a text that isn't much longer, so most texts need no search
    least = math.ceil(0.8 * threshold * min(len(a), len(b)) - 1e-9)
    if a[len(a) - least : least] in b and b[len(b) - least : least] in a:
        run = m.find_longest_match(0, len(a), 0, len(b)).size
        if run and run / min(len(a), len(b)) >= 0.8 * threshold:
            return True
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


def dedup_greedy(hits: DataFrame, threshold: float = 0.85, text: bool = True, semantic: bool = False) -> DataFrame:
    """Greedy in order of rank: a hit goes if it is like one already kept, by text and/or by vector. Hits without a vector
    are kept and compared with nothing.

    A query has at most twice ``k`` hits; one with more than ``MOST_HITS`` is refused, since comparing all of them in one
    task would not end. Near-duplicates of a whole corpus are ``dedup.near_duplicates``'s work.
    """
    schema = hits.schema
    n = F.count("*").over(W.partitionBy("query_id"))
    # few rows, much work in each: not to be gathered into one task
    hits = hits.repartition(hits.sparkSession.sparkContext.defaultParallelism, "query_id").withColumn("__n", n).where(F.when(F.col("__n") <= MOST_HITS, F.lit(True)).otherwise(F.raise_error(F.lit("dedup_greedy: too many hits of a query")).cast("boolean"))).drop("__n")

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        chosen: list[int] = []
        vectors: list[np.ndarray] = []
        for i in range(len(frame)):
            content = frame["content"].iloc[i] or ""
            if text and any(similar_texts(content, frame["content"].iloc[j] or "", threshold) for j in chosen):
                continue
            v = frame["vector"].iloc[i] if semantic else None
            if v is not None:
                v = np.asarray(v, dtype=np.float64)
                n = np.linalg.norm(v)
                if n and any(float(v @ w) / (n * np.linalg.norm(w)) >= threshold for w in vectors if np.linalg.norm(w)):
                    continue
                vectors.append(v)
            chosen.append(i)
        return frame.iloc[chosen]

    return hits.groupBy("query_id").applyInPandas(keep, schema)


def dedup(hits: DataFrame, threshold: float = 0.85, semantic: bool = False) -> DataFrame:
    """Exact, then by text, then, if asked for, by vector."""
    out = dedup_greedy(dedup_exact(hits), threshold)
    return dedup_greedy(out, threshold, text=False, semantic=True) if semantic else out


def rerank(hits: DataFrame) -> DataFrame:
    """Score plus a bonus for length and for query words in the content; stable. Needs ``query_text``."""
    n = F.length("content")
    length = F.when(n.between(100, 500), 0.05).when(n < 100, -0.02).otherwise(-0.01)
    words = F.filter(F.array_distinct(F.split(F.lower(F.trim("query_text")), r"(?U)\s+")), lambda w: w != "")
    found = F.size(F.filter(words, lambda w: F.contains(F.lower("content"), w)))
    score = F.col("score") + length + F.least(found * F.lit(0.03), F.lit(0.15))
    scored = hits.withColumn("rerank_score", F.round(score, 9))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return scored.withColumn("rank", place)


def quality(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n, avg_score, max_score, min_score, quality); a query without hits is ``poor``."""
    s = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("a"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    grade = F.when((F.col("a") >= 0.8) & (F.col("n") >= 3), "excellent").when((F.col("a") >= 0.7) & (F.col("n") >= 2), "good").when(F.col("a") >= 0.5, "acceptable").otherwise("poor")
    zero = F.lit(0.0)
    out = queries.select("query_id").join(s, "query_id", "left")
    return out.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(F.round(c, 3), zero).alias(a) for c, a in (("a", "avg_score"), ("hi", "max_score"), ("lo", "min_score"))], grade.alias("quality"))


def final_top(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; a blank query has none."""
    return hits.where((F.col("rank") <= k) & (F.trim("query_text") != ""))


def threshold_sweep(hits: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n): hits at or above each threshold, in one pass."""
    counted = hits.agg(*[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])))


def reuse_key(text: Column, k: int, threshold: float, strategy: str = "vector", document: str = "") -> Column:
    return F.concat_ws("|", F.lower(F.trim(text)), F.lit(str(k)), F.lit(str(threshold)), F.lit(strategy), F.lit(document))


def distinct_queries(queries: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(one query for each key, (query_id, first_id) of all): equal queries are searched once."""
    keyed = queries.withColumn("key", reuse_key(F.col("text"), k, threshold))
    first = keyed.groupBy("key").agg(F.min("query_id").alias("first_id"))
    same = keyed.join(first, "key").select("query_id", "first_id")
    return queries.join(first.select(F.col("first_id").alias("query_id")), "query_id", "left_semi"), same


def context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources with title, score in percent and content."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "document_title", "score", "content")))
    block = lambda x: F.concat(
        F.lit("### 资料来源"), x["rank"].cast("string"), F.lit("\n**文档标题**："), x["document_title"], F.lit("\n**相似度**："),
        F.format_string("%.2f%%", x["score"] * 100), F.lit("\n**内容片段**：\n"), x["content"],
    )
    text = hits.groupBy("query_id").agg(F.array_join(F.transform(parts, block), "\n\n").alias("context"))
    return queries.select("query_id").join(text, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """(conversation_id, id, history): for each message the ``n`` before it, oldest first, with their roles."""
    w = W.partitionBy("conversation_id").orderBy("created_at", "id").rowsBetween(-n, -1)
    return messages.select("conversation_id", "id", F.collect_list(F.struct("role", "content")).over(w).alias("history"))


def message_metadata(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, meta_data): JSON with the number of hits and the first of them."""
    docs = F.array_sort(F.collect_list(F.struct("rank", "document_id", F.round("score", 6).alias("score"))))
    return hits.groupBy("query_id").agg(F.to_json(F.struct(F.count("*").alias("doc_count"), F.slice(docs, 1, most).alias("retrieved_docs"))).alias("meta_data"))


META_SCHEMA = "doc_count long, retrieved_docs array<struct<rank:int,document_id:long,score:double>>"


def cited_documents(messages: DataFrame) -> DataFrame:
    """(query_id, rank, document_id, score) from metadata JSON; what is no JSON cites nothing."""
    parsed = messages.select("query_id", F.from_json("meta_data", META_SCHEMA).alias("m"))
    return parsed.select("query_id", F.explode_outer("m.retrieved_docs").alias("d")).select("query_id", "d.*")


def prompts(questions: DataFrame) -> DataFrame:
    """(id, prompt) from question, category, elements, entities, missing and context columns; a null context gives the
    prompt without sources."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}："), F.array_join(c, "、")))
    head = F.concat_ws("\n", F.concat(F.lit("问题："), F.col("question")), F.concat(F.lit("领域："), F.coalesce("category", F.lit("其他"))), part("法律要素", F.col("elements")), part("关键实体", F.col("entities")), part("缺失信息", F.col("missing")))
    return questions.select("id", F.concat_ws("\n\n", F.when(F.col("context").isNotNull(), F.concat(F.lit("参考资料：\n"), F.col("context"))), head).alias("prompt"))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0)))


def grounding(answer: Column, source: Column) -> Column:
    """Share of the answer's words of three characters or more that the source has; 0 if there are none."""
    words = long_words(answer)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, long_words(source))), F.size(words)), F.lit(0.0))


def safety_flags(answer: Column, sensitive=SENSITIVE, absolute=ABSOLUTE, disclaimers=DISCLAIMERS) -> Column:
    """Array of warnings."""
    has = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(answer, w))
    topics = F.transform(has(sensitive), lambda w: F.concat(F.lit("涉及敏感话题: "), w))
    firm = F.transform(has(absolute), lambda w: F.concat(F.lit("使用绝对化表述: "), w))
    bare = F.when(F.size(has(disclaimers)) == 0, F.array(F.lit("缺乏适当的法律免责声明"))).otherwise(F.array().cast("array<string>"))
    return F.concat(topics, firm, bare)


def validate_answer(grounded: Column, terms_ok: Column, complete: Column) -> Column:
    """Struct (confidence, issues, valid)."""
    confidence = F.when(grounded, 1.0).otherwise(0.7) * F.when(terms_ok, 1.0).otherwise(0.9) * F.when(complete, 1.0).otherwise(0.8)
    issues = F.array_compact(F.array(F.when(~grounded, F.lit("not grounded")), F.when(~terms_ok, F.lit("terminology")), F.when(~complete, F.lit("incomplete"))))
    return F.struct(F.round(confidence, 6).alias("confidence"), issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def key_information(conversations: DataFrame, messages: DataFrame, entity_values: Column) -> DataFrame:
    """(id, key_information): distinct entities of the user's messages, one a line; ``无`` if there are none."""
    said = messages.where("role = 'user'").select("conversation_id", F.explode(entity_values).alias("v"))
    joined = said.groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("v")), "\n").alias("k"))
    return conversations.join(joined, conversations.id == joined.conversation_id, "left").select(conversations.id, F.coalesce("k", F.lit("无")).alias("key_information"))


def retrieve(queries: DataFrame, items: DataFrame, titles: DataFrame, k: int = 5, threshold: float = 0.3, semantic: bool = False, contents: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, quality): candidates, typed rows, deduplication, reranking, the first ``k``, and a grade for each query.

    ``queries`` (query_id, query_text, vector), ``items`` (id, document_id, content, vector), ``titles`` (document_id,
    document_title). ``contents`` gives (id, content) of hits (id, document_id) where ``items`` have no content.
    """
    own = ["id", "document_id", *([] if contents else ["content"]), *(["vector"] if semantic else [])]
    found = candidates(queries, items, k, threshold).join(items.select(*own), "id")
    if contents:
        found = materialise(found, "hits")
        found = found.join(contents(found), "id")
    typed = typed_hits(found, titles).join(queries.select("query_id", "query_text"), "query_id")
    hits = final_top(rerank(dedup(typed, semantic=semantic)), k)
    return hits, quality(queries, hits)
