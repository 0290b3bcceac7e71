"""Conversation, knowledge-base and processing analytics over relational tables.

All functions take and return DataFrames; ``as_of`` stands for now. Ties are broken by id. Counts of nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import preview, vector_head

DEFAULT_TITLE = "新对话"


def message_totals(messages: DataFrame) -> DataFrame:
    """(conversation_id, message_count, first_at, last_at): the one aggregation that most reports share."""
    return messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def display_name(full_name: Column, username: Column) -> Column:
    return F.coalesce(F.nullif(full_name, F.lit("")), username)


def conversation_details(conversations: DataFrame, users: DataFrame, messages: DataFrame) -> DataFrame:
    c = conversations.alias("c").join(users.alias("u"), F.col("c.user_id") == F.col("u.id"))
    joined = c.join(message_totals(messages).alias("m"), F.col("c.id") == F.col("m.conversation_id"), "left")
    return joined.select(F.col("c.id"), "c.title", "c.is_archived", "c.created_at", "c.updated_at", "u.username", "u.full_name", F.coalesce("m.message_count", F.lit(0)).alias("message_count"), F.col("m.last_at").alias("last_message_at"))


def document_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.join(n, documents.id == n.document_id, "left").select(documents.id, "title", "status", "file_size", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def page_limit(requested: int | None, default: int = 20) -> int:
    return default if requested is None or not 1 <= requested <= 100 else requested


def conversation_page(conversations: DataFrame, users: DataFrame, messages: DataFrame, user_id: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    live = conversations.where(~F.col("is_archived"))
    live = live if user_id is None else live.where(F.col("user_id") == user_id)
    page = live.orderBy(F.desc("updated_at"), "id").offset(max(offset, 0)).limit(page_limit(limit))
    d = conversation_details(page, users, messages)
    return d.select("id", "title", "updated_at", "message_count", "last_message_at", display_name(F.col("full_name"), F.col("username")).alias("user_name"))


def conversation_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its messages as an array in order."""
    nested = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("messages"))
    return conversations.join(nested, conversations.id == nested.conversation_id, "left").select(conversations.id, "title", F.coalesce("messages", F.array().cast(nested.schema["messages"].dataType)).alias("messages"))


def message_tail(messages: DataFrame, n: int = 50, most: int = 200) -> DataFrame:
    """The last ``n`` messages of each conversation, with their place from the end and the total."""
    w = W.partitionBy("conversation_id")
    ranked = messages.withColumn("from_end", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("id")))).withColumn("total", F.count("*").over(w))
    return ranked.where(F.col("from_end") <= min(n, most))


def live_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.where(~F.col("is_archived")).agg(F.count("*").alias("total"))


def active_users(conversations: DataFrame, as_of: Column, days: int = 30, approximate: bool = False) -> DataFrame:
    recent = conversations.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    count = F.approx_count_distinct if approximate else F.count_distinct
    return recent.agg(count(F.col("user_id")).alias("active_users"))


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(60e6)


def average_minutes(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Mean of last minus first message over conversations with two messages or more, rounded half to even."""
    totals = message_totals(messages).where("message_count >= 2").join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id")
    mean = F.avg(minutes_between(F.col("first_at"), F.col("last_at")))
    return totals.agg(F.coalesce(F.bround(mean).cast("long"), F.lit(0).cast("long")).alias("avg_minutes"))


def daily_trend(conversations: DataFrame, as_of: Column, days: int = 7, zero_fill: bool = False) -> DataFrame:
    since = as_of - F.make_dt_interval(F.lit(days))
    trend = conversations.where(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    if not zero_fill:
        return trend
    every = conversations.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(since), F.to_date(as_of))).alias("day"))
    return every.join(trend, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def tokens(text: Column, pattern: str = "[一-龥]+") -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def topic_words(texts: DataFrame, key: str, column: Column, stop_words: DataFrame, shortest: int = 2, longest: int = 4) -> DataFrame:
    """(key, word): words of allowed length that are neither stop words nor numbers, before anything is shuffled."""
    words = texts.select(key, F.explode(column).alias("word"))
    words = words.where(F.length("word").between(shortest, longest) & ~F.col("word").rlike("^[0-9]+$"))
    return words.join(F.broadcast(stop_words.select("word").distinct()), "word", "left_anti")


def hot_topics(words: DataFrame, top: int = 10) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def hot_topics_tfidf(words: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Best ``2 * top`` words of each text by tf * ln(N / df), then the words that are best in most texts."""
    tf = words.groupBy(key, "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = words.select(key).distinct().agg(F.count("*").alias("docs"))
    score = F.round(F.col("tf") * F.log(F.col("docs") / F.col("df")), 9)
    best = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("score", score)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "word"))
    return hot_topics(best.withColumn("r", rank).where(F.col("r") <= 2 * top), top)


def text_keywords(words: DataFrame, key: str, top: int = 5) -> DataFrame:
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def recent_conversations(conversations: DataFrame, users: DataFrame, messages: DataFrame, n: int = 10) -> DataFrame:
    """The latest conversations, chosen before anything is joined."""
    latest = conversations.where(~F.col("is_archived")).orderBy(F.desc("updated_at"), "id").limit(n)
    own = messages.join(F.broadcast(latest.select(F.col("id").alias("conversation_id"))), "conversation_id", "left_semi")
    c = latest.join(users.select(F.col("id").alias("user_id"), "full_name", "username"), "user_id", "left").join(message_totals(own), F.col("id") == F.col("conversation_id"), "left")
    minutes = F.when(F.col("message_count") >= 2, F.floor(minutes_between(F.col("first_at"), F.col("last_at")))).otherwise(0).cast("long")
    return c.select("id", "title", display_name(F.col("full_name"), F.col("username")).alias("user_name"), F.coalesce("message_count", F.lit(0)).alias("message_count"), minutes.alias("minutes"), F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"))


def dashboard(conversations: DataFrame, documents: DataFrame, messages: DataFrame) -> DataFrame:
    hours = message_totals(messages).agg(F.coalesce(F.bround(F.sum(minutes_between(F.col("first_at"), F.col("last_at"))) / 60, 1), F.lit(0.0)).alias("total_hours"))
    return live_conversations(conversations).withColumnRenamed("total", "conversations").crossJoin(documents.agg(F.count("*").alias("documents"))).crossJoin(hours)


def document_list(documents: DataFrame, categories: DataFrame, owner: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of documents with the names of their categories, newest first, and ``total``, how many there are in all."""
    own = documents if owner is None else documents.where(F.col("user_id") == owner)
    names = categories.select(F.col("category_code").alias("file_category"), "category_name")
    page = own.orderBy(F.desc("created_at"), "id")
    page = page.offset(offset) if offset else page
    page = page if limit is None else page.limit(limit)
    named = page.join(names, "file_category", "left").crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))
    return named.select("id", "title", "file_category", "category_name", "status", "created_at", "total").orderBy(F.desc("created_at"), "id")


def chunk_pages(items: DataFrame, limit: int, offset: int = 0, head: int = 10, document_id: int | None = None) -> DataFrame:
    """(document_id, chunk_index, preview, vector_head, total): a page of the chunks of each document, or of one, in order."""
    own = items if document_id is None else items.where(F.col("document_id") == document_id)
    w = W.partitionBy("document_id")
    placed = own.select("document_id", "chunk_index", preview(F.col("content")).alias("preview"), vector_head(F.col("vector"), head).alias("vector_head"))
    placed = placed.withColumn("__n", F.row_number().over(w.orderBy("chunk_index"))).withColumn("total", F.count("*").over(w))
    return placed.where((F.col("__n") > offset) & (F.col("__n") <= offset + limit)).drop("__n")


def documents_per_category(documents: DataFrame, categories: DataFrame) -> DataFrame:
    n = documents.groupBy(F.col("file_category").alias("category_code")).agg(F.count("*").alias("n"))
    return categories.join(n, "category_code", "left").select("category_code", "category_name", F.coalesce("n", F.lit(0)).alias("n"))


def unmatched_categories(documents: DataFrame, categories: DataFrame) -> DataFrame:
    codes = categories.select(F.col("category_code").alias("file_category"))
    return documents.join(F.broadcast(codes), "file_category", "left_anti").groupBy("file_category").agg(F.count("*").alias("n"))


def search_documents(documents: DataFrame, keyword: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    hit = F.lit(True)
    if keyword:
        hit = hit & F.coalesce(F.contains(F.lower("title"), F.lower(F.lit(keyword))), F.lit(False))
    if status:
        hit = hit & (F.col("status") == status)
    if category:
        hit = hit & (F.col("file_category") == category)
    return documents.where(hit)


def search_conversations(conversations: DataFrame, keyword: str) -> DataFrame:
    k = F.lower(F.lit(keyword))
    return conversations.where(F.coalesce(F.contains(F.lower("title"), k), F.lit(False)) | F.coalesce(F.contains(F.lower("description"), k), F.lit(False)))


def created_between(table: DataFrame, after: Column, before: Column) -> DataFrame:
    return table.where((F.col("created_at") > after) & (F.col("created_at") < before))


def processing_summary(events: DataFrame) -> DataFrame:
    """Totals over the latest state of each file: a file succeeded if its last state has an end."""
    last = events.groupBy("file_path").agg(
        F.count_if(F.col("event_type") == "end").alias("ends"),
        F.max_by("processing_time", F.struct("ts", "event_id")).alias("processing_time"),
        F.sum("total_chars").alias("total_chars"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    ok = F.col("ends") > 0
    return last.agg(
        F.count("*").alias("total_files"), F.count_if(ok).alias("successful"), F.coalesce(F.round(F.avg(F.when(ok, F.col("processing_time"))), 6), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.sum("total_chars"), F.lit(0)).alias("total_chars"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.round(F.try_divide(F.count_if(ok), F.count("*")), 6), F.lit(0.0)).alias("success_rate"),
    )


def batch_stats(results: DataFrame) -> DataFrame:
    """Over (status, processing_time, chars, chunks) rows: rate of completed ones and their times and sizes."""
    done = F.col("status") == "completed"

    def over(f, c):
        return F.coalesce(F.round(f(F.when(done, F.col(c))), 6), F.lit(0.0))

    return results.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.coalesce(F.round(F.try_divide(F.count_if(done), F.count("*")), 6), F.lit(0.0)).alias("success_rate"),
        over(F.min, "processing_time").alias("min_time"), over(F.max, "processing_time").alias("max_time"), over(F.avg, "processing_time").alias("avg_time"), over(F.avg, "chars").alias("avg_chars"),
    )


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def error_summary(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").groupBy("file_path").agg(F.count("*").alias("errors"))


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def task_statistics(tasks: DataFrame, rollup: bool = False) -> DataFrame:
    by = tasks.rollup("type", "status") if rollup else tasks.groupBy("type", "status")
    seconds = F.unix_seconds("updated_at") - F.unix_seconds("created_at")
    return by.agg(F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("avg_seconds"))


def system_metrics(documents: DataFrame, messages: DataFrame, events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    since = as_of - F.make_dt_interval(F.lit(days))
    docs = documents.where((F.col("status") == "completed") & (F.col("created_at") >= since)).agg(F.count("*").alias("documents_processed"))
    asked = messages.where((F.col("role") == "user") & (F.col("created_at") >= since)).agg(F.count("*").alias("questions"))
    ended = F.col("event_type") == "end"
    times = events.where(F.col("ts") >= since).agg(F.round(F.avg(F.when(ended, F.col("processing_time"))), 6).alias("avg_time"), F.round(F.try_divide(F.count_if(ended), F.count_if(ended | (F.col("event_type") == "error"))), 6).alias("success_rate"))
    return docs.crossJoin(asked).crossJoin(times)


def embedding_metrics(requests: DataFrame) -> DataFrame:
    """Over (ok, tokens, seconds, cached) rows."""
    rate = lambda c: F.round(F.try_divide(F.count_if(c), F.count("*")), 6)
    return requests.agg(F.count("*").alias("requests"), F.count_if("ok").alias("succeeded"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), rate(F.col("cached")).alias("cache_hit_rate"))


def last_messages(messages: DataFrame) -> DataFrame:
    """(conversation_id, role, id, content): the last message of each role but system."""
    last = F.max_by(F.struct("id", "content"), F.struct("created_at", "id"))
    return messages.where("role in ('user', 'assistant')").groupBy("conversation_id", "role").agg(last.alias("m")).select("conversation_id", "role", "m.*")


def quality_report(answers: DataFrame) -> DataFrame:
    """(day, mean_score, n) over answers (created_at, score)."""
    return answers.groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


def conversation_titles(conversations: DataFrame, messages: DataFrame, chars: int = 20) -> DataFrame:
    """(id, title): a blank or default title becomes the beginning of the first user message, if there is one."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("content"))
    blank = F.coalesce(F.trim("title"), F.lit("")).isin("", DEFAULT_TITLE)
    own = conversations.join(first, conversations.id == first.conversation_id, "left")
    return own.select("id", F.when(blank, F.coalesce(F.nullif(F.substring("content", 1, chars), F.lit("")), F.lit(DEFAULT_TITLE))).otherwise(F.col("title")).alias("title"))
