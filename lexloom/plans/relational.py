"""Registered queries: conversation, document, permission and change jobs, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import chunk, rbac, segment, upsert
from ..sources import files, sinks, tables
from ..sources.scratch import materialise, new_path, shared_dir
from ..streaming import jobs
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
S = F.unix_seconds
STOP_WORDS = ("the", "and", "of", "in", "to", "is", "der", "die", "das", "und", "les", "des", "la", "el", "que")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = V.sql(sql)
        return f

    return register


@query("""select c.id, c.title, c.is_archived, c.created_s, c.updated_s, u.username, u.full_name, coalesce(t.message_count, 0) as message_count, t.last_s as last_message_s
from m_conv c join m_users u on c.user_id = u.id left join m_tot t on t.conversation_id = c.id""")
def a1_conversation_details(s, d):
    out = A.conversation_details(V.conversations(s, d), V.users(s, d), V.messages(s, d))
    return out.select("id", "title", "is_archived", S("created_at").alias("created_s"), S("updated_at").alias("updated_s"), "username", "full_name", "message_count", S("last_message_at").alias("last_message_s"))


@query("""select d.id, d.title, d.status, d.file_size, coalesce(n, 0) as chunk_count from m_docs d
left join (select document_id, count(*) as n from m_items group by 1) c on c.document_id = d.id""")
def a2_document_stats(s, d):
    return A.document_stats(V.documents(s, d), V.items(s, d))


@query("""select c.id, c.title, c.updated_s, coalesce(t.message_count, 0) as message_count, t.last_s as last_message_s, coalesce(nullif(u.full_name, ''), u.username) as user_name
from (select * from m_conv where not is_archived order by updated_s desc, id limit 20 offset 20) c join m_users u on c.user_id = u.id left join m_tot t on t.conversation_id = c.id""")
def a3_conversation_page(s, d):
    out = A.conversation_page(V.conversations(s, d), V.users(s, d), V.messages(s, d), limit=20, offset=20)
    return out.select("id", "title", S("updated_at").alias("updated_s"), "message_count", S("last_message_at").alias("last_message_s"), "user_name")


@query("""select c.id, c.title, coalesce(string_agg(m.role || ':' || length(m.content), ',' order by m.created_s, m.id), '') as transcript from m_conv c left join m_msg m on m.conversation_id = c.id group by 1, 2""")
def a4_conversation_messages(s, d):
    out = A.conversation_messages(V.conversations(s, d), V.messages(s, d))
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string")))
    return out.select("id", "title", F.array_join(line, ",").alias("transcript"))


@query("""select conversation_id, id, role, from_end, total from (select *, row_number() over (partition by conversation_id order by created_s desc, id desc) as from_end, count(*) over (partition by conversation_id) as total from m_msg) where from_end <= 3""")
def a5_message_tail(s, d):
    return A.message_tail(V.messages(s, d), 3).select("conversation_id", "id", "role", F.col("from_end").cast("long").alias("from_end"), "total")


@query("select count(*) as total from m_conv where not is_archived")
def a6_live_conversations(s, d):
    return A.live_conversations(V.conversations(s, d))


@query(f"select count(distinct user_id) as active_users from m_conv where created_s >= {V.AS_OF} - 30 * 86400")
def a7_active_users(s, d):
    return A.active_users(V.conversations(s, d), V.as_of())


@query("select coalesce(round_even(avg((last_s - first_s) / 60.0::double), 0)::bigint, 0) as avg_minutes from m_tot where message_count >= 2")
def a8_average_minutes(s, d):
    return A.average_minutes(V.conversations(s, d), V.messages(s, d))


@query(f"select strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d') as day, count(*) as n from m_conv where created_s >= {V.AS_OF} - 7 * 86400 group by 1")
def a9_daily_trend(s, d):
    return A.daily_trend(V.conversations(s, d), V.as_of()).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def _stop(s):
    return s.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def _words(s, d):
    texts = V.messages(s, d).select("id", A.tokens(F.lower("content"), "[a-z]+").alias("w"))
    return A.topic_words(texts, "id", F.col("w"), _stop(s))


_WORDS = f"w as (select id, word from (select id, unnest(regexp_extract_all(lower(content), '[a-z]+')) as word from m_msg) where length(word) between 2 and 4 and word not in {STOP_WORDS})"


@query(f"with {_WORDS} select word, count(*) as n from w group by 1 order by n desc, word limit 10")
def a10_hot_topics(s, d):
    return A.hot_topics(_words(s, d))


@query(f"""with {_WORDS}, tf as (select id, word, count(*) as tf from w group by 1, 2), df as (select word, count(*) as df from tf group by 1),
n as (select count(distinct id) as docs from w), b as (select id, word, row_number() over (partition by id order by round(tf * ln(docs / df), 9) desc, word) as r from tf join df using (word) cross join n)
select word, count(*) as n from b where r <= 20 group by 1 order by n desc, word limit 10""")
def a11_hot_topics_tfidf(s, d):
    return A.hot_topics_tfidf(_words(s, d), "id")


@query(f"""with {_WORDS} select id, word, n, rank from (select id, word, count(*) as n, row_number() over (partition by id order by count(*) desc, word) as rank from w group by 1, 2) where rank <= 5""")
def a12_text_keywords(s, d):
    return A.text_keywords(_words(s, d), "id").select("id", "word", "n", F.col("rank").cast("long").alias("rank"))


@query()
def a12_dictionary_keywords(s, d):
    """Keywords of messages cut by a word table: the endings and beginnings, of two to four letters, of the documents' words."""
    w = F.explode(A.tokens(F.lower("text"), "[a-z]+"))
    # words are counted before they are cut: there are far fewer different ones
    words = V.texts(s, d).select(w.alias("w")).where("length(w) > 4").groupBy("w").agg(F.count("*").alias("n"))
    parts = words.select("n", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.array(F.substring(F.col("w"), F.lit(1), n), F.substring(F.col("w"), -n, n))))).alias("word"))
    table = parts.groupBy("word").agg(F.sum("n").alias("frequency"))
    texts = V.messages(s, d).select("id", segment.segmenter(table, "[a-z]+")(F.lower("content")).alias("w"))
    return A.text_keywords(A.topic_words(texts, "id", F.col("w"), _stop(s)), "id").select("id", "word", "n", F.col("rank").cast("long").alias("rank"))


@query("""select c.id, c.title, coalesce(nullif(u.full_name, ''), u.username) as user_name, coalesce(message_count, 0) as message_count,
case when message_count >= 2 then (last_s - first_s) // 60 else 0 end::bigint as minutes, strftime(make_timestamp(updated_s * 1000000), '%Y-%m-%d %H:%M') as updated
from (select * from m_conv where not is_archived order by updated_s desc, id limit 10) c left join m_users u on u.id = c.user_id left join m_tot t on t.conversation_id = c.id""")
def a13_recent_conversations(s, d):
    return A.recent_conversations(V.conversations(s, d), V.users(s, d), V.messages(s, d))


@query("""select (select count(*) from m_conv where not is_archived) as conversations, (select count(*) from m_docs) as documents, (select coalesce(round_even(sum((last_s - first_s) / 60.0::double) / 60, 1), 0) from m_tot) as total_hours""")
def a14_dashboard(s, d):
    return A.dashboard(V.conversations(s, d), V.documents(s, d), V.messages(s, d))


_LISTED = "select d.id, d.title, d.file_category, c.category_name, d.status, d.created_s, (select count(*) from m_docs) as total from {} d left join m_cat c on c.category_code = d.file_category"


def _listed(s, d, **page):
    return A.document_list(V.documents(s, d), V.categories(s, d), **page).withColumn("created_s", S("created_at")).drop("created_at")


@query(_LISTED.format("m_docs"))
def a15_document_list(s, d):
    return _listed(s, d)


@query(_LISTED.format("(select * from m_docs order by created_s desc, id limit 50 offset 100)"))
def a15_document_page(s, d):
    return _listed(s, d, limit=50, offset=100)


@query("select c.category_code, c.category_name, count(d.id) as n from m_cat c left join m_docs d on c.category_code = d.file_category group by 1, 2")
def a16_documents_per_category(s, d):
    return A.documents_per_category(V.documents(s, d), V.categories(s, d))


@query("select file_category, count(*) as n from m_docs where file_category not in (select category_code from m_cat) group by 1")
def a16_unmatched_categories(s, d):
    return A.unmatched_categories(V.documents(s, d), V.categories(s, d))


_PREVIEW = "case when length(content) > 200 then substring(content, 1, 200) || '...' else content end as preview, len(vector[1:10])::int as head, round(list_sum(list_transform(vector[1:10], lambda x: x)), 6) as head_sum"


def _chunk_pages(s, d, limit, offset=0):
    total = F.aggregate(F.transform("vector_head", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    out = A.chunk_pages(V.items(s, d), limit, offset)
    return out.select("document_id", "chunk_index", "preview", F.size("vector_head").alias("head"), F.round(total, 6).alias("head_sum"), "total")


@query(f"select document_id, chunk_index, {_PREVIEW}, count(*) over (partition by document_id) as total from m_items")
def a17_chunk_previews(s, d):
    return _chunk_pages(s, d, 1 << 30)


@query(f"select * from (select document_id, chunk_index, {_PREVIEW}, count(*) over (partition by document_id) as total from m_items) where chunk_index >= 2 and chunk_index < 7")
def a17_chunk_page(s, d):
    return _chunk_pages(s, d, 5, 2)


@query("select id, title, status from m_docs where contains(lower(title), 'src1') and status = 'completed'")
def a18_search_documents(s, d):
    return A.search_documents(V.documents(s, d), keyword="SRC1", status="completed").select("id", "title", "status")


@query("select id, title from m_conv where contains(lower(title), 'th')")
def a18_search_conversations(s, d):
    return A.search_conversations(V.conversations(s, d), "TH").select("id", "title")


@query(f"select id, created_s from m_conv where created_s > {V.EPOCH + 5 * 86400} and created_s < {V.EPOCH + 20 * 86400}")
def a19_created_between(s, d):
    out = A.created_between(V.conversations(s, d), F.timestamp_seconds(F.lit(V.EPOCH + 5 * 86400)), F.timestamp_seconds(F.lit(V.EPOCH + 20 * 86400)))
    return out.select("id", S("created_at").alias("created_s"))


def _grants(s, d):
    return rbac.granted(V.user_roles(s, d), V.role_permissions(s, d), V.permissions(s, d))


_G = "g as (select distinct user_id, code, module from m_ur join m_rp using (role_id) join m_perms p on p.id = permission_id)"


@query(f"with {_G} select id, is_superuser or id in (select user_id from g where code in ('chat:delete', 'role:view')) as allowed from m_users")
def a20_has_any_permission(s, d):
    return rbac.has_permission(V.users(s, d), _grants(s, d), ["chat:delete", "role:view"])


@query(f"with {_G} select id, is_superuser or id in (select user_id from g where code in ('chat:view', 'chat:send') group by 1 having count(distinct code) = 2) as allowed from m_users")
def a20_has_all_permissions(s, d):
    return rbac.has_permission(V.users(s, d), _grants(s, d), ["chat:view", "chat:send"], all_of=True)


@query("""select v.id as viewer_id, count(*) as visible from m_users v join m_conv c on v.is_superuser or v.id = c.user_id group by 1""")
def a21_visible_conversations(s, d):
    viewers = V.users(s, d).withColumn("can_view_all", F.col("is_superuser"))
    return rbac.visible_counts(viewers, V.conversations(s, d))


@query(f"with {_G} select user_id, code, module from g union select u.id, code, module from m_users u, m_perms where is_superuser")
def a22_effective_permissions(s, d):
    return rbac.effective_permissions(V.users(s, d), V.user_roles(s, d), V.role_permissions(s, d), V.permissions(s, d))


@query("""select u.id, u.username, coalesce(r.roles, '') as roles, (select count(*) from m_users) as total from m_users u left join (select user_id, string_agg(distinct code, ',' order by code) as roles from m_ur join m_roles r on r.id = role_id group by 1) r on r.user_id = u.id""")
def a23_users_with_roles(s, d):
    return rbac.users_with_roles(V.users(s, d), V.user_roles(s, d), V.roles(s, d)).withColumn("roles", F.array_join("roles", ","))


@query("select r.id, r.code, count(distinct user_id) as user_count from m_roles r left join m_ur on r.id = role_id group by 1, 2")
def a24_role_user_counts(s, d):
    return rbac.role_user_counts(V.roles(s, d), V.user_roles(s, d))


@query("""select r.id, r.code, count(distinct user_id) as user_count, coalesce(max(codes), '') as permissions from m_roles r left join m_ur on r.id = role_id left join (select role_id as k, string_agg(code, ',' order by code) as codes from m_rp join m_perms p on p.id = permission_id group by 1) on k = r.id group by 1, 2""")
def a24_role_details(s, d):
    out = rbac.role_details(V.roles(s, d), V.user_roles(s, d), V.role_permissions(s, d), V.permissions(s, d))
    return out.withColumn("permissions", F.array_join("permissions", ","))


@query("select id, code from m_roles where id in (select role_id from m_ur)")
def a24_roles_in_use(s, d):
    return rbac.roles_in_use(V.roles(s, d), V.user_roles(s, d)).select("id", "code")


@query("""select u.id as user_id, p.module, count(distinct p.code) as codes from m_users u join m_ur on user_id = u.id join m_rp using (role_id) join m_perms p on p.id = permission_id group by 1, 2""")
def a25_permissions_by_module(s, d):
    return _grants(s, d).groupBy("user_id", "module").agg(F.count_distinct("code").alias("codes"))


@query("""with r as (select permission_id, role_id, count(*) as users from m_rp join m_ur using (role_id) group by 1, 2)
select p.module, count(distinct p.code) as permissions, count(distinct role_id) as roles, sum(users)::bigint as grants from m_perms p join r on r.permission_id = p.id group by 1""")
def a26_permission_stats(s, d):
    # how often each module's permissions are granted, over all users
    uses = V.role_permissions(s, d).join(V.user_roles(s, d), "role_id").groupBy("permission_id", "role_id").agg(F.count("*").alias("users"))
    p = V.permissions(s, d).join(uses, F.col("id") == F.col("permission_id"))
    return p.groupBy("module").agg(F.count_distinct("code").alias("permissions"), F.count_distinct("role_id").alias("roles"), F.sum("users").alias("grants"))


# links as they are in use: the grants of roles that active users hold
_USED = "(select distinct role_id, permission_id from m_rp join m_ur using (role_id) join m_users u on u.id = user_id where is_active)"


def _used(s, d):
    active = V.user_roles(s, d).join(V.users(s, d).where("is_active").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return V.role_permissions(s, d).join(active, "role_id", "left_semi")


@query(f"""select p.module, p.code, coalesce(string_agg(r.code, ',' order by r.code), '') as roles, count(r.code)::int as role_count from m_perms p left join {_USED} g on g.permission_id = p.id left join m_roles r on r.id = g.role_id group by 1, 2""")
def a25_permission_roles(s, d):
    return rbac.permission_roles(V.permissions(s, d), _used(s, d), V.roles(s, d)).withColumn("roles", F.array_join("roles", ","))


@query(f"""select p.module, p.code, coalesce(string_agg(r.code, ',' order by r.code), '') as roles, count(r.code)::int as role_count from m_perms p left join {_USED} g on g.permission_id = p.id left join m_roles r on r.id = g.role_id where p.module = 'chat' group by 1, 2""")
def a25_permission_roles_of_module(s, d):
    return rbac.permission_roles(V.permissions(s, d), _used(s, d), V.roles(s, d), "chat").withColumn("roles", F.array_join("roles", ","))


@query(f"""with p as (select * from m_perms where id in (select permission_id from {_USED} where role_id = 2))
select count(*) as permissions, count(distinct module) as modules, string_agg(distinct module, ',' order by module) as module_list, (select count(*) from m_roles where id in (select role_id from m_ur)) as roles from p""")
def a26_permission_totals(s, d):
    held = V.permissions(s, d).join(_used(s, d).where("role_id = 2").select(F.col("permission_id").alias("id")), "id", "left_semi")
    out = rbac.permission_stats(held, rbac.roles_in_use(V.roles(s, d), V.user_roles(s, d)))
    return out.withColumn("module_list", F.array_join("module_list", ","))


@query("select user_id, permission_id from m_ur, (select id as permission_id from m_perms where code in ('document:view', 'chat:view')) where role_id = 3")
def a27_expand_grants(s, d):
    grants = rbac.expand_grants(V.roles(s, d), V.permissions(s, d), "guest", list(V.GUEST_GRANTS))
    return V.user_roles(s, d).join(F.broadcast(grants), "role_id").select("user_id", "permission_id")


@query("""with l as (select file_path, count(*) filter (where event_type = 'end') as ends, arg_max(processing_time, (ts, event_id)) as pt, sum(total_chars)::bigint as chars, count(*) filter (where event_type = 'error') as errors from m_ev group by 1)
select count(*) as total_files, count(*) filter (where ends > 0) as successful, coalesce(round(avg(pt) filter (where ends > 0), 6), 0) as avg_time, sum(chars)::bigint as total_chars, sum(errors)::bigint as errors, round(count(*) filter (where ends > 0) / count(*), 6) as success_rate from l""")
def a28_processing_summary(s, d):
    return A.processing_summary(V.processing_events(s, d))


def _results(s, d):
    e = V.processing_events(s, d)
    return e.select("event_id", "file_path", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), "processing_time", F.col("total_chars").cast("double").alias("chars"))


@query("""with r as (select case when event_type = 'error' then 'failed' else 'completed' end as status, processing_time as t, total_chars as c from m_ev)
select count(*) as total, count(*) filter (where status = 'completed') as completed, round(count(*) filter (where status = 'completed') / count(*), 6) as success_rate, round(min(t) filter (where status = 'completed'), 6) as min_time, round(max(t) filter (where status = 'completed'), 6) as max_time, round(avg(t) filter (where status = 'completed'), 6) as avg_time, round(avg(c) filter (where status = 'completed'), 6) as avg_chars from r""")
def a29_batch_stats(s, d):
    return A.batch_stats(_results(s, d))


@query("select event_id, file_path, event_type from m_ev order by ts desc, event_id desc limit 100")
def a30_recent_events(s, d):
    return A.recent_events(V.processing_events(s, d)).select("event_id", "file_path", "event_type")


@query("select event_type, count(*) as n from m_ev group by 1")
def a30_events_by_type(s, d):
    return A.events_by_type(V.processing_events(s, d))


@query("select file_path, count(*) as errors from m_ev where event_type = 'error' group by 1")
def a30_error_summary(s, d):
    return A.error_summary(V.processing_events(s, d))


@query("select type, status, count(*) as n, round(avg(seconds), 6) as avg_seconds from m_tasks group by rollup (type, status)")
def a31_task_statistics(s, d):
    return A.task_statistics(V.tasks(s, d), rollup=True)


@query(f"""select (select count(*) from m_docs where status = 'completed' and created_s >= {V.AS_OF - 7 * 86400}) as documents_processed, (select count(*) from m_msg where role = 'user' and created_s >= {V.AS_OF - 7 * 86400}) as questions,
round(avg(processing_time) filter (where event_type = 'end'), 6) as avg_time, round(count(*) filter (where event_type = 'end') / count(*) filter (where event_type in ('end', 'error')), 6) as success_rate from m_ev where ts >= make_timestamp({V.AS_OF - 7 * 86400}::bigint * 1000000)""")
def a32_system_metrics(s, d):
    return A.system_metrics(V.documents(s, d), V.messages(s, d), V.processing_events(s, d), V.as_of())


@query("""select count(*) as requests, count(*) filter (where event_type <> 'error') as succeeded, sum(total_chars)::bigint as tokens, round(avg(processing_time), 6) as avg_seconds, round(count(*) filter (where event_type = 'progress') / count(*), 6) as cache_hit_rate from m_ev""")
def a33_embedding_metrics(s, d):
    e = V.processing_events(s, d)
    return A.embedding_metrics(e.select((F.col("event_type") != "error").alias("ok"), F.col("total_chars").alias("tokens"), F.col("processing_time").alias("seconds"), (F.col("event_type") == "progress").alias("cached")))


@query("select conversation_id, role, arg_max(id, (created_s, id)) as id, arg_max(content, (created_s, id)) as content from m_msg where role in ('user', 'assistant') group by 1, 2")
def a34_last_messages(s, d):
    return A.last_messages(V.messages(s, d))


@query("select strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d') as day, round(avg(tokens_used / 1000.0::double), 6) as mean_score, count(*) as n from m_msg where role = 'assistant' group by 1")
def a35_quality_report(s, d):
    answers = V.messages(s, d).where("role = 'assistant'").select("created_at", (F.col("tokens_used") / 1000.0).alias("score"))
    return A.quality_report(answers).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"select c.id, case when c.id % 4 = 0 then 'kept' else coalesce(nullif(substring(m.first, 1, 20), ''), '{V.DEFAULT_TITLE}') end as title from m_conv c left join (select conversation_id, arg_min(content, (created_s, id)) as first from m_msg where role = 'user' group by 1) m on m.conversation_id = c.id")
def t16_conversation_titles(s, d):
    c = V.conversations(s, d).withColumn("title", F.when(F.col("id") % 4 == 0, "kept").otherwise(F.lit(V.DEFAULT_TITLE)))
    return A.conversation_titles(c, V.messages(s, d))


@query(f"""with t as (select id, (updated_s - created_s) // 60 as m, {V.AS_OF} - updated_s as ago, updated_s from m_conv)
select id, case when m < 60 then m || '分钟' when m < 1440 then (m // 60) || '小时' else (m // 1440) || '天' end as duration,
case when ago < 60 then '刚刚' when ago < 3600 then (ago // 60) || '分钟前' when ago < 86400 then (ago // 3600) || '小时前' when ago < 604800 then (ago // 86400) || '天前' else strftime(make_timestamp(updated_s * 1000000), '%Y-%m-%d') end as ago from t""")
def t17_time_labels(s, d):
    from ..functions.text import duration_label, relative_time_label

    c = V.conversations(s, d)
    return c.select("id", duration_label(A.minutes_between(F.col("created_at"), F.col("updated_at"))).alias("duration"), relative_time_label(F.col("updated_at"), V.as_of()).alias("ago"))


@query("""with n as (select c_custkey as id, 'user' || (c_custkey % 900) as username, case when c_custkey % 5 = 0 then null else 'mail' || (c_custkey % 1100) end as email from customer),
e as (select username, 'mail' || (id * 7) as email from m_users), x as (select *, row_number() over (partition by username order by id) as ru, row_number() over (partition by email order by id) as re from n)
select id, case when username in (select username from e) then 'exists: username' when ru > 1 then 'repeated: username' when email in (select email from e) then 'exists: email' when email is not null and re > 1 then 'repeated: email' end as reason from x""")
def u1_accept_unique(s, d):
    key = F.col("c_custkey")
    new = V.table(s, d, "customer").select(key.alias("id"), F.concat(F.lit("user"), (key % 900).cast("string")).alias("username"), F.when(key % 5 != 0, F.concat(F.lit("mail"), (key % 1100).cast("string"))).alias("email"))
    old = V.users(s, d).select("username", F.concat(F.lit("mail"), (F.col("id") * 7).cast("string")).alias("email"))
    return upsert.accept_unique(new, old, ["username", "email"], "id").select("id", "reason")


@query("select user_id, role_id from m_ur where user_id % 4 <> 1 union all select distinct id, 1 + (id * 7) % 5 from m_users where id % 4 = 1 and 1 + (id * 7) % 5 <= 3")
def u2_replace_links(s, d):
    changes = V.users(s, d).where("id % 4 = 1").select(F.col("id").alias("user_id"), (1 + (F.col("id") * 7) % 5).alias("role_id"))
    return upsert.replace_links(V.user_roles(s, d), changes, V.roles(s, d), "user_id", "role_id")


@query(f"select id, case when id % 3 = 0 and id % 2 = 0 then 'renamed' else title end as title, is_archived or coalesce(id % 3 = 0, false) as is_archived, case when id % 3 = 0 then {V.AS_OF} else updated_s end as updated_s from m_conv")
def u3_patch(s, d):
    c = V.conversations(s, d)
    changes = c.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.lit("renamed")).alias("title"), F.lit(True).alias("is_archived"))
    return upsert.patch(c, changes, "id", V.as_of()).select("id", "title", "is_archived", S("updated_at").alias("updated_s"))


@query("select id, case when id % 3 = 0 and status not in ('processing', 'completed') then case when id % 6 = 0 then 'completed' else 'failed' end else status end as status, case when id % 6 = 0 and status not in ('processing', 'completed') then (file_size // 100)::bigint else 0 end as total_chunks from m_docs")
def u4_apply_results(s, d):
    none = F.create_map().cast("map<string,string>")
    docs = V.documents(s, d).select("id", "status", F.lit(0).cast("long").alias("total_chunks"), F.lit(None).cast("string").alias("processing_error"), none.alias("meta_data"))
    results = V.documents(s, d).where("id % 3 = 0").select("id", (F.col("id") % 6 == 0).alias("ok"), F.floor(F.col("file_size") / 100).alias("chunks"), F.lit("boom").alias("error"), F.create_map(F.lit("by"), F.lit("job")).alias("meta"))
    return upsert.apply_results(docs, results).select("id", "status", "total_chunks")


@query("select id, 1 + (id % 7) as attempts from m_docs where id % 7 <= 2")
def u5_retry(s, d):
    def attempt(rows):
        # a document comes through once it has been tried as often as its id modulo 7 asks for
        n = attempt.n = getattr(attempt, "n", 0) + 1
        return rows.withColumn("error", F.when(F.col("id") % 7 >= n, F.lit("not yet")))

    good, _ = upsert.retry(V.documents(s, d).select("id"), attempt, "id")
    return good.select("id", F.col("attempts").cast("long").alias("attempts"))


@query("select id::varchar as id, conversation_id::varchar as conversation_id, role, content, tokens_used, created_s from m_msg")
def s1_load(s, d):
    path = f"{shared_dir(s)}/lexloom/table-{uuid.uuid4().hex}"
    V.messages(s, d).select(F.col("id").cast("string"), F.col("conversation_id").cast("string"), "role", "content", F.col("tokens_used").cast("int"), "created_at").write.parquet(path)
    return tables.load(s, path, "messages").select("id", "conversation_id", "role", "content", "tokens_used", S("created_at").alias("created_s"))


@query()
def s2_list_files(s, d):
    out = files.list_files(s, d, "*.parquet")
    return out.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "size", "extension")


@query("select doc_id, 'utf-8' as encoding, text from documents")
def s3_decode(s, d):
    return V.texts(s, d).select("doc_id", files.decode(F.col("text").cast("binary")).alias("r")).select("doc_id", "r.encoding", "r.text")


@query("""select id, filename, case when id % 5 = 4 then 'unsupported' when file_size > 3000 then 'invalid' else 'valid' end as outcome, case when id % 5 = 4 then 'unsupported format' when file_size > 3000 then 'too large' end as reason from m_docs""")
def s4_validate(s, d):
    return files.validate(V.documents(s, d).withColumn("size", F.col("file_size")), largest=3000).select("id", "filename", "outcome", "reason")


@query(f"""select id, md5(text) as hash from m_docs where md5(text) not in (select md5(text) from m_docs where id % 2 = 0 and {V.AS_OF} - created_s < 1000000)""")
def s5_unprocessed(s, d):
    docs = V.documents(s, d).withColumn("fingerprint", files.content_hash(F.col("text").cast("binary")))
    manifest = docs.where("id % 2 = 0").select("fingerprint", F.col("created_at").alias("processed_at"))
    return files.unprocessed(docs, manifest, V.as_of(), 1_000_000).select("id", F.col("fingerprint").alias("hash"))


@query("select document_id, string_agg(chunk_index || ':' || length(content), ',' order by chunk_index) as chunks from m_items i join m_docs d on d.id = i.document_id where status = 'completed' group by 1")
def s6_nested_results(s, d):
    docs = V.documents(s, d).select("document_id", "status")
    chunks = V.items(s, d).select("document_id", "chunk_index", F.col("id").cast("string").alias("chunk_id"), "content", F.lit(1).alias("page_number"), F.lit("").alias("section_title"))
    out = sinks.nested_results(docs, chunks).where("chunks is not null")
    line = F.transform("chunks", lambda c: F.concat(c["chunk_index"].cast("string"), F.lit(":"), F.length(c["content"]).cast("string")))
    return out.select("document_id", F.array_join(line, ",").alias("chunks"))


@query("select event_id, floor(epoch(ts))::bigint as ts_s, user_id, event_type, value from events")
def s7_export_events(s, d):
    path, e = f"{shared_dir(s)}/lexloom/events-{uuid.uuid4().hex}", V.events(s, d)
    sinks.export_events(e, path, "json")
    return s.read.schema(e.schema).json(path).select("event_id", S("ts").alias("ts_s"), "user_id", "event_type", "value")


@query("select document_id || '_' || chunk_index as id, document_id, chunk_index, length(content) as n from m_items")
def s8_vector_rows(s, d):
    i = V.items(s, d)
    rows = sinks.vector_rows(i.select("document_id", "chunk_index", "content"), i.select("document_id", "chunk_index", F.col("vector").alias("embedding")))
    return rows.select("id", "document_id", "chunk_index", F.length("content").cast("long").alias("n"))


@query("select document_id || '_' || chunk_index as id, document_id, chunk_index, length(content) as n from m_items where document_id % 7 <> 3 and (document_id % 10 <> 0 or chunk_index = 0)")
def s8_replaced_vectors(s, d):
    """All documents stored, a tenth of them stored again with their first chunk only, and some deleted."""
    i = materialise(V.items(s, d), "items")
    # a change is chosen before its chunks and vectors are joined, so that the others aren't shuffled for it
    again = i.where("document_id % 10 = 0 and chunk_index = 0")
    stored = sinks.VectorTable(s, new_path(s, "vectors"))
    for change in (i, again, again):
        stored.upsert(sinks.vector_rows(change.select("document_id", "chunk_index", "content"), change.select("document_id", "chunk_index", F.col("vector").alias("embedding"))))
    stored.delete(V.texts(s, d).select("document_id").where("document_id % 7 = 3"))
    return stored.rows().select("id", "document_id", "chunk_index", F.length("content").cast("long").alias("n"))


@query("""select 'parents' as name, count(*) as deleted from m_conv where user_id = 3 union all select 'messages', count(*) from m_msg where conversation_id in (select id from m_conv where user_id = 3)""")
def s9_cascade_delete(s, d):
    c = V.conversations(s, d)
    return sinks.cascade_delete(c, c.where("user_id = 3").select("id"), {"messages": (V.messages(s, d), "conversation_id")})[1]


@query("select count(*) as n, min(len(embedding))::int as min_width, max(len(embedding))::int as max_width, count(*) filter (where len(embedding) <> 64) as wrong_width, 0::bigint as with_nan from embeddings")
def s10_collection_stats(s, d):
    return sinks.collection_stats(V.table(s, d, "embeddings"), width=64)


@query("""select id, case id % 5 when 0 then 'text/plain' when 1 then 'text/markdown' when 2 then 'application/pdf' when 3 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'application/octet-stream' end as mime, id % 5 < 2 as is_text,
(case when text = '' then 0 else len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end end)::int as lines from m_docs""")
def s11_file_facts(s, d):
    docs, name = V.documents(s, d), F.col("filename")
    return docs.select("id", files.mime_type(name).alias("mime"), files.is_text_file(name).alias("is_text"), files.line_count(F.col("text")).alias("lines"))


@query(f"select count(*) as files, sum(file_size)::bigint as bytes, count(*) filter (where {V.AS_OF} - created_s >= 1000000) as expired from m_docs")
def s12_manifest_stats(s, d):
    return files.manifest_stats(V.documents(s, d).select(F.col("file_size").alias("size"), F.col("created_at").alias("processed_at")), V.as_of(), 1_000_000)


@query("""with e as (select *, max(case when event_type = 'start' then (ts, event_id) end) over (partition by file_path order by ts, event_id) as st from m_ev),
k as (select *, count(*) filter (where event_type in ('end', 'error')) over (partition by file_path, st order by ts, event_id rows between unbounded preceding and 1 preceding) as closed from e where st is not null and event_type in ('start', 'progress', 'end', 'error')),
l as (select file_path, arg_max(event_type, (ts, event_id)) as t, max(ts) as ts from k where closed = 0 group by 1)
select file_path, case when t = 'end' then 'completed' when t = 'error' then 'error' when """ + str(V.AS_OF) + """ - floor(epoch(ts))::bigint > 3600 then 'timeout' else 'active' end as status, floor(epoch(ts))::bigint as updated_s from l""")
def w1_monitor(s, d):
    return jobs.monitor_batch(V.processing_events(s, d), V.as_of()).select("file_path", "status", S("updated").alias("updated_s"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as opens from events), n as (select *, sum(opens) over (partition by user_id order by ts) as k from e)
select user_id, floor(epoch(min(ts)))::bigint as start_s, count(*) as n from n group by user_id, k""")
def w2_sessions(s, d):
    return jobs.sessions(V.events(s, d), "user_id").select("user_id", S("session_start").alias("start_s"), "n")


_ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _streamed(s, rows, job):
    """What ``job`` makes of ``rows`` as a stream, with a row a year later behind them, so that the watermark passes all."""
    home = new_path(s, "stream")
    rows.write.parquet(f"{home}/in")
    last = rows.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts"))
    rows.limit(0).unionByName(last, allowMissingColumns=True).write.mode("append").parquet(f"{home}/in")
    before = s.conf.get(_ROCKSDB[0], None)
    s.conf.set(*_ROCKSDB)
    try:
        out = job(s.readStream.schema(rows.schema).parquet(f"{home}/in"))
        out.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.unset(_ROCKSDB[0]) if before is None else s.conf.set(_ROCKSDB[0], before)
    return s.read.schema(out.schema).parquet(f"{home}/out")


_LAST = """with m as (select conversation_id % 15 as user_id, created_s, content from m_msg), e as (select *, case when created_s - lag(created_s) over (partition by user_id order by created_s, content) <= 3600 then 0 else 1 end as opens from m),
n as (select *, sum(opens) over (partition by user_id order by created_s, content rows unbounded preceding) as k from e)
select user_id, min(created_s)::bigint as start_s, max(created_s)::bigint + 3600 as end_s, count(*) as n, array_to_string(list_reverse(list(content order by created_s desc, content desc)[1:10]), '|') as messages from n group by user_id, k"""


def _told(sessions):
    return sessions.select("user_id", S("session_start").alias("start_s"), S("session_end").alias("end_s"), "n", F.array_join("messages", "|").alias("messages"))


def _said(s, d):
    return V.messages(s, d).select((F.col("conversation_id") % 15).alias("user_id"), F.col("created_at").alias("ts"), "content")


@query(_LAST)
def w2_last_messages(s, d):
    return _told(jobs.last_messages_batch(_said(s, d), "user_id"))


@query(_LAST)
def w2_last_messages_stream(s, d):
    return _told(_streamed(s, _said(s, d), lambda rows: jobs.last_messages(rows, "user_id")))


@query("""with p as (select distinct user_id, ts::date as day from events), w as (select user_id, unnest(list_transform(range(1, 31), lambda i: day + i::int)) as until from p)
select strftime(until, '%Y-%m-%d') as until, count(distinct user_id) as users from w group by 1""")
def w3_active_users(s, d):
    return jobs.active_users(jobs.exact_panes(V.events(s, d))).select(F.date_format("until", "yyyy-MM-dd").alias("until"), "users")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def w3_daily_counts(s, d):
    return jobs.daily_counts(V.events(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


_HITS = """with recursive q as (select event_id, event_type || (user_id % 10) as k, floor(epoch(ts))::bigint as t, row_number() over (partition by event_type || (user_id % 10) order by floor(epoch(ts))::bigint, event_id) as i from events),
f as (select event_id, k, i, t as miss, false as hit from q where i = 1 union all select q.event_id, q.k, q.i, case when q.t - f.miss < 1800 then f.miss else q.t end, q.t - f.miss < 1800 from f join q on q.k = f.k and q.i = f.i + 1)
select k as query_key, event_id as query_id, hit from f"""


def _asked(s, d):
    return V.events(s, d).select(F.col("event_id").alias("query_id"), F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("query_key"), "ts")


@query(_HITS)
def w4_cache_hits(s, d):
    return jobs.cache_hits(_asked(s, d), "query_key").select("query_key", "query_id", "hit")


@query(_HITS)
def w4_cache_hits_stream(s, d):
    return _streamed(s, _asked(s, d), lambda rows: jobs.cache_hits_stream(rows, "query_key"))


@query("select doc_id as document_id, greatest(1, ceil((length(text) - 100) / 900.0))::bigint as chunks from documents where length(text) > 0")
def w5_ingest(s, d):
    home = f"{shared_dir(s)}/lexloom/ingest-{uuid.uuid4().hex}"
    V.texts(s, d).select("document_id", "text").write.parquet(f"{home}/in")
    arriving = s.readStream.schema("document_id long, text string").parquet(f"{home}/in")
    jobs.ingest(arriving, chunk.fixed_size, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return s.read.parquet(f"{home}/out").groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type as type, 'done' as status, count(*) as n, round(avg(value), 6) as avg_seconds from events group by 1, 2")
def w6_task_counters(s, d):
    t = V.events(s, d).select("ts", F.col("event_type").alias("type"), F.lit("done").alias("status"), F.col("value").alias("seconds"))
    return jobs.task_counters(t).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "type", "status", "n", "avg_seconds")
