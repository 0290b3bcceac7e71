"""Permissions, changes and analytics on inline tables: empty sides, nulls, several matches."""

from datetime import datetime

from pyspark.sql import functions as F

from lexloom.operators import analytics as A
from lexloom.operators import rbac, upsert
from lexloom.plans import views as V

NOW = datetime(2024, 1, 31)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_roles_and_permissions(spark):
    roles, permissions, grants = V.roles(spark, ""), V.permissions(spark, ""), V.role_permissions(spark, "")
    by_code = {r["code"]: (r["roles"], r["role_count"]) for r in rbac.permission_roles(permissions, grants, roles, "chat").collect()}
    assert by_code == {"chat:view": (["admin", "guest", "user"], 3), "chat:send": (["admin", "user"], 2), "chat:delete": (["admin"], 1)}
    stats = rbac.permission_stats(permissions, roles).first()
    assert (stats["permissions"], stats["modules"], stats["roles"]) == (20, 5, 3) and stats["module_list"] == ["chat", "document", "role", "system", "user"]
    assert rbac.expand_grants(roles, permissions, "admin").count() == 20
    links = frame(spark, "user_id long, role_id long", (1, 2), (2, 2))
    assert {(r["code"], r["user_count"]) for r in rbac.role_user_counts(roles, links, include_system=False).collect()} == {("user", 2), ("guest", 0)}


def test_several_matches_count_once(spark):
    users = frame(spark, "id long, is_superuser boolean", (1, False), (2, False), (3, True))
    links = frame(spark, "user_id long, role_id long", (1, 1), (1, 2))
    grants = rbac.granted(links, V.role_permissions(spark, ""), V.permissions(spark, ""))
    allowed = lambda codes, every=False: {r["id"]: r["allowed"] for r in rbac.has_permission(users, grants, codes, every).collect()}
    assert allowed(["chat:view"]) == {1: True, 2: False, 3: True}
    assert allowed([], True) == {1: True, 2: True, 3: True} and allowed([]) == {1: False, 2: False, 3: True}
    assert rbac.effective_permissions(users, links, V.role_permissions(spark, ""), V.permissions(spark, "")).where("user_id = 3").count() == 20


def test_visible_rows(spark):
    viewers = frame(spark, "id long, can_view_all boolean", (1, False), (2, True), (3, False))
    rows = frame(spark, "id long, user_id long", (10, 1), (11, 2), (12, None))
    assert {tuple(r) for r in rbac.visible_rows(viewers, rows).collect()} == {(1, 10, False), (2, None, True)}
    assert {tuple(r) for r in rbac.visible_counts(viewers, rows).collect()} == {(1, 1), (2, 3)}
    assert rbac.visible_counts(viewers, rows.where("false")).count() == 0


def test_upserts(spark):
    new = frame(spark, "id long, code string", (1, "a"), (2, "a"), (3, None), (4, None), (5, "old"))
    got = {r["id"]: r["reason"] for r in upsert.accept_unique(new, frame(spark, "code string", ("old",), ("old",)), ["code"], "id").collect()}
    assert got == {1: None, 2: "repeated: code", 3: None, 4: None, 5: "exists: code"}
    links = frame(spark, "user_id long, role_id long", (1, 1), (2, 1), (3, 1))
    changes = frame(spark, "user_id long, role_id long", (1, 2), (1, 2), (1, 9), (2, None), (3, 2))
    out = upsert.replace_links(links, changes, frame(spark, "id long", (1,), (2,)), "user_id", "role_id", frame(spark, "user_id long", (3,)))
    assert {tuple(r) for r in out.collect()} == {(1, 2), (3, 1)} and out.count() == 2
    table = frame(spark, "id long, a string, b string, updated_at timestamp", (1, "x", "y", datetime(2020, 1, 1)), (2, "x", None, datetime(2020, 1, 1)))
    patched = {r["id"]: (r["a"], r["b"], r["updated_at"].year) for r in upsert.patch(table, frame(spark, "id long, a string, b string", (1, None, "z")), "id", F.lit(NOW)).collect()}
    assert patched == {1: ("x", "z", 2024), 2: ("x", None, 2020)}


def test_apply_results(spark):
    docs = frame(spark, "id long, status string, total_chunks int, processing_error string, meta_data map<string,string>", (1, "pending", 0, None, {"k": "v"}), (2, "processed", 3, None, None), (3, "error", 0, "e", None), (4, "pending", 0, None, None))
    results = frame(spark, "id long, ok boolean, chunks int, error string, meta map<string,string>", (1, True, 5, None, {"m": "1"}), (2, True, 9, None, None), (3, False, 0, "again", None))
    got = {r["id"]: (r["status"], r["total_chunks"], r["processing_error"], r["meta_data"]) for r in upsert.apply_results(docs, results).collect()}
    assert got == {1: ("completed", 5, None, {"k": "v", "m": "1"}), 2: ("completed", 3, None, None), 3: ("failed", 0, "again", {}), 4: ("pending", 0, None, None)}


def test_retry(spark):
    tries: list[int] = []

    def attempt(rows):
        tries.append(rows.count())
        return rows.withColumn("error", F.when(F.col("id") >= len(tries), F.lit("no")))

    good, dead = upsert.retry(frame(spark, "id long", *[(i,) for i in range(5)]), attempt, "id")
    assert tries == [5, 4, 3] and {(r["id"], r["attempts"]) for r in good.collect()} == {(0, 1), (1, 2), (2, 3)}
    assert {r["id"] for r in dead.collect()} == {3, 4}


def test_empty_analytics(spark):
    c = frame(spark, "id long, user_id long, title string, description string, is_archived boolean, created_at timestamp, updated_at timestamp")
    m = frame(spark, "id long, conversation_id long, role string, content string, created_at timestamp, tokens_used int")
    u = frame(spark, "id long, username string, full_name string")
    assert A.average_minutes(c, m).first()[0] == 0 and A.live_conversations(c).first()[0] == 0
    assert A.conversation_page(c, u, m).count() == A.recent_conversations(c, u, m).count() == 0
    assert A.dashboard(c, frame(spark, "id long"), m).first()["total_hours"] == 0.0
    e = frame(spark, "event_id long, ts timestamp, file_path string, event_type string, processing_time double, total_chars long")
    assert tuple(A.processing_summary(e).first()) == (0, 0, 0.0, 0, 0, 0.0)
    assert A.daily_trend(c, F.lit(NOW), zero_fill=True).agg(F.sum("n"), F.count("*")).first() == (0, 8)


def test_titles_names_and_pages(spark):
    at = datetime(2024, 1, 1)
    c = frame(spark, "id long, title string", (1, " "), (2, "own"), (3, A.DEFAULT_TITLE), (4, None))
    m = frame(spark, "id long, conversation_id long, role string, content string, created_at timestamp", (1, 1, "assistant", "hello", at), (2, 1, "user", "q" * 30, at), (3, 2, "user", "x", at))
    assert {r["id"]: r["title"] for r in A.conversation_titles(c, m).collect()} == {1: "q" * 20, 2: "own", 3: A.DEFAULT_TITLE, 4: A.DEFAULT_TITLE}
    names = frame(spark, "f string, u string", ("", "u1"), (None, "u2"), ("F", "u3")).select(A.display_name(F.col("f"), F.col("u"))).collect()
    assert [r[0] for r in names] == ["u1", "u2", "F"]
    assert [A.page_limit(x) for x in (None, 0, 1, 100, 101)] == [20, 20, 1, 100, 20]


def test_half_to_even(spark):
    c = frame(spark, "id long", (1,), (2,))
    m = frame(spark, "id long, conversation_id long, role string, content string, created_at timestamp", *[(i, 1, "user", "", datetime(2024, 1, 1, 0, 0, s)) for i, s in ((1, 0), (2, 30))], (3, 2, "user", "", datetime(2024, 1, 1)))
    assert A.average_minutes(c, m).first()[0] == 0
    m2 = m.withColumn("created_at", F.when(F.col("id") == 2, F.lit(datetime(2024, 1, 1, 0, 1, 30))).otherwise(F.col("created_at")))
    assert A.average_minutes(c, m2).first()[0] == 2


def test_search(spark):
    d = frame(spark, "id long, title string, status string, file_category string", (1, "Labor LAW", "completed", "laws"), (2, None, "completed", "laws"), (3, "labor", "failed", "case"))
    assert {r["id"] for r in A.search_documents(d, "LABOR").collect()} == {1, 3}
    assert {r["id"] for r in A.search_documents(d, status="completed", category="laws").collect()} == {1, 2}
    c = frame(spark, "id long, title string, description string", (1, None, "Abc"), (2, "abc", None), (3, None, None))
    assert {r["id"] for r in A.search_conversations(c, "aBC").collect()} == {1, 2}


def every_segmentation(run):
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        for rest in every_segmentation(run[n:]):
            yield [run[:n], *rest]


def test_segmentation_against_all_paths(spark):
    """The best of all segmentations of short texts; ties to the longer last word."""
    import math
    import random

    from lexloom.operators import segment as S

    r = random.Random(2)
    table = {"".join(r.choice("甲乙丙") for _ in range(r.randint(1, 4))): r.choice([1, 1, 2, 5, 9]) for _ in range(14)}
    rows = [*table.items(), ("甲", 0), (None, 3), ("", 4), ("丁戊", None)]
    total = sum(table.values())
    runs = ["".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 9))) for _ in range(60)]
    words = spark.createDataFrame(rows, "word string, frequency int")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*runs, None, "", "abc", "甲乙x乙丙 丁"])], "id long, text string")
    got = {x["id"]: x["w"] for x in docs.select("id", S.segmenter(words)(F.col("text")).alias("w")).collect()}
    worth = lambda w: math.log(table[w] / total) if w in table else -math.log(total) if len(w) == 1 else -math.inf
    for i, run in enumerate(runs):
        best = max(every_segmentation(run), key=lambda p: (round(sum(map(worth, p)), 8), [len(w) for w in p[::-1]]))
        assert got[i] == best, run
    assert got[len(runs)] == got[len(runs) + 1] == got[len(runs) + 2] == [] and "".join(got[len(runs) + 3]) == "甲乙乙丙丁"
    none = docs.select("id", S.segmenter(words.limit(0))(F.col("text")).alias("w")).where("id = 0").first()["w"]
    assert none == list(runs[0])


def test_topics_with_a_dictionary(spark):
    from lexloom.operators import segment as S

    words = spark.createDataFrame([("劳动合同", 50), ("合同", 30), ("违约金", 20), ("劳动", 30)], "word string, frequency int")
    texts = spark.createDataFrame([(1, "劳动合同违约金"), (2, "合同的违约金, 劳动合同"), (3, None)], "id long, content string")
    tokens = texts.select("id", S.segmenter(words)(F.col("content")).alias("w"))
    stop = spark.createDataFrame([("的",)], "word string")
    found = A.hot_topics(A.topic_words(tokens, "id", F.col("w"), stop)).collect()
    assert [(r["word"], r["n"]) for r in found] == [("劳动合同", 2), ("违约金", 2), ("合同", 1)]
