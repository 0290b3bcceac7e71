"""Vector search, deduplication, reranking and the retrieval job."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import dedup as D
from lexloom.operators import inverted as K
from lexloom.operators import ivf as I
from lexloom.operators import retrieval as R
from lexloom.operators import vectors as N

HIT = "query_id long, id long, rank int, score double, content string"


def vectors(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, vector array<float>")


@pytest.mark.parametrize("metric", ["ip", "cosine"])
@pytest.mark.parametrize("tile", [N.QUERY_TILE_VALUES, 25])
def test_top_k(spark, metric, tile, monkeypatch):
    monkeypatch.setattr(N, "QUERY_TILE_VALUES", tile)
    r = np.random.default_rng(1)
    m = r.integers(-3, 4, size=(150, 5)).astype(np.float32)
    items = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0]), (902, [None] * 5)]).repartition(5)
    queries = vectors(spark, [(i, m[i].tolist()) for i in range(6)] + [(99, None)], "query_id")
    got = {}
    for x in N.top_k(queries, items, 7, metric).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["id"], x["score"]))
    d = m.astype(float)
    if metric == "cosine":
        d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
    assert set(got) == set(range(6))
    for q in range(6):
        s = d @ d[q]
        want = sorted(((-round(x, 9), i) for i, x in enumerate(s)))[:7]
        have = sorted((-round(x, 9), i) for _, i, x in got[q])
        assert [w[0] for w in want] == [h[0] for h in have]
    with pytest.raises(ValueError):
        N.top_k(queries, items, 3, "l1")


def test_top_k_of_nothing(spark):
    items, none = vectors(spark, [(1, [1.0, 2.0])]), vectors(spark, [], "query_id")
    assert N.top_k(none, items, 3).count() == 0
    assert N.top_k(vectors(spark, [(1, [1.0, 2.0])], "query_id"), items.where("false"), 3).count() == 0
    assert N.per_query(vectors(spark, [(4, [1.0, 2.0])], "query_id"), N.top_k(none, items, 3)).count() == 1


def test_no_product_in_plan(spark):
    q, i = vectors(spark, [(1, [1.0, 2.0])], "query_id"), vectors(spark, [(1, [1.0, 2.0])])
    plan = N.top_k(q, i, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_thresholds(spark):
    q, i = vectors(spark, [(1, [1.0, 0.0])], "query_id"), vectors(spark, [(k, [math.cos(k / 10), math.sin(k / 10)]) for k in range(16)])
    counts = [N.candidates(q, i, 5, t).count() for t in (0.0, 0.5, 0.9, 1.0)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 10
    assert N.candidates(q, i, 5).count() == N.candidates(q, i, 5, 0.7).count()


def test_score_policy(spark):
    hits = spark.createDataFrame([(1, 1, 1.0000001), (1, 2, 1.1), (1, 3, 0.5), (1, 4, -0.2)], "query_id long, document_id long, score double")
    titles = spark.createDataFrame([(1, "t")], "document_id long, document_title string")
    got = {r["document_id"]: (r["score"], r["document_title"]) for r in N.typed_hits(hits, titles).collect()}
    assert got == {1: (1.0, "t"), 3: (0.5, "未知文档")}
    assert {r["document_id"] for r in N.typed_hits(hits, titles, "drop").collect()} == {3}


def test_similarity_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(N.cosine(F.col("a"), F.col("b")), N.euclidean_similarity(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[1][0] == 0.0 and got[0][1] == pytest.approx(1 / (1 + math.sqrt(2)))


def test_top_k_of_any_width_and_id(spark):
    """Queries and items of two widths, ids of several types, and vectors that can't be scored."""
    nan, inf = float("nan"), float("inf")
    items = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0]), ("d", [nan, 1.0]), ("e", [inf, 1.0]), ("f", []), ("g", None), ("h", [None, 1.0]), ("i", [1.0, 0.0])]
    asked = [(1, [1.0, 0.1]), (2, [1.0, 0.1, 0.0]), (3, [nan, 0.0]), (4, []), (5, [1.0])]
    frame = spark.createDataFrame(items, "id string, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    want = {(1, "a", 1), (1, "i", 2), (1, "b", 3), (2, "c", 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in N.top_k(queries, frame, 5).collect()} == want
    for kind in ("decimal(9,2)", "timestamp", "double", "smallint", "binary"):
        cast = "cast(query_id as decimal(9,2))" if kind == "decimal(9,2)" else f"cast(cast(query_id as string) as {kind})" if kind == "binary" else f"cast(query_id as {kind})"
        other = queries.selectExpr(f"{cast} as query_id", "vector")
        assert N.top_k(other, other.withColumnRenamed("query_id", "id"), 1).count() == 3


def index_of(spark, tmp_path, n=600, width=8, **how):
    r = np.random.default_rng(2)
    m = r.normal(size=(n, width))
    m[: n // 3] = m[0] + r.normal(size=(n // 3, width)) * 0.05  # a cell with a third of all items
    items = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (5001, [1.0]), (5002, [float("nan")] * width)]).repartition(3)
    q = vectors(spark, [(i, v.tolist()) for i, v in enumerate(m[:: n // 40])] + [(98, None), (99, [1.0])], "query_id")
    return m, items, q, I.build(items, str(tmp_path / "index"), lists=8, **how)


def test_index_scores_what_its_cells_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "QUERIES_PER_BLOCK", 7)
    m, items, q, index = index_of(spark, tmp_path, per_part=40)
    assert max(index.parts.values()) > 4 and sum(index.sizes.values()) == len(m)
    stored = {r["id"]: (r["cell"], r["part"]) for r in index.items().collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cells = sorted(index.sizes)
    centres = index.quantiser.cells[cells]
    near = lambda x: -(x @ centres.T - 0.5 * (centres**2).sum(axis=1))
    assert all(stored[i][0] == cells[int(near(u[i]).argmin())] for i in range(len(m)))
    asked = {r["query_id"]: np.array(r["vector"], float) for r in q.collect() if r["vector"] and len(r["vector"]) == 8}
    for probes in (1, 3):
        got = {}
        for r in I.search(index, q, 5, probes).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
        assert set(got) == set(asked)
        pairs = 0
        for i, v in asked.items():
            v = v / np.linalg.norm(v)
            probed = {cells[c] for c in np.argsort(near(v[None]), axis=1, kind="stable")[0, :probes]}
            held = [j for j in range(len(m)) if stored[j][0] in probed]
            pairs += len(held)
            f32 = lambda j: m[j].astype(np.float32).astype(float) / np.linalg.norm(m[j].astype(np.float32).astype(float))
            want = sorted((-round(float(f32(j) @ v), 9), j) for j in held)[:5]
            assert [x[1:] for x in sorted(got[i])] == [(j, -s) for s, j in want]
        told = I.cost(index, q, probes)
        assert told["pairs"] == pairs and told["all_pairs"] == len(asked) * len(m) and told["files"] <= told["all_files"]
    assert I.cost(index, q.where("query_id = 1"), 1)["files"] < told["all_files"] and I.cost(index, q, 1)["pairs"] < told["pairs"]


def test_index_reads_probed_cells_only(spark, tmp_path):
    m, items, q, index = index_of(spark, tmp_path)
    found = I.search(index, q.where("query_id = 1"), 5, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert I.probes_for(index, q, items, 5, 1.0) <= len(index.sizes)
    exact = N.top_k(q, items, 5, "cosine")
    everything = N.recall(I.search(index, q, 5, len(index.sizes)), exact.join(index.items().select("id"), "id", "left_semi")).first()
    assert everything["recall"] == 1.0


def test_codes(spark, tmp_path):
    m, items, q, index = index_of(spark, tmp_path, stretches=4)
    exact = N.top_k(q.where("query_id < 98"), items, 5, "cosine")
    assert N.recall(I.search_codes(index, q, 5, len(index.sizes), 20), exact).first()["recall"] >= 0.9
    assert {len(r["code"]) for r in index.items().select("code").collect()} == {4}
    # what is decoded is near what was encoded
    rows = index.items().collect()
    decoded = np.array([index.quantiser.cells[r["cell"]] + np.concatenate([index.quantiser.words[i, c] for i, c in enumerate(r["code"])]) for r in rows])
    true = np.array([r["vector"] for r in rows])
    true /= np.linalg.norm(true, axis=1, keepdims=True)
    assert np.linalg.norm(decoded - true, axis=1).mean() < 0.25


def test_index_of_nothing(spark, tmp_path):
    none = vectors(spark, [(1, None)])
    index = I.build(none, str(tmp_path / "none"))
    assert I.search(index, vectors(spark, [(1, [1.0])], "query_id"), 3, 2).count() == 0
    assert I.search_codes(index, vectors(spark, [(1, [1.0])], "query_id"), 3, 2).count() == 0


def test_embedding_cache(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "bad")], "id long, content string")
    plain = N.hashing_embedder(4)

    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return plain(texts)

    got = {r["id"]: r for r in N.embed(rows, embedder, batch=1).collect()}
    assert got[1]["embedding"] == got[2]["embedding"] == plain(["a b"])[0] and got[4]["embedding"] is None and got[5]["error"] == "no"
    cache = spark.createDataFrame([(9, "c")], "i int, content string").select(F.md5(F.col("content").cast("binary")).alias("content_hash"), F.array(F.lit(7.0)).alias("embedding"))
    assert {r["id"]: r["embedding"] for r in N.embed(rows, embedder, cache, batch=1).collect()}[3] == [7.0]


def naive_greedy(texts, t):
    kept = []
    for x in texts:
        def like(y):
            m = difflib.SequenceMatcher(None, x, y)
            run = m.find_longest_match(0, len(x), 0, len(y)).size
            a, b = set(x.split()), set(y.split())
            jaccard = len(a & b) / len(a | b) if a | b else 1.0
            return m.ratio() >= t or (run / min(len(x), len(y)) if run else 0.0) >= 0.8 * t or jaccard >= t

        if not any(like(y) for y in kept):
            kept.append(x)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup(spark, seed):
    random.seed(seed)
    base = [" ".join(random.choice("甲乙丙丁戊") * random.randrange(1, 4) for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(14):
        t = list(random.choice(base))
        for _ in range(random.randrange(8)):
            t[random.randrange(len(t))] = random.choice("子丑寅 ")
        texts.append("".join(t))
    texts += ["", "", texts[0]]
    hits = spark.createDataFrame([(1, i, i + 1, 0.5, t) for i, t in enumerate(texts)], HIT)
    got = [r["content"] for r in R.dedup_greedy(hits).orderBy("rank").collect()]
    assert got == naive_greedy(texts, 0.85)
    assert R.dedup_exact(hits).count() == len(set(texts))


def test_greedy_is_no_component(spark):
    a, b, c = "x" * 40 + "a" * 60, "x" * 40 + "b" * 60, "y" * 100
    hits = spark.createDataFrame([(1, 1, 1, 0.9, a), (1, 2, 2, 0.8, b), (1, 3, 3, 0.7, c), (2, 4, 1, 0.9, a)], HIT)
    assert R.dedup(hits).count() == 4


def test_semantic_dedup(spark):
    rows = [(1, 1, 1, 0.9, "a", [1.0, 0.0]), (1, 2, 2, 0.8, "b", [0.999, 0.01]), (1, 3, 3, 0.7, "c", None), (1, 4, 4, 0.6, "d", [0.0, 1.0]), (1, 5, 5, 0.5, "e", [0.0, 0.0])]
    hits = spark.createDataFrame(rows, HIT + ", vector array<double>")
    assert [r["id"] for r in R.dedup(hits, semantic=True).orderBy("rank").collect()] == [1, 3, 4, 5]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, 1, 0.50, "x" * 99, "A b"), (1, 2, 2, 0.50, "a " * 60, "A b"), (1, 3, 3, 0.50, "y" * 600, "A b"), (1, 4, 4, 0.49, "z" * 600, "A b")], HIT + ", query_text string")
    got = [(r["id"], round(r["rerank_score"], 3)) for r in R.rerank(hits).orderBy("rank").collect()]
    assert got == [(2, 0.58), (3, 0.49), (1, 0.48), (4, 0.48)]
    assert R.final_top(R.rerank(hits), 2).count() == 2
    assert R.final_top(R.rerank(hits.withColumn("query_text", F.lit(" "))), 2).count() == 0


def test_quality_and_context(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, 1, 0.9, "c1", "t1"), (1, 2, 2, 0.8, "c2", "t2"), (1, 3, 3, 0.7, "c3", "t3")], HIT + ", document_title string")
    grades = {r["query_id"]: (r["n"], r["avg_score"], r["quality"]) for r in R.quality(q, hits).collect()}
    assert grades == {1: (3, 0.8, "excellent"), 2: (0, 0.0, "poor")}
    text = {r["query_id"]: r["context"] for r in R.context(q, hits).collect()}
    assert text[2] == R.NO_CONTEXT and text[1].count("### 资料来源") == 3 and "90.00%" in text[1]


def test_answers(spark):
    df = spark.createDataFrame([("必须赔偿，医疗诊断", "alpha beta gamma", "alpha delta"), ("仅供参考", "", "x")], "a string, b string, c string")
    got = df.select(R.safety_flags(F.col("a")), R.grounding(F.col("b"), F.col("c"))).collect()
    assert got[0][0] == ["涉及敏感话题: 医疗诊断", "使用绝对化表述: 必须", "缺乏适当的法律免责声明"] and got[0][1] == pytest.approx(1 / 3) and tuple(got[1]) == ([], 0.0)


def test_retrieve(spark, small):
    from lexloom.plans import views as V

    q, i = V.queries(spark, small), V.items(spark, small)
    titles = V.documents(spark, small).select("document_id", "document_title")
    hits, grades = R.retrieve(q, i, titles, k=4, threshold=0.2)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 4
    assert grades.count() == q.count()
    high, _ = R.retrieve(q, i, titles, k=4, threshold=0.9)
    assert high.count() <= hits.count()


def jaccard(a, b):
    a, b = set((a or "").split()), set((b or "").split())
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [D.BLOCK, 4])
def test_near_duplicate_passages(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.sample(words, 40))) for i in range(60)]
    for k in range(3):  # groups of near copies, some of which are like each other through others only
        text = r.sample(words, 40)
        for i in range(40):
            if r.random() < 0.3:
                text = text[:]
                text[r.randrange(40)] = r.choice(words)
            rows.append((100 * (k + 1) + i, " ".join(r.sample(text, 40))))
    rows += [(900, None), (901, ""), (902, " \n"), (7, rows[7][1]), (None, rows[8][1]), (None, "nothing else is like this")]
    df = spark.createDataFrame(rows, "id long, content string").selectExpr("*", "1 as words", "2 as node")
    found = {(x["id"], x["component_id"], x["kept"]) for x in D.near_duplicates(df).collect()}
    named = {i: t for i, t in rows if i is not None}
    root = {i: i for i in named}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in named:
        for b in named:
            if a < b and jaccard(named[a], named[b]) >= 0.85:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert found == {(i, top(i), top(i) == i) for i in named} | {(None, None, True)}
    assert D.near_duplicates(df).count() == len(rows) and D.near_duplicates(df.where("false")).count() == 0


def test_repeated_texts_in_results_go(spark):
    hits = spark.createDataFrame([(1, 1, 1, 0.9, "a b c"), (1, 2, 2, 0.8, "a b c"), (1, 3, 3, 0.7, "x y z")], "query_id long, id long, rank int, score double, content string")
    assert [r["id"] for r in R.dedup(hits).orderBy("rank").collect()] == [1, 3]


def test_queries_with_too_many_hits_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_HITS", 2)
    hits = spark.createDataFrame([(1, i, i, 0.9, f"t{i}") for i in range(3)], "query_id long, id long, rank int, score double, content string")
    with pytest.raises(Exception, match="too many hits"):
        R.dedup_greedy(hits).collect()


def test_keyword_search_by_shuffle(spark, monkeypatch):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "beta gamma gamma", "", None, "delta"])], "document_id long, text string")
    near = sorted(map(tuple, N.bm25(q, docs, 5).collect()))
    monkeypatch.setattr(N, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, N.bm25(q, docs, 5).collect())) == near and len(near) == 3


def test_similar_texts_need_no_search_unless_the_middle_is_shared():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    for _ in range(300):
        a = " ".join(word() for _ in range(r.randrange(1, 30)))
        b = a[r.randrange(len(a)) :] + " ".join(word() for _ in range(r.randrange(0, 12)))
        b = b if r.random() < 0.7 else word()
        m = difflib.SequenceMatcher(None, a, b)
        run = m.find_longest_match(0, len(a), 0, len(b)).size
        want = jaccard(a, b) >= 0.85 or (min(len(a), len(b)) > 0 and run / min(len(a), len(b)) >= 0.68) or m.ratio() >= 0.85
        assert R.similar_texts(a, b, 0.85) == want


@pytest.mark.parametrize("shingle", [1, 5])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_greedy_passages(spark, shingle, ids):
    """Against the sequential loop, with chains whose ends differ."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.sample(words, 40))) for i in range(20)]
    for k in range(4):
        text = r.sample(words, 40)
        for i in range(25):
            text = text[:]
            for _ in range(r.randrange(4)):
                text[r.randrange(40)] = r.choice(words)
            rows.append((100 * (k + 1) + (i * 7) % 25, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "one"), (7, rows[7][1])]
    name = (lambda i: f"p{i:04d}") if ids == "string" else (lambda i: i)
    df = spark.createDataFrame([(name(i), t) for i, t in rows] + [(None, rows[8][1]), (None, "alone")], f"id {ids}, content string")

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, min(len(w), 1)))}

    kept: list = []
    for i, t in sorted(dict(rows).items()):
        a = runs(t)
        if not any((len(a & b) / len(a | b) if a | b else 1.0) >= 0.8 for _, b in kept):
            kept.append((i, a))
    found = D.greedy(df, threshold=0.8, shingle=shingle, bands=48).collect()
    assert len(found) == len(rows) + 2
    stay = {name(i) for i, _ in kept}
    assert {x["id"] for x in found if x["kept"]} == stay | {None} and {x["id"] for x in found if not x["kept"]} == {name(i) for i, _ in rows} - stay
    assert sum(x["id"] is None and x["kept"] for x in found) == 2
    assert D.greedy(df.where("false")).count() == 0
    # some that reach a kept one only through others stay
    heads = {x["id"] for x in D.near_duplicates(df, threshold=0.8, shingle=shingle, bands=48).collect() if x["kept"]} - {None}
    assert heads < stay if shingle == 1 else heads <= stay


@pytest.mark.parametrize("held", [1024, 5])
def test_greedy_versions(spark, monkeypatch, held):
    """A text of many versions, each like the next: far more passages stay than there may be rounds. Components go to
    a task whole, or only once they are small."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    text, texts = r.sample(words, 30), []
    for _ in range(160 if held > 100 else 12):
        for _ in range(2):
            text[r.randrange(30)] = r.choice(words)
        texts.append(" ".join(text))
    texts += [texts[3], "", None, " ".join(r.sample(words, 30))]
    kept: list[tuple[int, set]] = []
    for i, t in enumerate(texts):
        own = set((t or "").split())
        if not any(own == k or (own | k and len(own & k) >= 0.85 * len(own | k) - 1e-9) for _, k in kept):
            kept.append((i, own))
    monkeypatch.setattr(D, "TASK_PASSAGES", held)
    rounds = 2 if held > 100 else 200
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    assert {x["id"] for x in D.greedy(df, bands=48, max_rounds=rounds).where("kept").collect()} == {i for i, _ in kept}
    assert len(kept) > (20 if held > 100 else 4)


def test_keyword_search_stores_no_pairs(spark, monkeypatch):
    """Many queries that share their words with all documents: no more is shuffled than a task's best of each query, and the scores are
    those of the formula, however few documents and queries are scored at a time."""
    r, held = random.Random(4), []
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(r.choices(words, k=r.randrange(1, 40))) for i in range(120)} | {500: "", 501: None}
    asked = {i: " ".join(r.sample(words, 6)) for i in range(40)} | {90: "", 91: "unknown"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string").repartition(3)
    monkeypatch.setattr(N, "materialise", lambda df, name, of=N.materialise: held.append(of(df, name)) or held[-1])
    tf = {i: (t or "").split() for i, t in texts.items()}
    average = sum(map(len, tf.values())) / len(tf)
    df = {w: sum(w in t for t in tf.values()) for w in words}
    want = {}
    for i, text in asked.items():
        gain = {d: sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in text.split() if w in t) for d, t in tf.items()}
        want |= {(i, d): round(s, 6) for s, d in sorted((-round(s, 6), d) for d, s in gain.items() if s > 0)[:5]}
    want = {k: -s for k, s in want.items()}
    for gains, scores in ((N.GAINS, N.SCORES), (200, 50)):
        monkeypatch.setattr(N, "GAINS", gains)
        monkeypatch.setattr(N, "SCORES", scores)
        got = {(x["query_id"], x["document_id"]): x["score"] for x in N.bm25(q, docs, 5).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert max(x.count() for x in held) <= max(len(texts), 6 * len(asked))


def test_equal_vectors_are_scored_once(spark):
    """Copies of a vector are one row with the smallest ids, and stand in the result as before."""
    r = np.random.default_rng(5)
    m = r.integers(-2, 3, size=(9, 4)).astype(float)
    items = vectors(spark, [(i, m[i % 9].tolist()) for i in range(200)]).repartition(4)
    held = N.collapsed(N.plain_vectors(items, "id"), 3, "vector").collect()
    assert len(held) == len({tuple(v) for v in m.tolist()}) and all(x["id"] == x["same"][0] and len(x["same"]) == 3 for x in held)
    q = vectors(spark, [(i, m[i].tolist()) for i in range(5)], "query_id")
    got = sorted((x["query_id"], x["rank"], x["id"]) for x in N.top_k(q, items, 30).collect())
    assert got == sorted((i, n + 1, j) for i in range(5) for n, (_, j) in enumerate(sorted((-round(float(m[j % 9] @ m[i]), 9), j) for j in range(200))[:30]))


def test_queries_are_routed_in_small_batches(spark, tmp_path, monkeypatch):
    """However many cells a query has, no batch of routed queries is larger than ``ROUTED_VALUES`` or one query's cells."""
    _, _, q, index = index_of(spark, tmp_path)
    few, sizes = q.where("query_id < 98").coalesce(1), []
    want = {tuple(x) for x in I.search(index, few, 5, len(index.sizes)).collect()}
    monkeypatch.setattr(I, "ROUTED_VALUES", 100)
    asked, _ = I._probed(index, few, len(index.sizes))
    sizes = [x["n"] for x in asked.mapInArrow(lambda batches: (b.select(["cell"]).from_arrays([b["cell"].slice(0, 1), __import__("pyarrow").array([b.num_rows])], names=["cell", "n"]) for b in batches), "cell int, n long").collect()]
    assert sum(sizes) == few.count() * len(index.sizes)
    assert {tuple(x) for x in I.search(index, few, 5, len(index.sizes)).collect()} == want


def test_word_index_stores_no_pairs(spark, tmp_path, monkeypatch):
    """The index finds what the search over texts does, in whatever shards, and nothing that it stores has a row for each query and document."""
    r, held = random.Random(6), []
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randrange(1, 30)))) for i in range(300)] + [(900, ""), (901, None)], "document_id long, text string")
    q = spark.createDataFrame([(i, " ".join(r.sample(words, r.randrange(1, 5)))) for i in range(30)] + [(90, ""), (91, "unknown")], "query_id long, text string")
    want = sorted((x["query_id"], x["rank"], x["document_id"], round(x["score"], 5)) for x in N.bm25(q, docs, 4).collect())
    monkeypatch.setattr(K, "materialise", lambda df, name, of=K.materialise: held.append(of(df, name)) or held[-1])
    for shards in (1, 8):
        index = K.Index(spark, str(tmp_path / f"words{shards}"), shards=shards)
        for batch in (0, 1):
            index.add(docs.where(F.col("document_id") % 2 == batch), str(batch))
        held.clear()
        got = sorted((x["query_id"], x["rank"], x["document_id"], round(x["score"], 5)) for x in K.search(index, q, 4).collect())
        assert got == want
        assert max(x.count() for x in held) <= 5 * 32
        told = K.cost(index, q, 4).first()
        assert 0 < told["postings"] <= told["all_postings"] and 0 < told["blocks"] <= told["all_blocks"]


def test_index_search_shuffles_no_vectors(spark, tmp_path, monkeypatch):
    """With all cells probed no query stands once for each cell: nothing but hits is shuffled, and tasks hold few distances."""
    _, items, q, index = index_of(spark, tmp_path)
    plan = I.search(index, q, 5, len(index.sizes))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Exchange" in plan
    assert all("vector" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    want = {tuple(x) for x in N.top_k(q.where("size(vector) = 8"), items, 5, "cosine").select("query_id", "id", "score", "rank").collect()}
    assert {tuple(x) for x in I.search(index, q, 5, len(index.sizes)).select("query_id", "id", "score", "rank").collect()} == want
    # placing items, too, forms few distances at a time
    monkeypatch.setattr(I, "ROUTED_VALUES", 600)
    small = I.build(items, str(tmp_path / "small"), index.quantiser)
    assert small.sizes == index.sizes


def test_products_in_single_precision_lose_nothing():
    """Scores that single precision can't tell apart, and numbers beyond it."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    for scale in (1.0, 1e-25, 1e30):
        base = r.normal(size=(1, 16))
        m = scale * (base + 1e-8 * r.normal(size=(400, 16)))
        q = r.normal(size=(30, 16))
        best = N.Best(5, pa.int64())
        ids = pa.array(range(400), pa.int64())
        same = pa.ListArray.from_arrays(pa.array(range(401), pa.int32()), ids)
        for a in range(0, 400, 50):
            N.add_products(best, np.arange(30), q, m[a : a + 50], ids.slice(a, 50), same.slice(a, 50))
        got = best.rows(pa.array(range(30)))
        scores = np.round(np.einsum("ij,kj->ik", q, m), N.DIGITS)
        if scale == 1e30:  # digits do not reach so far
            assert sorted(zip(got["query_id"].to_pylist(), got["id"].to_pylist())) == sorted((i, j) for i in range(30) for j in np.argsort(-(q[i] @ m.T))[:5].tolist())
        else:
            assert sorted(zip(got["query_id"].to_pylist(), got["id"].to_pylist())) == sorted((i, int(j)) for i in range(30) for j in sorted(range(400), key=lambda j: (-scores[i, j], j))[:5])


@pytest.mark.parametrize("find", [D.near_duplicates, D.greedy])
def test_words_of_unlike_passages_are_stored_once(spark, monkeypatch, find):
    """Only passages that meet others in a bucket have their words written again."""
    r, held = random.Random(11), []
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    texts += [texts[0] + " more", texts[1] + " more", texts[2]]
    passages = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(3)
    monkeypatch.setattr(D, "materialise", lambda df, name, of=D.materialise: held.append((name, of(df, name))) or held[-1][1])
    assert sorted(x["id"] for x in find(passages).collect() if not x["kept"]) == [60, 61, 62]
    again = [t.count() for name, t in held if "words" in t.columns and name != "passages"]
    assert again and max(again) <= 8


@pytest.mark.parametrize("find", [D.near_duplicates, D.greedy])
def test_words_of_bucket_mates_that_are_unlike_stay_where_they_are(spark, monkeypatch, find):
    """Unlike passages that share buckets are told apart by sketches: their words are neither stored nor shuffled."""
    r, held = random.Random(12), []
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(common + [f"w{r.randrange(10**6)}" for _ in range(40)]) for _ in range(80)]
    texts += [texts[0] + " more", texts[1]]
    passages = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(3)
    monkeypatch.setattr(D, "materialise", lambda df, name, of=D.materialise: held.append((name, of(df, name))) or held[-1][1])
    assert sorted(x["id"] for x in find(passages, rows=1).collect() if not x["kept"]) == [80, 81]
    assert sum(t.count() for name, t in held if "words" in t.columns) == 2


@pytest.mark.parametrize("tasks", [1024, 30])
def test_large_buckets_and_small_batches(spark, monkeypatch, tasks):
    """Buckets over the size that one task compares whole, members that come in many batches, links thinned now and then."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.sample(words, 30))) for i in range(40)]
    for k in range(2):
        text = r.sample(words, 30)
        for i in range(60):
            if r.random() < 0.2:
                text = text[:]
                text[r.randrange(30)] = r.choice(words)
            rows.append((100 * (k + 1) + (i * 7) % 60, " ".join(text + [f"x{r.randrange(3)}"])))
    df = spark.createDataFrame(rows, "id long, content string").repartition(4)
    whole = [sorted(map(tuple, find(df, rows=1).collect()), key=str) for find in (D.near_duplicates, D.greedy)]
    for name, value in (("BLOCK", 1), ("TASK_PASSAGES", tasks), ("LINKS", 20), ("COLUMNS", 7), ("SIGNED", 3)):
        monkeypatch.setattr(D, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = [sorted(map(tuple, find(df, rows=1).collect()), key=str) for find in (D.near_duplicates, D.greedy)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    named = {i: set(t.split()) for i, t in rows}
    kept: list[set] = []
    stay = {i for i, own in sorted(named.items()) if not any(len(own & k) / len(own | k) >= 0.85 for k in kept) and not kept.append(own)}
    assert parts == whole and {i for i, k in parts[1] if k} == stay and 40 < len(stay) < 150


@pytest.mark.parametrize("shingle", [1, 5])
def test_sketches_lose_no_similar_pair(shingle):
    """Words are those of Python's split(); sets that are alike may be so by their sketches too, and most others may not."""
    import pyarrow as pa

    r = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, " \n", "a", "a b", "\x1ca\x85b c d　e​f\x1f", "é 😀 é"]
    for _ in range(60):
        text = r.sample(words, r.randrange(1, 60))
        for _ in range(4):
            texts.append(" ".join(text))
            text = [w if r.random() > 0.04 else r.choice(words) for w in text]
    sets = D.Sets(pa.array(texts, pa.string()), shingle)

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, min(len(w), 1)))}

    own, lists = [runs(t) for t in texts], [set(x) for x in sets.lists().to_pylist()]
    assert sets.sizes.tolist() == [len(x) for x in own]
    assert all(len(lists[i] & lists[j]) == len(own[i] & own[j]) for i in range(len(texts)) for j in range(i))
    sketches = [sets.sizes, *(x.to_numpy().view(np.uint64) for x in sets.sketch())]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if own[i] and own[j]]
    i, j = np.array(pairs).T
    near = D._near(0.8, sketches, i, j)
    true = np.array([len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) - 1e-6 for a, b in pairs])
    assert near[true].all() and true.sum() > 50 and near[~true].sum() < 0.05 * len(pairs)
