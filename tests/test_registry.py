"""Every registered query of the library against DuckDB on the smallest tables, and the shape of some plans."""

import difflib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexloom.operators import retrieval as R
from lexloom.plans import registry, relational, textual
from lexloom.plans import views as V

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame, columns):
    out = frame[columns].copy()
    for c in columns:
        floats = str(out[c].dtype).lower().startswith("float")
        out[c] = out[c].map(lambda v, f=floats: "" if v is None or v != v else f"{v:.9g}" if f else str(v))
    return sorted(map(tuple, out.values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    found = registry.queries()[name](spark, small).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(want, columns)


def like(a: str, b: str, threshold: float = 0.85) -> bool:
    """The three measures, without any shortcut."""
    m, wa, wb = difflib.SequenceMatcher(None, a, b), set(a.split()), set(b.split())
    run = m.find_longest_match(0, len(a), 0, len(b)).size
    words = len(wa & wb) / len(wa | wb) if wa | wb else 1.0
    return words >= threshold or m.ratio() >= threshold or (run > 0 and run / min(len(a), len(b)) >= 0.8 * threshold)


def cosine(a, b) -> float:
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def first_of_each(hits: pd.DataFrame, same) -> pd.DataFrame:
    """Of each query, in order of rank, the hits that are like none kept before."""
    kept: list = []
    for row in hits.sort_values(["query_id", "rank"]).itertuples():
        if not any(k.query_id == row.query_id and same(row, k) for k in kept):
            kept.append(row)
    return hits.loc[[k.Index for k in kept]]


@pytest.fixture(scope="module")
def hits(duck):
    """The ten best items of each query, by SQL, with text and vector."""
    return duck.sql(V.sql(f"with {textual._HITS} select hits.*, vector from hits join m_items using (id)")).df()


def pairs(frame) -> set:
    return {(int(q), int(i), int(r)) for q, i, r in zip(frame["query_id"], frame["id"], frame["rank"])}


def test_dedup_of_all_hits(spark, small, hits):
    by_text = first_of_each(hits, lambda a, b: like(a.content, b.content))
    assert pairs(registry.queries()["r2_dedup_text"](spark, small).toPandas()) == pairs(by_text)
    exact = first_of_each(hits, lambda a, b: a.content == b.content)
    text = first_of_each(exact, lambda a, b: like(a.content, b.content))
    both = first_of_each(text, lambda a, b: cosine(a.vector, b.vector) >= 0.85)
    assert pairs(registry.queries()["r4_dedup"](spark, small).toPandas()) == pairs(both)
    assert 0 < len(both) < len(text) <= len(hits)


def test_dedup_of_copies(spark):
    """First chunks of documents, gathered by how they begin, so that copies and near copies are hits of one query."""
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    first = con.sql("select hash(substring(text, 1, 12)) % 100000 as query_id, doc_id as id, row_number() over (partition by hash(substring(text, 1, 12)) % 100000 order by doc_id)::int as rank, substring(text, 1, 1000) as content from documents where length(text) > 0").df()
    first["query_id"] = first["query_id"].astype("int64")
    want = first_of_each(first, lambda a, b: like(a.content, b.content))
    assert pairs(R.dedup_greedy(spark.createDataFrame(first)).toPandas()) == pairs(want)
    assert len(want) < len(first_of_each(first, lambda a, b: a.content == b.content)) < len(first)


def test_retrieval_of_all_queries(spark, small, hits):
    found = hits[(hits["score"] >= 0.3) & (hits["score"] <= 1 + 1e-6)]
    kept = first_of_each(found, lambda a, b: a.content == b.content or like(a.content, b.content)).copy()
    size = kept["content"].str.len()
    words = [{w for w in q.lower().split() if w} for q in kept["query_text"]]
    bonus = [min(0.03 * sum(w in c.lower() for w in ws), 0.15) for ws, c in zip(words, kept["content"])]
    kept["score"] = kept["score"].clip(0, 1)
    kept["again"] = (kept["score"] + np.select([size.between(100, 500), size < 100], [0.05, -0.02], -0.01) + bonus).round(9)
    kept = kept[kept["query_text"].str.strip() != ""].sort_values(["query_id", "again", "rank"], ascending=[True, False, True])
    kept["place"] = kept.groupby("query_id").cumcount() + 1
    kept = kept[kept["place"] <= 5]
    want = {(r.query_id, r.place, r.id, r.document_id, round(r.score, 6), round(r.again, 6)) for r in kept.itertuples()}
    got = registry.queries()["r17_retrieve"](spark, small).collect()
    assert {(r["query_id"], r["rank"], r["id"], r["document_id"], r["score"], r["rerank_score"]) for r in got} == want


def test_recall_of_the_index(spark, small, duck):
    """The recall that the query reports is that of its hits against those of SQL, and it is high."""
    reported = registry.queries()["v7_ivf_recall"](spark, small).first()
    best = duck.sql(V.sql("select query_id, id from (select query_id, i.id, row_number() over (partition by query_id order by round(list_cosine_similarity(q.vector, i.vector), 9) desc, i.id) as n from m_q q, m_items i) where n <= 10")).df()
    q, items, index = textual._index(spark, small)
    near = textual.I.search(index, q, 10, textual.I.probes_for(index, q, items, 10)).toPandas()
    both = set(zip(best["query_id"], best["id"])) & set(zip(near["query_id"], near["id"]))
    assert reported["n"] == len(best) and reported["recall"] == pytest.approx(len(both) / len(best)) and reported["recall"] >= 0.9
    assert reported["pairs"] < reported["all_pairs"] == len(set(best["query_id"])) * items.count()
    assert registry.queries()["v7_codes_recall"](spark, small).first()["recall"] >= 0.9


def test_cost_of_the_word_index(spark, small, duck):
    """What the index's search would open without a goal is every posting of the queries' terms."""
    told = registry.queries()["v10_index_cost"](spark, small).first()
    words = "regexp_extract_all(lower({}), '[a-zà-ÿ0-9]+')"
    want = duck.sql(V.sql(f"with a as (select distinct query_id, unnest({words.format('query_text')}) as term from m_q), t as (select distinct doc_id, unnest({words.format('text')}) as term from documents) select count(*) as n from a join t using (term)")).df()["n"][0]
    assert told["all_postings"] == want and 0 < told["postings"] <= want and 0 < told["blocks"] <= told["all_blocks"]


def test_keywords_by_a_dictionary(spark, small):
    """Every message, cut by a search over all ends of each run."""
    import functools
    import math
    import re
    from collections import Counter

    frequency: Counter = Counter()
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        for w in re.findall("[a-z]+", (r["text"] or "").lower()):
            if len(w) > 4:
                frequency.update(x for n in (2, 3, 4) for x in (w[:n], w[-n:]))
    total = sum(frequency.values())
    worth = lambda w: math.log(frequency.get(w, 1) / total) if w in frequency or len(w) == 1 else None

    @functools.cache
    def cut(run):
        best = [(0.0, ())]
        for j in range(1, len(run) + 1):
            ways = [(best[j - n][0] + worth(run[j - n : j]), n) for n in range(1, min(4, j) + 1) if worth(run[j - n : j]) is not None]
            top = max(s for s, _ in ways)
            n = max(n for s, n in ways if s >= top - 1e-9)
            best.append((max(s for s, m in ways if m == n), best[j - n][1] + (run[j - n : j],)))
        return best[-1][1]

    stop = {r[0] for r in relational._stop(spark).collect()}
    want = set()
    for r in V.messages(spark, small).collect():
        n = Counter(w for run in re.findall("[a-z]+", (r["content"] or "").lower()) for w in cut(run) if 2 <= len(w) <= 4 and w not in stop)
        want |= {(r["id"], w, c, k + 1) for k, (w, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:5])}
    got = registry.queries()["a12_dictionary_keywords"](spark, small).collect()
    assert {(r["id"], r["word"], r["n"], r["rank"]) for r in got} == want


def test_files_of_the_folder(spark, small):
    from pathlib import Path

    listed = {(r["name"], r["size"], r["extension"]) for r in registry.queries()["s2_list_files"](spark, small).collect()}
    assert listed == {(p.name, p.stat().st_size, ".parquet") for p in Path(small).glob("*.parquet")}


def test_flagship(spark, small):
    assert registry.flagship(spark, small).columns == ["query_id", "rank", "id", "document_id", "document_title", "score", "rerank_score"]


def test_plans(spark, small):
    plan = lambda name: registry.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan("a20_has_all_permissions")
    assert "Python" not in plan("a10_hot_topics") and "Python" not in plan("c4_legal_clauses")
    assert V.messages(spark, small).select("id")._jdf.queryExecution().toString().count("ReadSchema: struct<conv_id:bigint,turn:bigint>") >= 1


@pytest.mark.parametrize("name, shingle, threshold", [("r16_greedy_chunks", 1, 0.85), ("r16_greedy_shingles", 5, 0.8)])
def test_greedy_queries(spark, small, name, shingle, threshold):
    """The registered queries against the sequential loop over the whole table."""
    import re

    def runs(text):
        w = [x for x in re.split(r"[\s\x1c-\x1f]+", text or "") if x]
        return frozenset(tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, min(len(w), 1))))

    kept: dict = {}
    for i, text in sorted((r["id"], r["content"]) for r in V.items(spark, small).collect()):
        own = runs(text)
        if not any(own == k or (own | k and len(own & k) >= threshold * len(own | k) - 1e-6) for k in kept.values()):
            kept[i] = own
    got = registry.queries()[name](spark, small).collect()
    assert len(got) == V.items(spark, small).count() and {r["id"] for r in got if r["kept"]} == set(kept)
    assert 0 < len(kept) < len(got)


def test_hits_need_no_text_of_other_chunks(spark, small):
    """Queries by vectors alone cut no text, and chunks without content are those with it."""
    plan = registry.queries()["v2_top_k"](spark, small)._jdf.queryExecution().analyzed().toString()
    assert "substring" not in plan.split("documents.parquet")[-1] and "content" not in plan
    whole, lean = V.items(spark, small), V.item_vectors(spark, small)
    assert whole.drop("content").exceptAll(lean.select("id", "document_id", "chunk_index", "vector")).isEmpty() and whole.count() == lean.count()


def test_texts_of_passages_meet_no_vectors(spark, small, monkeypatch):
    """Chunks of the duplicate search are those of the chunk table, but for that no text is joined, unless some chunks have no vector or two."""
    from lexloom.operators import dedup

    given, table = [], V.table
    monkeypatch.setattr(dedup, "near_duplicates", given.append)
    registry.queries()["r16_near_duplicate_chunks"](spark, small)
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("id", "content").collect()))
    assert rows(given[0]) == rows(V.items(spark, small))
    for odd in (lambda e: e.where("vec_id <> 3"), lambda e: e.union(e.where("vec_id = 3")), lambda e: e.where("vec_id <> 3").union(e.where("vec_id = 4")), lambda e: e.where("false")):
        monkeypatch.setattr(V, "table", lambda s, d, name, odd=odd: odd(table(s, d, name)) if name == "embeddings" else table(s, d, name))
        assert rows(V.passages(spark, small)) == rows(V.items(spark, small)) != rows(given[0])
