"""Learned operators: language, quality, toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import language_id as li
from lexloom.llm import quality as qu
from lexloom.llm import queries as q
from lexloom.llm import toxicity as tx

LARGER = "/root/testdata/sf0.01"


def naive_phrases(sample: str, text: str) -> int:
    """Longest phrases that occur in the sample, one after another, from the first symbol to the last."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def symbols_of(sample: str, text: str) -> str:
    """The text as the sample's language reads it: its letters, a blank for what is no letter, a stranger for the rest."""
    return "".join((c if c in sample else "\0") if c.isalpha() else " " for c in text.lower())


@pytest.mark.parametrize("dense", [li.DENSE, 0])
@pytest.mark.parametrize("seed", range(4))
def test_cross_parsing(seed, dense, monkeypatch):
    random.seed(seed)
    word = lambda letters: "".join(random.choice(letters) for _ in range(random.randrange(1, 7)))
    samples = {"one": " ".join(word("abcd") for _ in range(200)), "two": " ".join(word("cdef") for _ in range(200))}
    texts = [" ".join(word("abcdefx") for _ in range(n)) for n in (1, 5, 100, 400)]
    # copies of the sample, whose phrases run over many blocks, and texts whose phrases never fall into step
    texts += [samples["one"] * 3, "ab" * 2000, "abcab d" * 700, "x" * 600]
    for rounds in (li.ROUNDS, 1):
        monkeypatch.setattr(li, "ROUNDS", rounds)
        model = li.train({k: (v, 1) for k, v in samples.items()}, dense)
        counts, letters = li.phrase_counts(model, texts)
        for i, t in enumerate(texts):
            for k, name in enumerate(model.languages):
                assert counts[i, k] == naive_phrases(samples[name], symbols_of(samples[name], t))
        assert letters.all()


def test_large_alphabets(spark):
    """Languages of hundreds of letters, most of them rare, and many of them shared."""
    r = random.Random(6)
    alphabets = {"latin": "abcdefghijklmnop", "one": [chr(0x4E00 + i) for i in range(700)], "two": [chr(0x4E00 + 500 + i) for i in range(700)], "three": [chr(0xAC00 + i) for i in range(900)]}
    words = {k: ["".join(r.choice(v) for _ in range(r.randrange(1, 4))) for _ in range(900)] for k, v in alphabets.items()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(list(alphabets) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = docs.select("lang", "doc_id", li.identify(F.col("text"), li.fit(docs), spark)["lang_pred"].alias("p")).toPandas()
    assert (found.lang == found.p).mean() > 0.97
    many = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 41).cast("string")))
    assert len(li.fit(many).languages) > 100  # every language that labels name is learned


def test_samples_are_whole_texts(spark):
    rows = [(i, f"word{i} " * n, "x" if i % 2 else "y") for i, n in enumerate([3, 400, 5, 700, 20, 10, 9, 8])] + [(90, "solo " * 5000, "z"), (91, "solo " * 4000, "z")]
    found = li.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars_per_language=6000)
    texts = {t for _, t, _ in rows}
    assert set("\n".join(found[k][0] for k in "xy").split("\n")) <= texts and all(len(t) <= 6000 for t, _ in found.values())
    # no text of z is short enough: passages from all over the shortest
    assert len(found["z"][0]) > 5000 and set(found["z"][0]) == set("solo \n")


def test_one_very_long_text_teaches_a_bounded_sample(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, lang string").select("doc_id", "lang", F.repeat(F.lit("lorem ipsum dolor "), 50_000_000 // 18).alias("text"))
    text, labelled = li.samples(rows)["x"]
    assert labelled == 1 and 60_000 < len(text) <= 64_000


def test_rows_without_an_id_teach_nothing(spark):
    rows = spark.createDataFrame([(None, "only here", "z"), (1, "the thing", "x"), (None, "a", "x")], "doc_id long, text string, lang string")
    assert li.samples(rows) == {"x": ("the thing", 1)}


def odd(spark, n=0):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "the thing " * 50, None), (5, "x " * 100_000, "en"), (6, "the the", "en"), (6, "the the", "en"), (None, "the", "fr"), (8, "É", "fr")]
    return spark.createDataFrame(rows[:n] if n is not None and n else rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred", "3 as y", "4 as n", "'f' as feature")


def empty(spark):
    return odd(spark).where("false")


def test_language_odd_rows(spark):
    docs = odd(spark)
    found = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", li.identify(F.col("text"), li.fit(docs), spark).alias("m")).collect()}
    assert found[1, None] == (li.UNDETERMINED, 0.0) and found[3, "123 !!"][0] == found[2, ""][0] == li.UNDETERMINED
    assert all(0 <= m[1] <= 1 for m in found.values()) and found[6, "the the"][0] in ("en", "fr")
    assert li.fit(empty(spark)) is None
    assert {r[0][0] for r in docs.select(li.identify(F.col("text"), None, spark)).collect()} == {li.UNDETERMINED}
    assert empty(spark).select(li.identify(F.col("text"), None, spark)).count() == 0


def test_language_query(spark, small):
    """Every document of the table: phrases counted symbol by symbol, costs and scores from them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = li.samples(docs)
    texts = {k: "".join(c if c.isalpha() else " " for c in t.lower()) for k, (t, _) in found.items()}
    bits = {k: np.log2(len(t)) for k, t in texts.items()}
    assert len(texts) == 4
    got = {r["doc_id"]: r for r in q.op3_language_id(spark, small).collect()}
    for r in docs.select("doc_id", "text").collect():
        text = r["text"] or ""
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not any(c.isalpha() for c in text):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        if len(text) > 6000:  # slow by loops
            continue
        cost = sorted((naive_phrases(texts[k], symbols_of(texts[k], text)) * bits[k], k) for k in texts)
        if cost[1][0] - cost[0][0] > 1e-9:
            assert got[r["doc_id"]]["lang_pred"] == cost[0][1], r["doc_id"]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - 0.5 * 2 ** (-(cost[1][0] - cost[0][0]) / 8), abs=1e-6)


def test_language_accuracy(spark):
    found = q.op3_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97


def test_language_stage_rejects_what_no_language_describes(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    strange = ["Kot siedzi na macie i patrzy przez okno, podczas gdy na zewnątrz pada deszcz. " * 4, "Кот сидит на коврике и смотрит в окно. " * 4, "qzxj vkwq jxzq " * 20, "1 2 3"]
    first = docs.first().asDict()
    odd = spark.createDataFrame([tuple({**first, "doc_id": -1 - i, "text": t, "lang": None}.values()) for i, t in enumerate(strange)], docs.schema)
    both = docs.union(odd)
    kept = {r["doc_id"] for r in cp.keep_language(spark, both, small).collect()}
    samples = li.samples(both)
    for r in [*docs.limit(12).collect(), *odd.collect()]:
        t, costs = r["text"].lower(), []
        for text, _ in samples.values():
            sample = "".join(c if c.isalpha() else " " for c in text.lower())
            unit = np.log2(len(sample) + 2)
            costs.append((naive_phrases(sample, symbols_of(sample, t)) * unit, len(t) * (np.log2(len(set(sample)) + 1) + li.MARGIN) + li.SPARE * unit))
        cost, most = min(costs)
        assert (r["doc_id"] in kept) == (any(c.isalpha() for c in t) and cost <= most)
    assert not kept & {-1, -2, -3, -4} and {r["doc_id"] for r in docs.collect()} <= kept
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.keep_language(spark, unlabelled, small).count() == docs.count()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "1 as n", "'t' as text", "2 as feature")


def test_quality_gradient():
    """The learned weights have a loss that no small step lowers much; attention is a weighted mean within a document."""
    random = np.random.default_rng(0)
    bags = [random.normal(size=(random.integers(1, 6), qu.WIDTH)).astype(np.float32) for _ in range(60)]
    y = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    model = qu.train(bags, y, epochs=60)
    counts = np.array([len(b) for b in bags])
    f = qu._forward(model.weights, model.encode(np.vstack(bags)), counts)
    assert np.add.reduceat(f["a"], f["starts"]) == pytest.approx(np.ones(60))
    assert ((f["p"] >= 0.5) == y).mean() > 0.95


def test_quality_odd_rows(spark):
    docs = odd(spark)
    for rows in ([], [(4, 1, 0)], [(4, 1, 0), (4, 0, 0), (5, 1, 1), (6, None, 1), (None, 1, 1), (2, 0, 0), (1, 0, 1), (8, 1, 0)]):
        model = qu.fit(docs, labels(spark, rows))
        found = docs.select(qu.quality_score(F.col("text"), model)).collect()
        assert len(found) == docs.count() and all(0 <= r[0] <= 1 for r in found)
    assert empty(spark).select(qu.quality_score(F.col("text"), model)).count() == 0
    assert qu.fit(empty(spark), labels(spark, [(1, 1, 1)])).weights is None


def test_quality_accuracy(spark):
    found = q.op4_quality(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def naive_score(model, text):
    """The same score by plain loops."""
    data = (text or "").encode()
    k = max(1, -(-len(data) // qu.PASSAGE))
    hidden = []
    for i in range(k):
        p = data[i * len(data) // k : (i + 1) * len(data) // k]
        n = max(1, len(p))
        classes = [0] * qu._CLASSES
        for c in p:
            ch = chr(c)
            at = qu._ALONE.find(ch) if ch in qu._ALONE else next((len(qu._ALONE) + g for g, group in enumerate(qu._GROUPS) if ch in group), None)
            classes[at if at is not None else qu._CLASSES - 2 if c < 32 else qu._CLASSES - 1 if c > 127 else qu._CLASSES - 3] += 1
        trigrams = [0] * 128
        for a, b, c in zip(p, p[1:], p[2:]):
            trigrams[(a * 961 + b * 31 + c) % 128] += 1
        x = [c / n for c in classes] + [sum(t > 0 for t in trigrams) / min(n, 128), sum(t * t for t in trigrams) / n**2]
        x += [sum(a == b for a, b in zip(p, p[lag:])) / n for lag in qu.LAGS]
        hidden.append(np.tanh((np.array(x, np.float32) - model.mean) / model.scale @ model.weights["W"] + model.weights["b"]))
    w = model.weights
    e = np.array([w["w"] @ (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) for h in hidden])
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return 1 / (1 + np.exp(-(sum(x * h for x, h in zip(a, hidden)) @ w["c"] + w["c0"])))


def test_a_score_depends_on_its_text_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = qu.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["", None, "x", "ab", "é" * 300, "| x |" * 900, "a b c " * 5000]
    alone = [qu.score_texts(model, [t])[0] for t in texts]
    assert qu.score_texts(model, texts) == pytest.approx(alone, abs=1e-9)
    assert qu.score_texts(model, texts[::-1], chunk=3, chars=5000)[::-1] == pytest.approx(alone, abs=1e-9)
    assert [naive_score(model, t) for t in texts] == pytest.approx(alone, abs=1e-6)
    by_batch = {r["doc_id"]: r["s"] for r in docs.repartition(7).select("doc_id", qu.quality_score(F.col("text"), model).alias("s")).collect()}
    assert [by_batch[r["doc_id"]] for r in docs.orderBy("doc_id").limit(60).collect()] == pytest.approx(alone[:60], abs=1e-9)


def test_ids_of_any_type(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    marks = spark.read.parquet(f"{small}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert qu.fit(docs, marks).weights is not None and tx.fit(docs, marks).place and li.fit(docs) is not None


def test_logistic():
    random = np.random.default_rng(1)
    x = random.normal(size=(400, 3))
    y = (x @ [2, -1, 0] > 0.3).astype(float)
    w = tx.logistic(x, y, penalty=0.1)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.6 and ((x @ w[:3] + w[3] > 0) == y).mean() > 0.97
    assert tx.logistic(x, np.ones(400))[:3].tolist() == [0, 0, 0]


def test_chain_uses_out_of_fold_predictions():
    random = np.random.default_rng(2)
    x = random.normal(size=(300, 4))
    first = (x[:, 0] > 0).astype(float)
    chain = tx.train_chain(np.vstack([x, x[:50]]), {"a": np.append(first, first[:50]), "b": np.append(first, first[:50])}, {bytes([i]): i for i in range(4)})
    assert [len(w) for w in chain.weights] == [5, 6] and chain.weights[1][4] > 0
    assert chain.predict(x).shape == (300, 2)


def test_kinds_are_clusters():
    r = np.random.default_rng(4)
    x = np.vstack([np.abs(r.normal(size=(40, 3))) @ np.eye(3, 6), np.abs(r.normal(size=(25, 3))) @ np.eye(3, 6, 3)])
    near = tx.kinds_of(x, 2)
    assert len(set(near[:40])) == len(set(near[40:])) == 1 and near[0] != near[-1]
    assert (tx.kinds_of(x, 2) == near).all() and tx.kinds_of(x[:1], 2).tolist() == [0] and len(tx.kinds_of(x[:0], 2)) == 0


def test_kinds_are_formed_without_the_fold_they_are_predicted_for():
    r = np.random.default_rng(8)
    x = np.vstack([np.abs(r.normal(size=(60, 3))) @ np.eye(3, 6), np.abs(r.normal(size=(60, 3))) @ np.eye(3, 6, 3), np.abs(r.normal(size=(200, 6))) * 0.1])
    toxic = np.append(np.ones(120), np.zeros(200))
    of = tx.kinds_from(x, toxic, 2, "toxic")
    every, asked = of(np.arange(320)), []
    assert list(every) == ["kind_1", "kind_2", "toxic"] and (every["kind_1"] + every["kind_2"] == toxic).all()
    # some rows' kinds are those of all, though their clusters are their own
    for rows in (np.arange(10, 300), np.arange(319, -1, -3)):
        assert all((of(rows)[c] == every[c][rows]).mean() > 0.97 for c in every)
    chain = tx.train_chain(x, lambda rows: asked.append(set(rows.tolist())) or of(rows), {bytes([i]): i for i in range(6)})
    assert len(asked) == 6 and max(map(len, asked)) == 320 and set.intersection(*asked) == set() and [len(w) for w in chain.weights] == [7, 8, 9]
    assert of(np.arange(130, 140))["kind_1"].sum() == 0


def test_long_documents_are_not_in_the_quality_sample(spark):
    rows = [(i, ("good words here " if i % 2 else "zq zq zq zq ") * 20) for i in range(40)] + [(i, "zq " * 60_000) for i in range(41, 61, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [(i, i % 2, 0) for i, _ in rows])
    model = qu.fit(docs, marks)
    short = qu.fit(docs.where("doc_id < 41"), marks)
    assert model.prior == short.prior and qu.score_texts(model, ["good words"]) == pytest.approx(qu.score_texts(short, ["good words"]))


def test_toxicity_against_plain_loops(spark, small):
    """Scores by the model's weights, feature by feature; given categories stand in the chain in order."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    marks = spark.read.parquet(f"{small}/labels.parquet")
    chain = tx.fit(docs, marks)
    texts = [r["text"] for r in docs.limit(40).collect()] + [None, "", "IDIOT idiotic\tidiots! " * 300]
    want = []
    for t in texts:
        words = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        x = np.zeros(len(chain.place))
        for w in (w.encode() for w in words):
            for f in [w, *[w[:n] + b"*" for n in (4, 5, 6, 7) if len(w) > n]]:
                if f in chain.place:
                    x[chain.place[f]] += 1
        p: list[float] = []
        for w in chain.weights:
            p.append(1 / (1 + np.exp(-np.clip(np.log1p(x) @ w[: len(x)] + np.array(p) @ w[len(x) : -1] + w[-1], -40, 40))))
        want.append(p)
    assert tx.score_texts(chain, texts) == pytest.approx(np.array(want), abs=1e-9)
    found = docs.limit(40).select(tx.toxicity(F.col("text"), chain).alias("m")).collect()
    assert [list(r["m"]) for r in found] == [pytest.approx(w, abs=1e-9) for w in want[:40]]
    assert tx.fit(docs, marks, categories=("quality", "toxic")).categories == ["quality", "toxic"]


def test_toxicity_odd_rows(spark):
    docs = odd(spark)
    for rows in ([], [(4, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (2, 0, 0), (1, 0, 1), (8, 1, 0), (8, 1, 1)]):
        chain = tx.fit(docs, labels(spark, rows))
        found = docs.select(tx.toxicity(F.col("text"), chain).alias("m")).select("m.*").collect()
        assert len(found) == docs.count() and all(0 <= v <= 1 for r in found for v in r)
    assert empty(spark).select(tx.toxicity(F.col("text"), chain)).count() == 0


def test_toxicity_accuracy(spark):
    found = q.op1_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert ((found.predicted == 1) & (found.toxic == 0)).sum() <= 0.02 * len(found)
