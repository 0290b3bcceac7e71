"""URL filter, phrase collocations, whitening."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import collocations as co
from lexloom.llm import queries as q
from lexloom.llm import url_filter as uf
from lexloom.llm import whitening as wh

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("B.org", "", "block"), (None, "/", "block"), ("x.org", None, "block"), ("a.com", "/x", "block"), ("a.com", "/x", "allow")]
URLS = [
    "http://Sub.Example.COM/en/a?x=1", "http://www.example.com/en/", "https://example.com/EN/", "http://example.com", "http://example.com/", "http://notexample.com/en/",
    "http://a.b.net/es/1#x", "net/es/1", "x://y://z.net/es/", "http://net/es/", "http://net", None, "", "://", "http://", "http:///en/", "http://b.ORG?q", "http://cb.org/", "http://a.com/xyz", "http://a.com/X",
    "http://" + "a." * 3000 + "net/es/" + "p" * 100_000, "http://example.com\n/en/", "http://www.list.io:80/p/?b=2&utm_source=y&a=1#t", "http://LIST.io/p?a=1&b=2", "http://list.io/p?a=1", "http://www.example.com/en/",
]


def judged(url):
    """host, path, rule and verdict by plain loops, without the list of whole addresses."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES if h is not None and p is not None and ("." + host).endswith("." + h.lower()) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best and best[3], best and best[4]


@pytest.mark.parametrize("blocks", [uf.MAX_BLOCKS, 0])
def test_urls(spark, monkeypatch, blocks):
    monkeypatch.setattr(uf, "MAX_BLOCKS", blocks)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0])], "page_id long, url string").selectExpr("*", "'c' as host", "1 as key", "2 as block", "3 as rule")
    entries = uf.prefix_rules(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    listed = uf.exact_urls(spark.createDataFrame([("http://list.io/p/?a=1&b=2",), (None,), ("nothing",)], "url string"))
    rows = {r["page_id"]: r for r in uf.judge_urls(pages, entries.unionByName(listed)).collect()}
    assert len(rows) == len(URLS) + 1 and rows[None]["verdict"] == rows[0]["verdict"]
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judged(u)
        known = u is not None and "list.io" in u.lower() and "b=2" in u
        assert tuple(rows[i])[1:] == (host, path, rule, verdict or ("block" if known else "allow")), u
    assert uf.judge_urls(pages.limit(0), entries).count() == 0
    assert {r["verdict"] for r in uf.judge_urls(pages, entries.limit(0), "block").collect()} == {"block"}


def test_filter_errs_on_one_side_only(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("key"))
    passed = {r["key"] for r in uf.possible_hits(asked, keys, 5000).collect()}
    assert {f"k{i}" for i in range(5000)} <= passed and len(passed) - 5000 < 45_000 * 0.005


def plain_collocations(rows, least, top):
    """By loops over all texts, with Python's whole numbers."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    f = {k: v for k, v in f.items() if v >= least}
    longer = defaultdict(int)
    for (lang, p), v in f.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i : i + n]] = max(longer[lang, p[i : i + n]], v)
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and longer[lang, p] < a:
            s, _, left, right = min(((1000 * a * total[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["a", "B", "the", "é", "of", "字", "x" * 40, "don't", "-"]
    odd = [("en", None), ("en", ""), (None, "  \t "), ("und", "a b c. a b c"), (None, "a\u00a0b a\u00a0b"), ("", "a b")]
    return odd + [(r.choice(["en", "en", "en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ! "]) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, seed, small):
    rows = texts(seed)
    if small:  # windows, slices and what a task holds of a few words, in the one process that runs the function
        monkeypatch.setattr(co, "WINDOW_WORDS", 7)
        monkeypatch.setattr(co, "SLICE_BYTES", 50)
        monkeypatch.setattr(co, "HELD", 5)
    want = plain_collocations(rows, 4, 30)
    assert want == found_in_process(rows, 4, 30) if small else want == collected(spark, rows, 4, 30)


def collected(spark, rows, least, top):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").selectExpr("*", "1 as n", "'x' as phrase", "2 as seed")
    return {tuple(r) for r in co.collocations(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def found_in_process(rows, least, top):
    """The task functions called here, sums by loops; scoring as in ``plain_collocations``."""
    import pyarrow as pa

    class Shared:
        def __init__(self, value):
            self.value = value

    langs = ["und" if lang is None else lang for lang, _ in rows]
    seeds = [hash(x) for x in langs]
    batch = pa.record_batch([pa.array([t or "" for _, t in rows]), pa.array(seeds, pa.int64()), pa.array(langs), pa.array(range(len(rows)))], names=["text", "seed", "lang", "doc_id"])

    def frequent(found):
        sums = Counter()
        for b in co._counter(found)([batch]):
            for k, n in zip(b["fp"].to_pylist(), b["n"].to_pylist()):
                sums[k] += n
        return [k for k, n in sums.items() if n >= least]

    def bits(fps):
        words = np.zeros(1 << 10, np.uint64)
        at = np.array(fps, np.int64).view(np.uint64) >> np.uint64(64 - 16)
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return Shared(words)

    short = frequent(co._pairs_of)
    long = frequent(co._longer(bits([k for k in short if k & 7 == 2])))
    sums, total = Counter(), Counter()
    for b in co._verifier(bits(short + long), pa.int64())([batch]):
        for r in b.to_pylist():
            if r["phrase"] is None:
                total[r["lang"]] += r["n"]
            else:
                sums[r["lang"], r["phrase"]] += r["n"]
                text = re.findall(r"[^ \t.,;:!?\n-\r]+", rows[r["doc_id"]][1])[r["word"] : r["word"] + r["words"]]
                assert " ".join(text).lower() == r["phrase"]
    # expand the sums into texts of their own, one occurrence a piece, but for the totals
    f = {(k[0], tuple(k[1].split(" "))): v for k, v in sums.items() if v >= least}
    want = plain_collocations(rows, least, top)
    whole = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            w = re.findall(r"[^ \t]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in piece))
            whole.update(("und" if lang is None else lang, tuple(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    assert f == {k: v for k, v in whole.items() if v >= least}
    assert all(total[lang] == n for lang, *_, n, _ in want)
    return want


def test_collisions_are_told_apart_by_text(spark, monkeypatch):
    rows = texts(7)
    want = plain_collocations(rows, 4, 30)
    monkeypatch.setattr(co.Fingerprints, "of", lambda self, first, n: np.full(len(first), np.uint64(8 + n)))
    assert found_in_process(rows, 4, 30) == want


def test_collocations_of_nothing(spark):
    assert collected(spark, [], 2, 10) == set() and collected(spark, [("en", None)], 2, 10) == set()
    assert collected(spark, [("en", "a b " * 200_000)], 100, 1) == plain_collocations([("en", "a b " * 200_000)], 100, 1)


def test_scores_pass_64_bits(spark):
    r = spark.range(1).select(F.lit(10**13).cast("decimal(18,0)").alias("a"), F.lit(10**14).cast("decimal(18,0)").alias("n"))
    assert r.select(F.expr("((cast(a * n as decimal(38,0)) * cast(1000 as decimal(4,0))) div (a * a))")).first()[0] == 10_000


def check_whitening(rows, vectors, components=4):
    """Against numpy over the distinct integer vectors."""
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    width = Counter(len(x) for _, x in kept).most_common(1)[0][0]
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    value, axes = np.linalg.eigh(centred.T @ centred / n)
    assert len(rows) == len(kept) * components
    got = defaultdict(dict)
    for r in rows:
        got[r["component"]].setdefault(r["vec_id"], []).append(r)
    for j in range(components):
        v, e = axes[:, -1 - j], value[-1 - j]
        sign = 0
        for i, x in kept:
            for r in got[j + 1][i]:
                w = float((x - total / n) @ v / np.sqrt(e))
                sign = sign or np.sign(w * r["whitened"])
                assert r["whitened"] == pytest.approx(sign * w, abs=1e-6)
                assert (r["n"], r["deviation"]) == (n, int(((n * x - total).astype(object) ** 2).sum()))
                assert r["explained"] == pytest.approx(e / value.sum(), rel=1e-6) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening(spark, kind):
    random = np.random.default_rng(3)
    vectors = [(i, (random.normal(size=6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for i in range(3000)]
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors]
    odd = [(9000, None), (9001, []), (9002, [None] * 6), (9003, [float("nan")] * 6), (9004, [float("-inf")] + [1.0] * 5), (9005, [1.0, 2.0]), (9006, [0.0, -0.0] * 3)]
    every = vectors + odd + [(7000 + i, vectors[0][1]) for i in range(500)] + [(None, vectors[1][1])]
    frame = spark.createDataFrame(every, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as index", "2 as x", "3 as n")
    check_whitening(wh.whitening(frame).collect(), every)


def test_whitening_without_variance(spark):
    schema = "vec_id string, embedding array<float>"
    assert wh.whitening(spark.createDataFrame([], schema)).count() == 0
    assert wh.whitening(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)).count() == 0
    line = [("a", [0.0, 0.0]), ("b", [1.0, 1.0]), (None, [2.0, 2.0])]
    check_whitening(wh.whitening(spark.createDataFrame(line, schema)).collect(), line, 1)


def test_whitening_query(spark, small):
    rows = q.op13_whitening(spark, small).collect()
    check_whitening(rows, [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()])
