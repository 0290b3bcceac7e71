"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over word and word-beginning features; every model also
sees the probabilities of the categories before it. In training these are out-of-fold predictions, so that a later
model learns from the kind of probabilities that it will get. Rows with equal features are in one fold.

``categories`` names the columns of ``labels`` in the order of the chain. Where there is one only, the chain is given
earlier categories that the data suggest: toxic documents of the sample are parted into ``kinds`` clusters by their
features (spherical k-means), and ``kind_1``, ``kind_2``, ... are membership of each. For out-of-fold predictions the
clusters are formed anew without the fold that is predicted. No list of words is used.

Learning takes ``max_documents`` labelled documents at most (smallest hashes first). The models' width is ``max_features``,
those features that speak most clearly for a category, of all that ``least`` of these documents have; features are
counted by Spark. Scoring reads whole texts.

Nulls: a null text is an empty one and gets the score of a text without features. Rows of ``labels`` with a null id
teach nothing, a null label counts as 0 unless all labels of the row are null; of repeated labels of an id the largest
counts. A category without both kinds has its share as probability (0 without labels). Repeated rows have equal results.
Extra columns are ignored. Ids may be of any type.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import held_out, materialise

_BEGINNINGS = (4, 5, 6, 7)  # bytes
_BLANK = bytes(32 if i < 48 or 57 < i < 97 or 122 < i < 128 else i for i in range(256))


def words_of(text: str | None) -> Counter:
    """Counts of the lower-case words of ASCII letters, digits and bytes above 127."""
    return Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())


def features_of_word(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in _BEGINNINGS if len(word) > n]]


def feature_counts(words: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        for f in features_of_word(word):
            out[f] += n
    return out


@dataclass
class Chain:
    categories: list[str]
    place: dict[bytes, int]
    weights: list[np.ndarray]  # by category: features, earlier categories, constant

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(documents, categories) of (documents, features)."""
        found = np.empty((len(x), 0))
        for w in self.weights:
            k = len(self.place)
            p = _sigmoid(x @ w[:k] + found @ w[k:-1] + w[-1])
            found = np.hstack([found, p[:, None]])
        return found


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and constant by Newton's method with a ridge penalty."""
    n, k = x.shape
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return np.append(np.zeros(k), np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    full = np.hstack([x, np.ones((n, 1))])
    ridge = np.append(np.full(k, penalty), 1e-6)
    w = np.zeros(k + 1)
    for _ in range(rounds):
        p = _sigmoid(full @ w)
        slope = full.T @ (p - y) + ridge * w
        curve = (full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_chain(x: np.ndarray, labels: dict[str, np.ndarray] | Callable[[np.ndarray], dict[str, np.ndarray]], place: dict[bytes, int], folds: int = 5) -> Chain:
    """Fit the categories in order; a row's fold is told by its features, so equal rows never teach about each other.
    ``labels``: of all rows, or a function that gives those of some rows from these rows alone."""
    of = labels if callable(labels) else lambda rows: {c: y[rows] for c, y in labels.items()}
    fold = np.array([zlib.crc32(row.tobytes()) % folds for row in x], dtype=np.int64)
    every = of(np.arange(len(x)))
    learned = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(folds)]
    within = [of(rest) for rest, _ in learned]
    earlier, weights = np.empty((len(x), 0)), []
    for c, y in every.items():
        wide = np.hstack([x, earlier])
        weights.append(logistic(wide, y))
        out = np.zeros(len(x))
        for (rest, own), known in zip(learned, within):
            w = logistic(wide[rest], known[c])
            out[own] = _sigmoid(wide[own] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(list(every), place, weights)


def kinds_from(x: np.ndarray, toxic: np.ndarray, kinds: int, name: str) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """A function that gives, of some rows, ``kind_1``, ``kind_2``, ... and ``name``: the clusters of these rows' toxic ones,
    numbered like those of all toxic rows that they share most with."""
    positive = np.flatnonzero(toxic)
    whole = np.full(len(x), -1)
    whole[positive] = kinds_of(x[positive], kinds)

    def of(rows: np.ndarray) -> dict[str, np.ndarray]:
        own = rows[toxic[rows] > 0]
        near = kinds_of(x[own], kinds)
        shared = np.zeros((kinds, kinds), int)
        np.add.at(shared, (near, whole[own]), 1)
        number = max(itertools.permutations(range(kinds)), key=lambda p: sum(shared[i, p[i]] for i in range(kinds)))
        kind = np.full(len(x), -1)
        kind[own] = np.array(number)[near]
        return {**{f"kind_{k + 1}": (kind[rows] == k).astype(float) for k in range(kinds)}, name: toxic[rows]}

    return of


def vectors(counts: list[Counter], place: dict[bytes, int]) -> np.ndarray:
    x = np.zeros((len(counts), len(place)))
    for i, c in enumerate(counts):
        for f, n in c.items():
            if f in place:
                x[i, place[f]] = np.log1p(n)
    return x


def kinds_of(x: np.ndarray, kinds: int, rounds: int = 20) -> np.ndarray:
    """Cluster of each row by spherical k-means; the first centre is the row nearest to the mean, each further one the
    row farthest from all centres so far, so reruns agree."""
    m = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if len(m) <= kinds:
        return np.arange(len(m))
    centres = [m[(m @ m.mean(axis=0)).argmax()]]
    while len(centres) < kinds:
        centres.append(m[(m @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        near = (m @ c.T).argmax(axis=1)
        sums = np.array([m[near == k].sum(axis=0) for k in range(kinds)])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return near


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("toxic",), kinds: int = 2, max_documents: int = 4000, max_features: int = 256, least: int = 4) -> Chain:
    """Learn from labelled documents that aren't held out. The driver gets ``max_features`` features and their counts in
    ``max_documents`` documents at most."""
    some = F.coalesce(*[F.col(c) for c in categories]).isNotNull()
    marked = labels.where(F.col("doc_id").isNotNull() & some & ~held_out(F.col("doc_id")))
    marks = F.array(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in categories])
    marked = marked.groupBy("doc_id").agg(marks.alias("marks")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)

    def count(frames):
        for frame in frames:
            rows = [(i, m, f, n) for i, m, t in zip(frame["doc_id"], frame["marks"], frame["text"]) for f, n in [(b"", 1), *feature_counts(words_of(t)).items()]]
            yield pd.DataFrame(rows, columns=["doc_id", "marks", "feature", "n"])

    wanted = marked.select(F.col("doc_id").cast("string").alias("__id"), "marks")  # max_documents rows of a few numbers
    chosen = docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("__id")).join(F.broadcast(wanted), "__id").drop("__id")
    # every document has the empty feature; written, since it is read three times
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = chosen.mapInPandas(count, f"doc_id {kind}, marks array<int>, feature binary, n long").groupBy("doc_id", "feature").agg(F.max("marks").alias("marks"), F.max("n").alias("n"))
    counted = materialise(counted, "counted")
    toxic = F.exists("marks", lambda m: m > 0)
    by_feature = counted.groupBy("feature").agg(F.count_if(toxic).alias("a"), F.count("*").alias("b"))
    whole = by_feature.where("feature = X''").select(F.col("a").alias("every_a"), F.col("b").alias("every_b"))  # one row
    a, b = F.col("a") + 0.5, F.col("b") - F.col("a") + 0.5
    ratio = F.log((a / (F.col("every_a") + 1)) / (b / (F.col("every_b") - F.col("every_a") + 1)))
    rated = by_feature.where((F.col("b") >= least) & (F.length("feature") > 0)).crossJoin(F.broadcast(whole)).select("feature", (ratio * F.col("a")).alias("gain"), ratio.alias("ratio"))
    top = rated.where("ratio > 0").orderBy(F.desc("gain"), "feature").limit(max_features)
    place = {bytes(r["feature"]): i for i, r in enumerate(top.collect())}
    # max_features rows of one word each
    kept = docs.sparkSession.createDataFrame([(bytearray(f),) for f in sorted({*place, b""})], "feature binary")
    rows = counted.join(F.broadcast(kept), "feature", "left_semi").groupBy("doc_id").agg(F.max("marks").alias("marks"), F.collect_list(F.struct("feature", "n")).alias("f")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = vectors([Counter({bytes(f["feature"]): f["n"] for f in r["f"]}) for r in rows], place)
    y = {c: np.array([float(r["marks"][i] > 0) for r in rows]) for i, c in enumerate(categories)}
    if len(categories) == 1:
        return train_chain(x, kinds_from(x, y[categories[0]], kinds, categories[0]), place)
    return train_chain(x, y, place)


def score_texts(chain: Chain, texts: list[str | None], known: dict | None = None) -> np.ndarray:
    """(documents, categories); ``known`` remembers the places of words already seen, 200 000 of them at most."""
    known = {} if known is None else known
    out, place = [], chain.place
    for a in range(0, len(texts), 1000):
        x = np.zeros((min(1000, len(texts) - a), len(place)))
        for i, t in enumerate(texts[a : a + 1000]):
            for word, n in words_of(t).items():
                at = known.get(word)
                if at is None:
                    at = [place[f] for f in features_of_word(word) if f in place]
                    if len(known) >= 200_000:
                        known.clear()
                    known[word] = at
                for k in at:
                    x[i, k] += n
        out.append(chain.predict(np.log1p(x)))
    return np.vstack(out) if out else np.empty((0, len(chain.categories)))


def toxicity(text: Column, chain: Chain) -> Column:
    """Struct column of a probability for each category."""
    known: dict = {}

    @F.pandas_udf(", ".join(f"{c} double" for c in chain.categories))
    def categories(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(score_texts(chain, texts.tolist(), known), columns=chain.categories)

    return categories(text)
