"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes that share its label. Every passage is encoded by byte-class
shares, distinct-trigram share and self-overlap at short lags, then by a learned layer. Gated attention weighs the
passages, the weighted mean is the document's representation, and a logistic layer scores it. Encoder, attention and
score are learned together from document labels.

Learning takes all passages of ``max_documents`` labelled documents at most (smallest hashes first), of which those of more
than ``max_passages`` passages are left out; scoring reads all passages of whole texts.

Nulls: a null text is an empty one; empty texts have one passage without features and get its score. Rows of ``labels``
with a null id or label teach nothing; of repeated labels of an id the smallest counts. Without labels of both kinds
every score is the share of label 1 (0.5 without labels). A score depends on nothing but the text and the learned
weights, so repeated rows have equal results, in whatever batch they stand. Extra columns are ignored. Ids may be of any
type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import held_out

PASSAGE = 256
LAGS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16)
_TRIGRAMS = 128
#: Characters that form a class of their own; then vowels, other lower-case letters, capitals, digits, brackets and
#: quotes, other visible ASCII, control characters, bytes above 127.
_ALONE = " \n.,!?|#*&%$@-_/:;=<>"
_GROUPS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "()[]{}\"'`")
_CLASSES = len(_ALONE) + len(_GROUPS) + 3
WIDTH = _CLASSES + 2 + len(LAGS)


def _byte_classes() -> np.ndarray:
    of = np.full(256, _CLASSES - 3, np.int64)
    of[:32], of[128:] = _CLASSES - 2, _CLASSES - 1
    for i, group in enumerate([*_ALONE, *_GROUPS]):
        for c in group:
            of[ord(c)] = i
    return of


_CLASS_OF = _byte_classes()


def passage_features(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(passages, WIDTH): features of consecutive passages of ``sizes`` bytes of ``data``.

    Each passage's features depend on its own bytes alone: trigrams and lags never reach over a passage's border.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    length = np.maximum(sizes, 1)[:, None]
    share = np.bincount(owner * _CLASSES + _CLASS_OF[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / length
    parts = [share]
    whole = np.ones(len(data), bool)  # whether a trigram of the passage begins here
    for back in (1, 2):
        whole[np.maximum(ends - back, 0)[sizes > 0]] = False
    at = np.flatnonzero(whole)
    wide = data.astype(np.int32)
    trigram = (wide[at] * 31 * 31 + wide[at + 1] * 31 + wide[at + 2]) % _TRIGRAMS
    table = np.bincount(owner[at] * _TRIGRAMS + trigram, minlength=n * _TRIGRAMS).reshape(n, _TRIGRAMS)
    most = np.minimum(length[:, 0], _TRIGRAMS)
    parts += [((table > 0).sum(axis=1) / most)[:, None], ((table * table).sum(axis=1) / (length[:, 0] ** 2))[:, None]]
    for lag in LAGS:
        same = np.zeros(len(data) + 1, np.int32)  # how many bytes before this one equal the byte ``lag`` before them
        same[lag + 1 :] = data[lag:] == data[:-lag]
        np.cumsum(same, out=same)
        parts.append((same[ends] - same[np.minimum(starts + lag, ends)])[:, None] / length)
    return np.hstack(parts).astype(np.float32)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, passage sizes, passages of each text): even passages, one at least."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes, counts = [], []
    for r in raw:
        k = max(1, -(-len(r) // PASSAGE))
        cuts = np.arange(k + 1) * len(r) // k
        sizes.append(np.diff(cuts))
        counts.append(k)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(sizes), np.array(counts)


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None  # None: one score for all
    prior: float

    def encode(self, features: np.ndarray) -> np.ndarray:
        return np.tanh((features - self.mean) / self.scale @ self.weights["W"] + self.weights["b"])

    def score(self, hidden: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _forward(self.weights, hidden, counts)["p"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], hidden: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(counts) - counts
    t, g = np.tanh(hidden @ w["V"]), _sigmoid(hidden @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    a = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(a[:, None] * hidden, starts)
    return {"t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["c0"]), "starts": starts}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 30, batch: int = 64, rate: float = 5e-3, decay: float = 1e-5) -> AttentionModel:
    """Adam over bags of passage features; a fixed seed, so reruns agree."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return AttentionModel(np.zeros(WIDTH), np.ones(WIDTH), None, prior)
    stacked = np.vstack(bags).astype(np.float64)
    mean, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-3
    random = np.random.default_rng(7)
    w = {
        "W": random.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "b": np.zeros(hidden), "V": random.normal(0, 0.3, (hidden, gates)),
        "U": random.normal(0, 0.3, (hidden, gates)), "w": random.normal(0, 0.3, gates), "c": random.normal(0, 0.3, hidden),
        "c0": np.array(np.log(prior / (1 - prior))),
    }
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            counts = np.array([len(bags[i]) for i in chosen])
            x = (np.vstack([bags[i] for i in chosen]) - mean) / scale
            h = np.tanh(x @ w["W"] + w["b"])
            f = _forward(w, h, counts)
            ds = (f["p"] - labels[chosen]) / len(chosen)
            dz = np.repeat(ds[:, None] * w["c"], counts, axis=0)
            da = (dz * h).sum(axis=1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), counts))
            gate = de[:, None] * w["w"]
            dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
            grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "c0": ds.sum()}
            step += 1
            for k, d in grad.items():
                d = d + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean, scale, w, prior)


def score_texts(model: AttentionModel, texts: list[str | None], chunk: int = 2_000, chars: int = 1_000_000) -> np.ndarray:
    """Scores of whole texts, read by about ``chars`` characters and encoded by ``chunk`` passages at a time."""
    if model.weights is None or not len(texts):
        return np.full(len(texts), model.prior)
    out, start = [], 0
    while start < len(texts):
        end, held = start + 1, len(texts[start] or "")
        while end < len(texts) and held + len(texts[end] or "") <= chars:
            held += len(texts[end] or "")
            end += 1
        data, sizes, counts = passages(texts[start:end])
        ends, hidden = np.cumsum(sizes), []
        for a in range(0, len(sizes), chunk):
            b = min(a + chunk, len(sizes))
            part = data[ends[a] - sizes[a] : ends[b - 1]]
            hidden.append(model.encode(passage_features(part, sizes[a:b])))
        out.append(model.score(np.vstack(hidden), counts))
        start = end
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 2500, max_passages: int = 256, label: str = "quality") -> AttentionModel:
    """Learn from all passages of labelled documents that aren't held out. The sample is of ``max_documents`` rows at most;
    those of more than ``max_passages`` passages aren't in it. The driver gets encoded passages, no texts."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min(label).alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)

    def encode(frames):
        for frame in frames:
            rows = []
            for i, y, text in zip(frame["doc_id"], frame["y"], frame["text"]):
                data, sizes, _ = passages([text])
                if len(sizes) <= max_passages:
                    rows.append((i, y, passage_features(data, sizes).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "bag"])

    # max_documents rows of two numbers are broadcast
    wanted = marked.select(F.col("doc_id").cast("string").alias("__id"), F.col("y").cast("int").alias("y"))
    bags = docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("__id")).join(F.broadcast(wanted), "__id").drop("__id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = bags.mapInPandas(encode, f"doc_id {kind}, y int, bag binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("bag").alias("bag")).collect()
    encoded.sort(key=lambda r: r["doc_id"])
    arrays = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in encoded]
    return train(arrays, np.array([r["y"] for r in encoded], dtype=float))


def quality_score(text: Column, model: AttentionModel) -> Column:
    """Column of scores, 0 to 1."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts.tolist()))

    return quality(text)
