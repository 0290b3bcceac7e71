"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints at most ``distance`` (4) bits apart share at least
8 - 4 = 4 of them. Posting lists on one byte would each hold a 256th of the corpus, so postings are on three positional
bytes at once: ``TRIPLES`` holds a triple inside every set of four positions, hence every pair with four shared bytes
meets in a posting list of about N / 2^24. There the shared positional bytes of the pair are tallied, pairs with fewer
than the guaranteed minimum go, and the rest are verified bit by bit. Equal fingerprints are one node from the start,
and a task turns its links into stars, so that no list writes out all its pairs. Posting lists longer than
``hot`` are dealt anew with further bytes, then nibbles, in their keys; nothing is capped.

Nulls: a null text is an empty one and has fingerprint 0, which links like any other; a null id is never a component
id unless its whole component has none. Texts under ``shingle`` words are one shingle. Repeated rows have equal
results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import components, forest, materialise, row_hashes

#: Positions 0 to 7 in three parts; triples within a part, and of two from one part and one from the next part round,
#: leave no set of four positions without a triple.
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = tuple(
    t
    for t in itertools.combinations(range(8), 3)
    if any(set(t) <= set(p) for p in _PARTS)
    or any(len(set(t) & set(_PARTS[i])) == 2 and len(set(t) & set(_PARTS[(i + 1) % 3])) == 1 for i in range(3))
)


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned number: majority of the XXH64 of its word shingles, bit by bit."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    count, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65536):  # very long texts: a bounded block of bits at a time
        block = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((count * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """Column of fingerprints as signed longs."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(text)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame) -> DataFrame:
    """(key, fp, triple): a posting for each triple of positional bytes."""
    keys = []
    for i, (a, b, c) in enumerate(TRIPLES):
        bits = F.shiftleft(_byte(F.col("fp"), a), 16).bitwiseOR(F.shiftleft(_byte(F.col("fp"), b), 8)).bitwiseOR(_byte(F.col("fp"), c))
        keys.append(F.struct((bits + (i << 24)).alias("key"), F.lit(i).alias("triple")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "fp", "k.triple")


def _finer(hot: DataFrame, level: int) -> DataFrame:
    """The postings of hot lists under longer keys.

    Level 1 adds one of the five other bytes, of which a linked pair shares at least one. Level 2 adds three of the
    eight nibbles of the four bytes then left, of which it shares four. Keys are hashed; a collision only makes a
    candidate that verification drops.
    """
    others = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in t]) for t in TRIPLES])
    if level == 1:
        more = hot.withColumn("p", F.explode(F.element_at(others, F.col("triple") + 1)))
        key = F.expr("xxhash64(key, p, shiftrightunsigned(fp, 8 * p) & 255)")
        return more.select(key.alias("key"), "fp", "triple", "p")
    left = hot.withColumn("left", F.array_except(F.element_at(others, F.col("triple") + 1), F.array("p")))
    nibble = [f"shiftrightunsigned(fp, 8 * left[{k // 2}] + {4 * (k % 2)}) & 15" for k in range(8)]
    keys = [F.expr(f"xxhash64(key, {i}, {nibble[a]}, {nibble[b]}, {nibble[c]})") for i, (a, b, c) in enumerate(TRIPLES)]
    return left.select(F.explode(F.array(*keys)).alias("key"), "fp", "triple", "p")


def _linker(distance: int, block: int = 1024, flush: int = 1_000_000):
    """A mapInArrow function over postings sorted by key: pairs of a list that share enough positional bytes and differ
    in few enough bits, as stars (a, b) of what a task has linked."""

    def verified(x, y):
        xor = x ^ y
        # count filter: positional bytes that the two share
        shared = (xor.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        ok = shared >= 8 - distance
        ok[ok] = np.bitwise_count(xor[ok]) <= distance
        return ok

    def pairs(key, fp):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        small = size <= 64
        # short lists together: compare each posting with the one ``lag`` places on, while any list is that long
        for lag in range(1, int(size[small].max(initial=1))):
            at = np.flatnonzero(key[lag:] == key[:-lag])
            at = at[np.repeat(small, size)[at]]
            x, y = fp[at], fp[at + lag]
            ok = verified(x, y)
            yield x[ok], y[ok]
        for s, n in zip(starts[~small], size[~small]):
            group = fp[s : s + n]
            for i in range(0, n, block):
                a = group[i : i + block]
                for j in range(i, n, block):
                    b = group[j : j + block]
                    x, y = np.repeat(a, len(b)), np.tile(b, len(a))
                    ok = verified(x, y) & (x != y)
                    yield forest(x[ok], y[ok])

    def link(batches):
        out, n, key, fp = [], 0, np.empty(0, np.int64), np.empty(0, np.uint64)

        def stars():
            a, b = forest(np.concatenate([x for x, _ in out]).view(np.int64), np.concatenate([y for _, y in out]).view(np.int64))
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        def eat(k, f):
            nonlocal n
            for x, y in pairs(k, f):
                out.append((x.astype(np.uint64), y.astype(np.uint64)))
                n += len(x)
            if n > flush:
                batch = stars()
                out[:] = [(batch["a"].to_numpy().view(np.uint64), batch["b"].to_numpy().view(np.uint64))]
                n = batch.num_rows

        for batch in batches:
            key = np.concatenate([key, batch["key"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
            if len(key) < 100_000:  # gather batches, a list goes on in the next
                continue
            last = np.searchsorted(key, key[-1])
            if last:
                eat(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
        if len(key):
            eat(key, fp)
        if out:
            yield stars()

    return link


def links(fps: DataFrame, distance: int = 4, hot: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough of them to connect what pairs within ``distance`` bits
    connect, never more than one for each node and task."""
    if distance != 4:
        raise ValueError("the byte triples hold for a distance of 4")
    found, postings = None, _postings(fps)
    for level in (1, 2, 3):
        long_lists = None
        if level < 3:
            long_lists = materialise(postings.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot")
            if long_lists.isEmpty():
                long_lists = None
        cold = postings if long_lists is None else postings.join(long_lists, "key", "left_anti")
        star = (
            cold.select("key", "fp")
            .repartition("key")
            .sortWithinPartitions("key", "fp")
            .mapInArrow(_linker(distance), "a long, b long")
        )
        found = star if found is None else found.union(star)
        if long_lists is None:
            break
        postings = _finer(postings.join(long_lists, "key", "left_semi"), level)
    return found


def groups(fps: DataFrame, hot: int = 4096) -> DataFrame:
    """(fp, component) of distinct fingerprints ``fp``: the smallest one reachable by links of at most 4 bits."""
    joined = components(links(fps, hot=hot), "a", "b").withColumnRenamed("node", "fp")
    return fps.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, hot: int = 4096) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest id reachable by links of at most 4 bits, of every row."""
    printed = materialise(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    classes = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    node = classes.join(groups(classes.select("fp"), hot), "fp")
    smallest = node.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = node.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return printed.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, hot: int = 4096) -> DataFrame:
    """One row of each group: of the smallest id (null ids come last), then of the smallest hash of the whole row."""
    h, g = row_hashes(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", h.alias("h"), g.alias("g"))
    printed = materialise(docs.select(key.alias("key"), fingerprint(F.col("text")).alias("fp")), "fingerprints")
    first = materialise(printed.groupBy("fp").agg(F.min("key").alias("key")), "classes")
    found = first.join(groups(first.select("fp"), hot), "fp").groupBy("component").agg(F.min("key").alias("key"))
    chosen = found.select("key.h", "key.g")
    keyed = docs.select(F.struct("*").alias("document"), key.alias("key")).select("document", "key.h", "key.g").join(chosen, ["h", "g"], "left_semi")
    # rows that are equal in all columns are in one group
    once = F.row_number().over(W.partitionBy("h", "g").orderBy("h"))
    return keyed.select("document", once.alias("n")).where("n = 1").select("document.*")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
