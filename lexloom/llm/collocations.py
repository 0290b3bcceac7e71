"""Phrase collocations: words that stand together more often than their parts would have it.

Rabin-Karp fingerprints: within a task the words of many texts are laid out in one buffer, a numpy prefix polynomial over
its bytes gives the fingerprint of every run of words by one subtraction and one product. Three passes over the texts:

1. fingerprints of single words and pairs are counted in tasks and summed by a shuffle;
2. so are those of longer runs, if all their pairs may be frequent: a bitmap of the frequent fingerprints tells. A run
   that is frequent has frequent pairs only, so none is lost;
3. runs whose fingerprint may be frequent are compared with the text at their occurrence pointer, the first occurrence in the
   task, and shuffled as fingerprint, pointer and text. There counts are by text, so neither a
   collision of fingerprints nor of bits of the bitmap changes a result. Only frequent phrases get that far, but for the
   bitmap's errors.

A bitmap has 64 bits for each fingerprint, 2**26 at most (8 MB): with more frequent phrases than a million it tells less
and more runs are counted, with the same result. It is the only thing that is broadcast.

Nulls: a null text is empty, a null language is ``und``, and one with the language of that name. Empty texts have no words. Repeated
texts count each time. Ties of score go to the more frequent phrase, then to the smaller by bytes. Very long texts are
taken in windows of words, a run belonging to the window of its first word. Extra columns are left out. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import materialise

LONGEST = 5
#: Bytes of text that a task takes at a time, and words of a window.
SLICE_BYTES, WINDOW_WORDS = 1 << 20, 1 << 18
#: Words that are compared byte by byte at a time.
COMPARED = 1 << 15
#: Distinct fingerprints that a task sums up before it passes them on.
HELD = 1 << 19
BITS_PER_FINGERPRINT, MAX_BITS = 64, 1 << 26

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: What each byte is: 0 of a word, 1 blank, 2 end of a piece; and its lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts: ``buffer`` holds them in lower case with one space after each, word i being
    ``buffer[start[i]:end[i]]``; ``room[i]`` words from i on are in one piece, i included (``LONGEST`` at most)."""

    def __init__(self, raw: np.ndarray, text_starts: np.ndarray):
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(text_starts, a, side="right") - 1
        self.ordinal = np.arange(len(a)) - np.searchsorted(self.text, self.text, side="left")
        # a word's own bytes and the one behind it, of which raw has one since every text ends with a line feed
        kept = inside.copy()
        kept[b] = True
        self.buffer = np.where(inside, _LOWER[raw], np.uint8(0x20))[kept]
        long = b - a
        self.start = np.cumsum(long + 1) - (long + 1)
        self.end = self.start + long
        piece = np.searchsorted(np.flatnonzero(kind == 2), a)
        self.room = np.ones(len(a), np.int8)
        for n in range(1, LONGEST):
            if n < len(a):
                self.room[:-n] += piece[n:] == piece[:-n]

    def __len__(self) -> int:
        return len(self.start)

    def windows(self) -> Iterator[tuple[int, int]]:
        for i in range(0, len(self), WINDOW_WORDS):
            yield i, min(len(self), i + WINDOW_WORDS)


class Fingerprints:
    """Fingerprints of the runs that begin in words ``lo`` to ``hi``; the language's seed is a part of each, and its last
    three bits are the number of words."""

    powers = np.empty((2, 0), np.uint64)

    def __init__(self, words: Words, lo: int, hi: int, seeds: np.ndarray):
        top = min(len(words), hi + LONGEST - 1)
        origin = words.start[lo]
        part = words.buffer[origin : words.end[top - 1]]
        powers = self.power(len(part) + 1)
        self.prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[0, : len(part)], out=self.prefix[1:])
        self.start, self.end = words.start[lo:top] - origin, words.end[lo:top] - origin
        self.scale = powers[1, self.start]
        self.seed = seeds[words.text[lo:hi]]
        self.room, self.n = words.room[lo:hi], hi - lo

    @classmethod
    def power(cls, n: int) -> np.ndarray:
        if cls.powers.shape[1] < n:
            cls.powers = np.empty((2, max(n, 2 * cls.powers.shape[1])), np.uint64)
            for row, base in zip(cls.powers, (_BASE, _INVERSE)):
                row[0] = 1
                row[1:] = base
                np.multiply.accumulate(row, out=row)
        return cls.powers

    def of(self, first: np.ndarray, n: int) -> np.ndarray:
        h = (self.prefix[self.end[first + n - 1]] - self.prefix[self.start[first]]) * self.scale[first]
        h ^= self.seed[first]
        for m in _MIX:
            h ^= h >> np.uint64(31)
            h *= m
        h ^= h >> np.uint64(31)
        return (h & ~np.uint64(7)) | np.uint64(n)

    def begins(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.room >= n)


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def __contains__(self, fingerprint):
        raise TypeError("use has()")

    def has(self, fingerprints: np.ndarray) -> np.ndarray:
        at = fingerprints >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(fingerprints: DataFrame, count: int) -> np.ndarray:
    """64-bit words of a bitmap of ``fingerprints`` (fp), put together in tasks; the driver gets ``MAX_BITS`` bits at most."""
    log = max(10, min(MAX_BITS.bit_length() - 1, (count * BITS_PER_FINGERPRINT).bit_length()))
    at = F.shiftrightunsigned("fp", 64 - log)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    found = fingerprints.groupBy(F.shiftrightunsigned(at, 6).alias("i")).agg(F.bit_or(bit).alias("w")).toArrow()
    out = np.zeros(1 << (log - 6), np.uint64)
    out[found["i"].to_numpy()] = found["w"].to_numpy().view(np.uint64)
    return out


def _slices(batches) -> Iterator[tuple[Words, np.ndarray, pa.RecordBatch]]:
    """The texts of some rows (text, seed, ...) as words, the rows' seeds, and the rows."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES, append=-1)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist()):
            rows = batch.slice(lo, hi - lo)
            held = rows.column("text").cast(pa.binary()).to_pylist()
            raw = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
            size = np.fromiter(map(len, held), np.int64, len(held)) + 1
            words = Words(raw, np.cumsum(size) - size)
            if len(words):
                yield words, rows.column("seed").to_numpy().view(np.uint64), rows


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counter(found):
    """A mapInArrow function: (fp, n) of the fingerprints that ``found(fingerprints)`` yields, summed up in the task."""

    def count(batches):
        keys, counts, held = [], [], 0

        def out(k, c):
            return pa.record_batch([pa.array(k.view(np.int64)), pa.array(c)], names=["fp", "n"])

        for words, seeds, _ in _slices(batches):
            for lo, hi in words.windows():
                for fp in found(Fingerprints(words, lo, hi, seeds)):
                    k, c = np.unique(fp, return_counts=True)
                    keys.append(k)
                    counts.append(c.astype(np.int64))
                    held += len(k)
            if held > 2 * HELD:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                if len(k) > HELD:
                    yield out(k, c)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if keys:
            yield out(*_summed(np.concatenate(keys), np.concatenate(counts)))

    return count


def _identities(words: Words, lo: int, hi: int) -> np.ndarray:
    """Numbers of the words ``lo`` to ``hi``: equal if and only if their bytes are."""
    start, long = words.start[lo:hi], words.end[lo:hi] - words.start[lo:hi]
    origin = start[0]
    part = words.buffer[origin : words.end[hi - 1]]
    f = Fingerprints.power(len(part) + 1)
    prefix = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * f[0, : len(part)], out=prefix[1:])
    h = (prefix[start - origin + long] - prefix[start - origin]) * f[1, start - origin]
    _, pointer, number = np.unique(h, return_index=True, return_inverse=True)
    same = long == long[pointer[number]]
    # every byte of every word against the word that its pointer names, some words at a time
    every = np.flatnonzero(same)
    for told in (every[i : i + COMPARED] for i in range(0, len(every), COMPARED)):
        of = np.repeat(told, long[told])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(long[told]) - long[told], long[told])
        differs = words.buffer[start[of] + nth] != words.buffer[start[pointer[number[of]]] + nth]
        same[of[differs]] = False
    other = np.flatnonzero(~same)
    if len(other):
        names: dict[bytes, int] = {}
        for i in other.tolist():
            number[i] = len(pointer) + names.setdefault(words.buffer[start[i] : start[i] + long[i]].tobytes(), len(names))
    return number


def _verifier(shared, doc_type: pa.DataType):
    """A mapInArrow function: (lang, fp, phrase, words, n, doc_id, word) of the runs whose fingerprints may be frequent, by
    text; and for each language the number of its words, with a null phrase."""

    def verify(batches):
        frequent = Bitmap(shared.value)
        names = ["lang", "fp", "phrase", "words", "n", "doc_id", "word"]
        for words, seeds, rows in _slices(batches):
            lang, doc = rows.column("lang"), rows.column("doc_id")
            for lo, hi in words.windows():
                f = Fingerprints(words, lo, hi, seeds)
                top = lo + len(f.start)
                number = _identities(words, lo, top)
                paired = np.zeros(len(f.start), bool)
                first, long, keys, single = [], [], [], None
                for n in range(1, LONGEST + 1):
                    at = f.begins(n)
                    if n == 2:
                        at = at[single[at]]
                    for j in range(n - 1 if n > 2 else 0):
                        at = at[paired[at + j]]
                    key = f.of(at, n)
                    told = frequent.has(key)
                    if n == 1:
                        single = np.zeros(f.n, bool)
                        single[at[told]] = True
                    if n == 2:
                        # pairs that begin behind the window are for the next one to tell; here they pass
                        paired[f.n :] = True
                        paired[at[told]] = True
                    first.append(at[told])
                    keys.append(key[told])
                    long.append(np.full(told.sum(), n))
                first, long, keys = np.concatenate(first), np.concatenate(long), np.concatenate(keys)
                _, pointer, of = np.unique(keys, return_index=True, return_inverse=True)
                same = long == long[pointer[of]]
                same &= seeds[words.text[lo + first]] == seeds[words.text[lo + first[pointer[of]]]]
                for j in range(LONGEST):
                    here = same & (long > j)
                    same[here] = number[first[here] + j] == number[first[pointer[of[here]]] + j]
                other = np.flatnonzero(~same)
                if len(other):
                    # collisions: runs that differ from the text at their pointer are told apart by their words
                    texts: dict[tuple, int] = {}
                    more = []
                    for i in other.tolist():
                        run = (int(seeds[words.text[lo + first[i]]]), *number[first[i] : first[i] + long[i]].tolist())
                        if run not in texts:
                            texts[run] = len(pointer) + len(more)
                            more.append(i)
                        of[i] = texts[run]
                    pointer = np.concatenate([pointer, np.array(more, dtype=pointer.dtype)])
                n = np.bincount(of, minlength=len(pointer))
                a = words.start[lo + first[pointer]]
                b = words.end[lo + first[pointer] + long[pointer] - 1]
                whole = words.buffer.tobytes() if lo == 0 else whole
                phrases = [whole[x:y] for x, y in zip(a.tolist(), b.tolist())]
                text = pa.array(words.text[lo + first[pointer]])
                yield pa.record_batch(
                    [lang.take(text).cast(pa.string()), pa.array(keys[pointer].view(np.int64)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(long[pointer].astype(np.int32)), pa.array(n.astype(np.int64)),
                     doc.take(text).cast(doc_type), pa.array(words.ordinal[lo + first[pointer]].astype(np.int64))], names=names,
                )
            each = np.bincount(words.text, minlength=rows.num_rows)
            size = rows.num_rows
            yield pa.record_batch(
                [lang.cast(pa.string()), pa.array(np.zeros(size, np.int64)), pa.nulls(size, pa.string()), pa.array(np.zeros(size, np.int32)), pa.array(each.astype(np.int64)), pa.nulls(size, doc_type), pa.nulls(size, pa.int64())], names=names,
            )

    return verify


def _pairs_of(f: Fingerprints):
    for n in (1, 2):
        yield f.of(f.begins(n), n)


def _longer(shared):
    def found(f: Fingerprints):
        frequent = Bitmap(shared.value)
        at = f.begins(2)
        paired = np.zeros(len(f.start), bool)
        paired[f.n :] = True
        paired[at[frequent.has(f.of(at, 2))]] = True
        for n in range(3, LONGEST + 1):
            at = f.begins(n)
            for j in range(n - 1):
                at = at[paired[at + j]]
            yield f.of(at, n)

    return found


def frequent_phrases(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n, doc_id, word): runs of one to ``LONGEST`` words that occur ``least`` times in a language, how often,
    and where one occurrence is; a null phrase counts all words of the language."""
    sc = docs.sparkSession.sparkContext
    lang = F.coalesce("lang", F.lit("und"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("seed"))
    slim = rows.select("text", "seed")

    def frequent(found, name):
        fps = slim.mapInArrow(_counter(found), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
        fps = materialise(fps.where(F.col("n") >= least).select("fp"), name)
        return fps, fps.count()

    short, n = frequent(_pairs_of, "frequent-words")
    pairs = sc.broadcast(bitmap(short.where(F.col("fp").bitwiseAND(7) == 2), n))
    long, m = frequent(_longer(pairs), "frequent-runs")
    every = sc.broadcast(bitmap(short.union(long), n + m))
    doc_field = docs.select("doc_id").schema["doc_id"]
    told = rows.mapInArrow(_verifier(every, _arrow_type(docs)), f"lang string, fp long, phrase string, words int, n long, doc_id {doc_field.dataType.simpleString()}, word long")
    by_text = told.groupBy("lang", "fp", "phrase").agg(F.max("words").alias("words"), F.sum("n").alias("n"), F.min(F.struct("doc_id", "word")).alias("at"))
    return materialise(by_text.where(F.col("phrase").isNull() | (F.col("n") >= least)).select("lang", "phrase", "words", "n", "at.doc_id", "at.word"), "frequent-phrases")


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _part(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, subsumed: float = 1.0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, doc_id, word): the ``top`` phrases of each language.

    Candidates are phrases of two words or more that occur ``least`` times. A cut into a first part (l times) and a rest
    (r times) scores floor(1000 a n / (l r)); the lowest-scoring cut counts, of equal ones the one after fewer words.
    A candidate goes if a longer one that contains it occurs ``subsumed`` times as often or more. ``doc_id`` and ``word``
    are an occurrence.
    """
    found = frequent_phrases(docs, least)
    counts = found.where("phrase is not null").select("lang", "phrase", "words", F.col("n").alias("f"), "doc_id", "word")
    total = found.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    cut = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.col("phrase"), F.lit(1), F.col("k")).alias("first"), _part(F.col("phrase"), F.col("k") + 1, F.col("words")).alias("rest"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(total, "lang")
    # 38 digits hold 1000 a n and l r of any corpus below 10 ** 17 words
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    above = (exact("a") * exact("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = cut.withColumn("above", above).withColumn("below", exact("l") * exact("r")).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = candidates.where("words > 2").select(
        "lang", F.col("a").alias("f"), "words", F.col("phrase").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))).alias("s"),
    )
    inner = inner.select("lang", _part(F.col("longer"), F.col("s.i"), F.col("s.n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.lit(subsumed) * F.col("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", F.col("low.score").alias("score"))
    return best.join(candidates.select("lang", "phrase", "doc_id", "word"), ["lang", "phrase"])
