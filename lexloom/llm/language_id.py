"""Language identification by cross-parsing entropy.

The suffix automaton of a bounded sample of labelled text per language reads a document in longest phrases that occur
in the sample. A phrase of a sample of ``n`` symbols costs log2(n) bits, so the language that needs the fewest phrases,
normalised by that cost, describes the document best. Ties go to the language with more labelled documents, then to the
first by name.

Symbols are the letters of a language's own sample, whatever its alphabet, one for all that is no letter, and one that
occurs nowhere for letters that the sample lacks. Every symbol of a text is read, and phrases run on to the end of the
text: blocks of ``BLOCK`` symbols are read side by side by numpy, each from a guessed place, and again from the place
where the phrase before it really ended, until no place changes. A text whose places don't settle in ``ROUNDS`` is read
on from there symbol by symbol.

Sample: whole texts of ``docs_per_language`` labelled documents at most, one per hash bucket, in order of bucket while
they come to ``chars_per_language`` characters; passages of the first text if that alone is longer. Documents of up to ``longest`` characters are preferred, then the
shortest. The model grows with the number of languages, which is that of the labels in use, not with the corpus.

Whether the best language describes a text at all is told by its cost: a text is ``told`` unless the cost is above that
of writing its symbols one by one (log2 of the symbols in the language's sample) plus ``MARGIN`` bits a symbol and
``SPARE`` phrases, without which a text is too short to judge.

Nulls: texts that are null, empty or without a letter are ``und`` with score 0. With no labelled text at all every text
is ``und``. Repeated rows have equal results. Extra columns are ignored; rows with a null label or id teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import held_out

BLOCK = 256
ROUNDS = 6
MARGIN = 1.0
SPARE = 2
DENSE = 8_000_000  # entries of an automaton laid out as a whole table
_STRANGER, _BLANK = 0, 1
#: Passages of a text that is too long to learn from whole.
PASSAGES = 64
UNDETERMINED = "und"


class Parser:
    """The automaton of one sample as a lookup (state, symbol) -> 2 * next state + (1 where a phrase begins).

    From the initial state, and wherever the sample has no such continuation, a phrase begins; a symbol that the sample
    lacks is a phrase by itself. Small alphabets are one dense table, large ones a sorted list of edges.
    """

    def __init__(self, symbols: list[int], width: int, dense: int = DENSE):
        move, _ = suffix_automaton(symbols)
        self.width, self.bits = width, float(np.log2(len(symbols) + 2))
        self.first = np.ones(width, np.int64)  # by symbol, where a phrase begins with it
        for c, to in move[0].items():
            self.first[c] = 2 * to + 1
        key = np.array([s * width + c for s, edges in enumerate(move) if s for c in edges], np.int64)
        to = np.array([2 * t for s, edges in enumerate(move) if s for t in edges.values()], np.int64)
        self.table = self.key = self.to = None
        if len(move) * width <= dense:
            self.table = np.tile(self.first, len(move)).astype(np.int32)
            self.table[key] = to
        else:
            order = np.argsort(key)
            self.key, self.to = key[order], to[order]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = state * self.width + symbol
        if self.table is not None:
            return self.table.take(at)
        near = np.minimum(np.searchsorted(self.key, at), len(self.key) - 1) if len(self.key) else None
        first = self.first.take(symbol)
        return first if near is None else np.where(self.key[near] == at, self.to[near], first)

    def count_on(self, symbols: np.ndarray) -> int:
        """Phrases of symbols read one by one from the initial state."""
        state, phrases, one = np.zeros(1, np.int64), 0, np.zeros(1, np.int64)
        if self.table is not None:
            table, width, now = memoryview(self.table), self.width, 0
            for c in symbols.tolist():
                found = table[now * width + c]
                phrases += found & 1
                now = found >> 1
            return phrases
        for c in symbols.tolist():
            one[0] = c
            found = self.step(state, one)
            phrases, state = phrases + int(found[0] & 1), found >> 1
        return phrases


@dataclass
class LanguageModel:
    languages: list[str]
    letter: np.ndarray  # whether a code point is a letter
    known: np.ndarray  # code points to the letters of all samples; _STRANGER, _BLANK for no letter
    own: list[np.ndarray]  # by language, from those to its symbols
    parsers: list[Parser]
    bits: np.ndarray  # of a phrase, by language
    plain: np.ndarray  # bits of a symbol written by itself, by language


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and longest lengths of the minimal automaton of all substrings."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return move, length


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def train(samples: dict[str, tuple[str, int]], dense: int = DENSE) -> LanguageModel:
    """``samples``: language to (text, number of labelled documents)."""
    languages = sorted(samples, key=lambda k: (-samples[k][1], k))
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    texts = {k: _code_points(samples[k][0]) for k in languages}
    seen = np.zeros(0x110000, bool)
    for t in texts.values():
        seen[t] = True
    letters = np.flatnonzero(seen & letter)
    known = np.where(letter, _STRANGER, _BLANK).astype(np.int32)
    known[letters] = np.arange(2, 2 + len(letters))
    own, parsers, plain = [], [], []
    for k in languages:
        mine = np.unique(known[texts[k]])
        mine = mine[mine > _BLANK]
        to = np.zeros(2 + len(letters), np.int32)
        to[_BLANK], to[mine] = _BLANK, np.arange(2, 2 + len(mine))
        symbols = to[known[texts[k]]].tolist()
        own.append(to)
        parsers.append(Parser(symbols, 2 + len(mine), dense))
        plain.append(np.log2(len(set(symbols)) + 1))
    return LanguageModel(languages, letter, known, own, parsers, np.array([p.bits for p in parsers]), np.array(plain))


def _read(parser: Parser, flat: np.ndarray, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases that begin from ``entry`` on and before ``end``, place where the first after them begins) of each lane of
    ``flat``, where every text is followed by a stranger, at which a phrase begins in any case."""
    phrases, exit_at = np.zeros(len(entry), np.int64), np.empty(len(entry), np.int64)
    lane, at, stop, state, n = np.arange(len(entry)), entry.copy(), end, np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
    safe = int((end - entry).min(initial=0))
    while len(lane):
        found = parser.step(state, flat.take(at))
        begins = found & 1
        if safe <= 0:
            done = (begins == 1) & (at >= stop)
            if done.any():
                exit_at[lane[done]], phrases[lane[done]] = at[done], n[done]
                going = ~done
                lane, at, stop, n, found, begins = lane[going], at[going], stop[going], n[going], found[going], begins[going]
        safe -= 1
        n += begins
        state = found >> 1
        at += 1
    return phrases, exit_at


def phrase_counts(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases by text and language, whether a text has a letter)."""
    points = [_code_points(t or "") for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    has_letter = np.array([bool(model.letter[p].any()) for p in points], bool)
    known = np.concatenate([x for p in points for x in (model.known[p], np.array([_STRANGER], np.int32))]) if points else np.empty(0, np.int32)
    begin = np.cumsum(sizes + 1) - sizes - 1
    lanes = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), lanes)
    start = begin[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    end = np.minimum(start + BLOCK, (begin + sizes)[owner])
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # lanes that go on from the one before
    counts = np.zeros((len(texts), len(model.languages)))
    for k, parser in enumerate(model.parsers):
        flat = model.own[k].take(known)
        entry, again = start.copy(), np.arange(len(start))
        phrases, exit_at = np.zeros(len(start), np.int64), end.copy()
        for _ in range(ROUNDS):
            phrases[again], exit_at[again] = _read(parser, flat, np.minimum(entry[again], end[again]), end[again])
            # a phrase that runs through a whole block leaves nothing to begin in it
            exit_at[again] = np.maximum(exit_at[again], entry[again])
            moved = follows[entry[follows] != exit_at[follows - 1]]
            entry[moved] = exit_at[moved - 1]
            again = moved
            if not len(again):
                break
        if len(again):  # from the first unsettled lane of a text on
            for lane in again[np.unique(owner[again], return_index=True)[1]]:
                i = owner[lane]
                last = begin[i] + sizes[i]
                rest = (owner == i) & (np.arange(len(owner)) >= lane)
                phrases[rest] = 0
                phrases[lane] = parser.count_on(flat[entry[lane] : last])
        counts[:, k] = np.bincount(owner, phrases, minlength=len(texts))
    return counts, has_letter


def _chunks(texts: list[str | None], chunk_chars: int):
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end] or "") <= chunk_chars):
            chars += len(texts[end] or "")
            end += 1
        yield texts[start:end]
        start = end


def told(model: LanguageModel, texts: list[str | None], chunk_chars: int = 2_000_000) -> np.ndarray:
    """Whether each text has a letter and is described by its best language."""
    out = []
    for chunk in _chunks(texts, chunk_chars):
        counts, has_letter = phrase_counts(model, chunk)
        size = np.array([len((t or "").lower()) for t in chunk])
        cost = counts * model.bits
        best, row = cost.argmin(axis=1), np.arange(len(chunk))
        most = size * (model.plain[best] + MARGIN) + SPARE * model.bits[best]
        out.append(has_letter & (cost[row, best] <= most))
    return np.concatenate(out) if out else np.empty(0, bool)


def decide(model: LanguageModel, texts: list[str | None], chunk_chars: int = 2_000_000) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is 1 - 2^(-gap / 8) / 2, where ``gap`` is by how many bits the next
    best language costs more than the best: 0.5 for a tie, towards 1 as the gap grows; 1 if there is one language."""
    names, scores = [], []
    for chunk in _chunks(texts, chunk_chars):
        counts, has_letter = phrase_counts(model, chunk)
        cost = counts * model.bits
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(cost)), best]
        others = cost.copy()
        others[np.arange(len(cost)), best] = np.inf
        gap = np.minimum(others.min(axis=1) - least, 1e6)
        score = 1 - 0.5 * np.exp2(-gap / 8) if len(model.languages) > 1 else np.ones(len(cost))
        names += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter)]
        scores.append(np.where(has_letter, score, 0.0))
    return names, np.concatenate(scores) if scores else np.empty(0)


def samples(docs: DataFrame, docs_per_language: int = 128, chars_per_language: int = 64_000, longest: int = 1_000) -> dict[str, tuple[str, int]]:
    """Language to (sample, number of labelled documents), of those that aren't held out; rows without an id are in neither
    part and teach nothing. The driver gets, for each language, the ids of ``docs_per_language`` documents and
    ``chars_per_language`` characters of whole texts. Where even the first text exceeds that, it is learned by
    ``PASSAGES`` passages, as far apart as they can be."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = F.length("text")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(docs_per_language))
    place = F.struct((n > longest).alias("long"), F.when(n > longest, n).alias("n"), F.col("doc_id"))
    chosen = learn.groupBy("lang", bucket.alias("b")).agg(F.min(place).alias("p"), F.min_by(n, place).alias("chars"), F.count("*").alias("n")).collect()  # no text yet
    taken, labelled, chars = [], {}, {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["p"]["long"], r["p"]["n"] or 0, r["b"])):
        k = r["lang"]
        labelled[k] = labelled.get(k, 0) + r["n"]
        if k not in chars or chars[k] + r["chars"] <= chars_per_language:
            chars[k] = chars.get(k, 0) + min(r["chars"], chars_per_language)
            taken.append((r["p"]["doc_id"], k))
    if not taken:
        return {}
    ids = docs.sparkSession.createDataFrame(taken, docs.select("doc_id", "lang").schema)
    long = max(1, chars_per_language // PASSAGES - 1)  # a line feed stands between passages
    spread = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substring(F.col("text"), (F.lit(1) + i * F.floor((n - long) / (PASSAGES - 1))).cast("int"), F.lit(long)))
    bounded = F.when(n <= chars_per_language, F.col("text")).otherwise(F.array_join(spread, "\n"))
    chosen = learn.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", n.alias("n"), bounded.alias("text"))
    rows = chosen.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct("n", "text")).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: ("\n".join(t), labelled[k]) for k, t in texts.items()}


def fit(docs: DataFrame, **bounds) -> LanguageModel | None:
    """Learn from ``samples``; None without any."""
    found = samples(docs, **bounds)
    return train(found) if found else None


def identify(text: Column, model: LanguageModel | None, spark) -> Column:
    """Struct column (lang_pred, score) of each text."""
    shared = spark.sparkContext.broadcast(model)  # an automaton for each language, each bounded by chars_per_language

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0})
        names, scores = decide(shared.value, texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return language(text)


def is_told(text: Column, model: LanguageModel, spark) -> Column:
    """Boolean column: ``told`` of each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series(told(shared.value, texts.tolist()))

    return described(text)
