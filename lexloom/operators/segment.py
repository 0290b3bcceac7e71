"""Segmentation of running text by a word table, for scripts that write no blanks and for users' own terms.

The words of the table that occur in a run of letters form a lattice; the best path through it has the greatest sum of the
logarithms of its words' shares of all frequencies. A letter that no word covers is a word of frequency 1. Of paths of
equal worth (to nine digits) the one with the longer last word is taken, and so on towards the beginning.

Null and empty texts have no words. Of repeated words of the table the greatest frequency counts; null and empty words
and frequencies below 1 are left out.
"""

from __future__ import annotations

import math
import re
from array import array

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that the table may have: it is broadcast, since a path may need any of them.
MOST_WORDS = 2_000_000
#: Nine digits decide, whatever order logarithms were summed in.
TIE = 1e-9


def best_path(run: str, automaton, unknown: float) -> list[str]:
    """Words of ``run``. ``automaton`` yields (place of the last letter, (length, worth)) in order of that place."""
    score = array("d", [0.0]) * (len(run) + 1)
    taken = array("i", [0]) * (len(run) + 1)
    reached = 0

    def extend(upto: int) -> None:
        for j in range(reached + 1, upto + 1):
            if not taken[j]:
                score[j], taken[j] = score[j - 1] + unknown, 1

    for last, (length, worth) in automaton.iter(run):
        end = last + 1
        if end > reached:
            # all words that end before are known by now
            extend(end - 1)
            reached = end - 1
            score[end], taken[end] = score[end - 1] + unknown, 1
            reached = end
        begin = end - length
        found = score[begin] + worth
        if found > score[end] + TIE or (found >= score[end] - TIE and length > taken[end]):
            score[end], taken[end] = found, length
    extend(len(run))
    words, j = [], len(run)
    while j:
        words.append(run[j - taken[j] : j])
        j -= taken[j]
    return words[::-1]


class Segmenter:
    """Built once a process from the broadcast words."""

    _built: dict = {}

    def __init__(self, words: dict[str, int], pattern: str):
        total = sum(words.values()) or 1
        self.runs, self.unknown = re.compile(pattern), -math.log(total)
        self.automaton = ahocorasick.Automaton()
        for w, n in words.items():
            self.automaton.add_word(w, (len(w), math.log(n / total)))
        if words:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, name: str, shared, pattern: str) -> Segmenter:
        if name not in cls._built:
            cls._built.clear()
            cls._built[name] = cls(shared.value, pattern)
        return cls._built[name]

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        for m in self.runs.finditer(text or ""):
            out += best_path(m.group(), self.automaton, self.unknown) if len(self.automaton) else list(m.group())
        return out


def segmenter(words: DataFrame, pattern: str = "[一-龥]+"):
    """A function from a text column to an array of its words, by the table ``words`` (word, frequency)."""
    import uuid

    known = words.where("word <> '' and frequency >= 1").groupBy("word").agg(F.max("frequency").cast("long").alias("n"))
    count = known.count()
    if count > MOST_WORDS:
        raise ValueError(f"a table of {count} words is too large; {MOST_WORDS} are the most")
    shared = words.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in known.orderBy("word").collect()})
    name = uuid.uuid4().hex

    def segment(text: Column) -> Column:
        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            own = Segmenter.of(name, shared, pattern)
            return pd.Series([own.words(t) for t in texts])

        return cut(text)

    return segment
