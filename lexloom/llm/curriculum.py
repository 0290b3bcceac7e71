"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, piecewise linear between knots. Its integral gives
the source's cumulative token demand; the inverse of that demand turns the place of a document in its source's
token order into a training position, and documents are range-sorted by position.

Nulls: a null source is a source of its own and sorts last; a null text has size 0. Empty texts have size 0 and take
nothing. Repeated rows are rows of their own. Ties in the token order (equal ids) are broken by size, then by a hash of
the whole row; what is still equal is the same row twice. Extra columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import WORD, materialise, prefix_sum, row_hashes, rows_per_bucket

#: Knots (time, weight) of the default schedules, dealt to the sources in turn: rising, level and falling.
SCHEDULES = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(key, source_size, target, place) of each source.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all sizes. A target
    stops at ``max_epochs`` times its source's size; what is over goes to the others by weight. That has a closed
    form: with sources sorted by size/weight, the level is the largest of (rest of the demand)/(rest of the weights).
    The window runs over one row per source.
    """
    one = W.partitionBy(F.lit(0))
    by_name = sizes.groupBy("__null", "__source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = by_name.withColumn("place", F.row_number().over(one.orderBy("__null", "__source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    steps = one.orderBy(F.col("__cap") / F.col("__w"), "place")
    rest = F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(
        F.sum("__cap").over(steps.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
    )
    level = rest / F.sum("__w").over(steps.rowsBetween(0, W.unboundedFollowing))
    leveled = ranked.withColumn("__level", level)
    target = F.least("__cap", F.max("__level").over(one) * F.col("__w"))
    return leveled.select("__null", "__source", "source_size", "place", target.alias("target"))


def _segments(knots: tuple[tuple[float, float], ...]) -> Column:
    """A schedule as rows (demand before, time, weight, slope), demand scaled to end at 1."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
    done, rows = 0.0, []
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        rows.append((done, t0, a / area, (b - a) / area / (t1 - t0)))
        done += (t1 - t0) * (a + b) / 2 / area
    names = ("y", "t", "w", "slope")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(r, names)]) for r in rows])


def invert_demand(y: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which the schedule's share ``y`` (0 to 1) of a source's tokens has been asked for."""
    found = F.lit(None)
    for i, knots in enumerate(schedules):
        last = F.element_at(F.filter(_segments(knots), lambda s: s["y"] <= y), -1)
        dy = y - last["y"]
        t = last["t"] + 2 * dy / (last["w"] + F.sqrt(F.greatest(last["w"] * last["w"] + 2 * last["slope"] * dy, F.lit(0.0))))
        found = F.when(place % len(schedules) == i, t).otherwise(found)
    return F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0))


def curriculum(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    schedules=SCHEDULES,
    least_per_bucket: int = 2048,
    keep: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, positions (one for each time the mix takes the document), and, if ``keep``,
    the whole row of the input as a struct ``document``.

    Documents of a source stand in the order of md5(doc_id). Pass ``e`` takes a document if the middle of its words
    lies before the source's target, so a source's words miss the target by half a document at most.
    """
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        F.col("source").isNull().alias("__null"),
        name.alias("__source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__h"),
        F.struct(F.col("doc_id").isNull(), *(row_hashes(docs) if keep else ())).alias("__tie"),
        *([F.struct("*").alias("document")] if keep else []),
    )
    sizes = materialise(slim.drop("document", *(["__tie"] if keep else [])), "sizes")
    slim = slim if keep else sizes
    n = sizes.count()
    digits = max(2, math.ceil(math.log(max(n, 1) / rows_per_bucket(n, least_per_bucket) + 1, 16)))
    slim = slim.withColumn("__bucket", F.substring("__h", 1, digits))
    sources = materialise(source_targets(sizes, weights, share, max_epochs), "targets")
    placed = prefix_sum(slim, ["__null", "__source"], "__bucket", ["__h", "size", "__tie"], "size", "__before")
    placed = placed.join(sources, ["__null", "__source"])
    middle = F.col("__before") + F.col("size") / 2.0
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: middle + e * F.col("source_size"))
    taken = F.filter(passes, lambda x: (x < F.col("target")) & (F.col("size") > 0))
    at = F.transform(taken, lambda x: invert_demand(x / F.col("target"), F.col("place"), schedules))
    return placed.select("doc_id", "size", "source_size", "target", at.alias("positions"), *(["document"] if keep else []))


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each taking of a document, range-partitioned and sorted by training position."""
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions")
    ranged = rows.repartitionByRange(partitions, "position", "doc_id") if partitions else rows.repartitionByRange("position", "doc_id")
    return ranged.sortWithinPartitions("position", "doc_id")
