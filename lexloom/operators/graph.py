"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of one task as stars: each node that is not its component's smallest, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def components(links: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; nodes without a link don't appear.

    Alternates large-star and small-star steps, each a partial minimum and a join on the node, until the links
    stay the same. Every round is written to the shared folder. Hot nodes are split by AQE's skew join.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, "links")
    seen = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u")
        small = kept.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(kept.select("u", F.col("m").alias("v")))
        before, pairs = pairs, materialise(small.where("u <> v").distinct(), "links")
        discard(before)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                pairs.select("v", "v").distinct()
            )
        seen = now
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
