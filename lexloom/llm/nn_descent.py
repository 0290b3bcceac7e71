"""Near-duplicate embeddings by NN-descent.

Vectors are compared within a label and a width only. The neighbour graph starts from the best of a few
random-projection leaves. Each round joins neighbours of neighbours: every vector gathers its neighbours in both
directions, the gathered ones are compared with each other, and each keeps its ``k`` nearest. Rounds end when hardly any
link is added. A vector whose whole list lies above the threshold is saturated: it takes no more neighbours in rounds;
instead its list is enlarged to all that its links connect it to, and to other such groups that lie near enough to hold
a link, compared in blocks of ``BLOCK`` by ``BLOCK`` vectors, so that no list is cut short and no task holds a whole
group. Links are pairs of cosine at least ``threshold``, computed in double precision.

Recall is audited on the result: the final links of a fixed sample of vectors are held against their true ones, found
by comparing the sample with every vector. Below ``recall`` the graph is refined from more leaves and audited on another
sample; if that is not enough, all vectors of each label are compared, block by block, which is exact. The last measured
recall is returned with the rows.

Identical vectors of a label are one node that counts each copy. A node's number is a hash; should two different vectors
or labels ever share one, all are numbered anew by another.

Nulls: vectors that are null, empty, zero, or hold a null or a component that isn't finite link with nothing, nor do
vectors without a label. A null id is kept and is the smallest id of nothing. Vectors of different widths never link.
Of repeated ids each row is a vector. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import components, materialise

BLOCK = 2048
SALTS = 64
LEAF = 64
_SATURATED = 2.0  # no cosine reaches it


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, width) of an Arrow list column of equal widths."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither vanish nor overflow
    m = m / np.abs(m).max(axis=1, keepdims=True) if m.size else m
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _units(column: pa.Array, starts: np.ndarray, ends: np.ndarray):
    """Unit vectors of each run from ``starts`` to ``ends``; widths may differ between runs, not within one."""
    for a, b in zip(starts.tolist(), ends.tolist()):
        yield a, b, _unit(_matrix(column.slice(a, b - a)))


def _runs(batches, key: str):
    """Batches, sorted by ``key``, as batches that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        keys = batch[key].to_numpy()
        first = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if sum(b.num_rows for b in held) < 4096 or (first == 0 and len(held) > 0 and held[0][key][0].as_py() == keys[-1]):
            continue
        whole = pa.Table.from_batches([*held[:-1], batch.slice(0, first)]).combine_chunks()
        held = [batch.slice(first)]
        if whole.num_rows:
            yield whole.to_batches()[0]
    if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rows.to_batches()[0]


def prepared(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node or null; nodes: node, label, width, vector, copies)."""
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    vector = F.col("embedding").cast(kind)
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    label = F.col("label").cast("string")
    for seed in range(8):
        node = F.when(ok, F.xxhash64(F.lit(seed), label, vector))
        rows = embeddings.select("vec_id", label.alias("label"), F.when(ok, vector).alias("vector"), node.alias("node"))
        rows = materialise(rows, "vectors")
        nodes = rows.where("node is not null").groupBy("node", "label", "vector").agg(F.count("*").alias("copies"))
        nodes = materialise(nodes.withColumn("width", F.size("vector")), "nodes")
        every, numbers = nodes.agg(F.count("*"), F.count_distinct("node")).first()
        if every == numbers:
            return rows.select("vec_id", "node"), nodes
    raise RuntimeError("prepared: vectors share numbers under every hash")


def _leaves(nodes: DataFrame, tree: int, k: int, seed: int) -> DataFrame:
    """Edges (node, nbr, sim): the ``k`` nearest within leaves of ``LEAF`` vectors that stand together in one random order."""

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = batch["width"].to_numpy()
            out = np.zeros(batch.num_rows, np.int64)
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                m = _unit(_matrix(batch["vector"].take(pa.array(at))))
                random = np.random.default_rng(seed + tree)
                signs = m @ random.normal(size=(int(w), 20)) > 0
                out[at] = (signs * (1 << np.arange(20))).sum(axis=1)
            yield pa.record_batch([batch["node"], batch["label"], batch["width"], pa.array(out), batch["vector"]], names=["node", "label", "width", "code", "vector"])

    def nearest(batches):
        for batch in batches:
            label, width = batch["label"].to_pylist(), batch["width"].to_numpy()
            node = batch["node"].to_numpy()
            out: list = []
            a = 0
            while a < len(node):
                b = a + 1
                while b < len(node) and b - a < LEAF and label[b] == label[a] and width[b] == width[a]:
                    b += 1
                if b - a > 1:
                    m = _unit(_matrix(batch["vector"].slice(a, b - a)))
                    sim = m @ m.T
                    np.fill_diagonal(sim, -2)
                    n = min(k, b - a - 1)
                    top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                    rows = np.repeat(np.arange(b - a), n)
                    out.append((node[a:b][rows], node[a:b][top.ravel()], sim[rows, top.ravel()]))
                # leaves overlap by half
                a = b if b - a < LEAF else a + LEAF // 2
            if out:
                u, v, s = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(u), pa.array(v), pa.array(s)], names=["node", "nbr", "sim"])

    kind = nodes.schema["vector"].dataType.simpleString()
    coded = nodes.select("node", "label", "width", "vector").mapInArrow(code, f"node long, label string, width int, code long, vector {kind}")
    ordered = coded.repartitionByRange("label", "width", "code", "node").sortWithinPartitions("label", "width", "code", "node")
    return ordered.mapInArrow(nearest, "node long, nbr long, sim double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node, and whether they were there before. A node has no more than 2k * 2k candidates."""
    one = edges.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return one.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _joined(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Edges found by comparing the neighbours of each node with each other."""
    floor = graph.groupBy("node").agg(F.min("sim").alias("floor"), F.count("*").alias("n"))
    low = F.when(F.col("n") < k, F.lit(-2.0)).when(F.col("floor") >= threshold, F.lit(_SATURATED)).otherwise(F.col("floor"))
    floor = floor.select(F.col("node").alias("member"), low.alias("floor"))
    out = graph.select(F.col("node").alias("mid"), F.col("nbr").alias("member"), "old")
    # the nearest k that have the node in their lists; those further off meet elsewhere, and the audit sees to the rest
    back = graph.select(F.col("nbr").alias("mid"), F.col("node").alias("member"), "old", "sim")
    back = back.withColumn("r", F.row_number().over(W.partitionBy("mid").orderBy(F.desc("sim"), "member"))).where(F.col("r") <= k).select("mid", "member", "old")
    lists = out.union(back).groupBy("mid", "member").agg(F.min("old").alias("old")).join(floor, "member", "left")
    # only where someone is new and someone takes neighbours, before any vector is fetched
    own = W.partitionBy("mid")
    lists = lists.withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    lists = lists.withColumn("fresh", ~F.min("old").over(own) & (F.min("floor").over(own) < _SATURATED)).where("fresh").drop("fresh")
    lists = lists.join(nodes.select(F.col("node").alias("member"), "vector"), "member")

    def compare(batches):
        for rows in _runs(batches, "mid"):
            mid, member = rows["mid"].to_numpy(), rows["member"].to_numpy()
            old, low = rows["old"].to_numpy(zero_copy_only=False), rows["floor"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], mid[1:] != mid[:-1]]))
            found = []
            for a, b, m in _units(rows["vector"], starts, np.append(starts[1:], len(mid))):
                sim = m @ m.T
                # at least one of the two is new to the list, and the pair would enter a list
                fresh = ~(old[a:b, None] & old[None, a:b])
                i, j = np.nonzero(fresh & (sim > low[a:b, None] + 1e-12))
                ok = i != j
                found.append((member[a:b][i[ok]], member[a:b][j[ok]], sim[i[ok], j[ok]]))
            u, v, s = (np.concatenate(x) for x in zip(*found))
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(s)], names=["node", "nbr", "sim"])

    grouped = lists.select("mid", "member", "old", "floor", "vector").repartition("mid").sortWithinPartitions("mid", "member")
    return grouped.mapInArrow(compare, "node long, nbr long, sim double")


def neighbour_graph(nodes: DataFrame, threshold: float, k: int = 12, trees: int = 3, rounds: int = 6, change: float = 0.002, seed: int = 11, start: DataFrame | None = None) -> DataFrame:
    """(node, nbr, sim): approximate nearest neighbours, refined until hardly any new link comes up."""
    edges = None if start is None else start.select("node", "nbr", "sim")
    for t in range(trees):
        leaf = _leaves(nodes, t, k, seed)
        edges = leaf if edges is None else edges.union(leaf)
    graph = materialise(_best(edges.withColumn("old", F.lit(False)), k), "graph")
    count = lambda g: g.where(F.col("sim") >= threshold).count()
    before = count(graph)
    for _ in range(rounds):
        new = _joined(graph, nodes, k, threshold).withColumn("old", F.lit(False))
        graph = materialise(_best(graph.withColumn("old", F.lit(True)).union(new), k), "graph")
        now = count(graph)
        if now - before <= change * now:
            break
        before = now
    return graph


def _near_groups(member: DataFrame, nodes: DataFrame, threshold: float, k: int, trees: int = 3, seed: int = 23) -> DataFrame:
    """(a, b) with a < b: saturated groups that may hold a link between them.

    A group's smallest node stands for it, with the largest angle to a member. Two groups can only be linked if their
    representatives are no further apart than both angles and the threshold's; near ones are found in the same leaves.
    """
    own = member.join(nodes.select("node", "vector"), "node")
    # a group's members are spread over SALTS tasks, each with a copy of the centre
    own = own.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(SALTS)).cast("int"))
    groups = member.select(F.col("component").alias("node")).distinct()
    stand = materialise(nodes.join(groups, "node", "left_semi"), "centres")
    centre = stand.select(F.col("node").alias("component"), F.col("vector").alias("centre"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda t, z: t + z)
    cosine = product("vector", "centre") / F.sqrt(product("vector", "vector") * product("centre", "centre"))
    wide = own.join(centre, ["component", "salt"]).groupBy("component").agg(F.acos(F.least(F.greatest(F.min(cosine), F.lit(-1.0)), F.lit(1.0))).alias("angle"))
    wide = materialise(wide, "angles")
    edges = None
    for t in range(trees):
        leaf = _leaves(stand, t, k, seed)
        edges = leaf if edges is None else edges.union(leaf)
    left, right = wide.select(F.col("component").alias("node"), F.col("angle").alias("x")), wide.select(F.col("component").alias("nbr"), F.col("angle").alias("y"))
    apart = F.acos(F.least(F.greatest(F.col("sim"), F.lit(-1.0)), F.lit(1.0)))
    near = edges.join(left, "node").join(right, "nbr").where(F.isnan(F.col("x") + F.col("y")) | (apart <= F.col("x") + F.col("y") + float(np.arccos(threshold)) + 1e-6))
    return near.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()


def _compared(member: DataFrame, pairs: DataFrame | None, nodes: DataFrame, threshold: float) -> DataFrame:
    """For ``member`` (node, component, grp), all of each group, and of each of the ``pairs`` (a, b) of groups, compared
    once: rows (node, n, null), parts of a node's number of links, and rows (component, null, other) of components that
    a link joins."""
    # members are dealt to blocks by hash; larger groups have more and, up to BLOCK, larger ones
    sizes = member.groupBy("grp").agg(F.count("*").alias("m"))
    block = F.least(F.greatest(F.col("m") / 16, F.lit(float(LEAF))), F.lit(float(BLOCK)))
    sizes = materialise(sizes.select("grp", F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int").alias("blocks")), "sizes")
    sides = sizes.select("grp", F.col("grp").alias("other"), F.col("blocks").alias("others"), F.lit(0).alias("side"))
    if pairs is not None:
        size_of = lambda g, n: sizes.select(F.col("grp").alias(g), F.col("blocks").alias(n))
        both = pairs.join(size_of("a", "blocks_a"), "a").join(size_of("b", "blocks_b"), "b")
        sides = sides.union(both.select("a", "b", "blocks_b", F.lit(1))).union(both.select("b", "a", "blocks_a", F.lit(2)))
    placed = member.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = placed.join(sides, "grp").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    # the blocks of a task: of a group with itself the lower first, of two groups that of the lower group first
    own = F.col("side") == 0
    first = F.when(own, F.col("block") <= F.col("o")).otherwise(F.col("side") == 1)
    i, j = F.when(first, F.col("block")).otherwise(F.col("o")), F.when(first, F.col("o")).otherwise(F.col("block"))
    low, high = F.when(F.col("side") == 2, F.col("other")).otherwise(F.col("grp")), F.when(F.col("side") == 2, F.col("grp")).otherwise(F.col("other"))
    dealt = dealt.select(F.xxhash64(low, high, i, j).alias("task"), "node", "component", first.alias("first"), (own & (F.col("block") == F.col("o"))).alias("same"))
    dealt = dealt.join(nodes.select("node", "vector", "copies"), "node")

    def compare(batches):
        for rows in _runs(batches, "task"):
            task, node, copies, component = (rows[c].to_numpy() for c in ("task", "node", "copies", "component"))
            first, same = rows["first"].to_numpy(zero_copy_only=False), rows["same"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            names, counts, joins = [], [], []
            for a, b, m in _units(rows["vector"], starts, np.append(starts[1:], len(task))):
                x = np.arange(b - a) if same[a] else np.flatnonzero(first[a:b])
                y = x if same[a] else np.flatnonzero(~first[a:b])
                if not len(x) or not len(y):
                    continue
                hit = m[x] @ m[y].T >= threshold
                if same[a]:
                    np.fill_diagonal(hit, False)
                names.append(node[a + x])
                counts.append(hit @ copies[a + y])
                if not same[a]:
                    names.append(node[a + y])
                    counts.append(hit.T @ copies[a + x])
                if (component[a:b] != component[a]).any():
                    i, j = np.nonzero(hit & (component[a + x][:, None] != component[a + y][None, :]))
                    joins.append(np.unique(np.stack([component[a + x][i], component[a + y][j]]), axis=1))
            u, n = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (names, counts))
            linked = np.hstack(joins) if joins else np.empty((2, 0), np.int64)
            nothing = pa.nulls(linked.shape[1], pa.int64())
            yield pa.record_batch(
                [pa.array(np.concatenate([u, linked[0]])), pa.concat_arrays([pa.array(n.astype(np.int64)), nothing]), pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(linked[1])])],
                names=["node", "n", "other"],
            )

    grouped = dealt.repartition("task").sortWithinPartitions("task", "node")
    return materialise(grouped.mapInArrow(compare, "node long, n long, other long"), "compared")


def _merged(member: DataFrame, found: DataFrame) -> DataFrame:
    """``member`` (node, component) with the components that ``found`` joins as one."""
    joins = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if joins.isEmpty():
        return member
    merged = components(joins, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return member.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))


def _counted(nodes: DataFrame, member: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, component, copies, n_links) of every node."""
    every = nodes.select("node", "copies").join(member, "node", "left").join(counts, "node", "left")
    linked = every.select("node", F.coalesce("component", "node").alias("component"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return materialise(linked, "linked")


def _linked(graph: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Links and components by the graph, saturated lists enlarged."""
    link = graph.where(F.col("sim") >= threshold)
    both = link.select("node", "nbr").union(link.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
    both = materialise(both, "links")
    member = materialise(components(both, "node", "nbr"), "groups")
    full = link.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node")
    wide = member.join(full, "node", "left_semi").select("component").distinct()
    narrow = member.join(wide, "component", "left_anti").select("node")
    counts = both.join(narrow, "node", "left_semi").join(nodes.select(F.col("node").alias("nbr"), "copies"), "nbr").groupBy("node").agg(F.sum("copies").alias("n"))
    saturated = materialise(member.join(wide, "component", "left_semi").withColumn("grp", F.col("component")), "saturated")
    if not saturated.isEmpty():
        found = _compared(saturated, _near_groups(saturated, nodes, threshold, k), nodes, threshold)
        more = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
        counts = counts.union(more).groupBy("node").agg(F.sum("n").alias("n"))
        member = _merged(member, found)
    return _counted(nodes, member, counts)


def _exact(linked: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``linked`` by comparing all vectors of each label and width with each other, block by block."""
    grp = F.xxhash64("label", "width", F.lit(7)).alias("grp")
    member = materialise(linked.select("node", "component").join(nodes.select("node", grp), "node"), "all")
    found = _compared(member, None, nodes, threshold)
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    return _counted(nodes, _merged(member.select("node", "component"), found), counts)


def audit(linked: DataFrame, nodes: DataFrame, threshold: float, sample: int = 256, seed: int = 2) -> float:
    """Share of the true links of a sample, the smallest hashes, that the result has: of all their links, or on average of
    a vector's own, whichever is less, so that a large group doesn't hide what small ones lose. A vector in another component
    than one that it links with counts as a link missed. The sample is sent to every task and compared with every vector."""
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(sample).select("node", "label", "width", "vector").collect()
    if not chosen:
        return 1.0
    asked: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(q["label"], q["width"]) for q in chosen}:
        own = [q for q in chosen if (q["label"], q["width"]) == key]
        asked[key] = (np.array([q["node"] for q in own]), _unit(np.array([q["vector"] for q in own], dtype=np.float64)))

    def links(batches):
        for batch in batches:
            label, width, node = np.array(batch["label"].to_pylist(), dtype=object), batch["width"].to_numpy(), batch["node"].to_numpy()
            u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for (name, n), (ids, q) in asked.items():
                at = np.flatnonzero((label == name) & (width == n))
                if len(at):
                    hit = q @ _unit(_matrix(batch["vector"].take(pa.array(at)))).T >= threshold
                    i, j = np.nonzero(hit & (ids[:, None] != node[at][None, :]))
                    u.append(ids[i])
                    v.append(node[at[j]])
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["node", "nbr"])

    true = nodes.select("node", "label", "width", "vector").mapInArrow(links, "node long, nbr long")
    other = linked.select(F.col("node").alias("nbr"), F.col("component").alias("other"), F.col("copies").alias("weight"))
    own = linked.select("node", "component", (F.col("n_links") - F.col("copies") + 1).alias("n"))
    seen = true.join(other, "nbr").join(own.select("node", "component"), "node")
    seen = seen.groupBy("node").agg(F.sum("weight").alias("true"), F.count_if(F.col("other") != F.col("component")).alias("apart")).join(own.select("node", "n"), "node")
    had = F.least("n", "true") - F.least("apart", F.least("n", "true"))
    got, every, own_share = seen.agg(F.sum(had), F.sum("true"), F.avg(had / F.col("true"))).first()
    return min(got / every, own_share) if every else 1.0


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, k: int = 12, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall of every row."""
    rows, nodes = prepared(embeddings)
    graph = neighbour_graph(nodes, threshold, k)
    linked = _linked(graph, nodes, threshold, k)
    reached = audit(linked, nodes, threshold)
    if reached < recall:
        graph = neighbour_graph(nodes, threshold, k, trees=8, seed=101, start=graph)
        linked = _linked(graph, nodes, threshold, k)
        reached = min(audit(linked, nodes, threshold), audit(linked, nodes, threshold, seed=3))
    if reached < recall:
        linked, reached = _exact(linked, nodes, threshold), 1.0
    first = rows.join(linked.select("node", "component"), "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_node = linked.join(first, "component").select("node", "n_links", "component_id")
    joined = rows.join(by_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept, F.lit(reached).alias("audited_recall"))
