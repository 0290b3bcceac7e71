"""A stored inverted index for keyword search by BM25.

Postings are written once for each batch of documents, by term and shard of documents, in blocks of at most ``BLOCK``, those
that can score most first. A block tells its largest frequency and its shortest document, which bound what any of its
postings can score whatever the collection has grown to. A search

1. scores all queries in one shard of documents; a query's ``k``-th best there is the goal that a document has to reach;
2. opens the blocks of the queries' terms shard by shard, each once for all queries. A query passes over a shard in which its terms
   can't reach its goal together, or the ``k``-th best that the task has found for it so far;
3. hands on each task's best ``k`` of each query, so that no pair of a query and a document is stored.

A task holds the postings of one shard's documents in the queries' terms; ``shards`` is chosen with the size of the collection.
The result is that of ``vectors.bm25`` over all documents of all batches. A null text has no term; a document without
terms has length 0 and counts. Ties go to the smaller id. Document ids are of any type that can be sorted and stand in
one batch only; a batch that is written again replaces itself.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ..sources.scratch import materialise
from . import vectors as V

#: Postings of a block, folders that terms are dealt to, and shards of documents.
BLOCK, BUCKETS, SHARDS = 512, 64, 256
K1, B = 1.2, 0.75
#: Scores are rounded to six digits; a block that may come that near is opened.
SLACK = 2e-6


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    spark: SparkSession
    path: str
    pattern: str = r"[\p{L}\p{N}]+"
    shards: int = SHARDS

    def add(self, documents: DataFrame, batch: str) -> None:
        """Index ``documents`` (document_id, text) as ``batch``. The count of its documents is written last."""
        kind = documents.schema["document_id"].dataType.simpleString()
        # a document's words are counted where they are read; the empty term stands once in each and brings its length
        docs = documents.select("document_id", V.terms_of(F.col("text"), self.pattern).alias("terms"))
        counted = materialise(docs.mapInArrow(_counted, f"document_id {kind}, length int, term string, tf int"), "terms")
        rows, docs = counted.where("term <> ''"), counted.where("term = ''")
        # ranges and not hashes of terms: one that stands in every document is dealt to many tasks
        order = (F.col("bucket"), F.col("term"), F.col("shard"), F.desc("tf"), F.col("length"), F.col("document_id"))
        ordered = rows.withColumn("bucket", _bucket(F.col("term"))).withColumn("shard", F.pmod(F.xxhash64("document_id"), F.lit(self.shards)).cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
        schema = f"bucket int, term string, shard int, documents array<{kind}>, tfs array<int>, lengths array<int>, n int, max_tf int, min_length int"
        blocks = ordered.select("bucket", "term", "shard", "document_id", "tf", "length").mapInArrow(_blocks, schema)
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def postings(self) -> DataFrame:
        """Blocks of the batches that were written to the end."""
        whole = self.spark.read.parquet(f"{self.path}/batches").select("batch")
        return self.spark.read.parquet(f"{self.path}/postings").join(F.broadcast(whole), "batch", "left_semi")  # a row for each batch

    def size(self) -> tuple[int, float]:
        """Number of documents and their average length."""
        n, length = self.spark.read.parquet(f"{self.path}/batches").agg(F.sum("documents"), F.sum("length")).first()
        return n, length / max(n, 1)


def _blocks(batches):
    """Sorted postings to blocks of one term and shard; a block that a batch leaves open goes on in the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= 50 * BLOCK:
            yield from _cut(held, False)
            held = held.slice(_open_from(held))
    if held is not None and held.num_rows:
        yield from _cut(held, True)


def _counted(batches):
    for batch in batches:
        lists = batch["terms"]
        length = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        n = max(len(coded.dictionary), 1)
        pairs, tf = np.unique(np.repeat(np.arange(len(length)), length) * n + coded.indices.to_numpy(), return_counts=True)
        for at, term, count in ((pairs // n, coded.dictionary.take(pa.array(pairs % n)), tf), (np.arange(len(length)), pa.array([""] * len(length), pa.string()), np.zeros(len(length)))):
            yield pa.record_batch([batch["document_id"].take(pa.array(at)), pa.array(length[at], pa.int32()), term, pa.array(count.astype(np.int32))], names=["document_id", "length", "term", "tf"])


def _edges(table: pa.Table) -> list[int]:
    terms, shards = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(), table["shard"].to_numpy()
    at = np.arange(len(shards))
    begins = np.concatenate([[True], (shards[1:] != shards[:-1]) | (terms[1:] != terms[:-1])])
    return np.flatnonzero((at - np.maximum.accumulate(np.where(begins, at, 0))) % BLOCK == 0).tolist()


def _open_from(table: pa.Table) -> int:
    return _edges(table)[-1]


def _cut(table: pa.Table, last: bool):
    edges = _edges(table)
    ends = [*edges[1:], table.num_rows] if last else edges[1:]
    if not ends:
        return
    offsets = pa.array([0, *ends], pa.int32())
    whole = table.slice(0, ends[-1]).combine_chunks()
    column = lambda c: whole[c].combine_chunks() if isinstance(whole[c], pa.ChunkedArray) else whole[c]
    lists = [pa.ListArray.from_arrays(offsets, column(c)) for c in ("document_id", "tf", "length")]
    firsts = pa.array([0, *ends[:-1]])
    tfs, lengths = column("tf").to_numpy(), column("length").to_numpy()
    yield pa.record_batch(
        [column("bucket").take(firsts), column("term").take(firsts), column("shard").take(firsts), *lists, pa.array(np.diff(offsets), pa.int32()), pa.array(np.maximum.reduceat(tfs, firsts), pa.int32()), pa.array(np.minimum.reduceat(lengths, firsts), pa.int32())],
        names=["bucket", "term", "shard", "documents", "tfs", "lengths", "n", "max_tf", "min_length"],
    )


def _gains(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (average or 1.0)))


def _small(df: DataFrame) -> DataFrame:
    """Terms of queries are broadcast while they are few."""
    return F.broadcast(df) if df.count() <= V.BROADCAST_TERMS else df


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    return materialise(queries.select("query_id", F.explode(F.array_distinct(V.terms_of(F.col("text"), index.pattern))).alias("term")), "asked")


def _stored(index: Index, terms: DataFrame) -> DataFrame:
    """Blocks of ``terms`` (term)."""
    buckets = [r[0] for r in terms.select(_bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
    return index.postings().where(F.col("bucket").isin(buckets)).join(_small(terms), "term", "left_semi")


def _scored(index: Index, asked: V.Asked, top: int, goals: DataFrame | None, count: bool) -> DataFrame:
    """(query_id, id, score) of the best documents in the first shard, if there are no ``goals``, or in the others; or the (blocks, postings)
    opened there by each query, all added up."""
    spark, (n, average) = index.spark, index.size()
    words = spark.createDataFrame(pa.table({"term": asked.words, "place": pa.array(np.arange(len(asked.words)))}))
    # bounds only: the lists aren't read here
    df = _stored(index, words.select("term")).groupBy("term").agg(F.sum("n").alias("df")).join(words, "term").select("place", "df").toArrow()  # a row for each term of ``asked``
    idf = np.zeros(len(asked.words))
    idf[df["place"].to_numpy()] = np.log(1 + (n - df["df"].to_numpy() + 0.5) / (df["df"].to_numpy() + 0.5))
    floor = np.full(len(asked.names), -np.inf)
    if goals is not None:
        place = {q: i for i, q in enumerate(asked.names.to_pylist())}
        aims = goals.toArrow()  # a row for each query of ``asked``
        floor[[place[q] for q in aims["query_id"].to_pylist()]] = aims["goal"].to_numpy()
    shared = spark.sparkContext.broadcast((asked, idf, floor))
    blocks = _stored(index, words.select("term")).where(F.col("shard") == 0 if goals is None else F.col("shard") != 0).join(F.broadcast(words), "term")
    kind = blocks.schema["documents"].dataType.elementType
    id_type = to_arrow_type(kind)

    def visited(place, most, n_blocks, n_postings, best):
        """Which queries' terms can reach what is aimed at in a shard, and the blocks and postings that these open."""
        asked, _, floor = shared.value
        table = np.zeros((3, len(asked.words)))
        np.maximum.at(table[0], place, most)
        np.add.at(table[1], place, n_blocks)
        np.add.at(table[2], place, n_postings)
        bound, own_blocks, own_postings = np.add.reduceat(table[:, asked.terms], asked.starts[:-1], axis=1) if len(asked.terms) else np.zeros((3, 0))
        aim = floor if best is None else np.maximum(floor, np.pad(best.floor, (0, len(floor) - len(best.floor)), constant_values=-np.inf))
        open_ = (bound > 0) & (bound + SLACK >= aim)
        return open_, int(own_blocks[open_].sum()), int(own_postings[open_].sum())

    def score(batches):
        asked, idf, floor = shared.value
        best, rows, tallied = V.Best(top, id_type, 6), np.full(len(asked.words), -1), np.zeros(2, np.int64)
        for table in _shards(batches):
            place, n = table["place"].to_numpy(), table["n"].to_numpy()
            most = _gains(idf[place], table["max_tf"].to_numpy(), table["min_length"].to_numpy(), average)
            open_, b, p = visited(place, most, 1, n, None if count else best)
            tallied += (b, p)
            if count or not open_.any():
                continue
            flat = lambda c: pa.concat_arrays(table[c].chunks).flatten()
            ids, terms = flat("documents"), np.repeat(place, n)
            gains = _gains(idf[terms], flat("tfs").to_numpy(), flat("lengths").to_numpy(), average)
            coded = ids.dictionary_encode()
            docs = coded.indices.to_numpy()
            order = np.argsort(docs, kind="stable")
            V.add_keyword_hits(best, asked, coded.dictionary, docs[order], terms[order], gains[order], rows, open_)
        yield pa.record_batch([pa.array([x], pa.int64()) for x in tallied], names=["blocks", "postings"]) if count else pa.record_batch(best.rows(asked.names))

    held = [] if count else ["documents", "tfs", "lengths"]
    dealt = blocks.select("shard", "place", "n", "max_tf", "min_length", *held).repartition("shard").sortWithinPartitions("shard")
    schema = "blocks long, postings long" if count else f"query_id {from_arrow_type(asked.names.type).simpleString()}, id {kind.simpleString()}, score double"
    return dealt.mapInArrow(score, schema)


def _shards(batches):
    """Sorted rows, a table for each shard."""
    held = []
    for batch in batches:
        shard = batch["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0]["shard"][0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _goals(hits: DataFrame, top: int) -> DataFrame:
    """(query_id, goal) of the queries that have ``top`` hits."""
    return V.ranked(hits, top).where(F.col("rank") == top).select("query_id", F.col("score").alias("goal"))


def search(index: Index, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, document_id, score, rank) of queries (query_id, text)."""
    found = []
    for asked in V.asked_terms(_asked(index, queries)):
        first = materialise(_scored(index, asked, top, None, False), "first")
        found += [first, _scored(index, asked, top, _goals(first, top), False)]
    kind = index.spark.read.parquet(f"{index.path}/postings").schema["documents"].dataType.elementType.simpleString()
    none = index.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, score double")
    return V.ranked(functools.reduce(DataFrame.unionByName, found, none), top).withColumnRenamed("id", "document_id")


def cost(index: Index, queries: DataFrame, top: int) -> DataFrame:
    """(blocks, all_blocks, postings, all_postings): what a search opens for each of its queries, added up, and what it would
    without the goal. Blocks are counted by their bounds, and their lists aren't read beyond the first shard."""
    asked = _asked(index, queries)
    opened = [index.spark.createDataFrame([(0, 0)], "blocks long, postings long")]
    for part in V.asked_terms(asked):
        first = _scored(index, part, top, None, False)
        opened += [_scored(index, part, top, None, True), _scored(index, part, top, _goals(first, top), True)]
    told = functools.reduce(DataFrame.unionByName, opened).agg(F.sum("blocks").alias("blocks"), F.sum("postings").alias("postings"))
    terms = asked.groupBy("term").agg(F.count("*").alias("queries"))
    held = _stored(index, terms.select("term")).groupBy("term").agg(F.count("*").alias("b"), F.sum("n").alias("p")).join(terms, "term")
    total = lambda c: F.coalesce(F.sum(F.col(c) * F.col("queries")), F.lit(0))
    return told.crossJoin(held.agg(total("b").alias("all_blocks"), total("p").alias("all_postings"))).select("blocks", "all_blocks", "postings", "all_postings")  # a row each
