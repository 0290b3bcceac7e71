"""Streaming jobs against their batch twins; files and sinks."""

import os
from datetime import datetime, timedelta

import pytest
import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import chunk as C
from lexloom.sources import files, sinks, tables
from lexloom.streaming import jobs

T0 = datetime(2024, 1, 1)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path), spark.read.parquet(path)


def test_sessions(spark, tmp_path):
    rows = [(1, T0 + timedelta(minutes=m)) for m in (0, 30, 89, 200)] + [(2, T0), (9, T0 + timedelta(days=2))]
    stream, batch = source(spark, tmp_path, rows, "k int, ts timestamp")
    run(jobs.sessions(stream, "k"), "sessions", "append")
    got = {tuple(r) for r in spark.table("sessions").collect()}
    want = {tuple(r) for r in jobs.sessions(batch, "k").where("k <> 9").collect()}
    assert got == want and len(want) == 3


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def waves(spark, tmp_path, batches, schema):
    """A stream that reads one file of rows after another, and all rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "w" / f"{i}"))
        for f in (tmp_path / "w" / f"{i}").glob("*.parquet"):
            f.rename(tmp_path / "w" / f"{i:03d}.parquet")
    import time, os  # noqa: E401

    for i in range(len(batches)):
        os.utime(tmp_path / "w" / f"{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w" / "*.parquet")), spark.read.schema(schema).parquet(str(tmp_path / "w" / "*.parquet"))


def test_last_messages(spark, tmp_path, rocksdb):
    random = np.random.default_rng(4)
    rows = [(int(k), T0 + timedelta(minutes=int(m)), f"m{i}") for i, (k, m) in enumerate(zip(random.integers(0, 3, 150), np.sort(random.integers(0, 3000, 150)) + random.integers(0, 9, 150)))]
    batches = [rows[:50], rows[50:90], rows[90:], [(99, T0 + timedelta(days=9), "end")]]
    batches[0] += [(None, T0 + timedelta(minutes=1), None), (None, T0 + timedelta(minutes=2), "b"), (2**60 + 1, T0, "large")]
    schema = "k long, ts timestamp, content string"
    stream, batch = waves(spark, tmp_path, batches, schema)
    run(jobs.last_messages(stream, "k", keep=4), "lasting", "append")
    got = {(r["k"], r["session_start"], r["session_end"], r["n"], tuple(r["messages"])) for r in spark.table("lasting").collect()}
    twin = {(r["k"], r["session_start"], r["session_end"], r["n"], tuple(r["messages"])) for r in jobs.last_messages_batch(batch, "k", keep=4).where("not k <=> 99").collect()}
    assert got == twin and len(twin) > 10 and max(x[3] for x in twin) > 4
    windows = {tuple(r) for r in jobs.sessions(batch, "k").where("not k <=> 99").collect()}
    assert {x[:4] for x in twin} == windows


def test_cache_hits_of_a_stream(spark, tmp_path, rocksdb):
    random = np.random.default_rng(6)
    rows = [(i, f"k{k}", T0 + timedelta(seconds=int(s))) for i, (k, s) in enumerate(zip(random.integers(0, 4, 300), np.sort(random.integers(0, 9000, 300)) + random.integers(0, 500, 300)))]
    schema = "query_id long, key string, ts timestamp"
    stream, batch = waves(spark, tmp_path, [rows[:120] + [(None, "k0", T0), (2**60 + 1, None, T0)], rows[120:250], rows[250:], [(999, "z", T0 + timedelta(days=2))]], schema)
    run(jobs.cache_hits_stream(stream, "key", 700), "hits", "append")
    got = {tuple(r) for r in spark.table("hits").collect()}
    want = {tuple(r) for r in jobs.cache_hits(batch, "key", 700).collect() if r["key"] != "z"}
    assert got == want and len({x[2] for x in want}) == 2


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(1, T0 + timedelta(days=5)), (1, T0 + timedelta(days=6))]
    late = [(1, T0), (1, T0 + timedelta(days=1)), (1, T0 + timedelta(days=6))]
    # a batch drops what the watermark of the batch before it had passed
    stream, _ = waves(spark, tmp_path, [rows, rows, late], "user_id int, ts timestamp")
    listener = jobs.LateRows()
    spark.streams.addListener(listener)
    try:
        q = run(jobs.daily_counts(stream), "late_days", "update")
        assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 2
        for _ in range(50):
            if listener.count.get("late_days") == 2:
                break
            __import__("time").sleep(0.2)
        assert listener.count["late_days"] == 2
    finally:
        spark.streams.removeListener(listener)


def test_daily_counts_and_users(spark, tmp_path):
    rows = [(i % 3, T0 + timedelta(hours=7 * i)) for i in range(20)]
    stream, batch = source(spark, tmp_path, rows, "user_id int, ts timestamp")
    run(jobs.daily_counts(stream), "daily", "update")
    assert {tuple(r) for r in spark.table("daily").collect()} == {tuple(r) for r in jobs.daily_counts(batch).collect()}
    run(jobs.user_panes(stream), "panes", "complete")
    panes = spark.table("panes")
    assert panes.count() == 6 and {r["users"] for r in jobs.active_users(panes).where("until = date'2024-01-20'").collect()} == {3}


def test_active_users(spark):
    """Panes merged into windows against a count of distinct users for each window."""
    rows = spark.range(60_000).select((F.col("id") * 7919 % 20_011 - 5000).alias("user_id"), F.timestamp_seconds(1704067200 + F.col("id") * 97 % (86400 * 50)).alias("ts")).union(spark.sql("select cast(null as bigint), timestamp'2024-01-03'"))
    want = {r["until"]: r["n"] for r in jobs._windows(rows.select("user_id", F.col("ts").cast("date").alias("day")), 7).groupBy("until").agg(F.countDistinct("user_id").alias("n")).collect()}
    assert {r["until"]: r["users"] for r in jobs.active_users(jobs.exact_panes(rows), 7).collect()} == want
    near = {r["until"]: r["users"] for r in jobs.active_users(jobs.user_panes(rows), 7).collect()}
    assert set(near) == set(want) and all(abs(near[k] - n) <= 0.05 * n + 1 for k, n in want.items())


def test_task_counters(spark, tmp_path):
    stream, batch = source(spark, tmp_path, [("a", "ok", T0, 1.0), ("a", "ok", T0, 3.0)], "type string, status string, ts timestamp, seconds double")
    run(jobs.task_counters(stream), "tasks_seen", "update")
    assert spark.table("tasks_seen").collect() == jobs.task_counters(batch).collect()


def test_first_queries(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(minutes=5)), ("b", T0)]
    stream, batch = source(spark, tmp_path, rows, "key string, ts timestamp")
    run(jobs.first_queries(stream, "key"), "firsts", "append")
    assert {r["key"] for r in spark.table("firsts").collect()} == {"a", "b"} and spark.table("firsts").count() == 2
    hits = jobs.cache_hits(batch.withColumn("query_id", F.unix_seconds("ts")), "key").collect()
    assert sorted((r["key"], r["hit"]) for r in hits) == [("a", False), ("a", True), ("b", False)]


def test_monitor(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    rows = [(1, "f", "start", m(0), 0.0), (2, "f", "progress", m(1), 0.5), (3, "f", "end", m(2), 1.0), (4, "g", "progress", m(1), 0.1), (5, "h", "start", m(0), 0.0), (6, "i", "start", m(0), 0.0), (7, "i", "error", m(1), 0.0)]
    stream, batch = source(spark, tmp_path, rows, "event_id long, file_path string, event_type string, ts timestamp, progress double")
    run(jobs.monitor(stream), "monitored", "update")
    got = {r["file_path"]: r["status"] for r in spark.table("monitored").collect()}
    twin = {r["file_path"]: r["status"] for r in jobs.monitor_batch(batch, F.lit(m(3))).collect()}
    assert got == twin == {"f": "completed", "h": "active", "i": "error"}
    assert {r["file_path"]: r["status"] for r in jobs.monitor_batch(batch, F.lit(m(500))).collect()}["h"] == "timeout"


def test_ingest(spark, tmp_path):
    stream, batch = source(spark, tmp_path, [(1, "x" * 25), (2, None)], "document_id long, text string")
    cut = lambda d: C.fixed_size(d, 10, 0)
    for _ in range(2):
        jobs.ingest(stream, cut, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == cut(batch).count() == 3


def test_files(spark, tmp_path):
    for name, data in {"a.TXT": "文本".encode("gbk"), "b.md": "文本".encode(), "c.bin": b"\xff\xfe\x81", "sub/d.txt": b"plain", "e.txt": b""}.items():
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(data)
    listed = files.list_files(spark, str(tmp_path / "f")).collect()
    assert sorted((r["extension"], r["size"] > 0) for r in listed) == [(".bin", True), (".md", True), (".txt", False), (".txt", True), (".txt", True)]
    assert all(r["modified"] is not None for r in listed)
    indexed = files._indexed(spark, str(tmp_path / "f"), "*").collect()
    assert {(r["path"], r["size"], r["modified"]) for r in listed} == {tuple(r) for r in indexed}
    read = files.read_files(spark, str(tmp_path / "f")).select("path", files.decode(F.col("content")).alias("d")).collect()
    got = {r["path"].rsplit("/", 1)[1]: tuple(r["d"]) for r in read}
    assert got == {"a.TXT": ("gbk", "文本"), "b.md": ("utf-8", "文本"), "c.bin": ("latin1", "ÿþ\x81"), "d.txt": ("utf-8", "plain")}
    df = spark.createDataFrame([("a.pdf", 10, "text/plain"), ("b.xyz", 10, None), ("c.txt", 10**9, None), ("d.txt", 0, None), ("e.txt", None, None)], "filename string, size long, mime string")
    assert [(r["kind"], r["outcome"]) for r in files.validate(df).collect()] == [("text", "valid"), (None, "unsupported"), ("text", "invalid"), ("text", "invalid"), ("text", "invalid")]
    with pytest.raises(ValueError):
        files.content_hash(F.col("x"), "crc")


def test_listing(spark, tmp_path):
    root = tmp_path / "deep"
    for name in ("a b.txt", "x+%20.md", "p=1/q=2/c.csv", "p=1/_SUCCESS", "_k=1/d.csv", ".hid/e.csv", "_tmp/f.csv", "名/g.txt", "empty.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.json" else b"x" * len(name))
    (root / "none" / "within").mkdir(parents=True)
    at = lambda r: r["path"].removeprefix(f"file:{root}/")
    seen = {at(r): r["size"] for r in files.list_files(spark, f"file://{root}/").collect()}
    assert seen == {n: len(n) if n != "empty.json" else 0 for n in ("a b.txt", "x+%20.md", "p=1/q=2/c.csv", "_k=1/d.csv", "名/g.txt", "empty.json")}
    for pattern, want in {"*.{csv,txt}": 4, "[a-c]*": 2, "[!a-c]*": 4, "?.txt": 1, "none*": 0, "a?b.txt": 1, "x+*": 1}.items():
        got = {at(r) for r in files.list_files(spark, str(root), pattern).collect()}
        assert len(got) == want and got == {at(r) for r in files._indexed(spark, str(root), pattern).collect()}
    assert [(at(r), r["extension"]) for r in files.list_files(spark, str(root / "a b.txt")).collect()] == [("a b.txt", ".txt")]
    assert files.list_files(spark, str(root / "none")).count() == 0
    assert {at(r) for r in files.list_files(spark, f"{root}/p=*").collect()} == {"p=1/q=2/c.csv"}
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(root / "absent"))
    assert files._store("nowhere://host/folder") is None


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "completed"), (2, "failed")], "document_id long, status string")
    chunks = spark.createDataFrame([(1, 1, "1_1", "b\r\nc", 1, "t"), (1, 0, "1_0", "a", 1, "t"), (2, 0, "2_0", "z", 1, "t")], "document_id long, chunk_index int, chunk_id string, content string, page_number int, section_title string")
    for kind in ("json", "csv", "txt"):
        sinks.write_results(docs, chunks, str(tmp_path / kind), kind)
    assert [c["content"] for c in spark.read.json(str(tmp_path / "json")).first()["chunks"]] == ["a", "b\r\nc"]
    assert sorted(r["content"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["a", "b c"]
    events = spark.createDataFrame([("f", {"k": "v"})], "file_path string, details map<string,string>")
    sinks.export_events(events, str(tmp_path / "ev"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "ev")).count() == 1
    for f in (lambda: sinks.write_results(docs, chunks, "x", "xml"), lambda: sinks.export_events(events, "x", "xml")):
        with pytest.raises(ValueError):
            f()
    vectors = chunks.select("document_id", "chunk_index", F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(Exception, match="chunks and vectors differ"):
        sinks.vector_rows(chunks, vectors.where("chunk_index = 0")).collect()
    kept, counts = sinks.cascade_delete(docs, docs.where("document_id = 1"), {"chunks": (chunks, "document_id")}, "document_id")
    assert kept["chunks"].count() == 1 and {r["name"]: r["deleted"] for r in counts.collect()} == {"parents": 1, "chunks": 2}


def test_vectors_are_replaced_and_deleted(spark, tmp_path):
    def rows(*docs):
        chunks = spark.createDataFrame([(i, c, f"{i} {c} {mark}") for i, n, mark in docs for c in range(n)], "document_id long, chunk_index int, content string")
        return sinks.vector_rows(chunks, chunks.select("document_id", "chunk_index", F.array(F.lit(1.0)).alias("embedding")), 4)

    table = sinks.VectorTable(spark, str(tmp_path / "v"))
    have = lambda: sorted((r["document_id"], r["chunk_index"], r["content"].split()[2]) for r in table.rows().collect())
    assert table.rows() is None
    table.delete(spark.createDataFrame([(1,)], "document_id long"), 4)
    first = rows(*[(i, 3, "a") for i in range(20)])
    for _ in range(2):
        table.upsert(first)
        assert have() == [(i, c, "a") for i in range(20) for c in range(3)]
    before = table.rows()
    table.upsert(rows((5, 1, "b"), (30, 2, "b")))
    want = sorted([(i, c, "a") for i in range(20) if i != 5 for c in range(3)] + [(5, 0, "b"), (30, 0, "b"), (30, 1, "b")])
    assert have() == want and before.count() == 60
    # a write that is cut short before it is named isn't seen, and the next one takes its place
    with pytest.MonkeyPatch.context() as m:
        m.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut")))
        torn = first.where("document_id < 3")
        with pytest.raises(RuntimeError):
            table.upsert(torn)
    assert have() == want
    table.delete(spark.createDataFrame([(0,), (30,), (999,)], "document_id long"), 4)
    want = [x for x in want if x[0] not in (0, 30)]
    assert have() == want
    table.vacuum()
    assert have() == want
    table.delete(spark.range(40).select(F.col("id").alias("document_id")), 4)
    assert have() == []
    table.upsert(rows((1, 1, "c")))
    assert have() == [(1, 0, "c")]


def test_schemas(spark, tmp_path):
    for name, schema in tables.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        assert tables.load(spark, str(tmp_path / name), name).count() == 0


def test_cache_hits_against_a_loop(spark):
    random = np.random.default_rng(3)
    rows = [(i, None if k == 3 else f"k{k}", None if i % 17 == 0 else T0 + timedelta(seconds=int(s))) for i, (k, s) in enumerate(zip(random.integers(0, 4, 400), random.integers(0, 900, 400)))]
    last, want = {}, {}
    for i, k, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        want[i] = k in last and (t - last[k]).total_seconds() < 60
        if not want[i]:
            last[k] = t
    got = jobs.cache_hits(spark.createDataFrame(rows, "query_id long, key string, ts timestamp"), "key", 60)
    assert {r["query_id"]: r["hit"] for r in got.collect()} == {i: want.get(i, False) for i, _, _ in rows}
    assert jobs.cache_hits(spark.createDataFrame([], "query_id long, key string, ts timestamp"), "key").count() == 0


def test_sweep(spark, tmp_path, monkeypatch):
    from lexloom.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    assert scratch.sweep(spark) == 0
    scratch.materialise(spark.range(3), "old")
    new = scratch.materialise(spark.range(4), "new")
    at = next(p for p in (tmp_path / "lexloom").iterdir() if p.name.startswith("old-"))
    (tmp_path / "other").mkdir()
    for path in (at, tmp_path / "other"):
        os.utime(path, (0, 0))
    assert scratch.sweep(spark, 1.0) == 1 and not at.exists() and (tmp_path / "other").exists()
    assert new.count() == 4
    assert scratch.sweep(spark, -1.0) == 1
