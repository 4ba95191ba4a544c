"""Incremental ingest adds each file once; windowed counts of a stream equal those of the batch."""

import pytest
from pyspark.sql import functions as F

from lodeframe.plans.index import Index
from lodeframe.plans.tools import Engine
from lodeframe.streaming import append
from tests import builders as b


def test_streamed_files_are_sessions(spark, tmp_path):
    folder, index = tmp_path / "in", Index(spark, str(tmp_path / "index"))
    folder.mkdir()
    put = lambda name, parts: (folder / name).write_bytes(b.package([b.dex(c) for c in parts], b.manifest("p", 1, "1")))
    put("one.apk", b.demo_v1())
    (folder / "broken.apk").write_bytes(b"PK\x03\x04 nothing")
    run = lambda: append.watch(index, str(folder), str(tmp_path / "state"), owner="me").awaitTermination(240)
    run()
    assert index.table("classes").count() == 9
    # The file is a session that the tools answer for, and the broken one is told of.
    engine = Engine(spark, index=index)
    (session,) = index.sessions().collect()
    assert (session.pkg, session.kind, session.label) == ("p", "apk", "one.apk") and session.sources[0].endswith("/one.apk")
    out = engine.call("searchClasses", sessionId=session.session_id, query="com.example.demo", kind="prefix")
    assert out["ok"] and out["items"], out
    assert [(r.owner, r.session_id) for r in index.owners().collect()] == [("me", session.session_id)]
    (dead,) = index.dead_letters().collect()
    assert dead.path.endswith("/broken.apk") and dead.code and dead.message
    put("copy.apk", b.demo_v1())
    put("two.apk", b.demo_v2())
    run()
    assert sorted(r.n for r in index.table("classes").groupBy("session_id").agg(F.count("*").alias("n")).collect()) == [6, 9]
    edges = index.table("xref_edges").count()
    append.append_batch(index, spark.read.format("binaryFile").load(str(folder)))
    assert index.table("xref_edges").count() == edges and index.table("classes").count() == 15
    assert index.sessions().count() == 2 and index.dead_letters().count() == 1 and index.owners().count() == 2


def test_a_batch_that_stopped_half_way_is_finished(spark, tmp_path, monkeypatch):
    """The tables are there, the session is not: the same batch again writes both, and adds nothing twice."""
    folder, index = tmp_path / "in", Index(spark, str(tmp_path / "index"))
    folder.mkdir()
    (folder / "one.apk").write_bytes(b.package([b.dex(c) for c in b.demo_v1()], b.manifest("p", 1, "1")))
    files = lambda: spark.read.format("binaryFile").load(str(folder))
    with monkeypatch.context() as stop:
        stop.setattr(Index, "append_rows", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            append.append_batch(index, files())
    assert index.table("classes").count() == 9 and not index.sessions().count()
    append.append_batch(index, files())
    assert index.table("classes").count() == 9 and index.sessions().count() == 1 and index.owners().count() == 1


def test_windowed_counts(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    query = append.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("counts").select("start", "event_type", "n").collect())
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").count().select("window.start", "event_type", "count")
    assert got == sorted(tuple(r) for r in want.collect())
