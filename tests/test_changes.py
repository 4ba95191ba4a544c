"""The catalogue's numbered changes: writers side by side, snapshots, and sessions that are given up while they are loaded."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeframe.plans import changes
from lodeframe.plans.index import OWNERS, Index
from lodeframe.plans.tools import Engine
from tests import builders as b

AT = datetime(2024, 1, 2, 3, 4, 5, 678901)


@pytest.fixture
def package(tmp_path):
    path = tmp_path / "one.apk"
    path.write_bytes(b.package([b.dex(c) for c in b.demo_v1()], b.manifest("p", 1, "1")))
    return str(path)


def test_writers_side_by_side(spark, tmp_path, monkeypatch):
    """Each of two writers adds to one counter what it read: no change is lost, whoever comes first, and old changes go."""
    monkeypatch.setattr(changes, "EVERY", 4)
    logs = [Index(spark, str(tmp_path / "index")).log for _ in range(2)]

    def count(k: int) -> None:
        def decide(at: int) -> dict:
            there = logs[k].table("owners", at).where("session_id = 'n'").count()
            return {"rows": {"owners": [("n", f"{there:03d}", AT, False)]}}

        for _ in range(6):
            logs[k].commit(decide)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(count, range(2)))
    last = Index(spark, str(tmp_path / "index")).log
    assert last.head() == 12
    assert sorted(r.owner for r in last.table("owners").collect()) == [f"{k:03d}" for k in range(12)]
    assert {r.created_at for r in last.table("owners").collect()} == {AT}
    found = last._numbers()
    assert found["snapshot"] and min(found["change"]) > 1 and len(found["change"]) <= 8
    assert not list((tmp_path / "index/catalogue/drafts").glob("[!.]*"))


def test_rows_of_all_kinds_in_order(spark, tmp_path, monkeypatch):
    """A later change wins, be it a row, a folder or in a snapshot; states of the past can be read."""
    monkeypatch.setattr(changes, "EVERY", 3)
    log = Index(spark, str(tmp_path / "index")).log
    one = lambda owner, gone=False: {"rows": {"owners": [("s", owner, AT, gone)]}}
    folder = lambda *owners: {"folders": {"owners": log.store("owners", spark.createDataFrame([("s", o, AT) for o in owners], OWNERS))}}
    want, states = set(), []
    for body, more, less in ((one("a"), {"a"}, set()), (folder("b", "c"), {"b", "c"}, set()), (one("b", True), set(), {"b"}), (one("d"), {"d"}, set()), (folder("b"), {"b"}, set()), (one("a", True), set(), {"a"})):
        log.commit(lambda _, body=body: body)
        want = (want | more) - less
        states.append((log.head(), set(want)))
        assert {r.owner for r in log.table("owners").collect()} == want
    assert [n for n, _ in states] == [1, 2, 3, 4, 5, 6]
    for n, owners in states[3:]:
        assert {r.owner for r in log.table("owners", n).collect()} == owners
    log.commit(lambda _: None)
    assert log.head() == 6
    assert not log._claim(6, "change", one("z")) and {r.owner for r in log.table("owners").collect()} == want


def test_a_session_given_up_while_another_loads_it(spark, tmp_path, package, monkeypatch):
    """The loader has written its tables when the last owner goes, who takes the files along: the loader writes them again."""
    root = str(tmp_path / "index")
    one, two = (Engine(spark, root, [str(tmp_path)], f"owner{k}") for k in (1, 2))
    session = one.call("loadApk", path=package)["sessionId"]
    write, times = Index.write, []

    def written(self, tables, **options):
        write(self, tables, **options)
        times.append(self)
        if len(times) == 1:
            assert one.call("unload", sessionId=session)["items"][0]["deleted"]

    monkeypatch.setattr(Index, "write", written)
    out = two.call("loadApk", path=package, force=True)
    assert out["ok"] and out["items"][0]["counts"]["classes"] == 9 and len(times) == 2
    assert [(r.session_id, r.owner) for r in two.index.owners().collect()] == [(session, "owner2")]
    assert two.call("searchClasses", sessionId=session, query="com.example.demo", kind="prefix")["ok"]
    assert two.call("doctor")["issues"] == []


def test_a_known_session_given_up_before_the_second_owner(spark, tmp_path, package, monkeypatch):
    """Found in the catalogue, then given up: it is loaded as if it had not been there."""
    root = str(tmp_path / "index")
    one, two = (Engine(spark, root, [str(tmp_path)], f"owner{k}") for k in (1, 2))
    session = one.call("loadApk", path=package)["sessionId"]
    upsert, times = Index.upsert, []

    def late(self, *args, **more):
        times.append(self)
        if len(times) == 1:
            assert one.call("unload", sessionId=session)["items"][0]["deleted"]
        return upsert(self, *args, **more)

    monkeypatch.setattr(Index, "upsert", late)
    out = two.call("loadApk", path=package)
    assert out["ok"] and not out["items"][0]["reused"] and out["items"][0]["counts"]["classes"] == 9
    assert two.index.table("classes", session).where(F.col("descriptor").isNotNull()).count() == 9
    assert not two.index.dead_letters().count() and two.call("sessionList")["items"][0]["indexAvailable"]
