"""The live path: notifications of a folder, index and events over restarts, readers that lag, vaults that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.plans.catalog import Catalog, Vault
from quillspark.plans import engine as engine_module
from quillspark.plans.engine import Engine, ingest
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import walk
from quillspark.streaming import live as live_module
from quillspark.streaming.changes import apply_batch
from quillspark.streaming.event_log import EventLog, after
from quillspark.streaming.live import Live


@pytest.fixture
def vault(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    s, log = Snapshots(spark, f"file://{tmp_path}/index"), EventLog(spark, f"file://{tmp_path}/log", capacity=4)
    return tmp_path / "notes", Live(s, log, "v", str(tmp_path / "notes"), f"file://{tmp_path}/work", limit=10)


def tick(live):
    live.start(availableNow=True).awaitTermination()


def told(log):
    return [(r.event_type, r.path, r.content_hash) for r in log.read().orderBy("seq").collect()]


def test_a_folder_that_changes_gives_each_event_once(spark, vault):
    notes, live = vault
    (notes / "a.md").write_text("# one\n")
    (notes / "b.md").write_text("# two\n")
    (notes / "c.sync-conflict-1.md").write_text("copy")
    tick(live)
    tick(live)  # the query is another one each time: offsets come from the checkpoint
    one = {p: h for _, p, h in told(live.log)}
    assert told(live.log) == [("created", "a.md", one["a.md"]), ("created", "b.md", one["b.md"])]
    (notes / "a.md").write_text("# one, and more\n")
    os.utime(notes / "b.md", (1, 1))  # touched, its bytes are the same
    tick(live)
    assert told(live.log)[2:] == [("modified", "a.md", told(live.log)[2][2])] and told(live.log)[2][2] != one["a.md"]
    (notes / "b.md").rename(notes / "z.md")
    tick(live)
    assert told(live.log)[3:] == [("deleted", "b.md", one["b.md"]), ("created", "z.md", one["b.md"])]
    assert not live.waiting().take(1) and [r.seq for r in live.log.read().orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    found = Engine(Catalog([Vault("v", "v", str(notes))]), live.snapshots.read("files"), live.snapshots.read("chunks"))
    assert [r.path for r in found.search_content("more").rows.collect()] == ["a.md"]


def test_only_what_changed_is_opened(spark, vault, monkeypatch):
    notes, live = vault
    for i in range(6):
        (notes / f"{i}.md").write_text(f"# {i}\n")
        os.utime(notes / f"{i}.md", (1_700_000_000 + i, 1_700_000_000 + i))
    tick(live)
    opened, whole = [], live_module.walk
    monkeypatch.setattr(live_module, "walk", lambda *a, content=True, **k: opened.append(whole(*a, content=content, **k)) or opened[-1] if content else whole(*a, content=False, **k))
    live.tick(100)
    assert opened == []  # nothing to read in a vault that is as it was
    (notes / "3.md").write_text("# 3, again\n")
    live.tick(101)
    assert [r.path for r in opened[0].collect()] == ["3.md"] and "PushedFilters: [IsNotNull(modificationTime), GreaterThanOrEqual(modificationTime" in opened[0]._jdf.queryExecution().toString()


def test_a_scan_opens_only_what_changed(spark, tmp_path, monkeypatch):
    (tmp_path / "n").mkdir()
    for i in range(5):
        (tmp_path / "n" / f"{i}.md").write_text(f"# {i}\n")
        os.utime(tmp_path / "n" / f"{i}.md", (1_700_000_000 + i, 1_700_000_000 + i))
    s = Snapshots(spark, f"file://{tmp_path}/index")
    scan = lambda: {k: v for k, v in engine_module.scan(s, "v", str(tmp_path / "n"), "t").first().asDict().items() if v and k != "vault"}
    assert scan() == {"inserted": 5}
    before, opened, whole = s.current(), [], engine_module.walk
    monkeypatch.setattr(engine_module, "walk", lambda *a, content=True, **k: opened.append(whole(*a, content=content, **k)) or opened[-1] if content else whole(*a, content=False, **k))
    assert scan() == {"skipped": 5} and s.current() == before and opened == []
    (tmp_path / "n" / "1.md").write_text("# one\n")
    (tmp_path / "n" / "2.md").unlink()
    (tmp_path / "n" / "5.md").write_text("# 5\n")
    assert scan() == {"inserted": 1, "updated": 1, "deleted": 1, "skipped": 3} and sorted(r.path for r in opened[0].collect()) == ["1.md", "5.md"]
    (tmp_path / "n" / "0.md").unlink()
    assert scan() == {"deleted": 1, "skipped": 4} and len(opened) == 1


def test_a_batch_that_fails_between_index_and_log_is_told_once(spark, vault, monkeypatch):
    notes, live = vault
    (notes / "a.md").write_text("# one\n")
    with monkeypatch.context() as m:
        m.setattr(EventLog, "append", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            tick(live)
    assert live.snapshots.read("files").count() == 1 and told(live.log) == []
    tick(live)
    assert [t[:2] for t in told(live.log)] == [("created", "a.md")]
    tick(live)
    assert len(told(live.log)) == 1


def test_a_burst_comes_in_bounded_batches_and_a_stop_loses_none(spark, vault):
    notes, live = vault
    for i in range(25):
        (notes / f"{i:02}.md").write_text(f"# {i}\n")
    tick(live)
    assert live.log.read().count() == 10 and live.waiting().count() == 15
    assert live.drain(0) is False and live.drain(120) is True
    assert live.log.read().groupBy("batch").count().agg(F.max("count")).first()[0] == 10
    assert sorted(p for _, p, _ in told(live.log)) == [f"{i:02}.md" for i in range(25)]


def test_readers_lag_and_go_on(spark, vault):
    notes, live = vault
    catalog = Catalog([Vault("v", "one", str(notes)), Vault("w", "two", "/w", status="paused")])
    slow, lone = live.log.subscribe(catalog), live.log.subscribe(catalog, "one")
    with pytest.raises(EngineError, match="vault_not_active"):
        live.log.subscribe(catalog, "two")
    with pytest.raises(EngineError, match="vault_not_found"):
        live.log.subscribe(catalog, "three")
    for i in range(7):
        (notes / f"{i}.md").write_text(f"# {i}\n")
    tick(live)
    first = json.loads(lone.lines().first()[0])
    assert first["type"] == "stream_lagged" and first["missed"] == 3 and first["action"] == "resync_required" and first["vault"] == "v" and "path" not in first
    got = slow.poll()
    assert [(r["type"], r["path"]) for r in got] == [("stream_lagged", None), *[("file_changed", f"{i}.md") for i in (3, 4, 5, 6)]]
    assert slow.poll() == []
    (notes / "7.md").write_text("# 7\n")
    catalog.resume("two")  # was not active at the start, so its events aren't for this reader
    live.log.append(live.log.read().where("seq = 1").drop("seq", "batch").withColumn("vault", F.lit("w")), "w", 0)
    tick(live)
    assert [(r["vault"], r["path"], r["seq"]) for r in slow.poll()] == [("v", "7.md", 8)] and len(live.log.subscribe(catalog).offsets) == 2


def test_lag_of_several_vaults(spark):
    rows = [(i, "file_changed", "modified", f"{i}", "h", f"t{i:03}", v, 0) for v, n in (("a", 9), ("b", 2), ("c", 5)) for i in range(1, n + 1)]
    log = spark.createDataFrame(rows, "seq long, type string, event_type string, path string, content_hash string, detected_at string, vault string, batch long")
    got = [(r.vault, r.seq, r.missed) for r in after(log, {"a": 3, "b": 0, "d": 7}, 4).orderBy("vault", "seq").collect()]
    assert got == [("a", 5, 2), ("a", 6, None), ("a", 7, None), ("a", 8, None), ("a", 9, None), ("b", 1, None), ("b", 2, None)]


def test_one_vault_that_cannot_be_read_leaves_the_others(spark, tmp_path):
    for v in "ab":
        (tmp_path / v).mkdir()
        (tmp_path / v / "n.md").write_text(f"# words of {v}\n")
    s = Snapshots(spark, f"file://{tmp_path}/index")
    ingest(s, walk(spark, "a", str(tmp_path / "a")).unionByName(walk(spark, "b", str(tmp_path / "b"))), "t")
    engine = Engine(Catalog([Vault("a", "a", "/a"), Vault("b", "b", "/b"), Vault("c", "c", "/c", status="paused")]), s.read("files"), s.read("chunks"))
    ask = lambda vaults: engine.search_content("words", vaults=vaults)
    whole, partial = engine.answer(ask)
    assert [r["vault"] for r in whole] == ["a", "b"] and not partial["failed"]
    for f in (tmp_path / "index" / "files" / "vault=b").rglob("*.parquet"):
        f.write_bytes(b"no table")
    for f in (tmp_path / "index" / "files" / "vault=b").rglob("*.crc"):
        f.unlink()
    got, partial = engine.answer(ask)
    assert [r["vault"] for r in got] == ["a"] and [x["vault"] for x in partial["failed"]] == ["b"] and [x["vault"] for x in partial["skipped"]] == ["c"]
    with pytest.raises(EngineError, match="invalid"):
        engine.answer(lambda vaults: engine.search_content("words", vaults=vaults, limit=0))


def test_notifications_of_shuffled_tables_are_joined_further(spark):
    """Where no side is broadcast, the notifications are grouped and joined with the index as elsewhere."""
    row = "vault string, path string, size long, mtime string, content_hash string"
    old = spark.createDataFrame([("v", p, n, "t", h) for p, n, h in [("same", 1, "a"), ("gone", 1, "b"), ("longer", 1, "c"), ("anew", 1, "")]], row)
    disk = spark.createDataFrame([("v", p, n, "t", h) for p, n, h in [("same", 1, "a"), ("longer", 2, "d"), ("anew", 1, "e"), ("new", 1, "f")]] + [(None, "lost", 1, "t", "g")], row)
    key, own = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        found = live_module.notifications(disk.drop("content_hash"), old)
        assert {tuple(r) for r in found.collect()} == {("v", "gone", "remove"), ("v", "longer", "upsert"), ("v", "anew", "upsert"), ("v", "new", "upsert"), (None, "lost", "upsert")}
        done = apply_batch(found.withColumn("ts", F.lit(0)), old, disk)
        assert {(r.path, r.effect) for r in done.collect()} == {("gone", "deleted"), ("longer", "updated"), ("anew", "updated"), ("new", "inserted")}
    finally:
        spark.conf.set(key, own)
