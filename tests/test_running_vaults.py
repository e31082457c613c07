"""Vaults that run: bootstrap, pause, resume, reset, restarts."""

import time

import pytest

from quillspark.errors import EngineError
from quillspark.plans.catalog import StoredCatalog
from quillspark.plans.lifecycle import Lifecycle
from quillspark.sources.snapshot import Snapshots
from quillspark.streaming.event_log import EventLog


@pytest.fixture
def running(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("# a\n")
    catalog = StoredCatalog(Snapshots(spark, f"file://{tmp_path}/catalog"))
    life = Lifecycle(catalog, Snapshots(spark, f"file://{tmp_path}/index"), EventLog(spark, f"file://{tmp_path}/log"), f"file://{tmp_path}/work", lambda: "2026-01-01T00:00:00.000000Z", trigger={"processingTime": "1 second"})
    yield life, tmp_path / "notes"
    life.close()


def until(holds, seconds=90):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.5)


def told(life):
    return sorted((r.event_type, r.path) for r in life.log.read().collect())


def test_a_vault_runs_pauses_and_resumes(spark, running):
    life, notes = running
    v = life.create(str(notes), "mine")
    assert life.wait("mine") == "ready" and life.status()[0]["bootstrap"]["jobs"] > 0
    assert life.snapshots.read("files").count() == 1 and told(life) == []  # a bootstrap tells nothing
    (notes / "b.md").write_text("# b\n")
    until(lambda: told(life) == [("created", "b.md")])
    assert life.pause("mine").status == "paused" and life.pause("mine").status == "paused"
    with pytest.raises(EngineError, match="vault_not_active"):
        life.rescan("mine")
    (notes / "a.md").unlink()
    (notes / "b.md").write_text("# b, more\n")
    time.sleep(3)
    assert told(life) == [("created", "b.md")] and life.snapshots.read("files").count() == 2  # nothing runs, the index stays
    life.resume("mine")
    until(lambda: told(life) == [("created", "b.md"), ("deleted", "a.md"), ("modified", "b.md")])
    life.close()
    again = StoredCatalog(life.catalog.snapshots)
    assert again.list() == life.catalog.list() and again.get("mine").id == v.id
    life.terminate("mine")
    again.reload()
    assert again.list() == [] and life.snapshots.vaults("files") == [] and notes.exists()


def test_a_bootstrap_that_fails_says_why(spark, running, monkeypatch):
    life, notes = running
    from quillspark.plans import lifecycle

    with monkeypatch.context() as m:
        m.setattr(lifecycle, "walk", lambda *a: 1 / 0)
        life.create(str(notes), "mine")
        assert life.wait("mine") == "errored"
    row = life.status()[0]
    assert row["status"] == "errored" and "ZeroDivisionError" in row["last_error"] and row["bootstrap"]["state"] == "errored"
    assert life.reset("mine").status == "active" and life.wait("mine") == "ready" and life.snapshots.read("files").count() == 1
    life.reset("mine", rebuild=True)
    assert "bootstrap" not in life.status()[0] and life.snapshots.read("chunks").count() == 0 and life.snapshots.read("files").count() == 1
    life.rescan("mine")
    until(lambda: life.snapshots.read("chunks").count() == 1)


def test_two_writers_of_a_catalog(spark, tmp_path):
    (tmp_path / "n").mkdir()
    one = StoredCatalog(Snapshots(spark, f"file://{tmp_path}/catalog"))
    v = one.create(str(tmp_path / "n"), "x")
    two = StoredCatalog(Snapshots(spark, f"file://{tmp_path}/catalog"))
    assert two.rename("x", "y").id == v.id
    one.reload()
    assert one.get("y").id == v.id and one.pause("y").status == "paused"
