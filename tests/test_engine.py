import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.errors import EngineError
from quillspark.functions.embed import Refused, by_index, hash_embedder, in_batches
from quillspark.operators import diff, ranked
from quillspark.plans.catalog import Catalog, Vault
from quillspark.plans.engine import Engine, ingest, rescan, stored_index
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import included, walk, watched
from quillspark.streaming import changes

VAULTS = [Vault("1", "alpha", "/a"), Vault("2", "bravo", "/b"), Vault("3", "charlie", "/c", status="paused")]


def test_catalog(tmp_path):
    c = Catalog(VAULTS)
    s = c.scope(["bravo", "1", "2", "charlie", "brav"])
    assert [v.id for v in s.run] == ["2", "1"] and s.skipped[0]["vault"] == "3" and "did you mean 'bravo'" in s.failed[0]["message"]
    assert c.scope(["alpha"]).partial() == {}
    with pytest.raises(EngineError, match="invalid_request"):
        c.scope([])
    v = c.create(str(tmp_path), "delta")
    for bad in (lambda: c.create(str(tmp_path), "x"), lambda: c.rename("alpha", "bravo"), lambda: c.rename("alpha", "a b"), lambda: c.create("rel")):
        with pytest.raises(EngineError):
            bad()
    assert c.rename("delta", "echo").name == "echo" and c.pause("echo").status == "paused" and c.resume("echo").status == "active"
    assert {x.id for x in c.reconcile()} == {"1", "2"} and c.get("alpha").status == "errored" and c.reset("alpha").status == "active"
    assert c.terminate("echo").id == v.id and tmp_path.exists()


def test_embedding_batches():
    calls = []

    def service(texts):
        calls.append(len(texts))
        if len(texts) > 3:
            raise Refused
        return hash_embedder(4)(texts)

    assert len(in_batches(service, [str(i) for i in range(10)], 4, batch=16)) == 10
    assert calls == [10, 5, 2, 2, 2, 2, 2]
    assert by_index([{"embedding": [2.0], "index": 1}, {"embedding": [1.0], "index": 0}]) == [[1.0], [2.0]]
    with pytest.raises(EngineError, match="embedding_unavailable"):
        by_index([{"embedding": [1.0], "index": 1}, {"embedding": [2.0], "index": 1}])


def test_ingest_search_and_second_scan(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "sub dir").mkdir(parents=True)
    (vault / "a.md").write_text("# Alpha\nhello world\n")
    (vault / "sub dir" / "b+.md").write_text("---\nt: 1\n---\n# Beta\nsourdough bread\n")
    (vault / "c.txt").write_text("no")
    snapshots = Snapshots(spark, f"{tmp_path}/index")
    scan = lambda now: {r["vault"]: r.asDict() for r in ingest(snapshots, walk(spark, "1", str(vault)), now, hash_embedder(8), 8).collect()}
    assert scan("t1")["1"]["inserted"] == 2
    assert scan("t2")["1"] == {"vault": "1", "inserted": 0, "updated": 0, "hash_unchanged": 0, "skipped": 2, "deleted": 0}
    (vault / "a.md").unlink()
    (vault / "sub dir" / "b+.md").write_text("# Beta\nrye bread, longer than it was before\n")
    third = scan("t3")["1"]
    assert [third[k] for k in ("updated", "deleted", "inserted")] == [1, 1, 0]
    e = Engine(Catalog(VAULTS), snapshots.read("files"), snapshots.read("chunks"), embed=hash_embedder(8))
    r = e.search_content("RYE", mode=None)
    assert [x["path"] for x in r.rows.collect()] == ["sub dir/b+.md"] and r.partial["skipped"][0]["vault"] == "3"
    assert e.search_paths(vaults=["alpha"], glob="**/*.md").rows.count() == 1
    assert e.search_content("bread", mode="ranked", vaults=["alpha"]).rows.count() == 1
    text = snapshots.read("chunks").first()["content"]
    best = e.search_semantic(text, vaults=["alpha"], granularity="chunk").rows.collect()
    assert best[0]["score"] == pytest.approx(1.0) and e.get(["sub dir/b+.md"], ["alpha"]).rows.count() == 1


def test_stored_postings_follow_scans(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for name, text in (("a", "wild oats and running water"), ("b", "a bowl of oats, oats and café milk"), ("c", ""), ("d", "nothing")):
        (vault / f"{name}.md").write_text(text)
    snapshots = Snapshots(spark, f"{tmp_path}/index")
    for now in ("t1", "t2", "t3"):
        ingest(snapshots, walk(spark, "1", str(vault)), now)
        files, stored = snapshots.read("files"), stored_index(snapshots)
        for query in ("oats", "oat* NOT bowl", '"wild oats"', "cafe", "runs OR nothing"):
            rows = lambda index: sorted((r["path"], round(r["score"], 9)) for r in ranked.bm25(index, query).collect())  # noqa: B023, E731
            assert rows(stored) == rows(ranked.porter_index(files)), (now, query)
        assert {r[0]: r[1] for r in stored.files.select("path", "dl").collect()}.keys() == {r[0] for r in files.select("path").collect()}
        if now == "t1":
            (vault / "a.md").write_text("wild barley, no longer what it was")
            (vault / "d.md").unlink()
            (vault / "e.md").write_text("oats again")
    e = Engine(Catalog(VAULTS), files, index=stored)
    assert {r["path"] for r in e.search_content("oats", mode="ranked", vaults=["alpha"]).rows.collect()} == {"b.md", "e.md"}
    assert "EqualTo(term,oat)" in stored.postings.where("term = 'oat'")._jdf.queryExecution().toString()
    # sorted by term in each file
    for part in (r[0] for r in stored.postings.select(F.input_file_name()).distinct().collect()):
        terms = [r[0] for r in stored.postings.where(F.input_file_name() == part).select("term").collect()]
        assert terms == sorted(terms)


def test_walk_finds_gitignores(spark, tmp_path):
    vault = tmp_path / "vault"
    for name in ("a.md", "log/b.md", "sub/log/c.md", "sub/keep.md", "sub/drop.md", "x.sync-conflict-1.md", "in/sub/keep.md"):
        (vault / name).parent.mkdir(parents=True, exist_ok=True)
        (vault / name).write_text("x")
    (vault / ".gitignore").write_text("log/\ndrop.md\nkeep.md\n")
    (vault / "sub" / ".gitignore").write_text("!keep.md\n")
    paths = lambda **how: {r[0] for r in walk(spark, "1", str(vault), **how).select("path").collect()}
    assert paths() == {"a.md", "sub/keep.md"}
    assert paths(gitignores={}) == {"a.md", "log/b.md", "sub/log/c.md", "sub/keep.md", "sub/drop.md", "in/sub/keep.md"}
    assert "x.sync-conflict-1.md" in paths(ignore=[])


def test_outage_is_mended_by_the_next_scan(spark, tmp_path):
    (tmp_path / "vault").mkdir()
    for name in ("good", "bad"):
        (tmp_path / "vault" / f"{name}.md").write_text(f"# {name}\ntext of {name}\n")
    snapshots = Snapshots(spark, f"{tmp_path}/index")

    def picky(texts):
        if any("bad" in t for t in texts):
            raise Refused
        return hash_embedder(8)(texts)

    scan = lambda embed: ingest(snapshots, walk(spark, "1", str(tmp_path / "vault")), "t", embed, 8).first().asDict()
    made = lambda: {r["file_path"]: r["embedding"] is not None for r in snapshots.read("chunks").collect()}
    assert scan(picky)["inserted"] == 2 and made() == {"good.md": True, "bad.md": False}
    assert rescan(snapshots, walk(spark, "1", str(tmp_path / "vault")), "t", picky, 8).count() == 0  # refused again, but no change
    assert scan(hash_embedder(8))["skipped"] == 2 and made() == {"good.md": True, "bad.md": True}
    assert scan(hash_embedder(8))["skipped"] == 2 and not list((tmp_path / "index").glob(".staged*"))
    e = Engine(Catalog(VAULTS), snapshots.read("files"), snapshots.read("chunks"), embed=hash_embedder(4))
    for query in ("text", [1.0] * 5):
        with pytest.raises(EngineError, match="embedding_unavailable"):
            e.search_semantic(query)
    with pytest.raises(EngineError, match="invalid_request"):
        e.search_semantic("text", granularity="page")


def test_one_of_two_writers_fails(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1)], "vault string, x int")
    one, two = Snapshots(spark, f"{tmp_path}/s"), Snapshots(spark, f"{tmp_path}/s")
    one.commit({"t": rows})
    point = two._point

    def late(n, tables):
        one.commit({"t": rows.withColumn("vault", F.lit("w"))}, ["w"])
        return point(n, tables)

    two._point = late
    with pytest.raises(EngineError, match="conflict"):
        two.commit({"t": rows.withColumn("vault", F.lit("x"))}, ["x"])
    assert one.vaults("t") == ["v", "w"] and one.current() == 2


def test_filters(spark):
    df = spark.createDataFrame([(p,) for p in (".git/x.md", "build/a.md", "build/keep.md", "log/x.md", "a/log/y.md", "ok.md", ".obsidian/z.md", "n.sync-conflict-1.md")], "p string")
    got = {r[0]: (r[1], r[2]) for r in df.select("p", included(F.col("p"), ["build/**", "!**/keep.md"], {".gitignore": "log/\n!a/log/\n"}), watched(F.col("p"))).collect()}
    assert {p for p, x in got.items() if not x[0]} == {".git/x.md", "build/a.md", "log/x.md"}
    assert {p for p, x in got.items() if not x[1]} == {".git/x.md", ".obsidian/z.md", "n.sync-conflict-1.md"}


def test_diff_effects(spark):
    cols = "vault string, path string, size long, mtime string, content_hash string"
    disk = spark.createDataFrame([("v", "new", 1, "t", "a"), ("v", "same", 1, "t", "a"), ("v", "touched", 1, "t2", "a"), ("v", "changed", 2, "t2", "b"), ("v", "rebuild", 1, "t", "a")], cols)
    old = spark.createDataFrame([("v", "same", 1, "t", "a"), ("v", "touched", 1, "t", "a"), ("v", "changed", 1, "t", "a"), ("v", "rebuild", 1, "t", ""), ("v", "gone", 1, "t", "g")], cols)
    d = diff.scan_diff(disk, old)
    assert {r["path"]: r["effect"] for r in d.collect()} == {"new": "inserted", "same": "skipped", "touched": "hash_unchanged", "changed": "updated", "rebuild": "updated", "gone": "deleted"}
    ev = {r["path"]: (r["event_type"], r["content_hash"]) for r in changes.events(d, F.lit("now")).collect()}
    assert ev == {"new": ("created", "a"), "changed": ("modified", "b"), "rebuild": ("modified", "a"), "gone": ("deleted", "g")}
    assert {r["path"] for r in diff.stat_candidates(disk, old).collect()} == {"new", "touched", "changed", "rebuild"}


def test_translate_and_debounce(spark):
    ts = datetime.datetime(2026, 1, 1)
    raw = [("v", "rename", "both", ["a.md", "b.md"], ts), ("v", "rename", None, ["c.md"], ts), ("v", "modify", None, [".x/d.md"], ts), ("v", "access", None, ["e.md"], ts), ("v", "remove", None, ["f.md"], ts)]
    t = changes.translate(spark.createDataFrame(raw, "vault string, kind string, rename_mode string, paths array<string>, ts timestamp"))
    assert sorted((r["path"], r["action"]) for r in t.collect()) == [("a.md", "remove"), ("b.md", "upsert"), ("c.md", "upsert"), ("f.md", "remove")]
    whole = [("v", "modify", None, ["/n/a.md", "/n/log/b.md", "/n/.git/c.md", "/n2/d.md", "/n/x.sync-conflict-1.md"], ts), ("w", "modify", None, ["/n/e.md"], ts)]
    t = changes.translate(spark.createDataFrame(whole, "vault string, kind string, rename_mode string, paths array<string>, ts timestamp"), {"v": "/n"}, gitignores={".gitignore": "log/"})
    assert [(r["vault"], r["path"]) for r in t.collect()] == [("v", "a.md")]
    at = lambda ms: ts + datetime.timedelta(milliseconds=ms)
    burst = spark.createDataFrame([("v", "a.md", "upsert", at(0)), ("v", "a.md", "remove", at(400)), ("v", "a.md", "upsert", at(901)), ("v", "b.md", "upsert", at(0)), ("v", "b.md", "remove", at(500))], "vault string, path string, action string, ts timestamp")
    assert sorted((r["action"], r["merged"]) for r in changes.debounce(burst, "500 milliseconds").collect()) == [("remove", 2), ("remove", 2), ("upsert", 1)]
    assert changes.lagged("v", 5, 3)["missed"] == 2 and changes.lagged("v", 5, 5) is None


def test_stream_writes_index_before_events(spark, tmp_path):
    cols = "vault string, path string, action string, ts timestamp"
    ts = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([("v", "a.md", "upsert", ts), ("v", "b.md", "remove", ts), ("v", "c.md", "upsert", ts)], cols).write.parquet(f"{tmp_path}/in")
    meta = "vault string, path string, size long, mtime string, content_hash string"
    disk = spark.createDataFrame([("v", "a.md", 1, "t", "new")], meta)
    old = spark.createDataFrame([("v", "b.md", 1, "t", "b"), ("v", "c.md", 1, "t", "c")], meta)
    order, out = [], []

    def index(df, n):
        order.append("index")
        return changes.apply_batch(df, old, disk)

    def sink(ev, n):
        order.append("events")
        out.extend(ev.collect())

    q = changes.watch(spark.readStream.schema(cols).parquet(f"{tmp_path}/in"), index, sink, f"{tmp_path}/checkpoint")
    q.awaitTermination(60)
    assert order == ["index", "events"]
    assert {(r["path"], r["event_type"], r["content_hash"]) for r in out} == {("a.md", "created", "new"), ("b.md", "deleted", "b"), ("c.md", "deleted", "c")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {"path_glob", "content_regex", "knn_documents", "bm25_plain", "scan_diff"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
