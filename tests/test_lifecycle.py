import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.embed import Refused, Unavailable, hash_embedder, in_batches
from quillspark.plans.catalog import Catalog, Vault
from quillspark.operators.diagnostics import debug_summary
from quillspark.plans.engine import Engine, ingest, rebuild, rescan, terminate
from quillspark.sources.embedding_http import http_embedder
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import follow_links, walk


@pytest.fixture
def two(tmp_path):
    for v, names in (("a", ("x", "y")), ("b/b", ("z",))):
        (tmp_path / v).mkdir(parents=True)
        for n in names:
            (tmp_path / v / f"{n}.md").write_text(f"# {n}\nwords of {n}\n")
    return tmp_path


def test_a_scan_touches_its_own_vault_alone(spark, two):
    s = Snapshots(spark, f"{two}/index")
    both = walk(spark, "1", f"{two}/a").unionByName(walk(spark, "v/2 %", f"{two}/b"))
    assert {r["vault"]: r["inserted"] for r in ingest(s, both, "t1").collect()} == {"1": 2, "v/2 %": 1}
    before = s.read("files", ["v/2 %"]).inputFiles()
    (two / "a" / "x.md").unlink()
    (two / "a" / "y.md").write_text("# y\nother words, more of them\n")
    ev = {r["path"]: (r["event_type"], r["vault"]) for r in rescan(s, walk(spark, "1", f"{two}/a"), "t2").collect()}
    assert ev == {"x.md": ("deleted", "1"), "y.md": ("modified", "1")}
    assert s.read("files").count() == 2 and s.read("files", ["v/2 %"]).inputFiles() == before and s.vaults("files") == ["1", "v/2 %"]
    # an emptied vault has to be named
    (two / "a" / "y.md").unlink()
    assert [r["deleted"] for r in ingest(s, walk(spark, "1", f"{two}/a"), "t3", vaults=["1"]).collect()] == [1]
    assert s.vaults("files") == ["v/2 %"] and s.read("files", ["1"]).count() == 0
    held = s.read("files").select("vault", "path", "content").collect()
    assert s.clean() > 0 and s.read("files").select("vault", "path", "content").collect() == held and s.clean() == 0


def test_rebuild_and_terminate(spark, two):
    s, c = Snapshots(spark, f"{two}/index"), Catalog([Vault("1", "one", f"{two}/a"), Vault("2", "two", f"{two}/b")])
    scan = lambda now: {r["vault"]: r["updated"] for r in ingest(s, walk(spark, "1", f"{two}/a").unionByName(walk(spark, "2", f"{two}/b")), now).collect()}
    scan("t1")
    chunks = s.read("chunks").count()
    rebuild(s, "1")
    assert s.vaults("chunks") == ["2"] and s.read("files").count() == 3
    assert scan("t2") == {"1": 2, "2": 0} and s.read("chunks").count() == chunks
    assert terminate(c, s, "two").id == "2" and s.vaults("files") == s.vaults("chunks") == ["1"] and (two / "b").exists()


def test_catalog_is_written_and_read(spark, tmp_path):
    c = Catalog([Vault("1", "one", "/a"), Vault("2", "two", "/b", status="errored", last_error="gone")])
    c.rows(spark).write.parquet(f"{tmp_path}/vaults")
    again = Catalog.load(spark.read.parquet(f"{tmp_path}/vaults"))
    assert again.list() == c.list() and again.subscribe() == ["1"] and again.subscribe("one") == ["1"]
    with pytest.raises(EngineError, match="vault_not_active"):
        again.subscribe("two")
    with pytest.raises(EngineError, match="vault_not_found"):
        again.subscribe("three")


def test_links_are_followed_inside_the_vault_only(spark, two):
    vault = two / "a"
    (vault / "sub [1]").mkdir()
    (vault / "sub [1]" / "w.md").write_text("w")
    (vault / "in.md").symlink_to(vault / "x.md")
    (vault / "circle").symlink_to(vault)
    (vault / "out").symlink_to(two / "b")
    (vault / "broken.md").symlink_to(two / "nowhere.md")
    got = follow_links(str(vault))
    assert (got.outside, got.errors) == (1, 1)
    assert sorted(r[0] for r in walk(spark, "1", str(vault)).select("path").collect()) == ["in.md", "sub [1]/w.md", "x.md", "y.md"]
    assert follow_links(str(two / "b")).files is None and follow_links("hdfs:///x").files is None


@pytest.fixture
def service():
    class Answers(BaseHTTPRequestHandler):
        calls: list = []
        script: list = []

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            self.calls.append(len(texts))
            code = self.script.pop(0) if self.script else 200 if len(texts) <= 2 else 413
            rows = [{"index": i, "embedding": v} for i, v in enumerate(hash_embedder(4)(texts))]
            body = json.dumps({"data": rows[::-1]}).encode() if code == 200 else b"{}"
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/embeddings", Answers
    server.shutdown()
    server.server_close()


def test_embedding_service(service):
    url, answers = service
    ask, texts = http_embedder(url, "m", timeout=5), [f"t{i}" for i in range(5)]
    assert in_batches(ask, texts, 4, batch=4, pause=0) == hash_embedder(4)(texts)
    assert answers.calls == [4, 2, 2, 1]
    answers.script[:] = [503]
    assert in_batches(ask, texts[:1], 4, pause=0) == hash_embedder(4)(texts[:1])
    answers.script[:] = [503, 503]
    with pytest.raises(EngineError, match="embedding_unavailable"):
        in_batches(ask, texts[:1], 4, pause=0)
    answers.script[:] = [400]
    with pytest.raises(Refused):
        in_batches(ask, texts[:1], 4, pause=0)
    with pytest.raises(EngineError, match="don't fit"):
        in_batches(ask, texts[:1], 5, pause=0)
    with pytest.raises(Unavailable):
        http_embedder("http://127.0.0.1:9/none", "m", timeout=1)(["x"])


def test_one_long_text_does_not_shrink_later_batches():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if "long" in texts and len(texts) > 1:
            raise Refused
        return [[1.0]] * len(texts)

    assert len(in_batches(embed, ["long", "a", "b", "c"], 1, batch=2)) == 4
    assert calls == [2, 1, 2, 1]


def test_no_snapshot(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/none")
    assert s.current() is None and s.vaults("files") == [] and s.clean() == 0
    with pytest.raises(EngineError, match="invalid_request"):
        s.read("files")
    s.commit({"t": spark.createDataFrame([("007", 1), ("x", 2)], "vault string, n int")})
    s.commit({"t": spark.createDataFrame([], "vault string, n int")}, ["x"])
    assert [tuple(r) for r in s.read("t").orderBy(F.col("n")).collect()] == [("007", 1)]


def test_debug_chunks(spark, two):
    (two / "a" / "code.md").write_text("# Code\n\n```python\nprint('a long line of code')\nprint('another one')\n```\n\n---\n\nAfter the rule.\n")
    (two / "b" / "b" / "x.md").write_text("x")
    s, c = Snapshots(spark, f"{two}/index"), Catalog([Vault("1", "one", f"{two}/a"), Vault("2", "two", f"{two}/b/b")])
    ingest(s, walk(spark, "1", f"{two}/a").unionByName(walk(spark, "2", f"{two}/b/b")), "t1")
    e = Engine(c, s.read("files"), s.read("chunks"))
    got = e.debug_chunks("code.md").rows
    rows = got.collect()
    assert [(r["started_by"], r["ended_by"], r["code_heavy"], r["warnings"], r["languages"]) for r in rows] == [("heading:h1", "thematic_break", True, ["code-heavy"], ["python"]), ("thematic_break", "document_end", False, [], [])]
    one = debug_summary(got).first()
    assert (one["chunks"], one["code_heavy"], one["break_boundaries"]) == (2, 1, 1)
    assert e.debug_chunks("code.md", "preview").rows.count() == 2
    assert {r["change"] for r in e.debug_chunks("code.md", "diff").rows.collect()} == {"same"}
    changed = Engine(c, s.read("files").withColumn("content", F.concat("content", F.lit("\n# More\n\ntext\n"))), s.read("chunks"))
    assert [r["change"] for r in changed.debug_chunks("code.md", "diff").rows.collect()] == ["same", "changed", "added"]
    assert [r["ended_by"] for r in changed.debug_chunks("code.md").rows.collect()] == ["thematic_break", "indexed_unknown"]
    for path, mode, code in (("x.md", "indexed", "invalid_request"), ("none.md", "indexed", "path_not_found"), ("code.md", "other", "invalid_request")):
        with pytest.raises(EngineError, match=code):
            e.debug_chunks(path, mode)
    assert e.debug_chunks("x.md", vaults=["two"]).rows.count() == 1
