import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.operators import content, paths, ranked, semantic

FILE = "vault string, path string, size long, mtime string, content_hash string, indexed_at string, content string"


def files(spark, rows, vault="v"):
    return spark.createDataFrame([(*(r[:2] if len(r) == 3 else (vault, r[0])), 1, "t", f"h{i}", "t", r[-1]) for i, r in enumerate(rows)], FILE)


def got(result):
    return [r["path"] for r in result.rows.collect()]


def test_paths(spark):
    f = files(spark, [(p, "") for p in ("notes/a.md", "notes/sub/b.md", "notesarchive/c.md", "top.md", "a/b/c/d.md")])
    assert got(paths.search_paths(f, prefix="notes")) == ["notes/a.md", "notes/sub/b.md"]
    assert got(paths.search_paths(f, max_depth=2)) == ["notes/a.md", "notesarchive/c.md", "top.md"]
    r = paths.search_paths(f, limit=2)
    assert len(got(r)) == 2 and r.truncated() and not paths.search_paths(f, limit=5).truncated()
    assert got(paths.search_paths(f, glob="notes/*.md")) == ["notes/a.md", "notes/sub/b.md"]
    for bad in (0, 1001):
        with pytest.raises(EngineError, match="invalid_request"):
            paths.search_paths(f, limit=bad)


def test_prefix_reaches_the_reader(spark, tmp_path):
    files(spark, [("a.md", "x")]).write.parquet(f"{tmp_path}/f")
    plan = paths.matching(spark.read.parquet(f"{tmp_path}/f"), prefix="notes")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(path,notes/)" in plan and "LessThan(path,notes0)" in plan
    assert "content:string" not in plan.split("ReadSchema")[-1]


def test_content(spark):
    f = files(spark, [("a", "Rye Bread"), ("b", "oats and barley"), ("c", "two loaves of RYE")])
    assert got(content.search_content(f, "rye")) == ["a", "c"]
    assert got(content.search_content(f, "RYE", case_sensitive=True)) == ["c"]
    assert got(content.search_content(f, "rye", mode="regex")) == [] and got(content.search_content(f, "r.e|barl?ey", regex=True)) == ["b"]
    assert got(content.search_content(f, "")) == []


def test_lines(spark):
    f = files(spark, [("a", "plum " * 7), ("b", "red\nblue\na kiln"), ("c", "warm oven\nbakes plum"), ("d", "thimble " + "z" * 300)])
    one = lambda q, **k: content.search_content(f, q, **k).rows.collect()[0]
    r = one("plum", max_matches_per_file=2)
    assert r["match_count"] == 7 and [m["line"] for m in r["matches"]] == [1, 1]
    assert [tuple(m) for m in one("kiln")["matches"]] == [(3, "a kiln")]
    assert [tuple(m) for m in one("oven\nbakes")["matches"]] == [(1, "warm oven")]
    assert len(one("thimble")["matches"][0]["text"]) == 240 and one("kiln", include_matches=False)["matches"] == []
    assert [tuple(m) for m in one("bl[a-v]e|k[a-z]ln", regex=True)["matches"]] == [(2, "blue"), (3, "a kiln")]
    assert [m["line"] for m in one("^", regex=True, prefix=None)["matches"]] == [1]


def test_modes():
    assert content.resolve_mode(None, True, False, "x") == content.resolve_mode("regex", False, False, "x") == "regex"
    for args in (("substring", True, False, "x"), ("ranked", False, True, "x"), ("what", False, False, "x")):
        with pytest.raises(EngineError, match="invalid_request"):
            content.resolve_mode(*args)
    with pytest.raises(EngineError, match="invalid_query"):
        content.resolve_mode("ranked", False, False, " ")


CORPUS = [("a.md", "The quick brown foxes were running over the lazy dogs"), ("b.md", "A fox runs; the dog sleeps. Running dogs bark at foxes and foxes"), ("c.md", "Café culture: running a café is hard work"), ("d.md", "nothing of note"), ("e.md", "lazy lazy dog over the quick fence quick brown"), ("f.md", "relational databases and vector search")]


@pytest.mark.parametrize("query", ["fox", "running dog", '"quick brown"', "cafe OR databases", "dog NOT fox", "data*", "NEAR(quick fence, 3)", "NEAR(fox dog, 1)", "(lazy OR cafe) AND running", "content: foxes", "the", "lazy AND quick OR vector", "café*", "running*", "NEAR(quick brown fence, 2)", "NEAR(lazy quick dog, 1)", "NEAR(foxes running dogs, 4)"])
def test_bm25_agrees_with_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, content, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?)", CORPUS)
    want = dict(db.execute("select path, bm25(t) from t where t match ?", (query,)).fetchall())
    mine = {r["path"]: r["score"] for r in ranked.bm25(ranked.porter_index(files(spark, CORPUS)), query).collect()}
    assert mine.keys() == want.keys() and all(math.isclose(mine[p], want[p], rel_tol=1e-9) for p in want)


def test_grammar_agrees_with_sqlite(spark):
    """Initial tokens, joined phrases and sets of columns: the same files, and the same queries refused."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, content, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?)", CORPUS)
    index = ranked.porter_index(files(spark, CORPUS))
    first = CORPUS[0][1].split()[:3]
    for query in (
        "a + b", "the + quick", f"^{first[0]}", f"^{first[1]}", f"^{first[0]} + {first[1]}", f'^"{first[0]} {first[1]}" {first[2]}', "{content} : fox", "{content path} : fox", "{path} : fox", "- content : fox", "- path : fox", "- {path} : fox",
        "content : ^the", "the + qui*", "the + quick + brown NOT dog", "content : (fox OR dog)", "^fox OR dog", "NEAR(^fox dog)", "+ fox", "fox +", "^", "{other} : fox", "- other : fox", "content : content : fox", "^^fox", "{content : fox",
    ):
        try:
            want = sorted(r[0] for r in db.execute("select path from t where t match ?", (query,)))
        except sqlite3.OperationalError:
            want = None
        try:
            got = sorted(r["path"] for r in ranked.bm25(index, query).collect())
        except EngineError:
            got = None
        assert got == want, query


def test_ranked_order_and_bad_queries(spark):
    index = ranked.porter_index(files(spark, CORPUS))
    rows = ranked.search_ranked(index, "fox", limit=2).rows.collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["score"] <= rows[1]["score"]
    for bad in ("foo-bar", "(a", "AND", '"'):
        with pytest.raises(EngineError, match="invalid_query"):
            ranked.bm25(index, bad)


def unit(*at):
    return [1.0 if i in at else 0.0 for i in range(8)]


def chunks(spark, rows):
    return spark.createDataFrame([("v", p, i, "A/B" if i else "", f"text {p} {i}", fh, v) for p, i, fh, v in rows], "vault string, file_path string, chunk_index int, heading_path string, content string, file_hash string, embedding array<float>")


def test_nearest(spark):
    c = chunks(spark, [("z.md", 0, "z", unit(0)), ("a.md", 1, "a", unit(0)), ("a.md", 0, "a", unit(0)), ("n.md", 0, "n", unit(1)), ("0.md", 0, "0", [0.0] * 8), ("1.md", 0, "1", None)])
    r = semantic.search_chunks(c, unit(0), limit=3)
    assert [(x["file_path"], x["chunk_index"], x["score"]) for x in r.rows.collect()] == [("a.md", 0, 1.0), ("a.md", 1, 1.0), ("z.md", 0, 1.0)] and r.truncated()
    assert semantic.search_chunks(c, unit(0), limit=5).rows.count() == 4
    assert [x["score"] for x in semantic.search_chunks(c, unit(0), limit=4, min_similarity=0.6).rows.collect()] == [1.0] * 3
    assert semantic.search_chunks(c, unit(0), limit=1, prefix="z.md").rows.count() == 0
    assert r.rows.collect()[0]["heading_path"] == [] and r.rows.collect()[1]["heading_path"] == ["A", "B"]


def test_documents(spark):
    rows = [("big.md", i, "b", unit(0)) for i in range(15)] + [(f"s{i}.md", 0, f"s{i}", unit(0, 1)) for i in range(9)]
    docs = semantic.search_documents(chunks(spark, rows), unit(0), limit=10).rows.collect()
    assert len(docs) == 10 and docs[0]["file_path"] == "big.md" and [c["chunk_index"] for c in docs[0]["chunks"]] == [0, 1, 2]
    with pytest.raises(EngineError):
        semantic.search_documents(chunks(spark, rows), unit(0), chunks_per_document=101)


def test_cut_of_all_vaults(spark):
    c = chunks(spark, [(f"{i}.md", 0, f"{i}", unit(0)) for i in range(7)])
    both = c.union(c.withColumn("vault", F.lit("w")))
    for search in (semantic.search_chunks, semantic.search_documents):
        r = search(both, unit(0), limit=10)
        assert r.rows.count() == 10 and r.truncated() and not search(both, unit(0), limit=15).truncated()


def test_hint(spark):
    c = chunks(spark, [("a.md", 0, "a", None)])
    assert [tuple(r) for r in semantic.building_hint(files(spark, [("a.md", "x")]), c).collect()] == [("v", True)]


def test_get(spark):
    f = files(spark, [("v1", "a.md", "x"), ("v2", "b.md", "y")])
    rows = content.get_content(f, ["v1", "v2"], ["./a.md"]).select("path", "vault", "content", F.col("error.code")).collect()
    assert [tuple(r) for r in rows] == [("a.md", "v1", "x", None), ("a.md", "v2", None, "path_not_found")]
