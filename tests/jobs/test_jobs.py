"""The jobs, by several runs over growing and changing copies of small tables."""

import datetime
import logging
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import change_feed, queries, search_index
from quillspark.operators import ranked
from quillspark.streaming.changes import bursts

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def files(folder):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


# --- the daily feed


@pytest.fixture(scope="module")
def arriving(spark):
    return spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").toPandas()


def feed_of(events, gap_ms):
    """The feed by walking through each note's day."""
    kinds, out, by = {"signup": "upsert", "click": "upsert", "purchase": "upsert", "error": "remove"}, [], {}
    for e in events.itertuples():
        if e.event_type in kinds and e.ts == e.ts:
            by.setdefault((e.user_id, e.ts.date()), []).append((e.ts.to_pydatetime(), kinds[e.event_type]))
    for (user, day), told in by.items():
        burst = []
        for t, action in [*sorted(told), (None, None)]:
            if burst and (t is None or t - burst[-1][0] > datetime.timedelta(milliseconds=gap_ms)):
                out.append({"vault": f"v{user % 4}", "path": f"notes/user-{user}.md", "action": burst[-1][1], "merged": len(burst), "first": burst[0][0], "last": burst[-1][0], "day": day})
                burst = []
            burst.append((t, action))
    return sorted(map(str, out))


def test_feed_takes_what_is_new_and_late(spark, arriving, tmp_path, caplog):
    caplog.set_level(logging.INFO, "change_feed")
    new, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    new.mkdir()
    arriving.iloc[::3].to_parquet(new / "a.parquet", coerce_timestamps="us")
    run = lambda: change_feed.run(spark, f"file://{new}", f"file://{out}", f"file://{mark}", gap_ms=3_600_000, files_per_batch=1)
    run()
    assert rows(change_feed.read(spark, f"file://{out}")) == feed_of(arriving.iloc[::3], 3_600_000)
    was = files(out)
    run()  # nothing new
    assert files(out) == was
    late = arriving[(arriving.ts < "2024-01-04") & (arriving.index % 3 != 0)]
    for i, part in enumerate((late.iloc[:20], late.iloc[20:])):
        part.to_parquet(new / f"b{i}.parquet", coerce_timestamps="us")
    run()
    whole = arriving[(arriving.index % 3 == 0) | arriving.index.isin(late.index)]
    assert rows(change_feed.read(spark, f"file://{out}")) == feed_of(whole, 3_600_000)
    kept = [f for f in was if "/feed/" in f and f.split("day=")[1][:10] >= "2024-01-04"]
    assert kept and all(files(out).get(f) == was[f] for f in kept)  # other days aren't written again
    assert "read" in caplog.text and "wrote" in caplog.text and len(os.listdir(mark / "commits")) >= 3


def test_feed_survives_a_batch_that_failed_half_way(spark, arriving, tmp_path, monkeypatch):
    new, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    new.mkdir()
    arriving.to_parquet(new / "a.parquet", coerce_timestamps="us")
    whole = change_feed._entries
    monkeypatch.setattr(change_feed, "_entries", lambda *a: 1 / 0)  # the log is written, the feed isn't
    args = (spark, f"file://{new}", f"file://{out}", f"file://{mark}", 60_000)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        change_feed.run(*args)
    monkeypatch.setattr(change_feed, "_entries", whole)
    change_feed.run(*args)
    assert rows(change_feed.read(spark, f"file://{out}")) == feed_of(arriving, 60_000)


def test_feed_of_odd_notifications(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 23, 59, 59, 900_000)
    told = [(1, at, 5, "click"), (2, at, 5, "error"), (3, at + datetime.timedelta(milliseconds=200), 5, "error"), (4, None, 5, "click"), (5, at, None, "click"), (6, at, 6, None), (7, at, 7, "view")]
    odd = spark.createDataFrame([(*t, "clash", "clash") for t in told], "event_id long, ts timestamp_ntz, user_id long, event_type string, day string, batch string")
    odd.write.parquet(f"file://{tmp_path}/in")
    change_feed.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark")
    got = [(r.path, r.action, r.merged, str(r.day)) for r in change_feed.read(spark, f"file://{tmp_path}/out").orderBy("day").collect()]
    assert got == [("notes/user-5.md", "upsert", 2, "2024-01-01"), ("notes/user-5.md", "remove", 1, "2024-01-02")]
    odd.where("event_type = 'view'").write.parquet(f"file://{tmp_path}/none")
    change_feed.run(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/out2", f"file://{tmp_path}/mark2")
    assert change_feed.read(spark, f"file://{tmp_path}/out2").count() == 0


def test_bursts_of_a_hot_note(spark):
    rng = random.Random(1)
    start, at = datetime.datetime(2024, 1, 1), []
    for _ in range(3000):
        at.append((at[-1] if at else 0) + rng.choice([0, 1, 499, 500, 501, 2000]))
    changes = spark.createDataFrame([("v", "hot.md", "upsert" if i % 2 else "remove", start + datetime.timedelta(milliseconds=t)) for i, t in enumerate(at)], "vault string, path string, action string, ts timestamp_ntz")
    want = [1]
    for a, b in zip(at, at[1:], strict=False):
        want = [*want, 1] if b - a > 500 else [*want[:-1], want[-1] + 1]
    assert [r.merged for r in bursts(changes, 500).orderBy("first").collect()] == want


# --- the search index


def documents(spark, path):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")


def test_index_follows_growing_and_changing_notes(spark, tmp_path):
    docs = documents(spark, tmp_path)
    out, work = f"file://{tmp_path}/out", f"file://{tmp_path}/work"
    put = lambda df, n: df.write.parquet(f"file://{tmp_path}/{n}/documents.parquet")
    run = lambda n, at=out: search_index.run(spark, f"file://{tmp_path}/{n}", at, work, slices=8)
    put(docs.where("doc_id % 2 = 0"), "one")
    assert run("one") == {"inserted": 100, "updated": 0, "hash_unchanged": 0, "skipped": 0, "deleted": 0}
    was = files(tmp_path / "out")
    assert run("one")["hash_unchanged"] == 100 and files(tmp_path / "out") == was
    change = F.when(F.col("doc_id") == 10, F.concat("text", F.lit(" the end"))).otherwise(F.col("text"))
    put(docs.where("doc_id % 2 = 0 and doc_id <> 20 or doc_id = 21").withColumn("text", change), "two")
    assert run("two") == {"inserted": 1, "updated": 1, "hash_unchanged": 98, "skipped": 0, "deleted": 1}
    now = files(tmp_path / "out")
    assert sum(f in now and now[f] == t for f, t in was.items()) >= len(was) - 6  # three slices at most, in two tables
    got = search_index.read(spark, out)
    assert [r.asDict() for r in got.where("state = 'deleted'").select("term", "tf", "dl").collect()] == [{"term": None, "tf": 0, "dl": None}]
    run("two", f"file://{tmp_path}/anew")
    assert rows(got.where("state = 'live'")) == rows(search_index.read(spark, f"file://{tmp_path}/anew"))
    put(docs.where("doc_id = 20"), "three")  # all others gone, one back
    assert run("three") == {"inserted": 1, "updated": 0, "hash_unchanged": 0, "skipped": 0, "deleted": 100}
    assert search_index.read(spark, out).where("state = 'live' and term is null").count() == 1


def test_index_answers_ranked_search_as_texts_do(spark, tmp_path):
    search_index.run(spark, SF, f"file://{tmp_path}/out", f"file://{tmp_path}/work", slices=3)
    from quillspark.sources import adapters

    stored, made = search_index.open_index(spark, f"file://{tmp_path}/out"), ranked.plain_index(adapters.files(spark, SF))
    for query in ('"of the" OR from', "th* NOT from"):
        assert rows(ranked.bm25(stored, query)) == rows(ranked.bm25(made, query))
    plan = ranked.bm25(stored, "the")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan


def test_index_after_a_run_that_failed_half_way(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path).write.parquet(f"file://{tmp_path}/in/documents.parquet")
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/work")
    with monkeypatch.context() as m:
        m.setattr(search_index, "_notes", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            search_index.run(*args)
    assert search_index.run(*args)["inserted"] == 200
    assert search_index.read(spark, args[2]).where("state is null").count() == 0


def test_index_of_odd_notes(spark, tmp_path):
    odd = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "Twice twice", "en", "s"), (3, "Another", "en", "s"), (3, "Twice twice", "en", "s"), (4, "no vault", None, "s"), (None, "no path", "en", "s"), (5, "é_1 " * 100_000, "fr", "s")]
    df = spark.createDataFrame([(*o, "clash", 7) for o in odd], "doc_id long, text string, lang string, source string, path string, slice int")
    df.write.parquet(f"file://{tmp_path}/in/documents.parquet")
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/work")
    assert search_index.run(*args)["inserted"] == 4 and search_index.run(*args)["hash_unchanged"] == 4
    got = {(r.path[-6:-3], r.term): (r.tf, r.dl) for r in search_index.read(spark, args[2]).collect()}
    assert got[("001", None)] == got[("002", None)] == (0, 0) and got[("005", "é")] == (100_000, None) and got[("005", None)] == (0, 200_000)
    assert {t for p, t in got if p == "003"} in ({None, "twice"}, {None, "another"}) and len(got) == 2 + 2 + 3
    df.where("false").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert search_index.run(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/out2", args[3])["inserted"] == 0
    assert search_index.read(spark, f"file://{tmp_path}/out2").count() == 0


# --- as registered, and from the command line


def test_registered_queries_leave_settings_as_they_were(spark):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert queries.job1_change_feed(spark, SF).count() > 0 and queries.job2_search_index(spark, SF).count() > 0
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before and not spark.streams.active


@pytest.mark.parametrize("job, keys", [("change_feed", ["out", "checkpoint"]), ("search_index", ["out", "work"])])
def test_command_line(job, keys, tmp_path):
    sets = [x for k in keys for x in ("--set", f"{k}=file://{tmp_path}/{k}")] + ["--set", f"source={SF}" + ("/events.parquet" if job == "change_feed" else "")]
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", f"jobs/{job}.toml", *sets], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]
        assert job in done.stderr
    assert any(f.endswith(".parquet") for f in files(tmp_path / "out"))


def test_index_is_read_back_without_moving_it_and_large_slices_are_several_files(spark, tmp_path, monkeypatch):
    docs = [(i, f"word{i} the the end", "en", "s", 1) for i in range(40)] + [(40, "", "en", "s", 0), (41, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(search_index, "NOTES_A_FILE", 5, raising=False)
    search_index.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/work", slices=1)
    got = search_index.read(spark, f"{tmp_path}/out")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = {(r.path[-5:-3], r.term): (r.state, r.tf, r.dl) for r in got.collect()}
    assert len(rows) == 40 * 4 + 2 and rows["07", "the"] == ("live", 2, None) and rows["07", None] == ("live", 0, 4) and rows["41", None] == ("live", 0, 0)
    assert len(list((tmp_path / "out/postings/vault=en/slice=0").glob("*.parquet"))) > 2
