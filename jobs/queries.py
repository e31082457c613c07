"""The jobs as registered queries: each runs twice into a new folder and gives what it has written, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import change_feed, search_index
from quillspark.sources.adapters import KINDS
from quillspark.sources.shared import new_folder

GAP_MS = 6 * 3600 * 1000


def job1_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "change-feed")
    for _ in range(2):
        change_feed.run(spark, f"{sf_dir}/events.parquet", f"{at}/out", f"{at}/checkpoint", gap_ms=GAP_MS)
    return change_feed.read(spark, f"{at}/out").withColumn("day", F.col("day").cast("string"))


def job2_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "search-index")
    for _ in range(2):
        search_index.run(spark, sf_dir, f"{at}/out", f"{at}/work")
    return search_index.read(spark, f"{at}/out")


QUERIES = {f.__name__: f for f in (job1_change_feed, job2_search_index)}

_ACTION = " ".join(f"when '{e}' then '{'remove' if k == 'remove' else 'upsert'}'" for e, k in KINDS.items())

ORACLES = {
    "job1_change_feed": f"""
with changes as (
  select 'v' || (user_id % 4) as vault, 'notes/user-' || user_id || '.md' as path, case event_type {_ACTION} end as action, ts, cast(ts as date) as day
  from events where user_id is not null and ts is not null),
told as (select *, lag(ts) over (partition by vault, path, day order by ts) as before from changes where action is not null),
numbered as (
  select *, sum(case when before is null or ts > before + interval {GAP_MS} milliseconds then 1 else 0 end) over (partition by vault, path, day order by ts rows unbounded preceding) as burst from told)
select vault, path, arg_max(action, (ts, action)) as action, count(*) as merged, min(ts) as first, max(ts) as last, cast(day as varchar) as day from numbered group by vault, path, day, burst""",
    "job2_search_index": """
with notes as (
  select lang as vault, 'notes/' || source || '/' || lpad(cast(doc_id as varchar), 8, '0') || '.md' as path, min(coalesce(text, '')) as content
  from documents where lang is not null and source is not null and doc_id is not null group by 1, 2),
worded as (select vault, path, 'live' as state, 'sha256:' || sha256(content) as content_hash, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') as words from notes)
select vault, path, state, content_hash, term, cast(count(*) as int) as tf, cast(null as bigint) as dl
from (select * exclude (words), unnest(words) as term from worded) group by all
union all select vault, path, state, content_hash, null, 0, cast(len(words) as bigint) from worded""",
}
