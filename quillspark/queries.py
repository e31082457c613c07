"""The engine's own queries over the given tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chunker
from quillspark.functions.text import byte_truncate, closest_of
from quillspark.operators import content, diagnostics, diff, paths, ranked, semantic
from quillspark.operators.merge import per_vault
from quillspark.plans.catalog import Catalog, Vault
from quillspark.sources import adapters
from quillspark.sources.vaults import included, watched
from quillspark.streaming import changes, event_log, live

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
META = "path, size, content_hash, vault"
_FILES = f"""files as (
  select lang as vault, 'notes/' || source || '/' || lpad(cast(doc_id as varchar), 8, '0') || '.md' as path, cast(strlen(text) as bigint) as size,
    'sha256:' || sha256(text) as content_hash, text as content, translate(text, '{_UPPER}', '{_LOWER}') as folded from documents)"""
QUERIES, ORACLES = {}, {}
_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VAULTS = [Vault("de", "german", "/v/de"), Vault("en", "english", "/v/en"), Vault("es", "spanish", "/v/es", status="paused"), Vault("fr", "french", "/v/fr")]


def _query(sql: str | None = None, files: bool = True):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {_FILES} {sql}" if files else sql
        return f

    return put


def _meta(df: DataFrame) -> DataFrame:
    return df.select("path", "size", "content_hash", "vault")


# --- path search


@_query(f"select {META} from files order by path, vault limit 100")
def path_scan_limit(spark: SparkSession, sf: str) -> DataFrame:
    return _meta(paths.search_paths(adapters.files(spark, sf)).rows)


@_query(f"select {META} from files where path >= 'notes/src1/' and path < 'notes/src10'")
def path_prefix(spark, sf):
    return _meta(paths.matching(adapters.files(spark, sf), prefix="notes/src1"))


@_query(f"select {META} from files where regexp_full_match(path, '(?s)(?:.*/)?src1?[0-4]/.*[02468]\\.md')")
def path_glob(spark, sf):
    return _meta(paths.matching(adapters.files(spark, sf), glob="**/src{1,}[0-4]/*[02468].md"))


@_query(f"select {META} from files where len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 3")
def path_max_depth(spark, sf):
    return _meta(paths.matching(adapters.files(spark, sf), max_depth=3))


@_query(f"select {META} from files where regexp_full_match(path, 'notes/src5/.*5\\.md') order by path, vault limit 20")
def path_glob_literal_start(spark, sf):
    return _meta(paths.search_paths(adapters.files(spark, sf), glob="notes/src5/*5.md", limit=20).rows)


@_query("select vault, path, not regexp_matches(path, '^notes/src1[0-9]/') or regexp_matches(path, '7\\.md$') as included, path like '%.md' as watched from files")
def inclusion_filter(spark, sf):
    f = adapters.files(spark, sf)
    return f.select("vault", "path", included(F.col("path"), ["notes/src1[0-9]/**", "!**/*7.md"]).alias("included"), watched(F.col("path")).alias("watched"))


# --- content search

_COUNT = "cast((strlen(folded) - strlen(replace(folded, 'the ', ''))) // 4 as bigint)"


@_query(f"select {META}, {_COUNT} as match_count from files where contains(folded, 'the ') order by path, vault limit 100")
def content_substring_ci(spark, sf):
    r = content.search_content(adapters.files(spark, sf), "The ", include_matches=False)
    return r.rows.select("path", "size", "content_hash", "vault", "match_count")


@_query(f"select {META}, cast((strlen(content) - strlen(replace(content, 'The', ''))) // 3 as bigint) as match_count from files where contains(content, 'The')")
def content_substring_cs(spark, sf):
    return content.matching(adapters.files(spark, sf), "The", case_sensitive=True).select("path", "size", "content_hash", "vault", "match_count")


@_query(f"select {META}, cast(len(regexp_extract_all(content, '[tT]h[ea]\\w+ing')) as bigint) as match_count from files where regexp_matches(content, '[tT]h[ea]\\w+ing')")
def content_regex(spark, sf):
    return content.matching(adapters.files(spark, sf), r"[tT]h[ea]\w+ing", mode="regex").select("path", "size", "content_hash", "vault", "match_count")


@_query(f"select {META}, cast(len(regexp_extract_all(content, '^[A-Z][a-z]+ [a-z]+ of')) as bigint) as match_count from files where regexp_matches(content, '^[A-Z][a-z]+ [a-z]+ of')")
def content_regex_anchored(spark, sf):
    return content.matching(adapters.files(spark, sf), r"^[A-Z][a-z]+ [a-z]+ of", mode="regex").select("path", "size", "content_hash", "vault", "match_count")


@_query("""
, lines as (select vault, path, t.line, t.n from files, unnest(string_split(content, chr(10))) with ordinality as t(line, n)),
hits as (select vault, path, n, line, unnest(range((strlen(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) - strlen(replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licensed', ''))) // 8)) as k from lines),
r as (select *, row_number() over (partition by vault, path order by n, k) as i from hits)
select vault, path, cast(n as bigint) as line, line as text from r where i <= 5""")
def content_match_lines(spark, sf):
    m = content.matching(adapters.files(spark, sf), "licensed", include_matches=True)
    return m.select("vault", "path", F.explode("matches").alias("m")).select("vault", "path", "m.line", "m.text")


@_query("""
select v.vault, p.path, f.size, f.content_hash, case when f.path is null then 'path_not_found' end as error
from (values ('de'), ('en'), ('fr')) v(vault) cross join (values ('notes/src0/00000000.md'), ('notes/src1/00000001.md'), ('notes/none.md')) p(path)
left join files f on f.vault = v.vault and f.path = p.path""")
def content_get_batch(spark, sf):
    got = content.get_content(adapters.files(spark, sf), ["de", "en", "fr"], ["./notes//src0/00000000.md", "notes/src1/00000001.md", "notes/none.md"])
    return got.select("vault", "path", "size", "content_hash", F.col("error.code").alias("error"))


@_query("select page_id, url, cast((strlen(html) - strlen(replace(html, '<p>', ''))) // 3 as bigint) as match_count from pages where contains(html, '<p>')", files=False)
def content_html_bodies(spark, sf):
    f = adapters.table(spark, sf, "pages").select(F.lit("web").alias("vault"), F.col("url").alias("path"), F.col("html").alias("content"), F.col("page_id").alias("size"))
    return content.matching(f, "<p>", case_sensitive=True).select(F.col("size").alias("page_id"), F.col("path").alias("url"), "match_count")


@_query(f"select {META}, left(content, list_max(list_filter(range(0, 201), lambda k: strlen(left(content, k)) <= 200))) as text, strlen(content) > 200 as truncated from files")
def preview_truncate(spark, sf):
    return adapters.files(spark, sf).select("path", "size", "content_hash", "vault", byte_truncate(F.col("content"), 200).alias("text"), (F.octet_length("content") > 200).alias("truncated"))


# --- across vaults


@_query("select vault, count(*) as files from files where vault in ('de', 'en') group by vault")
def scope_filter(spark, sf):
    scope = Catalog(_VAULTS).scope(["english", "de", "es", "en"])
    return adapters.files(spark, sf).where(F.col("vault").isin([v.id for v in scope.run])).groupBy("vault").agg(F.count("*").alias("files"))


@_query("select why, t.vault, coalesce(n, 0) as files from (values ('es', 'vault is paused'), ('frensh', 'vault_not_found')) t(vault, why) left join (select vault, count(*) as n from files group by vault) f on t.vault = f.vault")
def scope_unknown(spark, sf):
    """Vaults that a request names and doesn't reach, why, and how many files it misses there."""
    scope = Catalog(_VAULTS).scope(["english", "spanish", "frensh"])
    lost = spark.createDataFrame([(x["vault"], x["reason"]) for x in scope.skipped] + [(x["vault"], x["code"]) for x in scope.failed], "vault string, why string")
    files = adapters.files(spark, sf).groupBy("vault").agg(F.count("*").alias("files"))
    return lost.join(files, "vault", "left").select("why", "vault", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


@_query(f"select {META} from (select *, row_number() over (partition by vault order by path) as i from files) where i <= 25 order by path, vault limit 60")
def merge_per_vault_cap(spark, sf):
    f = adapters.files(spark, sf)
    return _meta(per_vault(f.drop("content"), [F.col("path")], 25).orderBy("path", "vault").limit(60))


@_query("select vault, count(*) > 100 as truncated from files where contains(folded, 'en') group by vault")
def merge_truncated_flag(spark, sf):
    m = content.matching(adapters.files(spark, sf), "EN")
    return per_vault(m, [F.col("path")], 101).groupBy("vault").agg((F.count("*") > 100).alias("truncated"))


# --- semantic search

_CHUNKS = f"""with d as (
  select 'v' || (vec_id % 3) as vault, 'topic/' || label || '.md' as file_path, cast(vec_id as int) as chunk_index,
    1 - list_cosine_similarity(cast(embedding as double[]), {_VECTOR}) as distance from embeddings),
s as (select *, greatest(0.0, least(1.0, 1 - distance / 2)) as score, row_number() over (partition by vault order by distance, file_path, chunk_index) as i from d)"""
_HIT = "vault, file_path, chunk_index, round(score, 6) as score"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("vault", "file_path", "chunk_index", F.round("score", 6).alias("score"))


@_query(f"{_CHUNKS} select {_HIT} from s where i <= 10 order by s.score desc, vault, file_path, chunk_index limit 10", files=False)
def knn_chunks(spark, sf):
    return _hits(semantic.search_chunks(adapters.vectors(spark, sf), _VECTOR, include="none").rows)


@_query(f"{_CHUNKS} select {_HIT} from s where i <= 50 and s.score >= 0.6", files=False)
def knn_min_similarity(spark, sf):
    return _hits(semantic.nearest(adapters.vectors(spark, sf), _VECTOR, 50, min_similarity=0.6)[0])


_EVEN = _CHUNKS.replace("'topic/' || label", "case when vec_id % 2 = 0 then 'topic/even/' else 'topic/' end || label")


@_query(f"{_EVEN} select {_HIT} from s where i <= 40 and file_path >= 'topic/even/' and file_path < 'topic/even0'", files=False)
def knn_prefix_postfilter(spark, sf):
    folder = F.when(F.col("chunk_index") % 2 == 0, F.replace("file_path", F.lit("topic/"), F.lit("topic/even/"))).otherwise(F.col("file_path"))
    return _hits(semantic.nearest(adapters.vectors(spark, sf).withColumn("file_path", folder), _VECTOR, 40, prefix="topic/even")[0])


_DOCS = "docs as (select vault, file_path, max(score) as best from s where i <= 100 group by all order by best desc, vault, file_path limit 10)"


@_query(f"{_CHUNKS}, {_DOCS} select vault, file_path, round(best, 6) as score from docs", files=False)
def knn_documents(spark, sf):
    return semantic.search_documents(adapters.vectors(spark, sf), _VECTOR, include="none").rows.select("vault", "file_path", F.round("score", 6).alias("score"))


@_query(f"{_CHUNKS}, {_DOCS}, e as (select s.*, row_number() over (partition by vault, file_path order by score desc, chunk_index) as j from s join docs using (vault, file_path) where i <= 100) select {_HIT} from e where j <= 3", files=False)
def knn_evidence_topn(spark, sf):
    rows = semantic.search_documents(adapters.vectors(spark, sf), _VECTOR, include="none").rows
    return _hits(rows.select("vault", "file_path", F.explode("chunks").alias("c")).select("vault", "file_path", "c.chunk_index", "c.score"))


@_query("select vault, vault = 'v1' as building from (select distinct 'v' || (vec_id % 3) as vault from embeddings)", files=False)
def knn_building_hint(spark, sf):
    c = adapters.vectors(spark, sf)
    return semantic.building_hint(c.select("vault"), c.withColumn("embedding", F.when(F.col("vault") != "v1", F.col("embedding"))))


# --- ranked search


@_query("""
, tokens as (select vault, path, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) as term from files),
stats as (select vault, count(*) as docs, avg(dl) as avgdl from (select vault, path, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) as dl from files) group by vault),
lengths as (select vault, path, count(*) as dl from tokens group by all),
tf as (select vault, path, term, count(*) as tf from tokens where term in ('the', 'from') group by all),
n as (select vault, term, count(*) as n from tf group by all),
scored as (
  select vault, path, -sum(case when ln((docs - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((docs - n + 0.5) / (n + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score, count(*) as terms
  from tf join n using (vault, term) join stats using (vault) join lengths using (vault, path) group by all)
select vault, path, round(score, 9) as score from scored where terms = 2""")
def bm25_plain(spark, sf):
    return ranked.bm25(ranked.plain_index(adapters.files(spark, sf)), "the from").select("vault", "path", F.round("score", 9).alias("score"))


# the words whose stems the query asks for: of, the, trash, and what begins with stupid
_STEM = """case when regexp_full_match(term, '(?:of|trash)(?:e|s|es|ed|ing|ings|eds|ness|ful)?') then if(term[1] = 'o', 'of', 'trash') when term in ('the', 'thes', 'theing', 'theings') then 'the' when starts_with(term, 'stupid') then 'stupid' end"""
_PART = "coalesce(-case when ln((docs - n{0} + 0.5) / (n{0} + 0.5)) <= 0 then 1e-6 else ln((docs - n{0} + 0.5) / (n{0} + 0.5)) end * c{0} * 2.2 / (c{0} + 1.2 * (0.25 + 0.75 * dl / avgdl)), 0)"


@_query(f"""
, tokens as (select vault, path, t.term, t.pos from files, unnest(regexp_extract_all(lower(strip_accents(content)), '[\\p{{L}}\\p{{N}}]+')) with ordinality as t(term, pos)),
stems as (select vault, path, pos, {_STEM} as stem from tokens),
pairs as (select *, lead(stem) over (partition by vault, path order by pos) as after from stems),
counted as (
  select f.vault, f.path, coalesce(max(dl), 0) as dl, coalesce(max(c0), 0) as c0, coalesce(max(c1), 0) as c1, coalesce(max(c2), 0) as c2 from files f left join (
    select vault, path, count(*) as dl, count(*) filter (stem = 'of' and after = 'the') as c0, count(*) filter (stem = 'stupid') as c1, count(*) filter (stem = 'trash') as c2 from pairs group by all) using (vault, path) group by all),
stats as (select vault, count(*) as docs, avg(dl) as avgdl, count(*) filter (c0 > 0) as n0, count(*) filter (c1 > 0) as n1, count(*) filter (c2 > 0) as n2 from counted group by vault),
scored as (select vault, path, {_PART.format(0)} + {_PART.format(1)} + {_PART.format(2)} as score from counted join stats using (vault) where c0 > 0 or (c1 > 0 and c2 = 0)),
best as (select * from scored order by score, path, vault limit 50)
select vault, path, round(score, 9) as score, cast(row_number() over (order by best.score, path, vault) as int) as rank from best""")
def bm25_porter(spark, sf):
    return ranked.search_ranked(ranked.porter_index(adapters.files(spark, sf)), '"of the" OR stupid* NOT trash', limit=50).rows.withColumn("score", F.round("score", 9))


# --- ingest, chunks, diagnostics, status

_SCAN = """
, old as (select vault, path, size, content_hash, row_number() over (order by path, vault) as r from files where size % 7 <> 0),
disk as (select vault, path, case when size % 5 = 0 then size + 1 else size end as size, case when size % 5 = 0 and size % 2 = 0 then content_hash || 'x' else content_hash end as content_hash from files where size % 11 <> 0),
j as (select coalesce(d.vault, o.vault) as vault, coalesce(d.path, o.path) as path,
  case when o.path is null then 'inserted' when d.path is null then 'deleted' when d.size = o.size then 'skipped' when d.content_hash = o.content_hash then 'hash_unchanged' else 'updated' end as effect, coalesce(d.content_hash, o.content_hash) as content_hash
  from disk d full outer join old o on d.vault = o.vault and d.path = o.path)"""


def _listings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The documents as a folder's listing, and as an index that differs from it."""
    f = adapters.files(spark, sf).drop("content", "indexed_at")
    old = f.where("size % 7 <> 0")
    disk = f.where("size % 11 <> 0").withColumn("content_hash", F.expr("if(size % 5 = 0 and size % 2 = 0, concat(content_hash, 'x'), content_hash)")).withColumn("size", F.expr("if(size % 5 = 0, size + 1, size)"))
    return disk, old


def _scan(spark, sf) -> DataFrame:
    return diff.scan_diff(*_listings(spark, sf))


@_query(f"{_SCAN} select vault, path, effect from j")
def scan_diff(spark, sf):
    return _scan(spark, sf).select("vault", "path", "effect")


@_query(f"{_SCAN} select vault, count(*) filter (effect = 'inserted') as inserted, count(*) filter (effect = 'updated') as updated, count(*) filter (effect = 'hash_unchanged') as hash_unchanged, count(*) filter (effect = 'skipped') as skipped, count(*) filter (effect = 'deleted') as deleted from j group by vault")
def scan_report(spark, sf):
    return diff.report(_scan(spark, sf))


@_query(f"{_SCAN} select 'file_changed' as type, case effect when 'inserted' then 'created' when 'updated' then 'modified' else 'deleted' end as event_type, vault, path, content_hash from j where effect in ('inserted', 'updated', 'deleted')")
def change_events(spark, sf):
    return changes.events(_scan(spark, sf), F.lit("2026-01-01T00:00:00.000000Z")).select("type", "event_type", "vault", "path", "content_hash")


# the texts of the given tables are one paragraph each, so they are one chunk
@_query("select vault, path as file_path, 0 as chunk_index, cast(0 as bigint) as start_byte, size as end_byte, 'document_start' as started_by, 'document_end' as ended_by from files where regexp_matches(content, '\\S')")
def chunk_documents(spark, sf):
    return chunker.chunk_files(adapters.files(spark, sf)).select("vault", "file_path", "chunk_index", "start_byte", "end_byte", "started_by", "ended_by")


@_query("""
, pieces as (
  select vault, path, t.i, len(string_split(content, chr(10))) as n, t.line,
    case when t.i > 1 then '## part' || chr(10) else '' end || t.line || case when t.i < len(string_split(content, chr(10))) then chr(10) else '' end as piece
  from files, unnest(string_split(content, chr(10))) with ordinality as t(line, i)),
placed as (select *, cast(sum(strlen(piece)) over (partition by vault, path order by i) as bigint) as end_byte from pieces)
select vault, path as file_path, cast(i - 1 as int) as chunk_index, cast(end_byte - strlen(piece) as bigint) as start_byte, end_byte, 'sha256:' || sha256(piece) as content_hash,
  case when i = 1 then '' else '/part' end as heading_path, case when i = 1 then 'document_start' else 'heading:h2' end as started_by,
  case when i = n then 'document_end' when strlen(piece) > 2000 and line <> '' then 'size_after_block' else 'heading:h2' end as ended_by
from placed where regexp_matches(piece, '\\S')""")
def chunk_headings(spark, sf):
    """Chunks of notes with a heading between each two lines."""
    f = adapters.files(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n## part\n")))
    return chunker.chunk_files(f).select("vault", "file_path", "chunk_index", "start_byte", "end_byte", "content_hash", "heading_path", "started_by", "ended_by")


@_query("select 'conv/' || conv_id || '.md' as file_path, count(*) as chunks, cast(min(strlen(text)) as bigint) as min_bytes, cast(max(strlen(text)) as bigint) as max_bytes, round(avg(strlen(text)), 6) as avg_bytes, count(*) filter (strlen(text) > 3200) as oversized from conversations group by conv_id", files=False)
def chunk_summary(spark, sf):
    return diagnostics.chunk_summary(adapters.turns(spark, sf)).select("file_path", "chunks", "min_bytes", "max_bytes", F.round("avg_bytes", 6).alias("avg_bytes"), "oversized")


@_query("""
with a as (select * from conversations where turn % 4 <> 3), b as (select conv_id, turn, case when turn % 3 = 1 then text || '!' else text end as text from conversations where turn % 5 <> 4)
select 'conv/' || coalesce(a.conv_id, b.conv_id) || '.md' as file_path, cast(coalesce(a.turn, b.turn) as int) as chunk_index,
  case when a.turn is null then 'added' when b.turn is null then 'removed' when a.text is not distinct from b.text then 'same' else 'changed' end as change
from a full outer join b on a.conv_id = b.conv_id and a.turn = b.turn""", files=False)
def chunk_diff(spark, sf):
    t = adapters.turns(spark, sf)
    new = t.where("chunk_index % 5 <> 4").withColumn("content_hash", F.expr("if(chunk_index % 3 = 1, concat(content_hash, '!'), content_hash)"))
    return diagnostics.chunk_diff(t.where("chunk_index % 4 <> 3"), new).drop("vault")


@_query("select vault, count(*) as files, '2026-01-01T00:00:00.000000Z' as last_indexed from files group by vault")
def vault_status(spark, sf):
    return diagnostics.status(adapters.files(spark, sf))


@_query("""
with e as (select user_id, event_type, ts, event_id, lag(ts) over (partition by user_id order by ts) as before from events),
g as (select *, sum(case when before is null or ts > before + interval 6 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as burst from e)
select user_id, count(*) as merged, max(ts) as ts from g group by user_id, burst""", files=False)
def change_debounce(spark, sf):
    e = adapters.table(spark, sf, "events").select("user_id", F.col("event_type"), F.col("ts").cast("timestamp").alias("ts"))
    return changes.debounce(e, "6 hours", ["user_id"], "event_type").select("user_id", "merged", F.col("ts").cast("timestamp_ntz").alias("ts"))


@_query("select user_id, arg_max(event_id, (ts, event_id)) as last_event, count(*) as changes from events group by user_id", files=False)
def change_fold(spark, sf):
    e = adapters.table(spark, sf, "events")
    return changes.fold(e, ["user_id"], "event_id", ["ts", "event_id"]).withColumnRenamed("event_id", "last_event")


@_query("select n_name as wanted, (select arg_min(r_name, (levenshtein(n_name, r_name), r_regionkey)) from region where levenshtein(n_name, r_name) <= 6) as closest from nation", files=False)
def closest_name(spark, sf):
    known = [r[0] for r in adapters.table(spark, sf, "region").orderBy("r_regionkey").select("r_name").collect()]  # a catalog's few names
    return adapters.table(spark, sf, "nation").select(F.col("n_name").alias("wanted"), closest_of(F.col("n_name"), known, 6).alias("closest"))


# --- live changes

_COPIES = ["notes/a.sync-conflict-1.md", "(conflicted copy).md", "my conflicted copy) x.md", "my conflicted copy notes.md", ".hidden.md", "x.txt"]


@_query(f"""
select vault, p || n as path, n not in ('/.hidden.md', '/x.txt') and not contains(n, '.sync-conflict-') and not contains(n, '(conflicted copy') and not contains(n, 'conflicted copy)') as watched
from (select vault, path as p from files), (select unnest([{', '.join(f"'/{c}'" for c in _COPIES)}]) as n)""")
def watch_filter(spark, sf):
    f = adapters.files(spark, sf)
    path = F.explode(F.array(*[F.concat("path", F.lit("/" + c)) for c in _COPIES]))
    return f.select("vault", path.alias("path")).select("vault", "path", watched(F.col("path")).alias("watched"))


@_query(f"{_SCAN} select vault, path, case effect when 'deleted' then 'remove' else 'upsert' end as action from j where effect <> 'skipped'")
def watch_notifications(spark, sf):
    disk, old = _listings(spark, sf)
    return live.notifications(disk.drop("content_hash"), old)


@_query(f"{_SCAN} select vault, path, effect, content_hash from j where effect <> 'skipped'")
def watch_effects(spark, sf):
    """What the notifications of a folder do to its index: only the files they name are compared."""
    disk, old = _listings(spark, sf)
    told = live.notifications(disk.drop("content_hash"), old).withColumn("ts", F.lit(0))
    return changes.apply_batch(told, old, disk).select("vault", "path", "effect", F.coalesce("content_hash", "previous_hash").alias("content_hash"))


@_query("""
with log as (select event_id + 1 as seq, user_id, event_type from events), n as (select max(seq) as newest from log), f as (select greatest(5, newest - 256) as first from n)
select seq, 'file_changed' as type, 'notes/user-' || user_id || '.md' as path, cast(null as bigint) as missed, cast(null as varchar) as action from log, f where seq > first
union all select first, 'stream_lagged', null, first - 5, 'resync_required' from f where first > 5""", files=False)
def event_log_lag(spark, sf):
    """What a reader gets that has had 5 of all events, from a log that is read back 256 events."""
    none = F.lit(None).cast("string")
    log = adapters.table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.lit("file_changed").alias("type"), F.lit("modified").alias("event_type"), F.concat(F.lit("notes/user-"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        none.alias("content_hash"), none.alias("detected_at"), F.lit("v").alias("vault"),
    )
    return event_log.after(log, {"v": 5}).select("seq", "type", "path", "missed", "action")


@_query(f"""
, e as (select *, row_number() over (partition by vault, path, before order by ts) as i from (select *, sum(starts) over (partition by vault, path order by ts rows unbounded preceding) as before from (
  select *, case when lag(ts) over w is null or ts > lag(ts) over w + interval 6 hours then 1 else 0 end as starts from (
    select 'v' || (user_id % 4) as vault, 'notes/user-' || user_id || '.md' as path, case event_type when 'error' then 'remove' else 'upsert' end as action, ts from events where event_type in ('signup', 'click', 'purchase', 'error')) window w as (partition by vault, path order by ts))))
select vault, path, arg_max(action, ts) as action, count(*) as merged from e group by vault, path, before""")
def watch_bursts(spark, sf):
    e = changes.translate(adapters.notifications(adapters.table(spark, sf, "events")))
    return changes.bursts(e, 6 * 3600 * 1000).select("vault", "path", "action", "merged")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Files that contain 'the ' in all active vaults below a prefix, in the order of paths, with counts of matches."""
    scope = Catalog(_VAULTS).scope()
    f = adapters.files(spark, sf).where(F.col("vault").isin([v.id for v in scope.run]))
    return content.search_content(f, "the ", prefix="notes", include_matches=False).rows


__all__ = ["ORACLES", "QUERIES", "flagship"]
