"""The engine: one door to searches over the vaults of a catalog, and to their ingest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.chunker import chunk_files
from quillspark.functions.embed import Embedder, embed_chunks, in_batches
from quillspark.operators import content, diagnostics, diff, paths, ranked, semantic
from quillspark.operators.merge import Result
from quillspark.plans.catalog import Catalog, Scope, Vault
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import TIME, walk
from quillspark.streaming.changes import events

FILES = ["vault", "path", "size", "mtime", "content_hash", "indexed_at", "content"]


@dataclass
class Engine:
    """files: vault (an id), path, size, mtime, content_hash, indexed_at, content. chunks: what search_chunks reads.

    index: what ranked search reads, as stored_index gives it; without one it's made from the texts for each query.
    """

    catalog: Catalog
    files: DataFrame
    chunks: DataFrame | None = None
    index: ranked.Index | None = None
    embed: Embedder | None = None

    def _scoped(self, df: DataFrame, vaults: list[str] | None) -> tuple[DataFrame, Scope]:
        """Rows of the vaults in scope: a predicate on the partition column, so others aren't read."""
        scope = self.catalog.scope(vaults)
        names = F.create_map(*[F.lit(x) for v in scope.run for x in (v.id, v.name)]) if scope.run else None
        own = df.where(F.col("vault").isin([v.id for v in scope.run]))
        return (own.withColumn("vault_name", names[F.col("vault")]) if names is not None else own.withColumn("vault_name", F.lit(None).cast("string"))), scope

    def _run(self, df: DataFrame, vaults: list[str] | None, search: Callable[[DataFrame], Result]) -> Result:
        own, scope = self._scoped(df, vaults)
        return replace(search(own), partial=scope.partial())

    def answer(self, ask: Callable[[list[str] | None], Result], vaults: list[str] | None = None) -> tuple[list[dict], dict]:
        """The rows of a search (a function of vaults that gives a Result), and which vaults it couldn't reach.

        If the search fails, each vault is asked by itself; those whose index can't be read are named as failed, and the
        others answer. Errors in the request itself are raised. Results are bounded by the search's limit.
        """
        rows = lambda r: [x.asDict(recursive=True) for x in r.rows.collect()]
        try:
            got = ask(vaults)
            return rows(got), got.partial
        except (PySparkException, Py4JJavaError):
            scope, good, lost = self.catalog.scope(vaults), [], []
        for v in scope.run:
            try:
                rows(ask([v.id]))
                good.append(v.id)
            except (PySparkException, Py4JJavaError) as e:
                lost.append({"vault": v.id, "code": "storage_error", "message": " ".join(str(e).split())[:200]})
        partial = {"skipped": scope.skipped, "failed": [*scope.failed, *lost]}
        return (rows(ask(good)) if good else []), partial

    def search_paths(self, vaults: list[str] | None = None, **query) -> Result:
        return self._run(self.files, vaults, lambda f: paths.search_paths(f, **query))

    def search_content(self, query: str, vaults: list[str] | None = None, mode: str | None = None, prefix: str | None = None, limit: int = 100, **how) -> Result:
        if content.resolve_mode(mode, how.get("regex", False), how.get("case_sensitive", False), query) != "ranked":
            return self._run(self.files, vaults, lambda f: content.search_content(f, query, mode=mode, prefix=prefix, limit=limit, **how))

        def search(files: DataFrame) -> Result:
            if self.index is None:
                return ranked.search_ranked(ranked.porter_index(files), query, prefix, limit)
            index, keep = self.index, [v.id for v in self.catalog.scope(vaults).run]
            own = ranked.Index(index.postings.where(F.col("vault").isin(keep)), index.files.where(F.col("vault").isin(keep)), index.stemmed)
            return ranked.search_ranked(own, query, prefix, limit)

        return self._run(self.files, vaults, search)

    def search_semantic(self, query: str | list[float], vaults: list[str] | None = None, granularity: str = "document", **how) -> Result:
        searches = {"document": semantic.search_documents, "chunk": semantic.search_chunks}
        if granularity not in searches:
            raise EngineError("invalid_request", f"unknown granularity {granularity!r}")
        if self.chunks is None or isinstance(query, str) and self.embed is None:
            raise EngineError("embedding_unavailable", "there are no vectors, or nothing to embed the query with")
        stored = self.chunks.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
        dims = stored[0] if stored else None
        if isinstance(query, str):
            vector = in_batches(self.embed, [query], dims)[0]
        else:
            vector = query
        if dims is not None and len(vector) != dims:
            raise EngineError("embedding_unavailable", f"the query has {len(vector)} dimensions, the index {dims}")
        search = searches[granularity]
        out = self._run(self.chunks, vaults, lambda c: search(c, vector, **how))
        if not out.rows.take(1):
            hints = semantic.building_hint(self._scoped(self.files, vaults)[0], self._scoped(self.chunks, vaults)[0])
            state = hints.agg(F.count("*"), F.count_if("building")).first()
            if state[0] and state[0] == state[1]:
                out = replace(out, hint=semantic.BUILDING)
        return out

    def get(self, wanted: list[str], vaults: list[str] | None = None) -> Result:
        own, scope = self._scoped(self.files, vaults)
        return Result(content.get_content(own, [v.id for v in scope.run], wanted), partial=scope.partial())

    def debug_chunks(self, path: str, mode: str = "indexed", vaults: list[str] | None = None) -> Result:
        """How one file is cut: its indexed chunks with their boundaries, a preview of a new cut, or the difference.

        Just one vault in scope may have the path.
        """
        if mode not in ("indexed", "preview", "diff"):
            raise EngineError("invalid_request", f"unknown mode {mode!r}")
        own, scope = self._scoped(self.files, vaults)
        vault = diagnostics.owner(own, path)
        new = chunk_files(own.where((F.col("vault") == vault) & (F.col("path") == path)))
        if mode == "preview":
            return Result(diagnostics.diagnosed(new).orderBy("chunk_index"), partial=scope.partial())
        old = self.chunks.where((F.col("vault") == vault) & (F.col("file_path") == path)).drop("embedding").withColumnRenamed("chunk_hash", "content_hash")
        if mode == "diff":
            return Result(diagnostics.chunk_diff(old, new).orderBy("chunk_index"), partial=scope.partial())
        return Result(diagnostics.diagnosed(diagnostics.annotate(old, new)).orderBy("chunk_index"), partial=scope.partial())


def stored_index(snapshots: Snapshots, vaults: list[str] | None = None) -> ranked.Index:
    """The postings that scans have stored, sorted by term within each vault."""
    return ranked.Index(snapshots.read("postings", vaults), snapshots.read("lengths", vaults), True)


def ingest(snapshots: Snapshots, disk: DataFrame, now: str, embed: Embedder | None = None, dims: int = 64, vaults: list[str] | None = None) -> DataFrame:
    """Brings the snapshot up to what is on disk (vault, path, size, mtime, content_hash, content); the diff's report.

    vaults: those that disk is a listing of, by default those that it has files of; others are neither read nor
    written. Chunks, postings and vectors are made for new and changed files only. A file whose vectors can't be made stays
    searchable by path and content, with null vectors, and the next scan with an embedder makes it anew.
    """
    return diff.report(_ingest(snapshots, disk, now, embed, dims, vaults))


def _ingest(snapshots: Snapshots, disk: DataFrame, now: str, embed: Embedder | None, dims: int, vaults: list[str] | None) -> DataFrame:
    """ingest, and the diff as it was when the scan began."""
    spark = snapshots.spark
    own = [r[0] for r in disk.select("vault").distinct().collect()] if vaults is None else vaults  # names of vaults
    if snapshots.current() is None:
        files = spark.createDataFrame([], disk.select("vault", "path", "size", "mtime", "content_hash").schema).withColumn("indexed_at", F.lit("")).withColumn("content", F.lit(""))
        chunks = index = None
    else:
        files, chunks = snapshots.read("files", own).select(*FILES), snapshots.read("chunks", own)
        index = stored_index(snapshots, own)
    with snapshots.staged(disk.where(F.col("vault").isin(own))) as disk:  # read once: a later look could find other bytes
        return _apply(snapshots, disk, files, chunks, index, now, embed, dims, own)


def _apply(snapshots: Snapshots, disk: DataFrame, files: DataFrame, chunks: DataFrame | None, index: ranked.Index | None, now: str, embed: Embedder | None, dims: int, own: list[str]) -> DataFrame:
    """Commits what the diff between disk and files calls for, and gives that diff."""
    changes = diff.scan_diff(disk, files)
    anew = changes.where(F.col("effect").isin("inserted", "updated")).select("vault", "path")
    gone = changes.where(F.col("effect").isin("inserted", "updated", "deleted")).select("vault", F.col("path").alias("file_path"))
    if embed and chunks is not None:  # files whose vectors couldn't be made are tried again, which isn't a change
        open_ = chunks.where(F.col("embedding").isNull()).select("vault", "file_path").distinct()
        anew, gone = anew.unionByName(open_.withColumnRenamed("file_path", "path")).distinct(), gone.unionByName(open_).distinct()
    fresh = disk.join(anew, ["vault", "path"], "left_semi")
    made = chunk_files(fresh).withColumnRenamed("content_hash", "chunk_hash")
    made = embed_chunks(made, embed, dims) if embed else made.withColumn("embedding", F.lit(None).cast("array<float>"))
    kept = made if chunks is None else chunks.select(*made.columns).join(gone, ["vault", "file_path"], "left_anti").unionByName(made)
    with snapshots.staged(ranked.porter_rows(fresh)) as rows:  # read for the postings and for the lengths
        postings, lengths = ranked.postings_of(rows), ranked.lengths_of(rows)
        if index is not None:
            other = gone.withColumnRenamed("file_path", "path")
            postings = index.postings.join(other, ["vault", "path"], "left_anti").select(*postings.columns).unionByName(postings)
            lengths = index.files.join(other, ["vault", "path"], "left_anti").unionByName(lengths)
        new = {"files": diff.apply_diff(files, disk, changes, now).select(*FILES), "chunks": kept, "postings": postings, "lengths": lengths, "changes": changes}
        snapshots.commit(new, own, {"postings": ["term", "path"]})
    return snapshots.read("changes", own)


def update(snapshots: Snapshots, vault: str, contents: DataFrame, removed: DataFrame, now: str, embed: Embedder | None = None, dims: int = 64) -> DataFrame:
    """Brings a vault's index up to what some of its files hold now (as `ingest` has them) and without those removed
    (path); no other file is looked at. Doing it again changes nothing."""
    known = [vault] if snapshots.current() is not None else None
    if known is None:
        return diff.report(_ingest(snapshots, contents, now, embed, dims, [vault]))
    files = snapshots.read("files", known).select(*FILES)
    cols = [c for c in FILES if c != "indexed_at"]
    touched = contents.select("path").unionByName(removed.select("path"))
    disk = files.select(*cols).join(touched, "path", "left_anti").select(*cols).unionByName(contents.select(*cols))
    return diff.report(_ingest(snapshots, disk, now, embed, dims, known))


def scan(snapshots: Snapshots, vault: str, folder: str, now: str, embed: Embedder | None = None, dims: int = 64, **how) -> DataFrame:
    """ingest for a vault's folder that opens only files which have changed since the oldest of those that are new or of
    another size or time; the report. A vault that is as it was is listed, and no file of it is read. how: as in walk."""
    spark = snapshots.spark
    if snapshots.current() is None:
        return ingest(snapshots, walk(spark, vault, folder, **how), now, embed, dims, [vault])
    listing, files = walk(spark, vault, folder, content=False, **how), snapshots.read("files", [vault])
    look = diff.stat_candidates(listing.withColumn("content_hash", F.lit("")), files)
    gone = files.join(listing, ["vault", "path"], "left_anti").select("vault", "path")
    with snapshots.staged(look.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))) as differing:
        oldest = listing.join(differing.where("not gone"), ["vault", "path"], "left_semi").agg(F.min(F.to_timestamp("mtime", TIME))).first()[0]
        if oldest is None:
            contents = files.select(*[c for c in FILES if c != "indexed_at"]).limit(0)
            if not differing.take(1):
                return diff.report(diff.scan_diff(files, files))
        else:
            contents = walk(spark, vault, folder, since=F.lit(oldest), **how).join(differing.where("not gone"), ["vault", "path"], "left_semi")
        return update(snapshots, vault, contents, differing.where("gone"), now, embed, dims)


def rescan(snapshots: Snapshots, disk: DataFrame, now: str, embed: Embedder | None = None, dims: int = 64, vaults: list[str] | None = None) -> DataFrame:
    """ingest, answered by an event for each file that was created, modified or deleted."""
    return events(_ingest(snapshots, disk, now, embed, dims, vaults), F.lit(now))


def rebuild(snapshots: Snapshots, vault: str) -> int:
    """Forgets a vault's chunks and its files' hashes, so that its next scan makes all anew; paths and texts stay."""
    files = diff.rebuild(snapshots.read("files", [vault]))
    return snapshots.commit({"files": files, "chunks": snapshots.read("chunks", [vault]).limit(0)}, [vault])


def terminate(catalog: Catalog, snapshots: Snapshots, token: str) -> Vault:
    """Takes a vault out of the catalog and the index; its notes stay."""
    gone = catalog.terminate(token)
    snapshots.forget(gone.id)
    return gone
