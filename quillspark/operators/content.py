"""Content search: substrings (ASCII case folded, unless asked not to) and regular expressions, with lines of matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.text import ascii_fold, byte_truncate, fold, has_prefix, java_regex, normal_path
from quillspark.operators.merge import Result, check_limit, merged

LINE_BYTES = 240


def resolve_mode(mode: str | None, regex: bool, case_sensitive: bool, query: str) -> str:
    """substring, regex or ranked; asking for `regex` in either way gives it."""
    if mode not in (None, "substring", "regex", "ranked"):
        raise EngineError("invalid_request", f"unknown mode {mode!r}")
    if regex and mode not in (None, "regex"):
        raise EngineError("invalid_request", "regex doesn't go with that mode")
    mode = mode or ("regex" if regex else "substring")
    if mode == "ranked" and case_sensitive:
        raise EngineError("invalid_request", "ranked search has no case")
    if mode == "ranked" and not query.strip():
        raise EngineError("invalid_query", "the query is empty")
    return mode


def _lines(content: Column, pieces: Column, hits: Column, most: int) -> Column:
    """An array of (line, text) for the first hits: a hit's line follows from the newlines before it."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, x: a + breaks(x))
    at = lambda k: 1 + total(pieces, k) + total(hits, k - 1)
    text = lambda line: byte_truncate(F.get(F.split(content, "\n"), line - 1), LINE_BYTES)
    ks = F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.least(F.size(hits), F.lit(most)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(F.transform(ks, at), lambda line: F.struct(line.cast("bigint").alias("line"), text(line).alias("text")))


def matching(files: DataFrame, query: str, mode: str = "substring", case_sensitive: bool = False, prefix: str | None = None, include_matches: bool = False, max_matches_per_file: int = 5) -> DataFrame:
    """The files whose content matches, with match_count and, if asked for, matches."""
    out = files
    if (c := has_prefix(F.col("path"), prefix)) is not None:
        out = out.where(c)
    if mode == "regex":
        java = java_regex(files.sparkSession, query)
        body = F.col("content")
        out = out.where(body.rlike(java))
        count = F.regexp_count(body, F.lit(java))
        hits, pieces = F.regexp_extract_all(body, F.lit(java), F.lit(0)), F.split(body, java)
        # nothing comes before an empty match at the start, and split leaves that piece out
        pieces = F.when(F.size(pieces) <= F.size(hits), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)
    else:
        needle = query if case_sensitive else fold(query)
        body = F.col("content") if case_sensitive else ascii_fold(F.col("content"))
        out = out.where(body.contains(needle) if needle else F.lit(False))
        n = len(needle.encode()) or 1
        count = ((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(needle), F.lit("")))) / n).cast("bigint")
        pieces = F.split(body, re.escape(needle))
        hits = F.array_repeat(F.lit(needle), F.size(pieces) - 1)
    found = _lines(F.col("content"), pieces, hits, max_matches_per_file) if include_matches else F.expr("cast(array() as array<struct<line:bigint,text:string>>)")
    keep = [c for c in ["path", "size", "mtime", "content_hash", "vault", "vault_name"] if c in files.columns]
    return out.select(*keep, count.cast("bigint").alias("match_count"), found.alias("matches"))


def search_content(files: DataFrame, query: str, mode: str | None = None, regex: bool = False, case_sensitive: bool = False, prefix: str | None = None, include_matches: bool = True, max_matches_per_file: int = 5, limit: int = 100) -> Result:
    mode = resolve_mode(mode, regex, case_sensitive, query)
    if mode == "ranked":
        raise EngineError("invalid_request", "ranked search needs an index: see ranked.search_ranked")
    rows = matching(files, query, mode, case_sensitive, prefix, include_matches, max_matches_per_file)
    return merged(rows, [F.col("path"), F.col("vault")], check_limit(limit))


def get_content(files: DataFrame, vaults: list[str], paths: list[str]) -> DataFrame:
    """A row for each of the paths in each of the vaults: the file, or the error path_not_found; by path and vault."""
    spark = files.sparkSession
    asked = spark.createDataFrame([(v, p) for p in dict.fromkeys(map(normal_path, paths)) for v in vaults], "vault string, path string")
    found = files.select("vault", "path", "size", "mtime", "content_hash", "content")
    error = F.when(F.col("content_hash").isNull(), F.struct(F.lit("path_not_found").alias("code"), F.concat(F.lit("no file "), "path").alias("message")))
    return asked.join(found, ["vault", "path"], "left").withColumn("error", error).orderBy("path", "vault")
