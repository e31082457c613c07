"""Path search: prefix, glob and depth over file metadata, in the order of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import glob_regex, glob_start, has_prefix
from quillspark.operators.merge import Result, check_limit, merged

COLUMNS = ["path", "size", "mtime", "content_hash", "vault"]


def matching(files: DataFrame, prefix: str | None = None, glob: str | None = None, max_depth: int | None = None, depth_from_prefix: bool = False) -> DataFrame:
    """The files that match; only metadata is read, and prefixes (a glob's too) are ranges that the reader can use."""
    out = files
    for p in (prefix, glob_start(glob) if glob else None):
        if (c := has_prefix(F.col("path"), p)) is not None:
            out = out.where(c)
    if glob is not None:
        out = out.where(F.col("path").rlike(glob_regex(glob)))
    if max_depth is not None:
        base = len([x for x in (prefix or "").split("/") if x]) if depth_from_prefix else 0
        out = out.where(F.size(F.filter(F.split("path", "/"), lambda x: x != "")) <= max_depth + base)
    return out.select(*[c for c in [*COLUMNS, "vault_name"] if c in files.columns])


def search_paths(files: DataFrame, prefix: str | None = None, glob: str | None = None, max_depth: int | None = None, limit: int = 100) -> Result:
    return merged(matching(files, prefix, glob, max_depth), [F.col("path"), F.col("vault")], check_limit(limit))
