"""Markdown vaults on disk as a DataFrame, with the rules for what belongs to one."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.text import glob_regex
from quillspark.operators.diff import content_hash

#: How times are written.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# Names of copies that synchronising programs make.
CONFLICTS = (".sync-conflict-", "(conflicted copy", "conflicted copy)")
# What a vault leaves out unless it's told otherwise.
IGNORED = (".git/**", ".obsidian/**", ".trash/**", "*.sync-conflict-*", "**/*.tmp")


def compile_ignores(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Regular expressions of what to leave out, and of what to take all the same (`!`)."""
    out: tuple[list[str], list[str]] = ([], [])
    for p in patterns:
        try:
            out[p.startswith("!")].append(glob_regex(p.removeprefix("!")))
        except EngineError as e:
            raise EngineError("invalid_request", f"ignore pattern {p!r}: {e.message}") from None
    return out


def gitignore_rules(path: str, text: str) -> list[tuple[str, bool]]:
    """A .gitignore's rules as (regular expression over the vault's paths, does it ignore?); later ones win."""
    folder = path.rpartition("/")[0]
    base = re.escape(folder + "/") if folder else ""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        line = line.removeprefix("!").removeprefix("\\")
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        anywhere = "/" not in line
        parts = []
        for part in line.removeprefix("/").split("/"):
            parts.append("**" if part == "**" else re.sub(r"\\\[(.*?)\\\]", r"[\1]", re.escape(part).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")))
        body = "/".join(parts).replace("**/", "(?:.*/)?").replace("/**", "/.*")
        rules.append((f"^{base}{'(?:.*/)?' if anywhere else ''}{body}{'/.*' if only_folders else '(?:/.*)?'}$", ignores))
    return rules


def included(path: Column, ignore: list[str] | None = None, gitignores: dict[str, str] | None = None) -> Column:
    """First match wins: .git is out, re-included is in, excluded is out, then .gitignore files, the deepest first."""
    out, again = compile_ignores(ignore or [])
    any_of = lambda rs: path.rlike("|".join(rs)) if rs else F.lit(False)
    verdict = F.when(path.rlike(r"(^|/)\.git(/|$)"), False).when(any_of(again), True).when(any_of(out), False)
    for at in sorted(gitignores or {}, key=lambda p: -p.count("/")):
        for rule, ignores in reversed(gitignore_rules(at, gitignores[at])):
            verdict = verdict.when(path.rlike(rule), not ignores)
    return verdict.otherwise(True)


def watched(path: Column) -> Column:
    """May a change of this path concern the index? Markdown, no hidden part, no copy of a synchronising program."""
    name = F.element_at(F.split(path, "/"), -1)
    return path.endswith(".md") & ~path.rlike(r"(^|/)\.") & ~F.greatest(*[name.contains(c).cast("int") for c in CONFLICTS]).cast("boolean")


@dataclass(frozen=True)
class Links:
    """What symbolic links of a local folder lead to: the files to read, or None where a plain listing does."""

    files: list[str] | None
    outside: int = 0
    errors: int = 0
    gitignores: tuple[tuple[str, str], ...] = ()  # paths below the folder, and texts, of those not reached by a link


def follow_links(folder: str) -> Links:
    """Follows a local folder's links; what they reach outside it, or can't reach, is counted and left out.

    A folder that is reached twice is read once, under the path found first, so circles end. Folders of stores have no
    links.
    """
    at = urlsplit(folder)
    if at.scheme not in ("", "file"):
        return Links(None)
    root = (unquote(at.path) if at.scheme else folder).rstrip("/") or "/"
    real, seen, files, outside, errors, linked = os.path.realpath(root), set(), [], 0, 0, False
    rules: list[tuple[str, str]] = []
    todo = [root]
    while todo:
        here = todo.pop()
        if (own := os.path.realpath(here)) in seen:
            continue
        seen.add(own)
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            errors += 1
            continue
        for e in entries:
            linked = linked or e.is_symlink()
            if e.is_symlink() and not os.path.exists(e.path):
                errors += e.name.endswith(".md")
            elif e.is_symlink() and os.path.commonpath([real, os.path.realpath(e.path)]) != real:
                outside += 1
            elif e.is_dir():
                todo.append(e.path)
            elif e.name == ".gitignore":
                path = os.path.relpath(e.path, root)
                if os.path.realpath(e.path) == os.path.join(real, path):
                    try:
                        with open(e.path, encoding="utf-8", errors="replace") as f:
                            rules.append((path, f.read()))
                    except OSError:
                        errors += 1
            elif e.name.endswith(".md"):
                files.append(e.path)
    return Links(files if linked or errors else None, outside, errors, tuple(sorted(rules)))


def walk(spark: SparkSession, vault: str, folder: str, ignore: list[str] | None = None, gitignores: dict[str, str] | None = None, content: bool = True, since: Column | None = None) -> DataFrame:
    """The Markdown files below a folder: vault, path, size, mtime and, if asked for, content and content_hash.

    Without content only the listing is read; a scan asks so first, and reads the files that need it afterwards.
    since: only files changed then or later; Spark's reader doesn't open the others.
    ignore: patterns instead of IGNORED. gitignores: path to text; without them, those of a local folder are found.
    """
    links = follow_links(folder)
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
    if links.files is None:
        raw = listing.option("recursiveFileLookup", True).load(folder)
    else:  # paths, not patterns
        named = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f) for f in links.files]
        raw = listing.load(named) if named else listing.option("recursiveFileLookup", True).load(folder).limit(0)
    if since is not None:
        raw = raw.where(F.col("modificationTime") >= since)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/") + "/"
    decoded = F.url_decode(F.replace(F.regexp_replace("path", r"^[a-z][\w+.-]*:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B")))
    path = F.substring(decoded, F.lit(len(root) + 1), F.length(decoded))
    cols = [F.lit(vault).alias("vault"), path.alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", TIME).alias("mtime")]
    if content:
        cols += [content_hash(F.col("content")).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")]
    files = raw.select(*cols)
    rules = dict(links.gitignores) if gitignores is None else gitignores
    return files.where(included(F.col("path"), list(IGNORED) if ignore is None else ignore, rules))
