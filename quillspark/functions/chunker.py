"""A heading-aware Markdown chunker with byte offsets, and its diagnostics.

A block-level scan of CommonMark: front matter, ATX and setext headings, fences, indented code, thematic breaks,
lists, block quotes, paragraphs. Headings of level 1 to 3 and thematic breaks end a chunk; so does a block that ends
beyond TARGET bytes. Chunks never overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TARGET, HARD = 2000, 3200
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
# CommonMark's block tags, and how its other HTML blocks begin and end (those end with a blank line).
_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
_HTML = [(r"<(?:script|pre|style|textarea)(?:\s|>|$)", r"</(?:script|pre|style|textarea)>"), (r"<!--", r"-->"), (r"<\?", r"\?>"), (r"<![a-z]", r">"), (r"<!\[CDATA\[", r"\]\]>"), (rf"</?(?:{_TAGS.replace(' ', '|')})(?:\s|/?>|$)", None)]
_HTML = [(re.compile(begin, re.I), end and re.compile(end, re.I)) for begin, end in _HTML]
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")  # CommonMark's line ends, no others
_CLOSE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*$")
_TAG = re.compile(r" {0,3}(?=<)")
#: What a list item may begin with.
_MARKERS = frozenset("-+*0123456789")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")


@dataclass
class Chunk:
    index: int
    heading_path: str
    content: str
    start: int
    end: int
    started_by: str
    ended_by: str
    content_hash: str = field(init=False)

    def __post_init__(self):
        self.content_hash = "sha256:" + hashlib.sha256(self.content.encode()).hexdigest()


def front_matter(text: str) -> int:
    """Characters of front matter at the start: from `---` to the next line `---`; 0 if there's none."""
    if not text.startswith("---\n"):
        return 0
    end = text.find("\n---\n", 3)
    return end + 5 if end >= 0 else 0


def _plain(inline: str) -> str:
    """A heading's text: code and words, without marks of emphasis, links or images."""
    s = re.sub(r"!?\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", inline)
    s = re.sub(r"(`+)(.+?)\1", r"\2", s)
    s = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    s = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", s)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s).strip()


def events(text: str) -> Iterator[tuple]:
    """("heading", level, title, start, end), ("rule", start, end), ("block", kind, start, end): in order, by characters."""
    at, lines = 0, []
    for raw in _LINE.findall(text):
        lines.append((at, raw))
        at += len(raw)
    i = 0
    kind, start, end, fence, quoted, html = None, 0, 0, None, False, None

    def done():
        nonlocal kind
        if kind:
            out = ("block", kind, start, end)
            kind = None
            yield out

    while i < len(lines):
        at, raw = lines[i]
        line = raw.rstrip("\r\n")
        i += 1
        if fence:
            end = at + len(raw)
            inner = line
            while quoted and (m := _QUOTE.match(inner)):
                inner = inner[m.end() :]
            close = _CLOSE.match(inner)
            if quoted and inner == line:  # the quote is over, and its fence with it
                end, fence = at, None
                yield from done()
            elif close and close[1][0] == fence[0] and len(close[1]) >= len(fence):
                fence = None
                yield from done()
                continue
            else:
                continue
        if html is not None:
            end = at + len(raw)
            if html.search(line) if html else not line.strip():
                html = None
                yield from done()
            continue
        bare, inside = line, None
        first = bare.lstrip(" ")[:1]  # what a block begins with says which patterns can match
        while first == ">" and (m := _QUOTE.match(bare)):
            bare, inside = bare[m.end() :], "quote"
            first = bare.lstrip(" ")[:1]
        if first in _MARKERS and (m := _ITEM.match(bare)) and not _RULE.match(bare):
            bare, inside = bare[m.end() :], "item"
            first = bare.lstrip(" ")[:1]
        if not first or not bare.strip():
            if kind != "code":
                yield from done()
            continue
        if kind == "paragraph" and inside is None and first in "=-" and (m := _SETEXT.match(line)):
            kind = None
            yield "heading", 1 if m[1][0] == "=" else 2, _plain(" ".join(text[start:end].split())), start, at + len(raw)
            continue
        if first == "#" and (m := _ATX.match(bare)) and not (kind == "code" and line.startswith("    ")):
            yield from done()
            yield "heading", len(m[1]), _plain(m[2] or ""), at, at + len(raw)
            continue
        if first in "*-_" and _RULE.match(bare):
            yield from done()
            yield "rule", at, at + len(raw)
            continue
        if first in "`~" and (m := _FENCE.match(bare)) and not (m[1][0] == "`" and "`" in m[2]):
            yield from done()
            kind, start, end, fence, quoted = "fence", at, at + len(raw), m[1], inside == "quote"
            continue
        if first == "<" and inside is None and kind != "code" and (m := _TAG.match(line)):
            ends = next((e or "" for s, e in _HTML if s.match(line[m.end() :])), None)
            if ends is not None:
                yield from done()
                kind, start, end = "html", at, at + len(raw)
                html = None if ends and ends.search(line[m.end() :]) else ends
                if html is None:
                    yield from done()
                continue
        code = line.startswith(("    ", "\t")) and kind not in ("paragraph", "item", "quote")
        want = "code" if code else inside or (kind if kind in ("item", "quote", "paragraph") else "paragraph")
        if want != kind or inside == "item":
            yield from done()
            kind, start = want, at
        end = at + len(raw)
    yield from done()


def chunks(text: str) -> list[Chunk]:
    """The chunks of a Markdown text, front matter left out; offsets are bytes of the whole text."""
    skip = front_matter(text)
    body = text[skip:]
    base = len(text[:skip].encode())
    out: list[Chunk] = []
    slots = ["", "", ""]
    opened: int | None = None
    began = "document_start"
    path = ""
    sizes = None
    if not body.isascii():
        points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    byte = lambda i: i if sizes is None else int(sizes[i])

    def close(stop: int, by: str):
        nonlocal opened, began
        if opened is not None and stop > opened:
            content = body[opened:stop]
            if content.strip():
                out.append(Chunk(len(out), path, content, base + byte(opened), base + byte(stop), began, by))
        opened = None
        began = by

    for e in events(body):
        if e[0] == "heading" and e[1] <= 3:
            close(e[3], f"heading:h{e[1]}")
            slots[e[1] - 1 :] = [e[2], *[""] * (3 - e[1])]
            path = "/".join(slots).rstrip("/")
            opened, began = e[3], f"heading:h{e[1]}"
            continue
        if e[0] == "rule":
            close(e[1], "thematic_break")
            continue
        start, stop = e[-2], e[-1]
        opened = start if opened is None else opened
        if e[0] == "block" and byte(stop) - byte(opened) > TARGET:
            close(stop, "size_after_code_block" if e[1] in ("fence", "code") else "size_after_block")
    close(len(body), "document_end")
    if out:
        out[-1].ended_by = "document_end"
    return out


def diagnose(content: str) -> dict:
    """A chunk's fences and rules: bytes in fences, languages in the order they come, thematic breaks."""
    fenced, languages, rules = 0, [], 0
    for e in events(content):
        if e[0] == "rule":
            rules += 1
        elif e[0] == "block" and e[1] == "fence":
            part = content[e[2] : e[3]]
            fenced += len(part.encode())
            m = _FENCE.match(part.split("\n", 1)[0])
            name = m[2].split()[0] if m and m[2].split() else ""
            if name and name not in languages:
                languages.append(name)
    return {"fenced_bytes": fenced, "languages": languages, "thematic_breaks": rules, "code_heavy": fenced * 2 > len(content.encode())}


CHUNKS = "vault string, file_path string, chunk_index int, heading_path string, content string, content_hash string, start_byte long, end_byte long, started_by string, ended_by string, file_hash string"


#: Characters of chunks that are held before they are given back to Spark.
HELD = 1 << 20


def chunk_files(files: DataFrame) -> DataFrame:
    """The chunks of files (vault, path, content, content_hash), each file where it lies.

    A task's Python holds a batch as Spark sends it, of which a file at a time becomes Python objects, and about HELD
    characters of chunks.
    """
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in CHUNKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for i in range(b.num_rows):
                vault, path, content, file_hash = (c[i].as_py() for c in b.columns)
                for c in chunks(content or ""):
                    rows.append((vault, path, c.index, c.heading_path, c.content, c.content_hash, c.start, c.end, c.started_by, c.ended_by, file_hash))
                    held += len(c.content) + 200
                    if held >= HELD:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("vault", "path", "content", "content_hash").mapInArrow(run, CHUNKS)
