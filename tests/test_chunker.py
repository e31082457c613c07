import pyarrow as pa
import pytest

from quillspark.functions.chunker import chunks, diagnose, events, front_matter
from quillspark.operators import diagnostics

LONG = "word " * 450


def shape(t):
    return [(c.heading_path, c.started_by, c.ended_by) for c in chunks(t)]


def test_nothing_to_chunk():
    assert chunks("") == [] and chunks("---\na: 1\n---\n") == []
    assert front_matter("---\na: 1\n") == 0 and front_matter("---\na\n---\nx") == 10


def test_headings_and_their_paths():
    t = "intro\n\n# One\na\n## Two\nb\n# Three\nc\n#### Four\nd\n"
    assert [(c.heading_path, c.content.split("\n")[0]) for c in chunks(t)] == [("", "intro"), ("One", "# One"), ("One/Two", "## Two"), ("Three", "# Three")]
    assert chunks(t)[-1].content.endswith("#### Four\nd\n")
    assert [c.heading_path for c in chunks("# Setup\n### Prereqs\nx\n")] == ["Setup", "Setup//Prereqs"]
    assert [c.heading_path for c in chunks("### Lone\nx\n")] == ["//Lone"]
    assert [c.heading_path for c in chunks("Title\n=====\nx\n\nSub `code`\n---\ny\n")] == ["Title", "Title/Sub code"]


def test_rules_break_before_themselves():
    t = "a\n\n---\n\nb\n"
    assert [c.content.strip() for c in chunks(t)] == ["a", "b"]
    assert shape(t) == [("", "document_start", "thematic_break"), ("", "thematic_break", "document_end")]
    assert shape("a\n\n***\n# H\nb\n")[-1] == ("H", "heading:h1", "document_end")
    assert [c.content.strip() for c in chunks("```\n---\n# no\n```\n")] == ["```\n---\n# no\n```"]


def test_size_breaks():
    t = f"{LONG}\n\n{LONG}\n\nend\n"
    assert [c.ended_by for c in chunks(t)] == ["size_after_block", "size_after_block", "document_end"]
    fence = "```py\n" + "x = 1\n" * 600 + "```\n"
    got = chunks(fence + "after\n")
    assert got[0].content == fence and got[0].ended_by == "size_after_code_block" and got[1].started_by == "size_after_code_block"


@pytest.mark.parametrize("t", ["---\nk: é\n---\n# Ä\nü€\n\n---\nx\n", f"# a\n{LONG}\n\n- {LONG}\n- b\n\n> q\n\n1. c\n", "\n\n  text\n    code\n\ttab\n"])
def test_chunks_are_slices_of_the_file_in_order(t):
    raw, last = t.encode(), 0
    for i, c in enumerate(chunks(t)):
        assert c.index == i and raw[c.start : c.end].decode() == c.content and c.start >= last
        last = c.end


def test_diagnostics():
    d = diagnose("```py\na\n```\n\n---\n\n~~~sh x\nb\n~~~\n```py\n```\n")
    assert d["languages"] == ["py", "sh"] and d["thematic_breaks"] == 1 and d["code_heavy"]
    assert diagnostics.health(True, True, 0, True) == ("healthy", 200) and diagnostics.health(True, False, 0, True)[1] == 503
    assert diagnostics.health(True, True, 1, True)[0] == "degraded"


def test_quoted_fences_line_ends_and_html():
    level = lambda t: [e[2] for e in events(t) if e[0] == "heading"]
    assert level("> ```\n> # no\n> ```\n\n# yes\n") == ["yes"]
    assert level("> ```\n> # no\n# yes\n") == ["yes"]
    assert level("a\x0c# no # no\x85# no\r\n# yes\n") == ["yes"]
    assert level("<!-- x\n# no\n-->\n# yes\n") == ["yes"] and level("<div>\n# no\n\n# yes\n") == ["yes"]
    text = "# ä\n" + "é🦉 words\n\n" * 400
    assert all(text.encode()[c.start : c.end].decode() == c.content for c in chunks(text))


def test_chunks_come_back_some_at_a_time(spark):
    """A batch of many files isn't held as chunks; all chunks are there."""
    from quillspark.functions import chunker

    class Files:  # what Spark hands to Python
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            n = 400
            text = "\n".join(f"# part {i}\n\n{'word ' * 100}\n" for i in range(20))
            b = pa.RecordBatch.from_arrays([pa.array([x] * n, pa.string()) for x in ("v", "a.md", text, "h")], names=["vault", "path", "content", "content_hash"])
            return list(run(iter([b])))

    got = chunker.chunk_files(Files())
    assert sum(b.num_rows for b in got) == 400 * 20
    assert len(got) > 3 and max(b.nbytes for b in got) < 3 << 20
    odd = spark.createDataFrame([("v", "none", None, "h"), ("v", "empty", "", "h"), (None, "one", "# a\ntext", None)], "vault string, path string, content string, content_hash string")
    assert [(r.vault, r.file_path, r.content, r.file_hash) for r in chunker.chunk_files(odd).collect()] == [(None, "one", "# a\ntext", None)]
