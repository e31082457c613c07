import re

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions import text
from quillspark.functions.lexical import fold_tokens, stem


@pytest.mark.parametrize(
    ("glob", "hits", "misses"),
    [
        ("**/*.md", ["a.md", "notes/b.md", "a/b/c.md"], ["a.txt"]),
        ("*.md", ["x.md", "a/b.md"], ["x.mdx"]),
        ("notes/**", ["notes/a", "notes/a/b"], ["notes/", "notesx/a"]),
        ("a/**/b.md", ["a/b.md", "a/x/y/b.md"], ["ab.md"]),
        ("?.md", ["a.md", "/.md"], ["ab.md"]),
        ("[!a-c]{x,yy}.md", ["dx.md", "eyy.md"], ["ax.md", "dz.md"]),
        ("a+b(1).md", ["a+b(1).md"], ["aab1.md"]),
    ],
)
def test_globs(glob, hits, misses):
    r = re.compile(text.glob_regex(glob))
    assert all(r.search(h) for h in hits) and not any(r.search(m) for m in misses)


def test_bad_globs_and_prefixes():
    for bad in ("[unterminated", "{a,b"):
        with pytest.raises(EngineError, match="invalid_glob"):
            text.glob_regex(bad)
    for bad in ("/abs/path", "notes/../escape"):
        with pytest.raises(EngineError, match="invalid_prefix"):
            text.normal_prefix(bad)
    assert text.normal_prefix("notes") == text.normal_prefix("notes/") == "notes/" and text.normal_prefix("") == ""
    assert text.normal_path("./a//b.md") == "a/b.md"
    for bad in ("", "/a", "a/../b"):
        with pytest.raises(EngineError, match="invalid_path"):
            text.normal_path(bad)


def test_byte_truncate(spark):
    df = spark.createDataFrame([("aé€\U0001f600z",), ("abc",), ("",)], "s string")
    for n in range(1, 13):
        for s, t in df.select("s", text.byte_truncate(F.col("s"), n)).collect():
            assert t == s.encode()[:n].decode(errors="ignore")


def test_ascii_fold_leaves_other_letters(spark):
    assert spark.sql("select 'Éa ABC' s").select(text.ascii_fold(F.col("s"))).first()[0] == "Éa abc" == text.fold("Éa ABC")


@pytest.mark.parametrize("bad", ["[unterminated", "(?=a)", "(?<!a)b", r"(a)\1"])
def test_bad_regex(spark, bad):
    with pytest.raises(EngineError, match="invalid_regex"):
        text.java_regex(spark, bad)


def test_regex_dialect(spark):
    df = spark.createDataFrame([("x\n", "é1"), ("x", "é٣")], "a string, b string")
    assert [r[0] for r in df.select(F.col("a").rlike(text.java_regex(spark, "x$"))).collect()] == [False, True]
    assert [r[0] for r in df.select(F.col("b").rlike(text.java_regex(spark, r"^\w\d$"))).collect()] == [True, True]


def test_stemmer_and_tokens():
    known = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal sensitibiliti:sensit triplicate:triplic formative:form electrical:electr goodness:good revival:reviv allowance:allow inference:infer adjustable:adjust replacement:replac adoption:adopt activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
    for pair in known.split():
        word, want = pair.split(":")
        assert stem(word) == want, word
    assert fold_tokens("Café foo_bar É1") == ["cafe", "foo", "bar", "e1"]


#: A pattern, a text, and the matches that a linear-time engine with Unicode classes finds.
MATCHES = [
    (r"[\w--a]+", "a-bca", ["bc"]), (r"[a-z--[aeiou]]+", "audio book", ["d", "b", "k"]), (r"[\p{L}--\p{Lu}]+", "abCd", ["ab", "d"]), (r"[a-f&&[^c]]+", "abcdefg", ["ab", "def"]), (r"[a-c--b]", "abc-", ["a", "c"]), (r"[+--]", "+-,", ["+", "-", ","]),
    (r"\<w\w*", "why how w", ["why", "w"]), (r"\w+y\>", "why yes", ["why"]), (r"\b{start}\w", "ab cd", ["a", "c"]), (r"\w\b{end}", "ab cd", ["b", "d"]), (r"\b{start-half}x", "x ax", ["x"]), (r"x\b{end-half}", "xa x", ["x"]),
    (r"\p{Greek}+", "abc αβγ", ["αβγ"]), (r"\p{script=Cyrillic}+", "abc где", ["где"]), (r"\p{sc=Greek}", "aα", ["α"]), (r"\P{Greek}+", "αab", ["ab"]), (r"\p{Lu}", "aB", ["B"]), (r"\pL+", "ab1", ["ab"]), (r"\p{Alphabetic}+", "é1", ["é"]), (r"\p{gc=Nd}+", "a12", ["12"]), (r"\p{Uppercase_Letter}", "aB", ["B"]), (r"\p{general_category=letter}+", "aB1", ["aB"]), (r"\p{Nothing}", "x", None),
    (r"(?U)a+", "aa", None), (r"(?i)É", "é", ["é"]), (r"(?x) a b # c", "ab", ["ab"]), (r"(?s)a.b", "a\nb", ["a\nb"]), (r"a.b", "a\nb", []), (r"a.b", "a\rb", ["a\rb"]), (r"(?m)^b$", "a\nb\nc", ["b"]), (r"\d+", "a٣4", ["٣4"]), (r"[[:digit:]]+", "a٣4", ["4"]),
    (r"[a~~b]", "a", None), (r"(?P<n>x)", "x", ["x"]), (r"a{2,}", "aaa", ["aaa"]), (r"(?:ab)+?", "abab", ["ab", "ab"]), (r"\x{41}", "A", ["A"]), (r"\u0041", "A", ["A"]), (r"[^\n]+", "a\nb", ["a", "b"]), (r"\.", "a.b", ["."]), (r"\S+", "a b", ["a", "b"]),
]


def test_patterns_find_what_they_should(spark):
    for pattern, given, want in MATCHES:
        try:
            java = text.java_regex(spark, pattern)
        except EngineError:
            assert want is None, pattern
            continue
        row = spark.createDataFrame([(given,)], "t string").select(F.regexp_extract_all("t", F.lit(java), 0).alias("m")).first()
        assert row["m"] == want, pattern


def test_closest():
    assert text.closest(["notes", "work"], "note") == "notes" and text.closest(["notes"], "elsewhere") is None


def test_preview_has_every_file_cut_at_a_bound_of_characters(spark, tmp_path):
    from quillspark.queries import QUERIES

    texts = ["", "short", "é" * 100, "a" + "é" * 100, "ab€" * 70, "x" * 199 + "\U0001f600z", "x" * 200, "x" * 201]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["path"]: (r["text"], r["truncated"]) for r in QUERIES["preview_truncate"](spark, str(tmp_path)).collect()}
    assert got == {f"notes/s/{i:08d}.md": (t.encode()[:200].decode(errors="ignore"), len(t.encode()) > 200) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("pattern", "given", "want"), [("[[:digit:]]+", "ab12", "12"), ("[^[:alpha:]_]+", "é_x", "é"), (r"(?P<n>\d)x", "1x", "1x"), (r"\p{L}+", "é1", "é"), (r"a{2}b+?", "aabb", "aab"), (r"\++", "1++", "++"), ("[[:^space:]]+", " ab ", "ab")])
def test_dialect_of_regular_expressions(spark, pattern, given, want):
    row = spark.createDataFrame([(given,)], "t string").select(F.regexp_extract("t", text.java_regex(spark, pattern), 0)).first()
    assert row[0] == want


@pytest.mark.parametrize("pattern", ["a++", "a*+", "a{2}+", "(?>a)", r"\Qa\E", r"\Ga", "[[:none:]]", r"(?=a)"])
def test_other_dialects_are_refused(spark, pattern):
    with pytest.raises(EngineError, match="invalid_regex"):
        text.java_regex(spark, pattern)


def test_closest_of_a_column(spark):
    df = spark.createDataFrame([("note",), ("elsewhere",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(text.closest_of(F.col("n"), ["notes", "nose", "work"])).collect()] == ["notes", None, None, None]
    assert text.closest(["notes", "nose", "work"], "note") == "notes"
