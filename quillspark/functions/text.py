"""Text helpers: ASCII folding, globs, prefixes, regular expressions, byte-wise cuts."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EngineError


def ascii_fold(c: Column) -> Column:
    """Lower case for A-Z alone, so that offsets stay."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def normal_prefix(prefix: str | None) -> str:
    """A folder prefix with a slash at its end; '' for none."""
    if not prefix:
        return ""
    if prefix.startswith("/") or ".." in prefix.split("/"):
        raise EngineError("invalid_prefix", f"{prefix!r} must be relative and stay inside the vault")
    return prefix.rstrip("/") + "/"


def has_prefix(path: Column, prefix: str | None) -> Column | None:
    """A half-open range over paths, which the Parquet reader can use; None if all paths qualify."""
    p = normal_prefix(prefix)
    return (path >= p) & (path < p[:-1] + chr(ord("/") + 1)) if p else None


def glob_regex(glob: str) -> str:
    """The anchored regular expression of a glob: `*` and `?` match slashes too, `**/` also matches nothing."""
    out, i, depth = [], 0, 0
    if glob.startswith("**/"):
        out.append("(?:.*/)?")
        i = 3
    while i < len(glob):
        c = glob[i]
        if glob.startswith("/**/", i):
            out.append("/(?:.*/)?")
            i += 4
            continue
        if glob[i:] == "/**":
            out.append("/.+")
            break
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] == "!" else i + 2)
            if end < 0:
                raise EngineError("invalid_glob", f"{glob!r} has a class without an end")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[negated:].replace("\\", r"\\").replace("[", r"\[").replace("]", r"\]").replace("^", r"\^").replace("&", r"\&")
            out.append(f"[{'^' * negated}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise EngineError("invalid_glob", f"{glob!r} has an open brace")
    return f"^(?s:{''.join(out)})$"


def glob_start(glob: str) -> str:
    """The folders that every match of a glob lies in, for a range over paths."""
    plain = re.split(r"[*?\[{\\]", glob, maxsplit=1)[0]
    return plain.rpartition("/")[0]


# POSIX classes, as ranges of ASCII.
_POSIX = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "a-zA-Z0-9_", "xdigit": "0-9A-Fa-f",
}


#: Bounds of words in the dialect, and what Java has for them.
_BOUNDS = {r"\b{start-half}": r"(?<!\w)", r"\b{end-half}": r"(?!\w)", r"\b{start}": r"\b(?=\w)", r"\b{end}": r"\b(?<=\w)", r"\<": r"\b(?=\w)", r"\>": r"\b(?<=\w)"}


# Unicode's general categories by their long names.
_CATEGORIES = dict(x.split(":") for x in "Uppercase_Letter:Lu Lowercase_Letter:Ll Titlecase_Letter:Lt Cased_Letter:LC Modifier_Letter:Lm Other_Letter:Lo Letter:L Nonspacing_Mark:Mn Spacing_Mark:Mc Enclosing_Mark:Me Mark:M Decimal_Number:Nd Letter_Number:Nl Other_Number:No Number:N Connector_Punctuation:Pc Dash_Punctuation:Pd Open_Punctuation:Ps Close_Punctuation:Pe Initial_Punctuation:Pi Final_Punctuation:Pf Other_Punctuation:Po Punctuation:P Math_Symbol:Sm Currency_Symbol:Sc Modifier_Symbol:Sk Other_Symbol:So Symbol:S Space_Separator:Zs Line_Separator:Zl Paragraph_Separator:Zp Separator:Z Control:Cc Format:Cf Surrogate:Cs Private_Use:Co Unassigned:Cn Other:C".lower().split())


def _property(spark: SparkSession, name: str) -> str:
    """Java's name of a Unicode property: its categories and binary properties by name, scripts and blocks by kind."""
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    key, eq, value = name.strip("{}").partition("=")
    own = key.strip() if not eq else value.strip()
    if (short := _CATEGORIES.get(own.lower().replace(" ", "_"))) and (not eq or key.strip().lower() in ("gc", "general_category")):
        return "{" + short[0].upper() + (short[1:] if short != "lc" else "C") + "}"
    kinds = ["script=", ""] if eq and key.strip().lower() in ("script", "sc", "scx", "script_extensions") else ["gc="] if eq and key.strip().lower() in ("gc", "general_category") else ["", "Is", "script="]
    for kind in [] if eq and len(kinds) > 2 else kinds:
        for word in (own, own.upper() if len(own) < 3 else own.replace("_", "").title()):
            try:
                pattern.compile(f"\\p{{{kind}{word}}}")
                return f"{{{kind}{word}}}"
            except Exception:  # noqa: BLE001, S112  Java refuses the name
                continue
    raise EngineError("invalid_regex", f"unknown property {name}")


def java_regex(spark: SparkSession, pattern: str) -> str:
    """A linear-time dialect's expression for Java: Unicode classes, \\n alone ends lines, `$` is the very end.

    POSIX classes, `(?P<name>`, bounds of words, properties and differences of classes are translated; what only a
    backtracking dialect has is refused, and so is what Java would take for something else.
    """
    if re.search(r"(?<!\\)(?:\\\\)*\(\?[a-z]*-?[a-z]*U", pattern):
        raise EngineError("invalid_regex", "swapped greediness isn't supported")
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<)", pattern):
        raise EngineError("invalid_regex", "look-around and back-references aren't supported")
    if re.search(r"(?<!\\)(?:\\\\)*(?:\\[QEGRXZhHNK]|\(\?>)", pattern):
        raise EngineError("invalid_regex", "quoting, atomic groups and escapes of other dialects aren't supported")
    out, i, inside = [], 0, False
    multi = re.search(r"\(\?[a-z]*m", pattern)
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            bound = next((b for b in _BOUNDS if pattern.startswith(b, i)), None)
            named = re.match(r"\\([pP])(\{[^}]*\}|[A-Z])", pattern[i:])
            if bound and not inside:
                out.append(_BOUNDS[bound])
                i += len(bound)
            elif named:
                out.append(f"\\{named[1]}{_property(spark, named[2])}")
                i += len(named[0])
            else:
                out.append(pattern[i : i + 2])
                i += 2
            continue
        if inside and pattern.startswith(("~~", "--"), i) and not pattern.startswith("--]", i):
            if c == "~":
                raise EngineError("invalid_regex", "symmetric differences of classes aren't supported")
            rest = re.match(r"--((?:\\[pP]\{[^}]*\}|\\.|\[(?:\\.|[^\\\[\]])*\]|[^\\\[\]])+?)(?=--|&&|\])", pattern[i:], re.S)
            if rest is None:
                raise EngineError("invalid_regex", "a difference of nested classes isn't supported")
            inner = java_regex(spark, f"[{rest[1]}]").removeprefix("(?U)(?d)")
            out.append(f"&&[^{inner}]")
            i += len(rest[0])
            continue
        if inside and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
            if m[2] not in _POSIX:
                raise EngineError("invalid_regex", f"unknown class {m[0]}")
            out.append(f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
            i += len(m[0])
            continue
        if not inside and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if not inside and c == "+" and re.search(r"(?<!\\)(?:\\\\)*(?:[*+?]|(?<!\\[pPxuU])\{\d+,?\d*\})$", pattern[:i]):
            raise EngineError("invalid_regex", "possessive repetition isn't supported")
        inside = (inside or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not inside and not multi else c)
        i += 1
    java = "(?U)(?d)" + "".join(out)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise EngineError("invalid_regex", str(e).split("\n")[0]) from None
    return java


def byte_truncate(c: Column, n: int) -> Column:
    """The longest start of at most n bytes that ends with a whole character."""
    raw = c.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(min(4, n))]
    return F.when(F.octet_length(c) <= n, c).otherwise(F.coalesce(*tries, F.lit("")))


def normal_path(path: str) -> str:
    """A request's path, checked and without empty or `.` parts."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or path.startswith("/") or ".." in parts:
        raise EngineError("invalid_path", f"{path!r} must be a relative path inside the vault")
    return "/".join(parts)


def closest_of(wanted: Column, names: list[str], most: int = 3) -> Column:
    """As closest, for a column of names, by built-in functions alone."""
    near = F.transform(F.array(*[F.lit(n) for n in names]), lambda n, i: F.struct(F.levenshtein(wanted, n).alias("distance"), i.alias("place"), n.alias("name")))
    best = F.array_min(near)
    return F.when(best["distance"] <= most, best["name"])


def closest(names: list[str], wanted: str, most: int = 3) -> str | None:
    """The first of the names with the least edit distance, if that is at most `most`."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = min(names, key=lambda n: distance(n, wanted), default=None)
    return best if best is not None and distance(best, wanted) <= most else None
