"""Chat formatting with typed content parts. JVM-side only.

A message is a list of parts (text, image, audio or document). A visitor, VISITORS, turns each into its written form:
a text into itself, escaped; any other part into a numbered placeholder, whose attachment is recorded with what it
refers to and the tokens that a model will put in its place. Attachments are numbered through a conversation in the
order of its messages and parts.

The template is `<turn ROLE>BODY</turn>` and a line feed for each message. In texts and roles a backslash is written
as `\\b`, `<` as `\\l`, `>` as `\\g`, so `<` and `>` stand only at the ends of marks and no text can end a turn or make
a placeholder, also not where two texts meet. `read` undoes it.

The loss mask holds spans of UTF-8 bytes of the formatted text, one for each message of the assistant, its body.
Sums run along a conversation's sorted rows, so nothing grows with the square of its length, and its rows meet once, as
one training text, which must fit one row (2 GB).

Defined results: rows are put in the order of turn (null first), then role and parts, so ties and repeated rows have a
fixed order and each is a message; null roles, texts and parts are empty ones; a part that is null is left out; a part
of another type is a placeholder `other` without tokens, with its reference; sizes that are null or negative count 0;
a null conv_id is a conversation of its own; an empty table gives an empty one; columns other than those named are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import words

PART = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
#: What is written for characters that marks are made of; the backslash first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
END = "</turn>\n"


@dataclass(frozen=True)
class Costs:
    """How many tokens a part is expanded to."""

    patch: int = 28  #: pixels of a side of an image's patch; a token each
    per_second: int = 25  #: tokens of a second of audio
    per_page: int = 256  #: tokens of a page of a document, beside its text's

    def text(self, text: Column) -> Column:
        """A text's: its words, as no tokenizer runs in the JVM."""
        return F.size(words(text)).cast("long")


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """escape, undone: an escaped text has a backslash only before one of the letters, so the order is the reverse."""
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def _positive(n: Column) -> Column:
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long")


#: type -> tokens that a part of this type is expanded to
VISITORS: dict[str, Callable[[Column, Costs], Column]] = {
    "text": lambda p, c: c.text(p["text"]),
    "image": lambda p, c: F.ceil(_positive(p["width"]) / c.patch) * F.ceil(_positive(p["height"]) / c.patch),
    "audio": lambda p, c: _positive(F.ceil(F.nanvl(p["seconds"], F.lit(0.0)) * c.per_second)),
    "document": lambda p, c: _positive(p["pages"]) * c.per_page + c.text(p["text"]),
}
TYPES = [t for t in VISITORS if t != "text"]


def _kind(p: Column) -> Column:
    return F.when(p["type"].isNull() | (p["type"] == "text"), "text").when(p["type"].isin(TYPES), p["type"]).otherwise("other")


def _visit(p: Column, costs: Costs) -> Column:
    """A part's kind, written form (without a placeholder's number) and tokens."""
    kind = _kind(p)
    tokens = F.lit(0).cast("long")
    for t, visitor in VISITORS.items():
        tokens = F.when(kind == t, visitor(p, costs)).otherwise(tokens)
    written = F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.lit(""))
    return F.struct(kind.alias("kind"), written.alias("written"), p["ref"].alias("ref"), F.coalesce(tokens, F.lit(0)).alias("tokens"))


def text_part(text: Column) -> Column:
    """The parts of a message that is a text alone."""
    fields = [f.split(":") for f in PART[len("struct<") : -1].split(",")]
    values = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]))


def format_chats(messages: DataFrame, parts: str = "parts", costs: Costs = Costs(), answers: str = "assistant") -> DataFrame:  # noqa: B008
    """conv_id, n_turns, formatted, loss (begin and bytes of each span), attachments (number, turn, type, ref, tokens),
    tokens (of all parts), for messages (conv_id, turn, role, and an array of parts)."""
    m = messages.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.expr(f"cast(array() as array<{PART}>)")).alias("parts"))
    m = m.select("conv_id", "turn", "role", F.transform(F.filter("parts", lambda p: p.isNotNull()), lambda p: _visit(p, costs)).alias("seen"))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "seen")
    before = lambda n: F.coalesce(F.sum(n).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    here = F.filter(F.transform("seen", lambda p, i: F.struct(i.alias("at"), p["kind"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda a: a["type"] != "text")
    m = m.withColumn("here", here).withColumn("first", before(F.size("here")))
    number = lambda i: (F.col("first") + F.array_position(F.col("here.at"), i) - 1).cast("string")
    numbered = F.transform("seen", lambda p, i: F.when(p["kind"] == "text", p["written"]).otherwise(F.concat(F.lit("<"), p["kind"], F.lit(" "), number(i), F.lit(">"))))
    attached = F.transform("here", lambda a, i: F.struct((F.col("first") + i).alias("number"), F.col("turn").alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    m = m.withColumn("body", F.concat_ws("", numbered)).withColumn("attached", attached).withColumn("tokens", F.aggregate("seen", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]))
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    size = F.octet_length(head) + F.octet_length("body") + len(END)
    m = m.select("conv_id", "role", "attached", "tokens", head.alias("head"), "body", before(size).alias("at"), F.row_number().over(line).alias("place"))
    span = F.when(F.col("role") == answers, F.struct((F.col("at") + F.octet_length("head")).alias("begin"), F.octet_length("body").cast("long").alias("bytes")))
    row = F.struct("place", F.concat("head", "body", F.lit(END)).alias("written"), span.alias("span"), "attached")
    chats = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("tokens").alias("tokens"))
    return chats.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), F.concat_ws("", F.col("rows.written")).alias("formatted"),
        F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("loss"), F.flatten(F.col("rows.attached")).alias("attachments"), "tokens",
    )


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, each as it was before formatting, without placeholders."""
    raw = F.transform(loss, lambda s: F.substring(formatted.cast("binary"), (s["begin"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))
    return F.transform(raw, _text)


def _text(body: Column) -> Column:
    return unescape(F.regexp_replace(body, "<[a-z]+ [0-9]+>", ""))


def read(formatted: Column) -> Column:
    """role, text (without placeholders) and placeholders of each message of a formatted text."""
    turns = F.split(formatted, END)  # the last is what follows the last end: nothing
    head = F.length(F.lit("<turn ")) + 1
    return F.transform(
        F.slice(turns, 1, F.size(turns) - 1),
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, ">", 1), head, F.length(t))).alias("role"),
            _text(F.substring(t, F.instr(t, ">") + 1, F.length(t))).alias("text"),
            F.regexp_extract_all(F.substring(t, F.instr(t, ">") + 1, F.length(t)), F.lit("<([a-z]+ [0-9]+)>"), 1).alias("placeholders"),
        ),
    )
