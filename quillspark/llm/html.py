"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Each page becomes a stream of block tags and text slots; runs of equal groups fold into repeated ones. Streams that
differ are aligned one after the other, many of a host in rounds of bounded groups: what both have stays, groups in one
alone become optional, a single occurrence of a repeated group counts as one repetition. The wrapper that results
covers every page of its host.

Each different stream is then matched against its host's wrapper, which binds its texts to the wrapper's slots. A slot
is judged by what its texts are like on all pages of the host (do they ever differ, how long are they, how much of
them is links) and by what the elements around it say of themselves; classes of `body` and `html` say nothing. A page's
text is that of its content slots, in page order.

Pages are parsed once, where they lie, into a written table of texts; counts by slot are summed before they're shuffled.
Which slots of a stream are content is broadcast if that table is small; else it's joined by host and stream, with hot
streams dealt out over as many parts as their pages call for.

Defined results: a null page counts as empty and has an empty text; pages without a URL form a host of their own;
repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import BROADCAST_ROWS, cut, join_dealt, sized

#: Different texts of a host's pages, beside which text that never differs counts as the template's.
STEADY = 5
#: Streams or wrappers that one task aligns in a round, about.
FAN = 64
#: Cells of a table of alignment; longer streams are cut at items that both have once, or at common runs.
CELLS = 1 << 20
#: Items of a wrapper times items of a stream, up to which all ways to match them are followed. Beyond it a stream whose
#: first way fails has slots of its own.
WORK = 1 << 24

# Element names and class words with a meaning.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe svg textarea select title object canvas audio video button".split()
OUT_TAGS = frozenset("nav aside menu dialog head search footer".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond replies reply disqus share sharing social related recommended recommendations widget widgets toolbar pagination pager skip paywall teaser teasers".split())
# words that add nothing to another one in a name: "share-buttons" are for sharing, "social-history" is history
PLAIN_WORDS = frozenset("site page global main primary secondary top bottom left right inner outer upper lower box block container wrapper wrap area zone region section panel bar strip row col column grid list lists item items link links button buttons icon icons btn post posts article articles story stories entry entries content body text slot unit form field input group module component header head title label nav inline sticky fixed floating mobile desktop small large big in out of to the and for up us our more tags tag js wp id class view first last new thread threads count holder heading".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
MAIN_WORDS = frozenset("article content main post entry story articlebody".split())
STATE_WORDS = (frozenset("has no with without is not hide show".split()), frozenset("open closed enabled disabled on off visible count left right".split()))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = frozenset("article main nav header footer section h1 h2 h3".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Marks that a label ends with: what the element says of what's in it.
OUT, DOUBT, MAIN, ARTICLE, HEADER, FORM = "-", "!", "+", "*", "^", "~"


def label_of(name: str, attributes: str) -> str:
    """An element's name in streams: its tag, the words of its classes and id, and its mark, if any."""
    got = {}
    for m in _ATTRIBUTE.findall(attributes) if attributes else ():
        got.setdefault(m[0].lower(), m[1] or m[2] or m[3])
    tokens = [[w.lower() for w in _WORD.findall(t)] for k in ("class", "id", "itemprop") for t in got.get(k, "").split()]
    label = name + "".join(f".{w}" for w in sorted({w for t in tokens for w in t}))
    hidden = "hidden" in got and got["hidden"].lower() != "false" or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    if name in ("body", "html"):
        return name
    role = got.get("role", "").lower()
    # "has-sidebar" and "comments-open" tell a state; "comment-list" and "site-footer" what it is
    telling = [t for t in tokens if t and t[0] not in STATE_WORDS[0] and not (len(t) > 1 and t[-1] in STATE_WORDS[1])]
    says = lambda words: any(w in words for t in telling for w in t)
    # a name with a word of its own beside these, as "comment-free" or "ad-hoc", is about something else
    means = lambda words: any(any(w in words for w in t) and all(w in words or w in OUT_WORDS or w in PLAIN_WORDS or len(w) < 3 for w in t) for t in telling)
    if name == "main" or role == "main" and not hidden:
        return label + MAIN
    if name in OUT_TAGS or hidden or role in OUT_ROLES or means(COMMENT_WORDS):
        return label + OUT
    if means(OUT_WORDS) and not (name in HEADINGS and not any(set(t) <= OUT_WORDS for t in telling)):
        return label + DOUBT
    if name == "article":
        return label + ARTICLE
    if says(MAIN_WORDS):
        return label + MAIN
    if name == "header" or says(HEADER_WORDS):
        return label + HEADER
    return label + FORM if name == "form" else label


def blocks(html: str, known: dict | None = None) -> list[str | tuple[str, int]]:
    """A page's stream: tags ("p", "/p"), and each block's text with how many of its characters lie in links.

    known: labels of (name, attributes), remembered between pages.
    """
    known = {} if known is None else known
    if len(known) > 50_000:
        known.clear()

    def label(name: str, attributes: str) -> str:
        at = (name, attributes)
        if at not in known:
            known[at] = label_of(name, attributes)
        return known[at]

    found: list[str | tuple[str, int]] = []
    stack: list[tuple[str, str]] = [("", "")]
    text: list[str] = []
    inline_out: list[str] = []
    forms: list[int] = []
    at = links = anchor = 0

    def flush():
        nonlocal links
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                found.append((whole, min(links, len(whole))))
        links = 0

    def close(to: int):
        while len(stack) > to:
            name, own = stack.pop()
            if name == "form" and forms:
                forms.pop()
            found.append(f"/{own}")

    def add(part: str):
        nonlocal links
        part = unescape(part)
        text.append(part)
        if anchor:
            links += len(part.strip())

    for m in _TOKEN.finditer(html):
        start = m.start()
        if start > at and not inline_out:
            add(html[at:start])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name not in BLOCKS:
            if inline_out:
                if m[2] and name in inline_out:
                    del inline_out[inline_out.index(name) :]
                elif not m[2] and name not in VOID:
                    inline_out.append(name)
            elif name == "br":
                text.append(" ")
            elif name == "a":
                anchor = 0 if m[2] else 1
            if not m[2] and not inline_out and name not in VOID and label(name, m[4])[-1] in (OUT, DOUBT):
                inline_out.append(name)
            continue
        inline_out.clear()
        flush()
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                close(depth)
            continue
        if name in ("body", "html"):
            close(1)
        elif stack[-1][0] == "p":
            close(len(stack) - 1)
        for i in range(len(stack) - 1, max(0, len(stack) - 4), -1):
            if stack[i][0] in CLOSES.get(name, ()):
                close(i)
                break
            if stack[i][0] in ("ul", "ol", "dl", "table"):
                break
        if name == "hr":
            continue
        if name in STRUCTURE:  # a form around it is the page's frame, not something to fill in
            for i in forms:
                found[i] = found[i].rstrip(FORM)
        own = label(name, m[4])
        if name == "form":
            forms.append(len(found))
        stack.append((name, own))
        found.append(own)
    if at < len(html) and not inline_out:
        add(html[at:])
    flush()
    close(1)
    return _lift_frames(found)


#: Characters of a block from which on it counts as prose, if little of it is links.
PROSE = 60


def _lift_frames(found: list) -> list:
    """found without the marks of forms that hold most of a page's prose: such a form is the page's frame."""
    prose = [0]  # prose before each place
    for x in found:
        prose.append(prose[-1] + (len(x[0]) if not isinstance(x, str) and len(x[0]) >= PROSE and 3 * x[1] < len(x[0]) else 0))
    opened: list[int] = []
    for i, x in enumerate(found):
        if not isinstance(x, str) or x[-1] != FORM:
            continue
        if x[0] != "/":
            opened.append(i)
        elif opened:
            start = opened.pop()
            if 2 * (prose[i] - prose[start]) > prose[-1]:
                found[start], found[i] = found[start].rstrip(FORM), x.rstrip(FORM)
    return found


# --- streams and wrappers: lists of tags, text slots ("#", the element that they're in, and what those around it say
# together), ["+", ...] repeated, ["?", ...] optional


def fold(items: list, of: list[list[list[int]]] | None = None) -> list:
    """items with runs of equal groups (of up to 12 items) folded into repeated ones.

    of: for each item the places of texts that its slots hold, a list a slot; it is folded likewise, in place.
    """
    out: list = []
    kept: list[list[list[int]]] = []

    def merge(to: list, more: list) -> None:
        for x, y in zip([s for p in to for s in p], [s for p in more for s in p], strict=True):
            x.extend(y)

    for k, x in enumerate(items):
        out.append(x)
        kept.append(of[k] if of is not None else [])
        again = True
        while again:
            again = False
            for n in range(1, min(12, len(out)) + 1):
                tail = out[-n:]
                if n < len(out) and isinstance(out[-n - 1], list) and out[-n - 1][0] == "+" and out[-n - 1][1:] == tail:
                    merge(kept[-n - 1 : -n], kept[-n:])
                    del out[-n:], kept[-n:]
                elif len(out) >= 2 * n and out[-1] == out[-n - 1] and not (n == 1 and isinstance(tail[0], list)) and out[-2 * n : -n] == tail:
                    merge(kept[-2 * n : -n], kept[-n:])
                    out[-2 * n :] = [["+", *tail]]
                    kept[-2 * n :] = [[s for p in kept[-2 * n : -n] for s in p]]
                else:
                    continue
                again = True
                break
    if of is not None:
        of[:] = kept
    return out


def named(found: list) -> list[str]:
    """The stream of blocks() with a slot's name for each text."""
    out: list[str] = []
    stack: list[str] = []
    name = None
    for x in found:
        if not isinstance(x, str):
            if name is None:
                marks = {own[-1] for own in stack}
                inside = next((m for m in (ARTICLE, MAIN) if m in marks), "")
                gone = marks & {OUT, FORM} or HEADER in marks and not inside
                name = "#" + (stack[-1] if stack else "") + "#" + (OUT if gone else DOUBT if DOUBT in marks else inside)
            out.append(name)
            continue
        name = None
        if x[0] != "/":
            stack.append(x)
        elif stack:
            stack.pop()
        out.append(x)
    return out


def stream_of(found: list, places: list | None = None) -> list:
    """The folded stream of blocks(); places gets for each of its slots, in order, which blocks' texts it holds."""
    n, of = 0, []
    for x in found:
        of.append([] if isinstance(x, str) else [[n]])
        n += not isinstance(x, str)
    out = fold(named(found), of)
    if places is not None:
        places += [s for p in of for s in p]
    return out


def _slots(item) -> int:
    return sum(map(_slots, item[1:])) if isinstance(item, list) else int(item[0] == "#")


def _once(items: list, bodies: list[list]) -> list:
    """items with single occurrences of repeated groups' bodies as groups. Slots stay in order."""
    out, i = [], 0
    while i < len(items):
        body = next((b for b in bodies if items[i : i + len(b)] == b), None)
        out.append(["+", *body] if body else items[i])
        i += len(body) if body else 1
    return out


def _flat(wrapper: list) -> list[tuple]:
    """The items of a wrapper, each with: is it optional?"""
    return [(y, isinstance(x, list) and x[0] == "?") for x in wrapper for y in (x[1:] if isinstance(x, list) and x[0] == "?" else [x])]


def _bodies(flat: list[tuple]) -> list[list]:
    return sorted((y[1:] for y, _ in flat if isinstance(y, list)), key=len, reverse=True)


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of long lists a common one, found between runs that both have."""
    n, m = len(a), len(b)
    if n * m > CELLS:
        return [(x.a + i, x.b + i) for x in SequenceMatcher(None, a, b, autojunk=True).get_matching_blocks() for i in range(x.size)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper that covers what a and b cover."""
    a, b = _once(a, _bodies(_flat(b))), _once(b, _bodies(_flat(a)))
    flat, other = _flat(a), _flat(b)  # optional groups are laid open for the alignment, each item marked
    names: dict[str, int] = {}
    number = lambda x: [names.setdefault(json.dumps(y), len(names)) for y, _ in x]
    merged: list = []

    def put(item, optional: bool) -> None:
        if not optional:
            merged.append(item)
        elif merged and isinstance(merged[-1], list) and merged[-1][0] == "?":
            merged[-1].append(item)
        else:
            merged.append(["?", item])

    i = j = 0
    for p, q in [*_common(number(flat), number(other)), (len(flat), len(other))]:
        for x, _ in flat[i:p]:
            put(x, True)
        for x, _ in other[j:q]:
            put(x, True)
        if p < len(flat):
            put(flat[p][0], flat[p][1] or other[q][1])
        i, j = p + 1, q + 1
    return merged


def bind(wrapper: list, stream: list) -> list[int] | None:
    """For each slot of the folded stream the wrapper's slot that it is, or None if the wrapper doesn't match it."""
    flat = _flat(wrapper)
    places = _follow(flat, stream)
    if places is None:
        return None
    first, n = [], 0
    for x, _ in flat:
        first.append(n)
        n += _slots(x)
    return [first[q] + k for q in places for k in range(_slots(flat[q][0]))]


def _follow(flat: list[tuple], stream: list) -> list[int] | None:
    """The places of the wrapper's items that the stream is, by leaving out optional ones; None if it can't be.

    A repeated group is matched by itself or by its body, once. Taking the first item that fits mostly does; where it
    doesn't, all places that the stream may be at are followed.
    """
    names: dict[str, int] = {}
    number = lambda x: names.setdefault(x if isinstance(x, str) else json.dumps(x), len(names))
    wrap = [(number(x), optional) for x, optional in flat]
    items = [number(x) for x in stream]
    i, out = 0, []
    for x in items:
        while i < len(wrap) and wrap[i][0] != x and wrap[i][1]:
            i += 1
        if i == len(wrap) or wrap[i][0] != x:
            break
        out.append(i)
        i += 1
    else:
        if all(optional for _, optional in wrap[i:]):
            return out
    n, m = len(wrap), len(items)
    if n * m > WORK:
        return None
    reach = [n] * (n + 1)  # how far a place can be left behind: up to the next item that isn't optional
    where: dict[int, list[int]] = {}
    bodies: dict[int, list[tuple[list[int], int]]] = {}  # by first item
    for q in range(n - 1, -1, -1):
        reach[q] = reach[q + 1] if wrap[q][1] else q
        where.setdefault(wrap[q][0], []).append(q)
        if isinstance(flat[q][0], list):
            body = [number(x) for x in flat[q][0][1:]]
            bodies.setdefault(body[0], []).append((body, q))
    steps: list[dict[int, int]] = [{0: 0}, *({} for _ in items)]  # by items matched: place -> how many the last one took
    sure: list[list[int]] = []
    for k in range(m + 1):
        sure.append(at := sorted(steps[k]))
        if k == m or not at:
            continue
        for size, q in [*((1, q) for q in where.get(items[k], ())), *((len(b), q) for b, q in bodies.get(items[k], ()) if items[k : k + len(b)] == b)]:
            j = bisect_right(at, q) - 1  # the last place before it reaches furthest
            if j >= 0 and reach[at[j]] >= q:
                steps[k + size][q + 1] = size
    if not sure[m] or reach[sure[m][-1]] != n:
        return None
    out, k, p = [], m, sure[m][-1]
    while k:
        out.append(p - 1)
        k -= steps[k][p]
        p = sure[k][bisect_right(sure[k], out[-1]) - 1]
    return out[::-1]


def covers(wrapper: list, stream: list) -> bool:
    """Does the wrapper match the folded stream?"""
    return bind(wrapper, stream) is not None


def hints(stream: list) -> list[str]:
    """For each slot what the elements around it say: OUT, DOUBT (by their classes only), MAIN, ARTICLE or nothing."""
    return [h for x in stream for h in (hints(x[1:]) if isinstance(x, list) else [x.rpartition("#")[2]] if x[0] == "#" else [])]


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][\w+.-]*://|[/?#].*", "", url or "", flags=re.I | re.S).lower()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    texts_type = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("links", pa.int32())]))
    names = ["page_id", "url", "host", "stream", "key", "page", "texts"]
    for b in batches:
        rows: list[tuple] = []
        held = 0
        for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            found, places = blocks(html.as_py() or "", known), []
            stream = json.dumps(stream_of(found, places))
            slot = {i: k for k, s in enumerate(places) for i in s}
            texts = [x for x in found if not isinstance(x, str)]
            whole = xxhash.xxh64("\n".join(x[0] for x in texts)).intdigest() >> 1
            rows.append((page_id, url, host_of(url), stream, xxhash.xxh64(stream).intdigest() >> 1, whole, [{"at": slot[i], "text": t, "links": n} for i, (t, n) in enumerate(texts)]))
            held += len(html.as_py() or "")
            if held > 8 << 20:
                yield _batch(rows, texts_type, names, b.column(0).type)
                rows, held = [], 0
        if rows:
            yield _batch(rows, texts_type, names, b.column(0).type)


def _batch(rows: list[tuple], texts: pa.DataType, names: list[str], page_id: pa.DataType) -> pa.RecordBatch:
    types = [page_id, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), texts]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, stream (folded, as JSON), its key, page (a hash of all text), texts with the slot that each
    is in: a written table with a row for each page (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, stream string, key long, page long, texts array<struct<at:int,text:string,links:int>>"
    return cut(pages.select("page_id", "url", "html").mapInArrow(_parse, schema), "parsed-pages")


def _infer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper from some streams or wrappers of a host, the most frequent first."""
    wrapper: list | None = None
    for what in rows.sort_values(["pages", "wrapper"], ascending=[False, True])["wrapper"]:
        stream = json.loads(what)
        if wrapper is None:
            wrapper = stream
        elif not covers(wrapper, stream):
            wrapper = align(wrapper, stream)
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper)], "pages": [int(rows["pages"].sum())]})


def streams(read: DataFrame) -> DataFrame:
    """host, key, stream, pages: a row for each different stream of a host of parsed pages, written."""
    return cut(read.groupBy("host", "key", "stream").agg(F.count("*").alias("pages")), "streams")


def wrappers(found: DataFrame, fan: int = FAN) -> DataFrame:
    """host, wrapper (as JSON), pages for the streams of hosts.

    A host's streams are aligned in rounds, about `fan` in a task, until one wrapper is left; so a host with any number
    of different streams never meets in one task.
    """
    level = found.select("host", F.col("stream").alias("wrapper"), "pages")
    while True:
        counts = cut(level.groupBy("host").agg(F.count("*").alias("n")), "streams-of-hosts")
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return level
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / F.lit(fan)).cast("long")).alias("part")
        dealt = level.join(sized(counts), "host").select("host", "wrapper", "pages", part)
        level = cut(dealt.groupBy("host", "part").applyInPandas(_infer, "host string, wrapper string, pages long"), "wrappers-round")


def _bind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each slot of a stream: host, key, at, slot (the wrapper's), hint. A stream that its wrapper doesn't
    match, if there is one, has slots of its own."""
    for b in batches:
        out: list[tuple] = []
        held: tuple = ("", [])
        for host, key, stream, wrapper in b.itertuples(index=False):
            if held[0] != wrapper:
                held = (wrapper, json.loads(wrapper))
            items = json.loads(stream)
            slots = bind(held[1], items)
            out += [(host, key, at, f"{key}:{at}" if slots is None else str(slots[at]), hint) for at, hint in enumerate(hints(items))]
        yield pd.DataFrame(out, columns=["host", "key", "at", "slot", "hint"])


def score() -> Column:
    """How much speaks for a slot: content if it's over 0."""
    links = F.col("links") / F.greatest(F.col("chars"), F.lit(1))
    constant = (F.col("low") == F.col("high")) & (F.col("contents") >= STEADY)
    prose = (F.col("chars") / F.greatest(F.col("texts"), F.lit(1)) >= 60) & (links < 0.3)
    most = prose & ~constant & (2 * F.col("chars") > F.col("host_chars"))
    hint = F.element_at(F.create_map(*[F.lit(x) for kv in {ARTICLE: 3, MAIN: 2, "": 0, DOUBT: -4, OUT: -9}.items() for x in kv]), F.col("hint"))
    points = lambda x, n: F.when(x, n).otherwise(0)
    return 1 + hint - points(constant, 2) - points(links > 0.5, 2) + points(prose, 1) + points(most, 3)


def slots(read: DataFrame, found: DataFrame, learned: DataFrame) -> DataFrame:
    """host, key, pages, kept (slots of the stream that are content): a row for each different stream of a host.

    Slots outside what calls itself the article or main content count only where they hold over twice as much text as
    those inside.
    """
    bound = cut(found.join(sized(learned.select("host", "wrapper"), wide=F.octet_length("wrapper")), "host").select("host", "key", "stream", "wrapper").mapInPandas(_bind, "host string, key long, at int, slot string, hint string"), "bound-slots")
    each = read.select("host", "key", "page", F.explode("texts").alias("t")).select("host", "key", "page", "t.at", F.xxhash64("t.text").alias("h"), F.length("t.text").alias("n"), "t.links")
    own = each.groupBy("host", "key", "at").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.approx_count_distinct("page", 0.1).alias("contents"), F.count("*").alias("texts"), F.sum("n").alias("chars"), F.sum("links").alias("links"))
    own = cut(own.join(bound, ["host", "key", "at"]), "texts-of-slots")
    total = own.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("contents").alias("contents"), F.sum("texts").alias("texts"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.collect_set("hint").alias("hints"))
    least = F.coalesce(*[F.when(F.array_contains("hints", x), x) for x in (OUT, DOUBT, "", MAIN, ARTICLE)])  # at most five
    judged = total.withColumn("hint", least).withColumn("host_chars", F.sum("chars").over(Window.partitionBy("host"))).select("host", "slot", "hint", (score() > 0).alias("content"))
    both = own.drop("hint").join(judged, ["host", "slot"]).where("content")
    chars = lambda inside: F.sum(F.when(F.col("hint").isin(MAIN, ARTICLE) == inside, F.col("chars")).otherwise(0))
    places = lambda inside: F.collect_list(F.when(F.col("hint").isin(MAIN, ARTICLE) | F.lit(not inside), F.col("at")))
    kept = both.groupBy("host", "key").agg(chars(True).alias("in"), chars(False).alias("out"), places(True).alias("main"), places(False).alias("all"))
    kept = kept.select("host", "key", F.when((F.col("in") > 0) & (2 * F.col("in") >= F.col("out")), F.col("main")).otherwise(F.col("all")).alias("kept"))
    return cut(found.select("host", "key", "pages").join(kept, ["host", "key"], "left"), "content-slots")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    read = parsed(pages)
    found = streams(read)
    return chosen(read, slots(read, found, wrappers(found)))


def chosen(read: DataFrame, kept: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The texts of parsed pages by the slots that are content; kept is broadcast up to so many rows."""
    pages = read.select("page_id", "url", "host", "key", "texts")
    small = sized(kept, rows, 64 + F.octet_length("host") + 4 * F.coalesce(F.size("kept"), F.lit(0)))
    both = join_dealt(pages, kept, ["host", "key"], "pages", ["page_id", "url"], "left") if small is kept else pages.join(small, ["host", "key"], "left")
    own = F.transform(F.filter("texts", lambda t: F.array_contains(F.coalesce("kept", F.array().cast("array<int>")), t["at"])), lambda t: t["text"])
    text = F.array_join(own, "\n\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
