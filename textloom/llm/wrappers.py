"""Main text of web pages by wrappers: union-free regular expressions inferred per host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

MERGED = 64  # page structures of a host that are aligned in one task, on average
DEPTH = 100  # elements within elements that a path tells
CELLS = 250_000  # places of two structures that are compared in one table
BROADCAST_ROWS = 20_000  # distinct page structures that are broadcast
REPEATED = 5  # pages of different text that tell a text which all of them hold from main text

# Fixed by HTML: elements whose content is not shown, with what ends it in a page without the end
# tag (nothing is lost for them but the tag itself, the rest of the page for code, the words before
# the next tag for titles), and elements that do not break a block. What may stand in a head is
# silent or void, so the head itself ends of its own where other content begins.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object", "title")
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
OPTIONAL_END = "p li dt dd td th tr option colgroup thead tbody tfoot".split()
# Elements, and words in class, id or role, that hold no main text.
SIDE_TAGS = "nav header footer aside form button select textarea menu dialog".split()
SIDE_WORDS = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer footer form header legal login menu nav navbar navigation newsletter notice "
    "popup promo related search share sharing sidebar social sponsor sponsored subscribe toolbar "
    "widget"
).split()
MODIFIERS = "with without has no tag category".split()  # before such a word: not the thing itself
MAIN_TAGS = ("article", "main")
# Inside a main element a word may name what a section is about. There these tell in any place, the
# next ones as an id of their own, and all others as a class or role, alone or with words for parts.
COMMENT_OR_AD = "ad ads advert advertisement comment comments promo sponsor sponsored".split()
PLAIN_IDS = "breadcrumb breadcrumbs navbar popup sidebar toolbar widget".split()
PARTS = (
    "bar block box button buttons container inner item items link links list module panel post posts "
    "signup slot stories unit wrap wrapper"
).split()

# Attributes up to the end of a tag: a quotation mark opens a value only after an equals sign.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<silent>{'|'.join(SILENT)})(?=[\s/>])(?P<inside>{_ATTRS})>"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>"
    r"|<[!?][^>]*>|<[a-zA-Z/!?][^<>]*\Z",
    re.S | re.I,
)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
_UNCLOSED = {"script": re.compile(r"\Z"), "style": re.compile(r"\Z"), "title": re.compile(r"(?=<)|\Z")}
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")  # a slash behind it belongs to the value
_ATTR = re.compile(r"([^\s=/>][^\s=/>]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))|[^\s=/>]++")

Item = str | list  # a token, or ["+" or "?", items]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@lru_cache(4096)
def _label(name: str, attrs: str) -> str:
    """The element with the words of its class, id and role; ``has-sidebar`` says nothing of a sidebar.

    A word that also counts inside a main element ends in ``*``.
    """
    words: set[str] = set()
    for key, *values in _ATTR.findall(attrs):
        key = key.lower()
        if key not in ("class", "id", "role"):
            continue
        for known in "".join(values).lower().split():
            pieces = [w for w in _modified(re.split(r"[^a-z]+", known)) if w]
            if key == "id":
                telling = pieces if len(pieces) == 1 and pieces[0] in PLAIN_IDS else []
            else:
                telling = pieces if all(w in SIDE_WORDS or w in PARTS for w in pieces) else []
            words.update(w + "*" if w in telling or w in COMMENT_OR_AD else w for w in pieces)
    return ".".join([name, *sorted(words)])


def _modified(words: list[str]) -> list[str]:
    return ["-".join(words)] if len(words) > 1 and words[0] in MODIFIERS else words


def _silent_end(page: str, m: re.Match, unclosed: set[str]) -> int:
    """Where a silent element ends; ``unclosed`` collects names without a later end tag."""
    name, inside = m["silent"].lower(), m["inside"]
    if name in ("svg", "iframe", "object", "template") and inside.endswith("/"):
        if not _UNQUOTED.search(inside):
            return m.end()
    end = None if name in unclosed else _END[name].search(page, m.end())
    if end is None:
        unclosed.add(name)
        end = _UNCLOSED[name].search(page, m.end()) if name in _UNCLOSED else m
    return end.end()


def tokens(page: str | None) -> Iterator[tuple[str, str, int]]:
    """``kind, value, link``: ``<`` with an element's label, ``>`` with its name, ``#`` with a text.

    Inline elements leave no token; ``link`` counts the characters that stand in
    links. Elements that may stay open are closed by what follows them.
    """
    page = page or ""
    piece: list[str] = []
    link = at = 0
    in_link = 0

    def text() -> Iterator[tuple[str, str, int]]:
        nonlocal link
        value = " ".join(entities.unescape("".join(piece)).split())
        piece.clear()
        if value:
            yield "#", value, min(link, len(value))
        link = 0

    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece.append(page[at : m.start()])
            link += in_link * (m.start() - at)
        at = m.end()
        if m["silent"]:
            at = _silent_end(page, m, unclosed)
            continue
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m["close"] else 1
        if name in INLINE or name in SILENT:  # of the latter, a stray end tag
            continue
        if name == "head":
            yield from text()
            continue
        if name == "br":
            piece.append(" ")
            continue
        yield from text()
        if m["close"]:
            if name not in OPTIONAL_END:
                yield ">", name, 0
        elif name not in VOID:
            yield "<", _label(name, m["attrs"]), 0
    if at < len(page):
        piece.append(page[at:])
        link += in_link * (len(page) - at)
    yield from text()


def parse(page: str | None) -> tuple[list[Item], list[tuple[int, str, int]]]:
    """The page as a folded expression, and its texts with their slot in it.

    A slot is a text token of the expression, numbered in order. Repetitions are
    folded into groups first, so texts of all repeats share a slot.
    """
    flat: list[str] = []
    texts: list[tuple[str, int]] = []
    for kind, value, link in tokens(page):
        if kind == "#":
            texts.append((value, link))
            flat.append("#")
        else:
            flat.append(kind + value)
    folded, slots = fold(flat)
    return folded, [(s, t, n) for s, (t, n) in zip(slots, texts, strict=True)]


def fold(flat: list[str]) -> tuple[list[Item], list[int]]:
    """Fold neighbouring repeats into ``["+", items]``; the slot of each text token.

    Works on a stack: as the last tokens repeat those before them, or the body
    of the group before them, they are taken into one group.
    """
    items: list[tuple[Item, list]] = []  # an item with the texts of its slots
    longest = 12
    count = 0

    for token in flat:
        held = []
        if token == "#":
            held = [[count]]
            count += 1
        items.append((token, held))
        again = True
        while again:
            again = False
            for n in range(1, min(longest, len(items) // 2 + 1) + 1):
                if n >= len(items):
                    break
                before = items[-n - 1]
                group = isinstance(before[0], list) and len(before[0][1]) == n
                if not group and before[0] != items[-1][0]:
                    continue
                tail = items[-n:]
                if not any(isinstance(i, list) or i[0] == "<" for i, _ in tail):
                    continue  # a group holds an element
                body = [i for i, _ in tail]
                if group and before[0][1] == body:
                    for have, more in zip(before[1], [s for _, h in tail for s in h], strict=True):
                        have.extend(more)
                    del items[-n:]
                    again = True
                    break
                twin = items[-2 * n : -n]
                if [i for i, _ in twin] == body:
                    slots = [s for _, h in twin for s in h]
                    for have, more in zip(slots, [s for _, h in tail for s in h], strict=True):
                        have.extend(more)
                    del items[-2 * n :]
                    items.append((["+", body], slots))
                    again = True
                    break
    slot_of = [0] * count
    for number, places in enumerate(s for _, h in items for s in h):
        for p in places:
            slot_of[p] = number
    return [i for i, _ in items], slot_of


def _head(item: Item) -> str:
    while not isinstance(item, str):
        item = item[1][0]
    return item


def _key(item: Item) -> str | None:
    """Items of equal keys may be one in a common expression; those without a key stand alone."""
    head = _head(item)
    return head if head != "#" or isinstance(item, str) else None


def _table(x: list, y: list) -> list[tuple[int, int]]:
    """The matches of a longest common subsequence."""
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below, key = rows[i], rows[i + 1], x[i]
        for j in range(len(y) - 1, -1, -1):
            if key is not None and key == y[j]:
                row[j] = below[j + 1] + 1
            else:
                row[j] = max(below[j], row[j + 1])
    out = []
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] is not None and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _anchors(x: list, y: list) -> list[tuple[int, int]]:
    """Keys that stand once on both sides, the most of them that are in the same order."""
    in_x, in_y = Counter(x), Counter(y)
    at = {k: j for j, k in enumerate(y) if k is not None and in_y[k] == 1}
    pairs = [(i, at[k]) for i, k in enumerate(x) if k in at and in_x[k] == 1]
    ends: list[int] = []  # the least end of a rising run of each length
    last: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        back.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [n]
    out = []
    n = last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _matches(x: list, y: list) -> list[tuple[int, int]]:
    """Matching places, rising on both sides.

    Up to ``CELLS`` places are compared in a table. Longer stretches are cut
    at keys that stand once on both sides, or where there are none at their
    middles, so that memory is bounded and time is in proportion to the length.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] is not None and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= CELLS:
            out.extend((a + i, c + j) for i, j in _table(x[a:b], y[c:d]))
            continue
        cuts = [(a + i, c + j) for i, j in _anchors(x[a:b], y[c:d])]
        out.extend(cuts)
        if cuts:
            begins, ends = [(a, c), *((i + 1, j + 1) for i, j in cuts)], [*cuts, (b, d)]
        else:
            half = (a + b) // 2, (c + d) // 2
            begins, ends = [(a, c), half], [half, (b, d)]
        todo.extend((i, k, j, m) for (i, j), (k, m) in zip(begins, ends, strict=True))
    return sorted(out)


def _pairs(a: list[Item], b: list[Item]) -> list[tuple[int | None, int | None]]:
    """An alignment: pairs of places that match, or a place and None."""
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for k, m in [*_matches([_key(x) for x in a], [_key(x) for x in b]), (len(a), len(b))]:
        out.extend((n, None) for n in range(i, k))
        out.extend((None, n) for n in range(j, m))
        if k < len(a):
            out.append((k, m))
        i, j = k + 1, m + 1
    return out


def _body(item: Item) -> list[Item]:
    return item[1] if isinstance(item, list) else [item]


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The least common generalisation that the alignment shows.

    What stands in one only becomes optional; a group on one side makes the
    other one repeated; texts that differ are slots already.
    """
    out: list[Item] = []
    lone: list[Item] = []

    def end() -> None:
        if lone:
            out.append(["?", list(lone)] if not _is_optional(lone) else lone[0])
            lone.clear()

    for i, j in _pairs(a, b):
        if i is not None and j is not None:
            end()
            out.append(_join(a[i], b[j]))
        else:
            lone.append(a[i] if j is None else b[j])
    end()
    return out


def _is_optional(items: list[Item]) -> bool:
    return len(items) == 1 and isinstance(items[0], list) and items[0][0] == "?"


def _join(x: Item, y: Item) -> Item:
    if isinstance(x, str) and isinstance(y, str):
        return x
    marks = {i[0] for i in (x, y) if isinstance(i, list)}
    body = align(_body(x), _body(y))
    return ["+" if "+" in marks else "?", body]


def slots_of(wrapper: list[Item], page: list[Item]) -> list[int]:
    """For each slot of the page's expression, its slot in the wrapper that covers it; else -1."""
    numbers: dict[int, int] = {}

    def number(items: list[Item], at: int) -> int:
        for item in items:
            numbers[id(item)] = at if isinstance(item, list) else 0
            at = number(item[1], at) if isinstance(item, list) else at + (item == "#")
        return at

    def texts(items: list[Item]) -> int:
        return sum(texts(i[1]) if isinstance(i, list) else i == "#" for i in items)

    def walk(w: list[Item], p: list[Item], base: int) -> list[int]:
        begin, n = [], base
        for item in w:
            begin.append(n)
            n += texts([item])
        found: dict[int, list[int]] = {}
        for i, j in _pairs(w, p):
            if i is not None and j is not None:
                if isinstance(w[i], str) and isinstance(p[j], str):
                    found[j] = [begin[i]] if p[j] == "#" else []
                else:
                    found[j] = walk(_body(w[i]), _body(p[j]), begin[i])
        out: list[int] = []
        for j, item in enumerate(p):
            got = found.get(j)
            out.extend(got if got is not None and len(got) == texts([item]) else [-1] * texts([item]))
        return out

    flat = unfold_optional(wrapper)
    return walk(flat, page, 0)


def unfold_optional(items: list[Item]) -> list[Item]:
    """The wrapper with its optional groups opened, for matching; slots keep their order."""
    out: list[Item] = []
    for item in items:
        if isinstance(item, list) and item[0] == "?":
            out.extend(unfold_optional(item[1]))
        elif isinstance(item, list):
            out.append(["+", unfold_optional(item[1])])
        else:
            out.append(item)
    return out


def paths(page: list[Item]) -> list[list[str]]:
    """The labels of the elements around each slot of an expression.

    Elements deeper than ``DEPTH`` count as siblings, as in browsers.
    """
    out: list[list[str]] = []

    def walk(items: list[Item], stack: list[str]) -> None:
        for item in items:
            if isinstance(item, list):
                walk(item[1], list(stack))
            elif item == "#":
                out.append(list(stack))
            elif item[0] == "<":
                name = item[1:].split(".")[0]
                if name in OPTIONAL_END or name == "p":
                    while stack and stack[-1].split(".")[0] in OPTIONAL_END:
                        stack.pop()
                if len(stack) >= DEPTH:
                    stack.pop()
                stack.append(item[1:])
            else:
                names = [s.split(".")[0] for s in stack]
                if item[1:] in names:
                    del stack[len(names) - 1 - names[::-1].index(item[1:]) :]

    walk(page, [])
    return out


def side_label(label: str, inside: bool) -> str | None:
    """``"tag"`` or ``"words"`` by which an element is a menu, header, footer or the like.

    ``inside`` tells whether it stands in an article or main element, whose own
    words say nothing, whose header is part of it, and whose sections may be
    called after what they are about.
    """
    name, *words = label.split(".")
    if name in ("html", "body", *MAIN_TAGS) or (name == "header" and inside):
        return None
    if name in SIDE_TAGS:
        return "tag" if name != "form" else "words"  # a form may hold the whole page
    told = {w.rstrip("*") for w in words if not inside or w.endswith("*")} & set(SIDE_WORDS)
    return "words" if told - ({"header"} if inside else set()) else None


def side_elements(path: list[str]) -> list[tuple[tuple[str, ...], str]]:
    """The elements of a path that look like side elements, and by what."""
    found, inside = [], False
    for n, label in enumerate(path, 1):
        inside = inside or label.split(".")[0] in MAIN_TAGS
        by = side_label(label, inside)
        if by:
            found.append((tuple(path[:n]), by))
    return found


def side_slots(slots: list[dict]) -> set[int]:
    """The slots of a layout in side elements.

    A class, id or role says nothing where its element encloses a main element,
    all articles with at least half of the text, or nine tenths of the text:
    that of slots which are not links, not repeated and not in a nav, header,
    footer, aside or the like by tag.
    """
    marked = [(s, side_elements(s["path"])) for s in slots]
    plain = [
        s for s, found in marked
        if not s["links"] and not s["repeated"] and all(by != "tag" for _, by in found)
    ]
    chars = sum(s["chars"] for s in plain)

    def names(s: dict, n: int) -> set[str]:
        return {p.split(".")[0] for p in s["path"][n:]}

    articles = [s for s in plain if "article" in names(s, 0)]

    def encloses(element: tuple[str, ...]) -> bool:
        n = len(element)
        held = [s for s in plain if tuple(s["path"][:n]) == element]
        own = sum(s["chars"] for s in held)
        if any("main" in names(s, n) for s in held) or (held and 10 * own >= 9 * chars):
            return True
        inner = sum("article" in names(s, n) for s in held)
        return 2 * own >= chars and 0 < inner == len(articles)

    excused = {e: encloses(e) for _, found in marked for e, by in found if by == "words"}
    return {s["slot"] for s, found in marked if any(not excused.get(e, False) for e, _ in found)}


def choose(slots: list[dict]) -> set[int]:
    """The slots of a layout that hold main text.

    ``slots`` tell each slot's ``path``, its ``chars`` in this layout and its
    ``weight``, the characters of its place over all pages of the host;
    ``links`` are slots made of links, ``repeated`` ones hold one text in pages
    that differ elsewhere. Side elements fall out, and links and repeated slots
    outside article and main elements; the repeated ones stay if they are more than
    nine tenths of what is left: such pages are copies that differ in a counter or a date.
    Of the rest, those in article and main elements are taken if one of them is in a
    main element or they hold half of the characters; articles with less are teasers
    beside the text. Else those in the layout's smallest element that holds nine tenths of the
    characters, by ``chars`` and by ``weight``: a page with one long quotation is
    not cut to it, nor is a rare template measured by a hot one.
    """

    def in_main(s: dict) -> bool:
        return any(p.split(".")[0] in MAIN_TAGS for p in s["path"])

    side = side_slots(slots)
    text = [s for s in slots if s["slot"] not in side and (in_main(s) or not s["links"])]
    good = [s for s in text if in_main(s) or not s["repeated"]]
    if 10 * sum(s["chars"] for s in good) < sum(s["chars"] for s in text):
        good = text
    named = [s for s in good if in_main(s)]
    sure = any(p.split(".")[0] == "main" for s in named for p in s["path"])
    if named and (sure or 2 * sum(s["chars"] for s in named) >= sum(s["chars"] for s in good)):
        return {s["slot"] for s in named}
    held: dict[tuple[str, ...], tuple[int, int]] = {}
    for s in good:
        for n in range(len(s["path"]) + 1):
            chars, weight = held.get(tuple(s["path"][:n]), (0, 0))
            held[tuple(s["path"][:n])] = chars + s["chars"], weight + s["weight"]
    best: tuple[str, ...] = ()
    all_chars, all_weight = held.get((), (0, 0))
    for path, (chars, weight) in held.items():
        most = 10 * chars >= 9 * all_chars and 10 * weight >= 9 * all_weight
        if most and (len(path), path) > (len(best), best):
            if not path or path[-1].split(".")[0] not in OPTIONAL_END:
                best = path
    return {s["slot"] for s in good if tuple(s["path"][: len(best)]) == best}


def _merge(rows: list[list[Item]]) -> list[Item]:
    wrapper = rows[0]
    for row in rows[1:]:
        if row != wrapper:
            wrapper = align(wrapper, row)
    return wrapper


def extract(
    pages: DataFrame,
    scratch: Scratch,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id, url, text`` for every row: the main text of each page.

    1. Each page becomes a token stream; inline elements vanish, repeats fold
       into groups, so pages of one layout share an expression, and its 128-bit hash.
    2. The distinct expressions of a host are aligned: mismatches become optional
       parts, repeats become groups, differing texts are slots. About 64 of them meet
       in a task, and their common expressions meet in the next round.
    3. Characters, link characters and repeated texts are summed per slot of the
       wrapper, over all pages, copies of a page counting once for the latter; with these each layout decides which of its
       slots hold main text.
    4. Each page's texts in these slots are joined in page order.

    Character references are decoded, white space inside a block becomes one
    space. A null or empty page has an empty text. A null or broken URL counts
    as the host ``""``. Pages that repeat, and ids that repeat or are null, are
    rows of their own. Side content in a page that its host's wrapper does not
    cover is judged by its path and its page. Other columns are ignored. The result
    reads tables of ``scratch``.
    """
    source = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    parsed = scratch.table(
        source.mapInArrow(
            _parse_pages,
            "id long, url string, host string, layout string, shape string, "
            "texts array<struct<slot:int,text:string,chars:int,link:int>>",
        ).withColumn("page", F.xxhash64(F.transform("texts", lambda t: t["text"]))),
        "parsed",
    )
    # Sketches of page texts count the few that matter exactly and do not grow with the pages.
    layouts = scratch.table(
        parsed.groupBy("host", "layout").agg(
            F.hll_sketch_agg("page").alias("pages"), F.any_value("shape").alias("shape")
        ),
        "layouts",
    )
    wrappers = _wrappers(layouts.select("host", "shape"), scratch)
    wrapper = wrappers.select("host", F.col("shape").alias("wrapper"))
    matched = scratch.table(
        layouts.select("host", "layout", "shape").join(wrapper, "host").mapInArrow(
            _match, "host string, layout string, places array<struct<place:int,path:string>>"
        ),
        "matched",
    )
    each = parsed.select("host", "layout", F.explode("texts").alias("t"))
    per_layout = each.groupBy("host", "layout", "t.slot").agg(
        F.sum("t.chars").alias("chars"), F.sum("t.link").alias("link"),
        F.min(F.xxhash64("t.text")).alias("low"), F.max(F.xxhash64("t.text")).alias("high"),
    )
    placed = matched.select("host", "layout", F.posexplode("places").alias("slot", "at"))
    placed = placed.select("host", "layout", "slot", "at.place", "at.path")
    slots = scratch.table(per_layout.join(placed, ["host", "layout", "slot"]), "slots")
    stats = (
        slots.join(layouts.drop("shape"), ["host", "layout"])
        .groupBy("host", "place", "path")
        .agg(
            F.sum("chars").alias("weight"), F.sum("link").alias("link"), F.hll_union_agg("pages").alias("pages"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
    )
    equal = (F.col("place") >= 0) & (F.col("low") == F.col("high"))
    stats = stats.select(
        "host", "place", "path", "weight", (2 * F.col("link") > F.col("weight")).alias("links"),
        (equal & (F.hll_sketch_estimate("pages") >= REPEATED)).alias("repeated"),
    )
    judged = slots.select("host", "layout", "slot", "place", "path", "chars").join(
        stats, ["host", "place", "path"]
    )
    judged = judged.groupBy("host", "layout").agg(
        F.collect_list(F.struct("slot", "path", "chars", "weight", "links", "repeated")).alias("slots")
    )
    kept = scratch.table(
        judged.mapInArrow(_choose, "host string, layout string, main array<int>"), "kept-slots"
    )
    few = kept.count() <= broadcast_rows
    joined = parsed.drop("shape").join(F.broadcast(kept) if few else kept, ["host", "layout"], "left")
    chosen = F.filter("texts", lambda t: F.array_contains("main", t["slot"]))
    text = F.array_join(F.transform(chosen, lambda t: t["text"]), " ")
    return joined.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.coalesce(text, F.lit("")).alias("text")
    )


def _wrappers(layouts: DataFrame, scratch: Scratch) -> DataFrame:
    """One expression per host that generalises its ``layouts``, merged as a tree."""
    while True:
        sizes = layouts.groupBy("host").agg(F.count("*").alias("size"))
        most = sizes.agg(F.max("size")).first()[0] or 0
        if most <= 1:
            return layouts
        part = F.pmod(F.xxhash64("shape"), F.ceil(F.col("size") / MERGED))
        dealt = layouts.join(sizes, "host").select("host", part.alias("part"), "shape")
        merged = dealt.groupBy("host", "part").applyInArrow(_infer, "host string, shape string")
        layouts = scratch.table(merged, "wrappers")


_PARSED = pa.schema(
    [
        ("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("layout", pa.string()),
        ("shape", pa.string()),
        (
            "texts",
            pa.list_(
                pa.struct(
                    [("slot", pa.int32()), ("text", pa.string()), ("chars", pa.int32()), ("link", pa.int32())]
                )
            ),
        ),
    ]
)


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            rows = []
            for r in batch.slice(a, 200).to_pylist():
                folded, texts = parse(r["html"])
                shape = json.dumps(folded)
                rows.append(
                    {
                        "id": r["id"], "url": r["url"], "host": host_of(r["url"]),
                        "layout": hashlib.blake2b(shape.encode(), digest_size=16).hexdigest(),
                        "shape": shape,
                        "texts": [
                            {"slot": s, "text": t, "chars": len(t), "link": n} for s, t, n in texts
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _PARSED)


def _infer(table: pa.Table) -> pa.Table:
    shapes = sorted(set(table.column("shape").to_pylist()), key=lambda x: (len(x), x))
    wrapper = _merge([json.loads(x) for x in shapes])
    return pa.table({"host": [table.column("host")[0].as_py()], "shape": [json.dumps(wrapper)]})


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("host", pa.string()), ("layout", pa.string()),
         ("places", pa.list_(pa.struct([("place", pa.int32()), ("path", pa.string())])))]
    )
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            page = json.loads(r["shape"])
            found = zip(slots_of(json.loads(r["wrapper"]), page), paths(page), strict=True)
            places = [{"place": n, "path": " ".join(p)} for n, p in found]
            rows.append({"host": r["host"], "layout": r["layout"], "places": places})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("layout", pa.string()), ("main", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            slots = [{**s, "path": s["path"].split()} for s in r["slots"]]
            rows.append({"host": r["host"], "layout": r["layout"], "main": sorted(choose(slots))})
        yield pa.RecordBatch.from_pylist(rows, schema)
