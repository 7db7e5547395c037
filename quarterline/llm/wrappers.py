"""Main text of pages by wrappers: union-free regular expressions inferred per template of a host.

Pages of a host whose article lies under the same elements are one template. The token streams of all of them (tags with their
classes, text) are aligned: runs that repeat inside a page become repeated groups, tokens that
some pages lack become optional, text that the pages have in one place is a constant, and other text is a slot. The result
is a regular expression without alternatives over tokens, the template's wrapper, in which the part that holds the
article is marked. Every different page is read once, into an outline; counts and folds over outlines are Spark's.

Slots decide which part that is: the innermost element in one place on two thirds of the pages that holds most of the text that
differs between pages. Tags and names only settle its extent, where the element they point at holds that one or lies in
it. Constants inside the article stay (a heading that all articles share is article text); where no element
holds the article, those before the first and after the last slot go.

A page that its wrapper matches has its article between the marks. A page that does not match (truncated, say) has it
found on its own tokens by tags and names. Tags that hardly any page of a template has are read over in matching. Either way menus, forms, notices, comments
and the like inside are left out by their tags and names.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Set
from functools import lru_cache, reduce
from itertools import accumulate, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.session import BATCH_ROWS, stage

#: different pages from which on a text that all of them have is the template's
ALIKE = 3
#: a text is a constant where at most one in this many pages lacks it
EVERY = 20
#: structures of a template that the first round of a fold takes, about
FOLDED = 64
#: a tag is the template's if one in this many pages has it; pages are read as if other tags were not there
RARE = 1000
#: characters of wrappers, or of other values per template, up to which they are broadcast; more are joined by shuffle
BROADCAST_CHARS = 16_000_000
#: product of lengths up to which an alignment is kept whole (bits)
_CELLS_HELD = 1 << 30

# fixed values: element names by what they do to text
_RAW = "script|style|noscript|iframe|template|svg|math|object|canvas|audio|video|title|textarea|select"
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split())
_SPACES = frozenset("td th option img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav header footer aside form button dialog menu head label fieldset".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion sidebar side aside menu nav navbar "
    "navigation breadcrumb breadcrumbs header footer masthead topbar cookie cookies consent notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond "
    "reply replies widget toolbar pagination pager skip copyright legal tags form search".split())
_HOLDERS = frozenset("article center div main section td".split())
_MAIN_NAMES = frozenset("content main article post entry story maincontent articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[-_]*[0-9]+")

# where HTML ends an element without its end tag: what an opening tag ends, and what it does not reach beyond
_CELLS = frozenset("td th".split())
_ROWS = _CELLS | {"tr"}
_BARS = frozenset("table td th caption html".split())
_ITEM_BARS = (_BLOCKS | _CELLS | {"button"}) - frozenset("address div p".split())
_ENDS_P = _BLOCKS - frozenset("body br caption html legend tbody tfoot thead tr".split())
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
_IN_HEAD = frozenset("base link meta".split())
_IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), _ITEM_BARS - {"li"}),
    **dict.fromkeys(("dd", "dt"), (frozenset({"dd", "dt"}), _ITEM_BARS - {"dd", "dt"})),
    **dict.fromkeys(("td", "th"), (_CELLS, frozenset({"table", "tr"}))),
    "tr": (_ROWS, frozenset({"table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_ROWS | {"tbody", "thead", "tfoot", "caption"}, frozenset({"table"}))),
    "option": (frozenset({"option"}), frozenset({"datalist"})),
}

#: (kind, name, label): kind is "open", "close" or "text"; the label of a text is the text
Token = tuple[str, str, str]


@lru_cache(maxsize=4096)
def _label(name: str, attributes: str) -> str:
    """Element name with its sorted class, id and role words, without digits."""
    found = {_DIGITS.sub("", w) for found in _NAMES.findall(attributes) for w in "".join(found).lower().split()}
    return " ".join([name, *sorted(found - {""})])


def tokens(page: str) -> list[Token]:
    found: list[Token] = []
    for match in _TOKEN.finditer(page):
        kind = match.lastgroup
        if kind == "text":
            text = match["text"]
            if found and found[-1][0] == "text":
                found[-1] = ("text", "", found[-1][2] + text)
            else:
                found.append(("text", "", text))
        elif match["name"] or match["name2"]:
            name = (match["name"] or match["name2"]).lower()
            if match["close"] or match["close2"]:
                found.append(("close", name, name))
            else:
                found.append(("open", name, _label(name, match["attributes"] or match["attributes2"] or "")))
    return found


def _ends(page: list[Token]) -> list[int]:
    """Per token that opens an element, the first token past its content.

    That is its end tag. Without one, it is the tag by which HTML implies the end (the next <li> of a list, the next
    block after a <p>), else the end of the element around it.
    """
    ends = list(range(1, len(page) + 1))
    stack: list[int] = []
    held: Counter[str] = Counter()

    def pop(place: int, past: int) -> None:
        for opened in stack[place:]:
            ends[opened] = past
            held[page[opened][1]] -= 1
        del stack[place:]

    def find(names: frozenset[str], bars: frozenset[str]) -> int:
        """Innermost place of one of ``names`` on the stack, none beyond one of ``bars``."""
        if any(held[name] for name in names):
            for place in range(len(stack) - 1, -1, -1):
                name = page[stack[place]][1]
                if name in names:
                    return place
                if name in bars:
                    break
        return -1

    for k, (kind, name, label) in enumerate(page):
        if kind != "close" and held["head"] and name not in _IN_HEAD and (name or label.strip()):
            pop(find(frozenset({"head"}), frozenset()), k)
        if kind == "open":
            if name in _ENDS_P and (place := find(frozenset({"p"}), _BARS | {"button"})) >= 0:
                pop(place, k)
            if name in _IMPLIED:
                while (place := find(*_IMPLIED[name])) >= 0:
                    pop(place, k)
            if name not in _VOID:
                stack.append(k)
                held[name] += 1
        elif kind == "close":
            bars = frozenset({"table"}) if name in _TABLE else _BARS | {"ol", "ul"} if name == "li" else _BARS
            place = find(frozenset({name}), bars - {name})
            if place >= 0:
                if name in _BLOCKS or name in _CELLS or not any(page[i][1] in _BLOCKS for i in stack[place:]):
                    pop(place, k)
                else:
                    # an inline element that ends inside a later block leaves that block open
                    ends[stack.pop(place)] = k
                    held[name] -= 1
    pop(0, len(page))
    return ends


@lru_cache(maxsize=4096)
def _named_beside(label: str) -> bool:
    """Whether an element's tag or a whole word of its class, id or role says that it is no part of an article.

    A word joined by hyphens or underscores counts if all of its pieces do: ``cookie-banner``, but not ``no-sidebar``.
    """
    name, *words = label.split()
    if name in _ASIDE:
        return True
    return name not in ("article", "body", "html", "main") and any(
        _ASIDE_NAMES.issuperset(re.split("[-_]+", word.removeprefix("site-"))) for word in words)


class Layout:
    """Where the elements of a page end, and which of them are beside the article.

    An element that holds more than half of the page's text is not beside, whatever its name.
    """

    def __init__(self, page: list[Token]) -> None:
        self.page = page
        self.ends = _ends(page)
        self.named = [k for k, token in enumerate(page) if token[0] == "open" and _named_beside(token[2])]
        before = [0]
        for kind, _, label in page:
            before.append(before[-1] + (len(label.strip()) if kind == "text" else 0))
        self.beside = {k for k in self.named if 2 * (before[self.ends[k]] - before[k]) <= before[-1]}

    def size(self, start: int, past: int, beside: set[int] | None = None) -> int:
        """Characters of text after token ``start`` and before ``past``, without elements beside."""
        beside = self.beside if beside is None else beside
        size, k = 0, start + 1
        while k < past:
            if k in beside:
                k = self.ends[k]
                continue
            if self.page[k][0] == "text":
                size += len(self.page[k][2].strip())
            k += 1
        return size

    def largest(self, starts: list[int]) -> int:
        return -max((self.size(s, self.ends[s]), -s) for s in starts)[1]


def main_region(layout: Layout) -> tuple[int, int]:
    """(first, past) token of the article: the largest <article>, else <main>, else an element
    named like one, else the body.

    Elements beside the article are not looked into, unless an <article> or <main> in one of them has at
    least as much text as the body has outside of all of them.
    """
    page, ends = layout.page, layout.ends
    ranks: list[list[int]] = [[], [], [], []]
    inner: list[int] = []
    k = 0
    while k < len(page):
        kind, name, label = page[k]
        if kind == "open":
            words = _PIECES.findall(label)[1:]
            if k in layout.beside and name != "header":
                inner += [i for i in range(k, ends[k]) if page[i][0] == "open" and page[i][1] in ("article", "main")]
                k = ends[k]
                continue
            if name == "article":
                ranks[0].append(k)
                k = ends[k]
                continue
            if name == "main" or (name in ("div", "section") and "main" in words):
                ranks[1].append(k)
            elif name in ("div", "section", "td") and not _MAIN_NAMES.isdisjoint(words):
                ranks[2].append(k)
            elif name == "body":
                ranks[3].append(k)
        k += 1
    if inner and not any(ranks[:3]):
        start = layout.largest(inner)
        if layout.size(start, ends[start]) >= layout.size(-1, len(page), set(layout.named)):
            return start, ends[start]
    for starts in ranks:
        if starts:
            start = layout.largest(starts)
            return start, ends[start]
    return -1, len(page)


#: first characters of what a spelled page is made of: groups (in inference only), tags, texts
_GROUP, _TAG, _TEXT = 0x20000, 0xF0000, 0x100000
_MOST_SYMBOLS = 0xFFFD
#: the tags of the article's element, in inference only
_MARKS = "\ue000\ue001"


def _symbols(layout: Layout) -> list[tuple[int, str, int]]:
    """(token, symbol, context) of the tags and texts of a page; an end tag has the words of the tag it closes.

    The context of a text is a digest of the text with the tags around it, and its symbol is empty; a tag has no context (0).
    """
    page, closed = layout.page, {}
    for k, past in enumerate(layout.ends):
        if page[k][0] == "open" and past < len(page) and page[past][:2] == ("close", page[k][1]):
            closed.setdefault(past, page[k][2])
    kept = [k for k, token in enumerate(page) if token[0] != "text" or token[2].strip()]
    names = ["" if page[k][0] == "text" else page[k][2] if page[k][0] == "open" else "/" + closed.get(k, page[k][1]) for k in kept]
    around = ["", *names, ""]
    return [
        (k, name, 0 if name else _digest("\n".join((around[i], " ".join(page[k][2].split()), around[i + 2]))))
        for i, (k, name) in enumerate(zip(kept, names))]


def template(layout: Layout) -> str:
    """The open elements down to the one that holds the article: pages that share them are one template."""
    start, _ = main_region(layout)
    return "\n".join(layout.page[k][2] for k in range(start + 1) if layout.page[k][0] == "open" and layout.ends[k] > start)


class _Alphabet:
    """One character per symbol, so that pages are strings; texts that are no constant share one. Tags that are not known are left out."""

    def __init__(self, known: dict[str, str], constants: dict[int, str]) -> None:
        self.known = known
        self.constants = constants

    def spell(self, symbols: list[tuple[int, str, int]]) -> str:
        return "".join(
            self.known.get(name, "") if name else self.constants.get(context, chr(_TEXT)) for _, name, context in symbols)


def _squares(page: str, period: int) -> set[str]:
    """Units of ``period`` characters that stand at least twice in a row."""
    codes = np.frombuffer(page.encode("utf-32-le"), np.uint32)
    same = codes[period:] == codes[:-period]
    if np.count_nonzero(same) < period:
        return set()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return {page[a: a + period] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= period}


def _common(a: str, b: str) -> list[int]:
    """After each character of ``b``: an integer with bit i clear where ``a[: i + 1]`` adds to the common subsequence."""
    codes = np.frombuffer(a.encode("utf-32-le"), np.uint32)
    masks: dict[str, int] = {}
    for char in set(a) & set(b):
        masks[char] = int.from_bytes(np.packbits(codes == ord(char), bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    row, rows = full, []
    for char in b:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(a: str, b: str) -> list[int]:
    """Length of the longest common subsequence of every prefix of ``a`` with ``b``."""
    bits = bin(_common(a, b)[-1] | 1 << len(a))[:2:-1] if b else "1" * len(a)
    return [0, *accumulate(int(bit == "0") for bit in bits)]


def aligned(a: str, b: str) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two strings."""
    start, last = 0, min(len(a), len(b))
    while start < last and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < last - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(start)]
    x, y = a[start: len(a) - tail], b[start: len(b) - tail]
    if x and y:
        if len(x) * len(y) > _CELLS_HELD and len(y) > 1:
            # halves of y, cut where they have most in common with x, so that memory stays small
            half = len(y) // 2
            ahead, behind = _lengths(x, y[:half]), _lengths(x[::-1], y[half:][::-1])
            cut = max(range(len(x) + 1), key=lambda i: ahead[i] + behind[len(x) - i])
            found = aligned(x[:cut], y[:half]) + [(cut + i, half + j) for i, j in aligned(x[cut:], y[half:])]
        else:
            rows, found, i, j = _common(x, y), [], len(x), len(y)
            while i and j:
                if rows[j - 1] >> (i - 1) & 1:
                    i -= 1
                elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((i, j))
            found.reverse()
        pairs += [(start + i, start + j) for i, j in found]
    return pairs + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


#: what inference reads of a page: names and texts of its symbols, the article by tags and names, elements that may hold it
Outline = dict
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32())}
#: a folded structure: characters, and for each whether some page lacks it ("1") or all have it ("0")
Folded = tuple[str, str]
#: around the unit of a group, where a group is written out
_BRACKETS = "\ue002\ue003"


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=65536)
def _path(around: int, label: str) -> int:
    """Key of an element's path: that of the element around it and its own label."""
    return _digest(f"{around}\n{label}")


def _holders(layout: Layout, at: list[int]) -> list[list[int]]:
    """[path, holder around, first, past, characters, alone, closed] per element that may hold an article.

    Places are those in ``at``, the tokens that are symbols. Elements beside the article and in links hold no slots
    and are left out. Of elements with one path the first is listed, and is not ``alone``.
    """
    before = [0]
    outside = beside = 0
    found: dict[int, list[int]] = {}
    listed: list[tuple[int, int]] = []
    stack: list[tuple[int, int, int]] = []
    for k, (kind, name, label) in enumerate(layout.page):
        while stack and layout.ends[stack[-1][0]] <= k:
            stack.pop()
        if k in layout.beside and k >= beside:
            beside = layout.ends[k]
        if k in layout.beside or (kind == "open" and name == "a"):
            outside = max(outside, layout.ends[k])
        before.append(before[-1] + (len(label.strip()) if kind == "text" and k >= beside else 0))
        if kind == "open" and name not in _VOID:
            path, around = _path(stack[-1][1] if stack else 0, label), stack[-1][2] if stack else 0
            if name in _HOLDERS and k >= outside:
                if path in found:
                    found[path][5] = 0
                else:
                    found[path] = [path, around, 0, 0, 0, 1, 0]
                    listed.append((path, k))
            stack.append((k, path, path if name in _HOLDERS else around))
    for path, k in listed:
        past = layout.ends[k]
        found[path][2:5] = bisect_left(at, k), bisect_left(at, past), before[past] - before[k]
        found[path][6] = int(_closed(layout, k))
    return list(found.values())


def _closed(layout: Layout, start: int) -> bool:
    past = layout.ends[start]
    return past < len(layout.page) and layout.page[past][:2] == ("close", layout.page[start][1])


def outline(layout: Layout) -> Outline:
    """What inference reads of a page: ``names`` of its symbols, ``contexts`` of its texts with the characters each has as
    a slot (text in links and beside the article is none), and ``marks``, the article by tags and names, then ``_holders``."""
    symbols = _symbols(layout)
    at = [k for k, _, _ in symbols]
    contexts, slots, outside, k = [], [], 0, 0
    for place, name, context in symbols:
        while k <= place:
            if k in layout.beside or layout.page[k][:2] == ("open", "a"):
                outside = max(outside, layout.ends[k])
            k += 1
        if not name:
            contexts.append(context)
            slots.append(len(layout.page[place][2].strip()) if place >= outside else 0)
    start, past = main_region(layout)
    first = bisect_left(at, start) if start >= 0 else -1
    main = [first, bisect_left(at, past), layout.size(start, past), int(start >= 0 and _closed(layout, start))]
    return {
        "names": "\n".join(name for _, name, _ in symbols), "contexts": contexts, "slots": slots,
        "marks": json.dumps([main, *_holders(layout, at)])}


def _slots(page: Outline, shared: Set[int]) -> list[int]:
    """Per symbol, the characters of slots before it."""
    before, texts = [0], iter(zip(page["contexts"], page["slots"]))
    for name in page["names"].split("\n"):
        context, size = (0, 0) if name or not page["contexts"] else next(texts)
        before.append(before[-1] + (size if context not in shared else 0))
    return before


def path_counts(page: Outline, shared: Set[int]) -> list[tuple[int, ...]]:
    """(path, holder around, pages, pages that have it once, slots, characters, pages whose tags agree) of one page.

    Path 0 is the whole page. Tags agree with an element if the one they point at holds it or lies in it.
    """
    before, names = _slots(page, shared), page["names"].split("\n")
    (start, end, _, _), *holders = json.loads(page["marks"])
    named = start >= 0 and names[start].split()[0] != "body"
    rows = [(0, 0, 1, 1, before[-1], 0, 0)]
    for path, around, first, past, size, alone, _ in holders:
        agree = named and (start <= first < end or first <= start < past)
        rows.append((path, around, 1, alone, *((before[past] - before[first], size, int(agree)) if alone else (0, 0, 0))))
    return rows


def core(rows: Iterable[tuple[int, ...]]) -> int | None:
    """The path that holds most slots, from the sums of ``path_counts`` over all pages of a template.

    From the whole page down, an inner element that two thirds of the pages have once is taken while it has more than two
    thirds of the slots of the one around it. None if pages are too few to tell slots from constants, constants are most of what it
    holds (copies of one article), no element has so many, or tags and names agree with it on most pages that have it.
    """
    known = {row[0]: row for row in rows}
    pages = known[0][2]
    if pages < ALIKE:
        return None

    def inside(path: int, outer: int) -> bool:
        while path and path != outer:
            path = known[path][1] if path in known else 0
        return path == outer

    def depth(path: int) -> int:
        steps = 0
        while path in known and path:
            path, steps = known[path][1], steps + 1
        return steps

    often = [path for path, row in known.items() if path and 3 * row[3] >= 2 * pages]
    found, size = 0, known[0][4]
    while size:
        inner = [path for path in often if path != found and 3 * known[path][4] > 2 * size and inside(path, found)]
        if not inner:
            break
        found = min(inner, key=lambda path: (-known[path][4], depth(path), path))
        size = known[found][4]
    _, _, _, alone, slots, text, agree = known[found]
    return found if found and 2 * slots > text and 2 * agree <= alone else None


def region(page: Outline, by_slots: int | None) -> tuple[str, int, int, int] | None:
    """(label, first, past, characters) of the article: the element on the path ``by_slots``, or the one by tags and names.

    None for a page that does not have it once or ends inside it.
    """
    main, *holders = json.loads(page["marks"])
    if by_slots is None:
        found = [main] if main[3] else []
    else:
        found = [holder[2:5] for holder in holders if holder[0] == by_slots and holder[5] and holder[6]]
    return (page["names"].split("\n")[found[0][0]], *found[0][:3]) if found else None


def spelled(page: Outline, first: int, past: int, alphabet: _Alphabet) -> str:
    """The page as a string, with the tags of the article's element as ``_MARKS``."""
    contexts = iter(page["contexts"])
    names = page["names"].split("\n")
    symbols = [(k, name, 0 if name else next(contexts)) for k, name in enumerate(names)]
    before, inside, after = map(alphabet.spell, (symbols[:first], symbols[first + 1: past], symbols[past + 1:]))
    return f"{before}{_MARKS[0]}{inside}{_MARKS[1]}{after}"


def _grouped(units: Iterable[str]) -> dict[str, str]:
    """Character to unit, inner groups first; in ``units`` groups are written out, in what is returned they are characters."""
    groups: dict[str, str] = {}
    chars: dict[str, str] = {}

    def nesting(unit: str) -> int:
        depth = most = 0
        for char in unit:
            depth += (char == _BRACKETS[0]) - (char == _BRACKETS[1])
            most = max(most, depth)
        return most

    for unit in sorted(set(units), key=lambda unit: (nesting(unit), len(unit), unit)):
        stack = [["", ""]]
        for char in unit:
            if char == _BRACKETS[0]:
                stack.append(["", ""])
            elif char == _BRACKETS[1]:
                written, _ = stack.pop()
                stack[-1][0] += f"{_BRACKETS[0]}{written}{_BRACKETS[1]}"
                stack[-1][1] += chars[written]
            else:
                stack[-1] = [part + char for part in stack[-1]]
        chars[unit] = chr(_GROUP + len(groups))
        groups[chars[unit]] = stack[0][1]
    return groups


def _collapsed(page: str, groups: dict[str, str]) -> str:
    for char, unit in groups.items():
        if unit in page:
            page = re.sub(f"(?:{re.escape(unit)})+", char, page)
    return page


def new_units(page: str, groups: dict[str, str]) -> list[str]:
    """Units that repeat in ``page`` once ``groups`` are collapsed, groups written out: smallest first, and again in
    what results, so groups may nest."""
    page, found, written = _collapsed(page, groups), dict(groups), {}

    def write(unit: str) -> str:
        return "".join(f"{_BRACKETS[0]}{write(found[c])}{_BRACKETS[1]}" if c in found else c for c in unit)

    before = None
    while before != page:
        before, period = page, 1
        while 2 * period <= len(page):
            for unit in sorted(_squares(page, period)):
                if unit + unit in page:
                    char = chr(_GROUP + len(found))
                    found[char] = unit
                    written[write(unit)] = None
                    page = re.sub(f"(?:{re.escape(unit)})+", char, page)
            period += 1
    return list(written)


def folded(a: Folded, b: Folded) -> Folded:
    """Two structures as one: what they have in common, and what one of them lacks as optional; the marks meet."""
    if a[0] == b[0]:
        return a[0], "".join(map(max, zip(a[1], b[1])))
    chars, lacks = "", ""
    i = j = 0
    while i <= len(a[0]):
        # the parts before, in and after the marked element, each with the mark that follows
        past, end = (min((len(x), *(at for mark in _MARKS if (at := x.find(mark, k)) >= 0))) for x, k in ((a[0], i), (b[0], j)))
        pairs = [(i + x, j + y) for x, y in aligned(a[0][i:past], b[0][j:end])]
        for x, y in [*pairs, (past, end)]:
            chars += a[0][i:x] + b[0][j:y] + a[0][x: x + 1]
            lacks += "1" * (x - i + y - j) + max(a[1][x: x + 1], b[1][y: y + 1])
            i, j = x + 1, y + 1
    return chars, lacks


def expression(found: Folded, groups: dict[str, str], mark: tuple[str, str]) -> str:
    """Regular expression of a folded structure; ``mark`` are the characters of the tags of its article's element."""
    marked = dict(zip(_MARKS, mark))

    def unfold(char: str) -> str:
        if char in groups:
            return "(?:" + "".join(map(unfold, groups[char])) + ")++"
        # where a constant stands, a page may have a text of its own
        return f"[{chr(_TEXT)}{char}]" if ord(char) > _TEXT else re.escape(marked.get(char, char))

    parts = []
    for char, lacks in zip(*found):
        part = unfold(char) if lacks == "0" else f"(?:{unfold(char)})?+" if char in groups else unfold(char) + "?+"
        parts.append("(?P<main>" + part if char == _MARKS[0] else ")" + part if char == _MARKS[1] else part)
    return "".join(parts)


def _constants(contexts: Iterable[int]) -> dict[int, str]:
    # constants beyond the characters there are share the last one
    return {context: chr(_TEXT + min(k, _MOST_SYMBOLS)) for k, context in enumerate(sorted(contexts), 1)}


def _known(names: Iterable[str]) -> dict[str, str]:
    return {name: chr(_TAG + k) for k, name in enumerate(sorted(names))}


def _core_text(page: Outline, first: int, past: int, size: int, shared: Set[int]) -> bool:
    """Whether most text between the marks is slots."""
    before = _slots(page, shared)
    return 2 * (before[past] - before[first]) > size


def _wrapper(found: Folded, mark: str, groups: dict[str, str], known: dict[str, str], constants: dict[int, str],
             mostly: bool, by_slots: bool) -> dict:
    return {
        "alphabet": known, "constants": constants, "edges": mark.split()[0] == "body" and mostly, "by_slots": by_slots,
        "expression": expression(found, groups, (known[mark], known["/" + mark]))}


def infer(pages: list[str]) -> dict | None:
    """Wrapper of a template whose pages are at hand: the steps of ``host_wrappers`` for one template.

    None if no page has the article's element whole or there are more tags than the alphabet has characters.
    """
    read = [outline(Layout(tokens(page))) for page in dict.fromkeys(pages)]
    held = Counter(context for page in read for context in set(page["contexts"]))
    shared = {context for context, count in held.items() if len(read) >= ALIKE and 3 * count >= 2 * len(read)}
    sums: dict[int, list[int]] = {}
    for page in read:
        for path, around, *counts in path_counts(page, shared):
            known = sums.setdefault(path, [around, *(0 for _ in counts)])
            known[1:] = [a + b for a, b in zip(known[1:], counts)]
    by_slots = core((path, *row) for path, row in sums.items()) if read else None
    whole = [(page, found) for page in read if (found := region(page, by_slots))]
    if not whole:
        return None
    marks = Counter(label for _, (label, *_) in whole)
    mark = min(marks, key=lambda label: (-marks[label], label))
    whole = [(page, found) for page, found in whole if found[0] == mark]
    held = Counter(context for page, _ in whole for context in set(page["contexts"]))
    constants = _constants(
        context for context, count in held.items() if len(whole) >= ALIKE and EVERY * count >= (EVERY - 1) * len(whole))
    tags = Counter(name for page, _ in whole for name in set(page["names"].split("\n")) - {""})
    known = _known(name for name, count in tags.items() if RARE * count >= len(whole))
    if len(known) > _MOST_SYMBOLS:
        return None
    alphabet = _Alphabet(known, constants)
    structures = sorted({spelled(page, first, past, alphabet) for page, (_, first, past, _) in whole})
    units: set[str] = set()
    groups: dict[str, str] = {}
    while fresh := {unit for page in structures for unit in new_units(page, groups)} - units:
        units |= fresh
        groups = _grouped(units)
    found = reduce(folded, ((page, "0" * len(page)) for page in sorted({_collapsed(page, groups) for page in structures})))
    mostly = sum(_core_text(page, *place, constants.keys()) for page, (_, *place) in whole)
    return _wrapper(found, mark, groups, known, constants, len(whole) >= ALIKE and 2 * mostly > len(whole), by_slots is not None)


def blocks(layout: Layout, first: int, past: int, fixed: frozenset[int] = frozenset()) -> str:
    """Text of the blocks between two tokens, one per line; elements beside the article and ``fixed`` texts are skipped."""
    page = layout.page
    lines: list[str] = []
    run: list[str] = []

    def end() -> None:
        line = " ".join(html.unescape("".join(run)).split())
        if line:
            lines.append(line)
        run.clear()

    k = first + 1
    while k < past:
        kind, name, label = page[k]
        if kind == "text":
            if k not in fixed:
                run.append(label)
        elif k in layout.beside:
            end()
            k = layout.ends[k]
            continue
        elif name in _BLOCKS:
            end()
        elif name in _SPACES:
            run.append(" ")
        k += 1
    end()
    return "\n".join(lines)


@lru_cache(maxsize=256)
def _compiled(wrapper: str) -> tuple[_Alphabet, re.Pattern, bool, bool]:
    known = json.loads(wrapper)
    constants = {int(context): char for context, char in known["constants"].items()}
    return _Alphabet(known["alphabet"], constants), re.compile(known["expression"], re.S), known["edges"], known["by_slots"]


def _headline(layout: Layout, first: int) -> str:
    """The last first-level heading before token ``first`` that is not beside the article."""
    found, k = "", 0
    while k < first:
        kind, name, _ = layout.page[k]
        if k in layout.beside and layout.ends[k] <= first:
            k = layout.ends[k]
            continue
        if kind == "open" and name == "h1" and layout.ends[k] <= first:
            found = blocks(layout, k, layout.ends[k])
        k += 1
    return found


def extract(page: str | None, wrapper: str | None) -> tuple[str, bool]:
    """(main text, whether the wrapper matched) of one page."""
    return _extract(Layout(tokens(page or "")), wrapper)


def _extract(layout: Layout, wrapper: str | None) -> tuple[str, bool]:
    if wrapper:
        alphabet, expression, edges, by_slots = _compiled(wrapper)
        symbols = [symbol for symbol in _symbols(layout) if not symbol[1] or symbol[1] in alphabet.known]
        match = expression.fullmatch(alphabet.spell(symbols))
        if match:
            first, past = (symbols[k][0] for k in match.span("main"))
            texts = [(k, context in alphabet.constants) for k, name, context in symbols if not name and first < k < past]
            slots = [k for k, constant in texts if not constant]
            fixed = frozenset(k for k, constant in texts if edges and slots and constant and not slots[0] < k < slots[-1])
            text = blocks(layout, first, past, fixed)
            if by_slots and not any(layout.page[k][:2] == ("open", "h1") for k in range(first, past)):
                text = "\n".join(filter(None, (_headline(layout, first), text)))
            return text, True
    return blocks(layout, *main_region(layout)), False


def host(url: str = "url"):
    """Lower-case host of a URL column; NULL and what has none share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _template_key(path: str) -> str:
    return hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()


def with_template(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host of ``pages`` with ``template``, a key of the page's template."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            paths = [template(Layout(tokens(page or ""))) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(_template_key, paths), pa.string())], names=[*part.schema.names, "template"])

    return pages.select("page_id", "url", "html", host().alias("host")).mapInArrow(
        run, "page_id bigint, url string, html string, host string, template string")


def _chars(table: DataFrame) -> int:
    return table.agg(F.sum(F.length(F.to_json(F.struct(*table.columns))))).head()[0] or 0


def _by_key(small: DataFrame, how: str, rows: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """``rows`` with what there is per ``key``: a dict that workers look up, for ``small`` up to ``BROADCAST_CHARS``, else joined."""
    small = stage(small)
    if _chars(small) > BROADCAST_CHARS:
        return rows.join(small, "key", how), None
    given = {row["key"]: row.asDict() for row in small.toLocalIterator()}
    empty = None if how == "inner" else dict.fromkeys(set(small.columns) - {"key"})
    return rows, rows.sparkSession.sparkContext.broadcast((given, empty))


def _rows(rows: DataFrame, function: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, small: DataFrame | None = None,
          how: str = "inner") -> DataFrame:
    """The rows that ``function`` makes of the rows of a partition; each is given what ``small`` has for its key."""
    fields = T.StructType.fromDDL(schema)
    arrow = pa.schema([(field.name, _ARROW[field.dataType.simpleString()]) for field in fields])
    rows, held = _by_key(small, how, rows) if small is not None else (rows, None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few rows at a time become Python objects
        read = (row for part in parts for k in range(0, part.num_rows, BATCH_ROWS) for row in part.slice(k, BATCH_ROWS).to_pylist())
        if held:
            given, empty = held.value
            read = (row | more for row in read if (more := given.get(row["key"], empty)) is not None)
        made = function(read)
        while some := list(islice(made, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*some), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _beside(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``rows`` joined with one small row per template; that side is broadcast up to ``BROADCAST_CHARS``."""
    small = stage(small)
    return rows.join(F.broadcast(small) if _chars(small) <= BROADCAST_CHARS else small, "key")


@lru_cache(maxsize=256)
def _list(values: str | None) -> list:
    return json.loads(values) if values else []


@lru_cache(maxsize=256)
def _set(values: str | None) -> frozenset:
    return frozenset(_list(values))


@lru_cache(maxsize=256)
def _units(values: str | None) -> dict[str, str]:
    return _grouped(_list(values))


@lru_cache(maxsize=256)
def _spelling(names: str, constants: str | None) -> _Alphabet:
    return _Alphabet(_known(_list(names)), _constants(_list(constants)))


def _gathered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Per template the sorted values of ``column`` as JSON; for what a template has few of."""
    return rows.groupBy("key").agg(F.to_json(F.sort_array(F.collect_list(column))).alias(name))


def _counted(rows: DataFrame, values, name: str) -> DataFrame:
    """Pages of each template that hold each of ``values`` (an array)."""
    return rows.select("key", F.explode(F.array_distinct(values)).alias(name)).groupBy("key", name).agg(F.count("*").alias("held"))


def outlines(pages: DataFrame) -> DataFrame:
    """``outline`` of each different page of each template of a host; ``key`` stands for host and template."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            layout = Layout(tokens(row["html"]))
            yield row["host"], _template_key(template(layout)), row["own"], *outline(layout).values()

    html_of = F.coalesce("html", F.lit(""))
    found = _rows(
        pages.select(host().alias("host"), F.xxhash64(html_of).alias("own"), html_of.alias("html")), run,
        "host string, template string, own bigint, names string, contexts array<bigint>, slots array<int>, marks string")
    return found.withColumn("key", F.xxhash64("host", "template")).dropDuplicates(["key", "own"])


def _cores(read: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, by_slots) of the templates whose slots decide where the article is."""
    often = _beside(_counted(read, F.col("contexts"), "context").filter("held > 1"), pages)
    shared = _gathered(often.filter((F.col("pages") >= ALIKE) & (3 * F.col("held") >= 2 * F.col("pages"))), "context", "shared")

    def count(rows: Iterator[dict]) -> Iterator[tuple]:
        while some := list(islice(rows, BATCH_ROWS)):
            sums: dict[tuple, list[int]] = {}
            for row in some:
                for path, around, *counts in path_counts(row, _set(row["shared"])):
                    known = sums.setdefault((row["key"], path, around), [0] * len(counts))
                    known[:] = [a + b for a, b in zip(known, counts)]
            yield from ((*which, *counts) for which, counts in sums.items())

    fields = ("having", "alone", "n_slots", "chars", "agree")
    sums = _rows(
        read.select("key", "names", "contexts", "slots", "marks"), count,
        "key bigint, path bigint, around bigint, " + ", ".join(f"{name} bigint" for name in fields), shared, "left")
    sums = sums.groupBy("key", "path", "around").agg(*(F.sum(name).alias(name) for name in fields))
    # a holder around one that two thirds of the pages have is on as many
    sums = _beside(sums, pages).filter(3 * F.col("having") >= 2 * F.col("pages"))
    each = sums.groupBy("key").agg(F.collect_list(F.struct("path", "around", *fields)).alias("sums"))
    found = _rows(
        each, lambda rows: ((row["key"], core(tuple(one.values()) for one in row["sums"])) for row in rows), "key bigint, by_slots bigint")
    return found.filter("by_slots IS NOT NULL")


def _whole(read: DataFrame, cores: DataFrame) -> DataFrame:
    """Pages that hold their template's article whole, with its place; of several labels the one most pages have."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            if found := region(row, row["by_slots"]):
                yield row["key"], row["by_slots"] is not None, *found, row["names"], row["contexts"], row["slots"]

    found = stage(_rows(
        read.select("key", "names", "contexts", "slots", "marks"), run,
        "key bigint, by_slots boolean, mark string, first int, past int, size int, names string, contexts array<bigint>, slots array<int>",
        cores, "left"))
    labels = found.groupBy("key", "mark").agg(F.count("*").alias("held"))
    most = labels.groupBy("key").agg(F.min(F.struct((-F.col("held")).alias("less"), F.col("mark").alias("most"))).alias("most"))
    most = most.select("key", F.col("most.most").alias("most"), (-F.col("most.less")).alias("pages"))
    return _beside(found, most).filter("mark = most").drop("most")


def _alphabets(whole: DataFrame) -> DataFrame:
    """(key, known, constants) per template, as JSON: its tags and constant texts. Of more tags than there are characters,
    those that fewest pages have are left out."""
    pages = whole.groupBy("key").agg(F.count("*").alias("pages"))
    held = _beside(_counted(whole, F.col("contexts"), "context").filter("held > 1"), pages)
    constants = held.filter((F.col("pages") >= ALIKE) & (EVERY * F.col("held") >= (EVERY - 1) * F.col("pages")))
    tags = _beside(_counted(whole, F.split("names", "\n"), "name").filter("name <> ''"), pages)
    tags = stage(tags.filter(RARE * F.col("held") >= F.col("pages")).drop("pages"))
    levels = tags.groupBy("key", "held").agg(F.count("*").alias("names"))
    above = F.sum("names").over(Window.partitionBy("key").orderBy(F.desc("held")))
    least = levels.withColumn("above", above).filter(F.col("above") <= _MOST_SYMBOLS).groupBy("key").agg(F.min("held").alias("least"))
    names = _gathered(_beside(tags, least).filter("held >= least"), "name", "known")
    return names.join(_gathered(constants, "context", "constants"), "key", "left")


def _structures(whole: DataFrame, alphabets: DataFrame) -> DataFrame:
    """(key, page, pages, mostly): different spelled pages, how many have each, and in how many most text is slots."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            alphabet = _spelling(row["known"], row["constants"])
            page = spelled(row, row["first"], row["past"], alphabet)
            mostly = row["mark"].split()[0] == "body" and _core_text(row, row["first"], row["past"], row["size"], alphabet.constants.keys())
            yield row["key"], row["mark"], row["by_slots"], page, int(mostly)

    found = _rows(whole, run, "key bigint, mark string, by_slots boolean, page string, mostly int", alphabets)
    return found.groupBy("key", "mark", "by_slots", "page").agg(F.count("*").alias("pages"), F.sum("mostly").alias("mostly"))


def _repeats(structures: DataFrame) -> DataFrame | None:
    """(key, units): what repeats on some page of a template, as JSON. Units found on one page are collapsed on all pages,
    which may give new ones, until none are new. None if nothing repeats."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        while some := list(islice(rows, BATCH_ROWS)):
            yield from {(row["key"], unit) for row in some for unit in new_units(row["page"], _units(row.get("units")))}

    found = known = None
    while True:
        fresh = _rows(structures.select("key", "page"), run, "key bigint, unit string", known, "left").distinct()
        fresh = stage(fresh.join(found, ["key", "unit"], "left_anti") if found else fresh)
        if fresh.isEmpty():
            return known
        found = found.unionByName(fresh) if found else fresh
        known = stage(_gathered(found, "unit", "units"))


def _folds(structures: DataFrame, units: DataFrame | None) -> DataFrame:
    """(key, chars, lacks): one structure per template, into which all its structures are folded.

    A round folds about ``FOLDED`` structures of a template, chosen by hash, twice as many as the round before. What the result
    covers already is done: folding it changes nothing. Others are left to the next round, until none are. So only what adds to
    the result goes through one task, and how rows lie does not matter.
    """
    if units:
        def collapse(rows: Iterator[dict]) -> Iterator[tuple]:
            return ((row["key"], _collapsed(row["page"], _units(row["units"]))) for row in rows)

        structures = _rows(structures.select("key", "page"), collapse, "key bigint, page string", units, "left")
    left = stage(structures.select("key", "page").distinct().withColumn("place", F.pmod(F.xxhash64("page"), F.lit(1 << 62))))
    found, few = None, FOLDED

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        for key, group in groupby(rows, key=lambda row: row["key"]):
            yield key, *reduce(folded, ((row["chars"], row["lacks"]) for row in group))

    def uncovered(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            known, page = (row["chars"], row["lacks"]), row["page"]
            if known[0] is None or folded(known, (page, "0" * len(page))) != known:
                yield row["key"], page, row["place"]

    while True:
        every = F.greatest(F.lit(1), F.floor(F.col("n") / few)).cast("bigint")
        left = _beside(left, left.groupBy("key").agg(F.count("*").alias("n"))).withColumn("chosen", F.col("place") % every == 0)
        fresh = left.filter("chosen").selectExpr("key", "page AS chars", "repeat('0', length(page)) AS lacks", "1 AS later")
        if found:
            fresh = fresh.unionByName(found.withColumn("later", F.lit(0)))
        fresh = fresh.repartition("key").sortWithinPartitions("key", "later", "chars").select("key", "chars", "lacks")
        found = stage(_rows(fresh, fold, "key bigint, chars string, lacks string"))
        rest = left.filter("NOT chosen").select("key", "page", "place")
        left = stage(_rows(rest, uncovered, "key bigint, page string, place bigint", found, "left"))
        if left.isEmpty():
            return found
        few *= 2


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, wrapper) from all different pages of each template of each host.

    Constants, the elements that hold the slots, tags and repeated units are counted over all pages; all structures are folded. What
    is shuffled are outlines, counts and structures; no task gets more of a template than a round of a fold takes. A template has no wrapper if no page has
    its article's element whole.
    """
    read = stage(outlines(pages))
    totals = stage(read.groupBy("key").agg(
        F.count("*").alias("pages"), F.first("host").alias("host"), F.first("template").alias("template")))
    whole = stage(_whole(read, _cores(read, totals.select("key", "pages"))))
    alphabets = stage(_alphabets(whole))
    structures = stage(_structures(whole, alphabets))
    units = _repeats(structures)
    sums = structures.groupBy("key", "mark", "by_slots").agg(F.sum("pages").alias("pages"), F.sum("mostly").alias("mostly"))
    found = _folds(structures, units).join(sums, "key").join(alphabets, "key").join(totals.select("key", "host", "template"), "key")
    found = found.join(units, "key", "left") if units else found.withColumn("units", F.lit(None).cast("string"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            known, constants = _known(_list(row["known"])), _constants(_list(row["constants"]))
            if row["mark"] not in known or "/" + row["mark"] not in known:
                continue
            mostly = row["pages"] >= ALIKE and 2 * row["mostly"] > row["pages"]
            wrapper = _wrapper(
                (row["chars"], row["lacks"]), row["mark"], _units(row["units"]), known, constants, mostly, row["by_slots"])
            yield row["host"], row["template"], json.dumps(wrapper)

    return _rows(found, run, "host string, template string, wrapper string")


def main_texts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, by_wrapper.

    A NULL or empty page, or one without an article, has the empty text. Equal pages of one host give equal texts; other columns
    are dropped; an empty table gives an empty one. Wrappers up to ``BROADCAST_CHARS`` are looked up by the workers, others joined.
    """

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            text, matched = extract(row["html"], row["wrapper"])
            yield row["page_id"], row["url"], text, len(text), matched

    def look_up(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            layout = Layout(tokens(row["html"] or ""))
            text, matched = _extract(layout, held.value.get((row["host"], _template_key(template(layout)))))
            yield row["page_id"], row["url"], text, len(text), matched

    schema = "page_id bigint, url string, text string, n_chars bigint, by_wrapper boolean"
    wrappers = stage(wrappers)
    if _chars(wrappers) <= BROADCAST_CHARS:
        found = {(row["host"], row["template"]): row["wrapper"] for row in wrappers.toLocalIterator()}
        held = pages.sparkSession.sparkContext.broadcast(found)
        return _rows(pages.select("page_id", "url", "html", host().alias("host")), look_up, schema)
    keyed = with_template(pages).join(wrappers, ["host", "template"], "left")
    return _rows(keyed.select("page_id", "url", "html", "wrapper"), run, schema)
