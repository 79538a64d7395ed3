"""Main text of web pages by union-free regular-expression inference (operator 3).

Pages of one host come from one template. A page is a stream of block tags and text slots. Repeats in it are folded
into groups, then the streams of a host are aligned one after another: a text that differs becomes a slot, a stretch
that one side lacks becomes optional, a group on one side takes in single copies on the other. The result is the
host's wrapper, a regular expression without unions. The wrapper decides, in this order:

1. slots whose text is the same on every page that has them are template, be they optional or not, and in whatever
   element: at least TOLD pages of different content must agree, so copies of a page say nothing;
2. slots whose text is all links, over TOLD pages or more, are menus;
3. the main container is the deepest that holds four fifths of the text of the other slots.

Names of elements, roles and classes only help where the wrapper leaves a choice: open slots in menus, forms, comments
and the like are no article, and among containers that hold half of the text one named for articles goes first. A host
of fewer than TOLD different pages has no template to infer; there the names decide. A page without text in its host's
container is judged alone.

Streams are folded and counted where the pages are, so a host with a third of all pages sends its distinct streams,
not its pages. They are merged level by level, each level over fewer parts of a host, so that no task gathers a host's
streams, nor the copies of one stream from all tasks. The wrappers are broadcast where their measured size is under
BROADCAST bytes, else joined by host. Pages are read in linear time, whatever is in them.

Defined cases: null or empty html gives an empty text; a null url or one without a host belongs to the host "";
repeated rows are extracted each; unclosed, unopened and misnested tags are taken as they come; elements inside DEEPEST
open ones count as part of the last of those, as browsers' parsers bound nesting; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import html
import json
import math
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Parts of a host at each level of merging: of streams by form and task, then by form, then by its remainders.
SPREAD = 64
LEVELS = (4096, 64, 1)
BROADCAST = 8 << 20
MASKS = 16 << 20
FLUSH = 5000
#: Python frames for wrappers of DEEPEST levels.
FRAMES = 20_000
DEEPEST = 512
#: Pages of different content that must agree before a text or a list of links is taken for template.
TOLD = 3
#: Signatures of pages that a slot remembers.
SIGNED = 4
SCHEMA = "page_id long, url string, text string, n_chars long"

MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
UNQUOTED = re.compile(r"[^>\"']*+>")
QUOTES = re.compile(r"[>\"']")
RAW = frozenset("script style noscript template textarea svg iframe".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: Words of a name; numbers of three digits and more tell pages apart, not parts.
PIECE = re.compile(r"[A-Z]?[a-z]+(?:[0-9]{1,2}(?![0-9]))?|[A-Z]+(?![a-z])")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
BREAKS = frozenset(("br", "hr"))
#: What an opening tag closes when it is innermost.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
DROP_TAGS = frozenset("nav aside footer form button select option title head menu dialog fieldset".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu menus footer sidebar aside ad ads adv advert adverts advertisement adverts banner banners promo promos promotion sponsor sponsored cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe"
    " subscription signup login search share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments reply replies respond disqus pagination pager widget widgets toolbar skip copyright masthead topbar alert outbrain taboola".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody post entry story".split())


def label(name: str, rest: str) -> str:
    """tag.class: the tag, a ! where it is no part of an article, a * where it is the article's, and the words of its class and id."""
    if not rest or rest.isspace():
        return name + ("!" if name in DROP_TAGS else "*" if name in MAIN_TAGS else "")
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    names = " ".join(found.get(k, "") for k in ("class", "id", "itemprop"))
    words = {w.lower() for w in PIECE.findall(names)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    page_part = name in ("html", "body")
    drop = name in DROP_TAGS or (not page_part and (hidden or bool(words & DROP_WORDS) or found.get("role", "").lower() in DROP_ROLES))
    main = not drop and (name in MAIN_TAGS or found.get("role", "").lower() in ("main", "article") or (not page_part and bool(words & MAIN_WORDS)))
    return name + ("!" if drop else "*" if main else "") + "".join(f".{w}" for w in sorted(words))


class Source:
    """Where the tags of a page end, in time linear in the page."""

    def __init__(self, text: str):
        self.text, self.last = text, text.rfind(">")
        self.quotes: tuple[list[int], list[int]] | None = None

    def tag_end(self, at: int) -> int:
        """The end of a tag whose attributes begin there: the first > outside quotes or, where quotes don't close, the first at all."""
        if m := UNQUOTED.match(self.text, at):
            return m.end()
        if self.quotes is None:
            # from the right: where a tag ends that is outside quotes, in double and in single ones before each mark
            places = [m.start() for m in QUOTES.finditer(self.text)]
            ends = [-1] * len(places)
            plain = double = single = -1
            for i in range(len(places) - 1, -1, -1):
                c = self.text[places[i]]
                if c == ">":
                    plain = places[i] + 1
                elif c == '"':
                    plain, double = double, plain
                else:
                    plain, single = single, plain
                ends[i] = plain
            self.quotes = places, ends
        places, ends = self.quotes
        i = bisect_left(places, at)
        return ends[i] if i < len(ends) and ends[i] >= 0 else self.text.find(">", at) + 1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes); comments, declarations and raw elements have no name."""
        text, at = self.text, 0
        while m := MARKUP.search(text, at):
            start = m.start()
            if start > self.last and not m[1]:  # no tag ends any more
                start = text.find("<!--", start)
                if start >= 0:
                    yield start, len(text), "", False, ""
                return
            if m[1]:
                at = text.find("-->", m.end()) + 3
                at = len(text) if at < 3 else at
                yield start, at, "", False, ""
            elif m[2]:
                at = text.find(">", m.end()) + 1
                yield start, at, "", False, ""
            else:
                at, name = self.tag_end(m.end()), m[4].lower()
                if not m[3] and name in RAW:
                    if text[at - 2] != "/" or name != "svg":
                        close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(text, at)
                        at = close.end() if close else len(text)
                    yield start, at, "", False, ""
                else:
                    yield start, at, name, bool(m[3]), text[m.end() : at - 1]


class Page:
    """A page as the stream of its block tags and texts: events are labels, "/" for an end, and (text, link characters) for a block of text.

    An open element is a node: its parent, its label, whether it or one above it is no part of an article, and a code of
    the labels on its path. Node 0 is the page.
    """

    def __init__(self, source: str | None):
        self.events: list[str | tuple[str, int]] = []
        self.parent, self.label, self.out, self.code = [0], [""], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, link characters
        stack: list[tuple[str, str, int]] = []
        open_names: Counter[str] = Counter()
        articles = 0
        held: list[str] = []
        links = depth = at = 0

        def flush() -> None:
            nonlocal links
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    self.events.append((text, links))
                    self.blocks.append((stack[-1][2] if stack else 0, text, links))
                held.clear()
            links = 0

        def push(name: str, mark: str) -> None:
            nonlocal articles
            above = stack[-1][2] if stack else 0
            out = self.out[above] or outside(mark)
            if len(stack) < DEEPEST:
                self.events.append(mark)
            if len(stack) < DEEPEST or out != self.out[above]:
                self.parent.append(above)
                self.label.append(mark)
                self.out.append(out)
                self.code.append(step(self.code[above], mark) if len(stack) < DEEPEST else self.code[above])
                above = len(self.parent) - 1
            stack.append((name, mark, above))
            open_names[name] += 1
            articles += made(mark)

        def pop() -> None:
            nonlocal articles
            name, mark, _ = stack.pop()
            open_names[name] -= 1
            articles -= made(mark)
            if len(stack) < DEEPEST:
                self.events.append("/")

        source = source or ""
        for start, end, name, closes, rest in Source(source).tags():
            if start > at:
                held.append(source[at:start])
                links += (start - at) * (depth > 0)
            at = end
            if name == "a":
                depth = 0 if closes else 1
            elif name in BREAKS:
                held.append(" ")
            elif name in BLOCKS:
                flush()
                if closes:
                    if open_names[name]:
                        while stack[-1][0] != name:
                            pop()
                        pop()
                    depth = 0
                    continue
                if stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ())):
                    pop()
                    while stack and stack[-1][0] in CLOSES.get(name, ()):
                        pop()
                # the header of a page goes, that of an article stays
                mark = label(name, rest)
                if name == "header" and not articles and "!" not in mark:
                    mark = "header!" + mark[6:]
                push(name, mark)
        if at < len(source):
            held.append(source[at:])
        flush()
        while stack:
            pop()

    def signature(self) -> int:
        """What tells pages of different content apart, and copies not, nor most near copies: the three longest blocks."""
        return zlib.crc32("\n".join(sorted({t for _, t, _ in self.blocks}, key=lambda t: (-len(t), t))[:3]).encode("utf-8", "surrogatepass"))


def step(code: int, mark: str) -> int:
    """The code of a path that goes on by an element."""
    return xxhash.xxh64_intdigest(mark.encode("utf-8", "surrogatepass"), code) >> 1


def outside(mark: str) -> bool:
    return "!" in mark.split(".", 1)[0]


def made(mark: str) -> bool:
    return "*" in mark.split(".", 1)[0]


# -- union-free regular expressions ----------------------------------------------------------------------------------
# An item is a slot ["#", crc of its text or None, characters, link characters, texts, signatures of pages], an element
# ["e", label, items], a group ["+", items] or an optional stretch ["?", items].
Item = list


def form(item: Item) -> str:
    """The item without its texts and figures: streams of one form differ in texts alone."""
    if item[0] == "#":
        return "#"
    return (item[1] if item[0] == "e" else item[0]) + "(" + " ".join(map(form, item[-1])) + ")"


def key(item: Item) -> str:
    """What makes two items alike enough to be aligned: an element's label, whatever is in it."""
    if item[0] == "#":
        return "#"
    return "e " + item[1] if item[0] == "e" else item[0] + "(" + " ".join(map(key, item[1])) + ")"


def likeness(item: Item) -> str:
    """What makes neighbours repeats of one another: of mere containers also what is right in them."""
    if item[0] == "e" and item[1].split(".", 1)[0] in ("div", "section"):
        return key(item) + "(" + " ".join(sorted({key(x) for y in item[2] for x in (y[1] if y[0] in "+?" else [y])})) + ")"
    return key(item)


def join(a: Item, b: Item) -> Item:
    """Two items of one key into one; texts that differ leave an open slot."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4] + b[4], sorted({*a[5], *b[5]})[:SIGNED]]
    if a[0] == "e":
        return ["e", a[1], align(a[2], b[2])]
    return [a[0], [join(x, y) for x, y in zip(a[1], b[1])]]


def tandem(items: list[Item], keys: list[str], unit: int) -> list[Item]:
    """Runs of alike units of that many items become groups."""
    n = len(items)
    alike = [0] * (n + 1)  # from there on, so many keys are those of a unit later
    for i in range(n - unit - 1, -1, -1):
        alike[i] = alike[i + 1] + 1 if keys[i] == keys[i + unit] else 0
    out, i = [], 0
    while i < n:
        copies = alike[i] // unit
        if not copies or all(k == "#" for k in keys[i : i + unit]):
            out.append(items[i])
            i += 1
            continue
        group = items[i : i + unit]
        for k in range(i + unit, i + (copies + 1) * unit, unit):
            group = [join(x, y) for x, y in zip(group, items[k : k + unit])]
        out.append(["+", group])
        i += (copies + 1) * unit
    return out


def period(keys: list[str], least: int) -> int | None:
    """The least unit, of that many items or more, that is repeated right after itself.

    A run of so many keys that are those of a unit later holds exactly one multiple of the unit, so only multiples are
    tried, which is n log n for all units of n keys.
    """
    n = len(keys)
    for unit in range(least, n // 2 + 1):
        for i in range(0, n - unit, unit):
            if keys[i] == keys[i + unit]:
                lo, hi = i, i + 1
                while lo and i - lo < unit and keys[lo - 1] == keys[lo - 1 + unit]:
                    lo -= 1
                while hi + unit < n and hi - lo < unit and keys[hi] == keys[hi + unit]:
                    hi += 1
                if hi - lo >= unit:
                    return unit
    return None


def fold(items: list[Item]) -> list[Item]:
    """Fold repeats of any length, short units first; elements arrive folded."""
    unit, keys = 1, [likeness(x) for x in items]
    while unit := period(keys, unit):
        folded = absorb(tandem(items, keys, unit))
        if len(folded) < len(items):
            items, unit, keys = folded, 1, [likeness(x) for x in folded]
        else:
            unit += 1
    return items


def absorb(items: list[Item]) -> list[Item]:
    """A group takes in a copy of its unit right before or after it, and a group or optional stretch of the same unit."""
    out: list[Item] = []
    for x in items:
        out.append(x)
        while len(out) > 1 and (inner := [likeness(y) for y in out[-1][1]] if out[-1][0] == "+" else [likeness(y) for y in out[-2][1]] if out[-2][0] == "+" else None):
            a, b = out[-2:]
            if a[0] in "+?" and b[0] in "+?" and [likeness(y) for y in a[1]] == [likeness(y) for y in b[1]] == inner:
                out[-2:] = [["+", [join(y, z) for y, z in zip(a[1], b[1])]]]
            elif b[0] == "+" and [likeness(y) for y in out[-1 - len(inner) : -1]] == inner:
                out[-1 - len(inner) :] = [["+", [join(y, z) for y, z in zip(out[-1 - len(inner) : -1], b[1])]]]
            elif a[0] == "+" and [likeness(b)] == inner:
                out[-2:] = [["+", [join(a[1][0], b)]]]
            else:
                break
    return out


def core(item: Item) -> tuple[str, ...]:
    """For alignment an optional or repeated stretch stands for what is in it."""
    return tuple(map(key, item[1])) if item[0] in "+?" else (key(item),)


def common(ka: list, kb: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of positions, one method for all lengths.

    A row of the table of lengths is one number with a bit for each of kb: 0 where the length grows. Of the rows every
    nth is kept, n a root of their number, and those between are made again; of the keys' bits at most MASKS bytes.
    """
    places: dict = {}
    for j, k in enumerate(kb):
        places.setdefault(k, []).append(j)
    size = len(kb) + 7 >> 3
    full = (1 << len(kb)) - 1

    @lru_cache(MASKS // size + 1)
    def mask(k: tuple[str, ...]) -> int:
        bits = bytearray(size)
        for j in places[k]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def table(part: list, row: int) -> Iterator[int]:
        for k in part:
            if k in places:
                hit = row & mask(k)
                row = ((row + hit) | (row - hit)) & full
            yield row

    step = math.isqrt(len(ka)) + 1
    kept = [full]
    for at in range(0, len(ka) - step, step):
        for row in table(ka[at : at + step], kept[-1]):
            pass
        kept.append(row)
    out: list[tuple[int, int]] = []
    j = len(kb)
    for n in range(len(kept) - 1, -1, -1):
        rows = [kept[n], *table(ka[n * step : (n + 1) * step], kept[n])]
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                    out.append((n * step + i, j))
    return out[::-1]


def matched(ka: list, kb: list) -> list[tuple[str, int, int, int, int]]:
    """Which stretches of two lists of keys are equal, by a longest common subsequence."""
    least = min(len(ka), len(kb))
    head = next((i for i in range(least) if ka[i] != kb[i]), least)
    tail = next((i for i in range(least - head) if ka[-1 - i] != kb[-1 - i]), least - head)
    i, k = len(ka) - tail, len(kb) - tail
    pairs = [(head + x, head + y) for x, y in common(ka[head:i], kb[head:k])] if head < i and head < k else []
    out: list[tuple[str, int, int, int, int]] = []
    a = b = 0
    for x, y in [*((n, n) for n in range(head)), *pairs, *((i + n, k + n) for n in range(tail))]:
        if (x, y) == (a, b) and out and out[-1][0] == "equal":
            out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
        else:
            if (x, y) != (a, b):
                out.append(("replace", a, x, b, y))
            out.append(("equal", x, x + 1, y, y + 1))
        a, b = x + 1, y + 1
    if (a, b) != (len(ka), len(kb)):
        out.append(("replace", a, len(ka), b, len(kb)))
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of two streams or wrappers."""
    out: list[Item] = []
    for op, i, j, k, m in matched([core(x) for x in a], [core(x) for x in b]):
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                kinds = {z[0] for z in (x, y) if z[0] in "+?"}
                if kinds:
                    inner = [join(p, q) for p, q in zip(x[1] if x[0] in "+?" else [x], y[1] if y[0] in "+?" else [y])]
                    out.append(["+" if "+" in kinds else "?", inner])
                else:
                    out.append(join(x, y))
        else:
            out += [x if x[0] == "?" else ["?", [x]] for x in a[i:j] + b[k:m]]
    return absorb(out)


def stream(page: Page) -> list[Item]:
    """A page's events as folded items."""
    stack: list[tuple[str, list[Item]]] = [("", [])]
    signature = page.signature()
    for e in page.events:
        if isinstance(e, tuple):
            stack[-1][1].append(["#", zlib.crc32(e[0].encode("utf-8", "surrogatepass")), len(e[0]), e[1], 1, [signature]])
        elif e != "/":
            stack.append((e, []))
        else:
            name, items = stack.pop()
            stack[-1][1].append(["e", name, fold(items)])
    return fold(stack[0][1])


def render(items: list[Item]) -> str:
    """The wrapper as text: tags, #text for open slots, =text for constant ones, ( )+ and ( )?."""
    out = []
    for x in items:
        if x[0] == "#":
            out.append("#text" if x[1] is None else "=text")
        elif x[0] == "e":
            out.append(" ".join(y for y in (f"<{x[1]}>", render(x[2]), "</>") if y))
        else:
            out.append(f"({render(x[1])}){x[0]}")
    return " ".join(out)


# -- what a wrapper says about the article ------------------------------------------------------------------------------
class Paths:
    """Paths by their code, with what is on them: depth, parent's code, label, whether it is outside the article, and the characters of text right in them."""

    def __init__(self):
        self.of: dict[int, list] = {0: [0, 0, "", False, 0]}

    def add(self, above: int, mark: str) -> int:
        code, up = step(above, mark), self.of[above]
        self.of.setdefault(code, [up[0] + 1, above, mark, up[3] or outside(mark), 0])
        return code

    def main(self, told: bool) -> int | None:
        """The container of the article. told: whether a template has been inferred, so that names of elements only choose among containers of half of the text."""
        weight = {c: p[4] for c, p in self.of.items()}
        for c in sorted(self.of, key=lambda c: -self.of[c][0]):
            if c:
                weight[self.of[c][1]] += weight[c]
        total = weight[0]
        if not total:
            return None
        name = lambda c: (-self.of[c][0], self.of[c][2], c)
        named = [c for c, p in self.of.items() if made(p[2]) and not p[3] and (2 if told else 5) * weight[c] >= total]
        if named:
            return min(named, key=lambda c: (-weight[c], *name(c)))
        whole = [c for c, p in self.of.items() if 5 * weight[c] >= 4 * total and not p[2].startswith(("p", "h1", "h2", "li", "td"))]
        return min(whole, key=lambda c: (-self.of[c][0], -weight[c], *name(c)))


def slots(items: list[Item], paths: Paths, at: int = 0, grouped: bool = False, optional: bool = False) -> Iterator[tuple[int, list, bool, bool]]:
    """Each slot with the path around it, whether it is in a group, and whether in an optional stretch."""
    for x in items:
        if x[0] == "#":
            yield at, x, grouped, optional
        elif x[0] == "e":
            yield from slots(x[2], paths, paths.add(at, x[1]), grouped, optional)
        else:
            yield from slots(x[1], paths, at, grouped or x[0] == "+", optional or x[0] == "?")


def verdict(wrapper: list[Item]) -> dict:
    """root: the article's container; fixed: texts of the template by path; menus: paths that hold links alone. All None or empty where there is no template to infer."""
    paths = Paths()
    found = list(slots(wrapper, paths))
    told = len({x for _, s, _, _ in found for x in s[5]}) >= TOLD
    pages = max((s[4] for _, s, grouped, _ in found if not grouped), default=0)
    fixed = {(p, s[1]) for p, s, grouped, optional in found if not grouped and s[1] is not None and len(s[5]) >= TOLD and (optional or 2 * s[4] >= pages)}
    lists: dict[int, list] = {}
    for p, s, _, _ in found:
        x = lists.setdefault(p, [0, 0, set()])
        x[0], x[1], x[2] = x[0] + s[2], x[1] + s[3], x[2] | set(s[5])
    menus = {p for p, (chars, links, pages_of) in lists.items() if 10 * links >= 9 * chars and len(pages_of) >= TOLD}
    inner = [(p, s) for p, s, _, _ in found if not paths.of[p][3]]
    free = [(p, s) for p, s in inner if (p, s[1]) not in fixed and p not in menus]
    if 10 * sum(s[2] for _, s in free) < sum(s[2] for p, s in inner if p not in menus):
        fixed, free = set(), [(p, s) for p, s in inner if p not in menus]  # what pages share is nearly all of them, so it isn't template
    for p, s in free:
        if 2 * s[3] <= s[2]:
            paths.of[p][4] += s[2]
    return {"root": paths.main(True) if told else None, "fixed": sorted(fixed), "menus": sorted(menus)}


def alone(page: Page) -> int | None:
    """The container of the article by one page alone."""
    paths = Paths()
    codes = [0]
    for i in range(1, len(page.parent)):
        above = codes[page.parent[i]]
        codes.append(paths.add(above, page.label[i]) if page.code[i] != page.code[page.parent[i]] else above)
    for node, text, links in page.blocks:
        if not page.out[node] and 2 * links <= len(text):
            paths.of[codes[node]][4] += len(text)
    return paths.main(False)


def main_text(page: Page, told: dict | None) -> str:
    """The article's blocks in page order; several articles of one kind on a page are one text. told: the host's verdict, or None."""
    fixed = {tuple(x) for x in told["fixed"]} if told else set()
    menus = set(told["menus"]) if told else set()

    def within(root: int) -> list[str]:
        inside = [root == 0] * len(page.parent)
        for i in range(1, len(inside)):
            inside[i] = inside[page.parent[i]] or page.code[i] == root
        kept = [(page.code[n], t) for n, t, _ in page.blocks if inside[n] and not page.out[n]]
        return [t for c, t in kept if c not in menus and (c, zlib.crc32(t.encode("utf-8", "surrogatepass"))) not in fixed]

    kept = within(told["root"]) if told and told["root"] is not None else []
    if not kept and (root := alone(page)) is not None:
        kept = within(root)
    return " ".join(kept)


# -- over tables -----------------------------------------------------------------------------------------------------
PARTIAL = "host string, shape long, part int, wrapper string"


def merged(wrappers: list[list[Item]]) -> list[Item]:
    """Aligned one after another, in an order that their content fixes."""
    out: list[Item] | None = None
    for w in sorted(wrappers, key=lambda w: (-len(w), json.dumps(w))):
        out = w if out is None else align(out, w)
    return out or []


def same(wrappers: list[list[Item]]) -> list[Item]:
    out = wrappers[0]
    for w in wrappers[1:]:
        out = [join(x, y) for x, y in zip(out, w)]
    return out


def induce(pages: DataFrame) -> DataFrame:
    """(host, html) to one row a host: host, verdict as JSON."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
        held: dict[tuple[str, str], list[Item]] = {}
        task = TaskContext.get().partitionId() % SPREAD

        def out() -> pa.RecordBatch:
            keys = list(held)
            shape = [zlib.crc32(k[1].encode("utf-8", "surrogatepass")) for k in keys]
            columns = [[k[0] for k in keys], shape, [task] * len(keys), [json.dumps(held[k]) for k in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["host", "shape", "part", "wrapper"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = stream(Page(source))
                key = (host, " ".join(map(form, w)))
                held[key] = same([held[key], w]) if key in held else w
            if len(held) >= FLUSH:
                yield out()
                held.clear()
        if held:
            yield out()

    def level(last: bool):
        def one(group: pd.DataFrame) -> pd.DataFrame:
            sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
            known: dict[str, list] = {}
            for w in map(json.loads, group.wrapper):
                known.setdefault(" ".join(map(form, w)), []).append(w)
            w = merged([same(v) for v in known.values()])
            first = group.iloc[0]
            return pd.DataFrame({"host": [first.host], "shape": [first["shape"]], "part": [0], "wrapper": [json.dumps(verdict(w) if last else w)]})

        return one

    rows = pages.mapInArrow(streams, PARTIAL)
    # the copies of a stream by task, then all of them, then the streams of ever larger parts of a host
    rows = rows.groupBy("host", "shape", "part").applyInPandas(level(False), PARTIAL)
    rows = rows.groupBy("host", "shape").applyInPandas(level(False), PARTIAL)
    for parts in LEVELS:
        rows = rows.groupBy("host", F.pmod("shape", F.lit(parts)).alias("of")).applyInPandas(level(parts == LEVELS[-1]), PARTIAL)
    return rows.select("host", F.col("wrapper").alias("verdict"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    verdicts = materialize(induce(rows.select("host", "html")))
    size = verdicts.agg(F.sum(F.octet_length("verdict") + F.octet_length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(verdicts) if size <= BROADCAST else verdicts, "host", "left").select("page_id", "url", "html", "verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            if len(known) > FLUSH:
                known = {None: None}
            texts = []
            for source, told in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if told not in known:
                    known[told] = json.loads(told)
                texts.append(main_text(Page(source), known[told]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, SCHEMA)
