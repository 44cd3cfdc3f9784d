"""Main text of web pages by union-free wrappers.

1. Every page is a stream of tags and texts.  The streams of a host are aligned one after
   another with the host's wrapper, a union-free regular expression.  Where both sides
   have an element or text it is matched; an element that only one side has becomes
   optional, equal neighbours become a repeated group.  A text is fixed while all pages
   that have it agree on it and at least two of them differ otherwise; the first page that
   has another text makes it a slot.
2. The wrapper's element that holds the slots with the most text is the main region; a
   repeated element is none.  What the wrapper has as fixed, in an element apart from the
   slots at an edge of the region, is the template's and goes.  Headings, preformatted and
   inline elements, paragraphs and whatever stands between slots stay, equal on all pages or not.

Elements whose tag, role or ``hidden`` says so are no main text, nor are those that id or
class name as something else, unless they hold the main region, most of the slot text or
the title; of names that are only compounded with such a word, the wrapper decides: they
go where it has them as fixed.  A page's own wrapper takes the place of its host's where
the host's region is not in it.

Nothing here recurses: pages may be as deep and as wide as they like.  A wrapper has at
most ``MAX_NODES`` elements of ``MAX_DEPTH`` levels; beyond, elements that one page
alone has, then the deepest, count as slot text of the element above them.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm import storage
from junctura.llm.word_encoding import slices

# How HTML treats its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
SELF_ENDING = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select", "tr": "table", "td": "tr table", "th": "tr table"}
BOUNDARY = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote".split())
# Elements without text to read, then elements, class words and roles that are no main text.
DROPPED = RAW | frozenset("head button select option template svg math object canvas audio video datalist".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored sponsors sidebar nav navbar navigation breadcrumb breadcrumbs footer notice notices cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup comment comments discussion disqus respond reply replies share sharing social related recommended widget widgets pagination pager".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
FRAME_WORDS = frozenset("area bar block body bottom box button buttons column container count feed group head header holder icon icons inner item items left link links list module outer panel post posts right row section slot thread title top unit wrap wrapper zone".split())
MAIN_WORDS = frozenset("article content main post entry story text body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
WORD = re.compile(r"[a-z0-9#]+")
CONTAINER = frozenset("article main section div td table center".split())
APART = frozenset("address aside center details div dl fieldset footer form header menu nav ol section table ul".split())  # may be cut at the region's edges
STAYS = frozenset("h1 h2 h3 h4 h5 h6 pre".split())  # not if one of these is in it
NEED, NEED_MARKED = 0.8, 0.5  # share of the slot text that a region has; with a tag or a word for main text
MAX_NODES, MAX_DEPTH, WIDE = 4000, 64, 64
AT_ONCE = 8  # pages that are aligned with a wrapper in one go
PLAN_BYTES = 8 << 20  # plans that may be broadcast
SALTS = 256
BESIDE = "~"  # a name for elements whose role or attribute says that they are no main text


class Element:
    __slots__ = ("tag", "key", "dropped", "kids", "parent")

    def __init__(self, tag: str, key: str = "", dropped: bool = False, parent: "Element | None" = None):
        self.tag, self.key, self.dropped, self.parent = tag, key, dropped, parent
        self.kids: list[Element | str] = []


def _open(tag: str, raw: str, parent: Element) -> Element:
    key, dropped = "", tag in DROPPED
    if raw and "=" in raw or "hidden" in raw:
        found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
        key = " ".join(f"{found.get('id', '')} {found.get('class', '')}".lower().split())
        if found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found:
            key = f"{BESIDE} {key}".strip()
        if found.get("role", "").lower() == "main":
            key = f"main {key}".strip()
        key = re.sub(r"\d+", "#", key)
    return Element(tag, key, dropped, parent)


def parse(page: str) -> Element:
    """A page's element tree; end tags that fit nothing are ignored, open elements end with their container.

    Each container counts its open elements by tag, so no tag is looked for in vain and
    the time is linear in the page."""
    root = here = Element("")
    everywhere: dict[str, int] = defaultdict(int)
    scopes: list[dict[str, int]] = [defaultdict(int)]

    def up_to(x: Element) -> Element:
        """Close all elements up to ``x`` and ``x`` itself; what is open then."""
        now = here
        while True:
            if now.tag in BOUNDARY:
                scopes.pop()
            scopes[-1][now.tag] -= 1
            everywhere[now.tag] -= 1
            if now is x:
                return now.parent
            now = now.parent

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            if at < len(page):
                here.kids.append(page[at:])
            return root
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if (everywhere if tag in BOUNDARY else scopes[-1])[tag] > 0:
                x = here
                while x.tag != tag:
                    x = x.parent
                here = up_to(x)
            continue
        if tag in SELF_ENDING:
            ends, stop = ("dt", "dd", "p") if tag in ("dt", "dd") else (tag, "p"), SELF_ENDING[tag].split()
            if any((scopes[-1] if e not in BOUNDARY else everywhere)[e] > 0 for e in ends):
                x, last = here, None
                while x.parent is not None and x.tag not in stop and (x.tag not in BOUNDARY or x.tag == tag):
                    if x.tag in ends:
                        last = x
                        if x.tag == tag:
                            break
                    x = x.parent
                if last is not None:
                    here = up_to(last)
        elif tag in ENDS_P and scopes[-1]["p"] > 0:
            x = here
            while x.tag != "p":
                x = x.parent
            here = up_to(x)
        new = _open(tag, m[3] or "", here)
        here.kids.append(new)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            here = new
            everywhere[tag] += 1
            scopes[-1][tag] += 1
            if tag in BOUNDARY:
                scopes.append(defaultdict(int))


CLEAR, VAGUE, COMPOUND, NAMED, TAGGED = range(5)


@lru_cache(1 << 16)
def doubt(tag: str, key: str) -> int:
    """How surely tag, id and class say that this is no main text.

    A name that is compounded with such a word says so if the word is its last one, or if
    its other words only say what kind of box it is; else it is vague."""
    if tag in ("", "html", "body"):
        return CLEAR
    if tag in ASIDE or BESIDE in key.split():
        return TAGGED
    level = CLEAR
    for name in key.split():
        words = WORD.findall(name)
        if name in DROPPED_WORDS:
            return NAMED
        if not DROPPED_WORDS.isdisjoint(words):
            said = words[-1] in DROPPED_WORDS or all(w in DROPPED_WORDS or w in FRAME_WORDS or "#" in w for w in words)
            level = max(level, COMPOUND if said else VAGUE)
    return level


def one_line(text: str) -> str:
    return " ".join(text.split())


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def in_turn(contents: list[str]) -> str:
    """The content of several after one another; empty if one of them varies."""
    if len(contents) == 1:
        return contents[0]
    return digest(" ".join(contents)) if all(contents) else ""


# --- wrappers: [tag, key, least, most, chars, marks, content, kids] ------------------
# A text has the tag "#".  The content is a digest of all that a page has in the node, empty once pages differ in it.
TAG, KEY, LEAST, MOST, CHARS, MARKS, CONTENT, KIDS = range(8)
TEXT_TAG = "#"
Kind = tuple[str, str]


def _fixed(w: list) -> bool:
    """Whether different pages agree on the node's content."""
    return bool(w[CONTENT]) and len(w[MARKS]) > 1


def wrapper_of(root: Element) -> list:
    """A page's own wrapper: its elements, runs of equal ones folded into repeated groups; all its texts are slots."""
    return merged([stream_of(root)])


def stream_of(root: Element) -> list:
    """A page's elements and texts as the wrapper of this page alone, nothing folded yet.

    All nodes share the page's mark, so that copies of a page count as one: the digest of
    its longer texts, those of half the longest one's length, outside of elements that are
    no main text for sure, and in elements for main text if there are any."""
    marks, said = [""], []
    top = [root.tag, root.key, 1, 1, 0, marks, "", []]
    nodes = [top]
    stack = [(root, top, 0, False, False)]
    while stack:
        x, node, depth, beside, main = stack.pop()
        for k in x.kids:
            if isinstance(k, str):
                if text := one_line(k):
                    node[KIDS].append([TEXT_TAG, "", 1, 1, len(text), marks, digest(text), []])
                    if not beside:
                        said.append((main, text))
            elif not k.dropped and k.tag not in VOID:
                if depth < MAX_DEPTH:
                    own = [k.tag, k.key, 1, 1, 0, marks, "", []]
                    node[KIDS].append(own)
                    nodes.append(own)
                    stack.append((k, own, depth + 1, beside or doubt(k.tag, k.key) >= NAMED, main or marked(k.tag, k.key)))
                elif below := list(texts(k)):
                    node[KIDS].append([TEXT_TAG, "", 1, 1, sum(map(len, below)), marks, in_turn([digest(t) for t in below]), []])
    said = [t for main, t in said if main] or [t for _, t in said]
    least = max(map(len, said), default=0) / 2
    marks[0] = digest("\n".join(t for t in said if len(t) >= least))
    for node in reversed(nodes):
        node[CONTENT] = in_turn([k[CONTENT] for k in node[KIDS]])
    return top


def texts(x: Element) -> Iterator[str]:
    """All texts in an element that are not dropped for sure."""
    stack: list[Element | str] = [x]
    while stack:
        k = stack.pop()
        if not isinstance(k, str):
            stack.extend(c for c in reversed(k.kids) if isinstance(c, str) or not c.dropped and c.tag not in VOID)
        elif text := one_line(k):
            yield text


def kind(w: list) -> Kind:
    return w[TAG], w[KEY]


def matched(x: list[Kind], y: list[Kind]) -> list[tuple[int, int]]:
    """Index pairs of a common subsequence: the longest one of short sequences, else that between kinds
    that both have once, and where there are none, the first fit."""
    out: list[tuple[int, int]] = []
    parts = [(0, len(x), 0, len(y))]
    while parts:
        a, b, c, d = parts.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= WIDE * WIDE:
            best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
            for i in range(b - a - 1, -1, -1):
                for j in range(d - c - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if x[a + i] == y[c + j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < b - a and j < d - c:
                if x[a + i] == y[c + j]:
                    out.append((a + i, c + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
            continue
        anchors = _rising(_once(x, a, b), _once(y, c, d))
        if anchors:
            for i, j in anchors:
                parts.append((a, i, c, j))
                out.append((i, j))
                a, c = i + 1, j + 1
            parts.append((a, b, c, d))
            continue
        spots: dict[Kind, list[int]] = defaultdict(list)
        for i in range(a, b):
            spots[x[i]].append(i)
        last = a - 1
        for j in range(c, d):
            own = spots.get(y[j], [])
            k = bisect_left(own, last + 1)
            if k < len(own):
                last = own[k]
                out.append((last, j))
    return sorted(out)


def _once(x: list[Kind], a: int, b: int) -> dict[Kind, int]:
    """Where the kinds stand that occur once in x[a:b]."""
    at: dict[Kind, int] = {}
    for i in range(a, b):
        at[x[i]] = -1 if x[i] in at else i
    return {k: i for k, i in at.items() if i >= 0}


def _rising(x: dict[Kind, int], y: dict[Kind, int]) -> list[tuple[int, int]]:
    """The longest run of common kinds whose places rise on both sides."""
    both = sorted((i, y[k]) for k, i in x.items() if k in y)
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(both)
    for n, (_, j) in enumerate(both):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [n]
        before[n] = ends[k - 1] if k else -1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(both[n])
        n = before[n]
    return out[::-1]


def merged(same: list[list]) -> list:
    """The wrapper that covers all of the given ones, which are of one kind.

    Their children are aligned one list after another: what some lack is optional,
    equal neighbours are one repeated group.  Lists that stay longer than WIDE have one
    group for each kind."""
    top = _joined(list(enumerate(same)))
    stack = [(top, list(enumerate(same)))]  # with the number of the given wrapper that each comes from
    while stack:
        node, sources = stack.pop()
        if node[TAG] == TEXT_TAG:
            continue
        groups: list[tuple[Kind, dict[int, list[list]]]] = []
        for n, (_, source) in enumerate(sources):
            own = _runs(source[KIDS], n)
            if not n:
                groups = own
                continue
            pairs, both, i, j = matched([g[0] for g in groups], [g[0] for g in own]), [], 0, 0
            for a, b in [*pairs, (len(groups), len(own))]:
                both += groups[i:a] + own[j:b]
                if a < len(groups):
                    groups[a][1].update(own[b][1])
                    both.append(groups[a])
                i, j = a + 1, b + 1
            groups = _neighbours(both)
            if len(groups) > WIDE:
                groups = _by_kind(groups)
        if len(groups) > WIDE:
            groups = _by_kind(groups)
        for _, held in groups:
            flat = [(sources[n][0], w) for n in sorted(held) for w in held[n]]
            child = _joined(flat)
            child[LEAST] = 0 if len(held) < len(sources) else min(2, *(sum(w[LEAST] for w in ws) for ws in held.values()))
            child[MOST] = min(2, max(sum(w[MOST] for w in ws) for ws in held.values()))
            node[KIDS].append(child)
            stack.append((child, flat))
    return bounded(top)


def _joined(same: list[tuple[int, list]]) -> list:
    """One node for all the given ones; its content is what every wrapper that has some agrees on."""
    first = same[0][1]
    if len(same) == 1:
        return [*first[:KIDS], []]
    marks: set[str] = set()
    contents: dict[int, list[str]] = defaultdict(list)
    for n, w in same:
        marks.update(w[MARKS])
        contents[n].append(w[CONTENT])
    each = {in_turn(c) for c in contents.values()}
    return [first[TAG], first[KEY], min(w[LEAST] for _, w in same), max(w[MOST] for _, w in same), sum(w[CHARS] for _, w in same), sorted(marks)[:2], each.pop() if len(each) == 1 else "", []]


def _runs(kids: list[list], n: int) -> list[tuple[Kind, dict[int, list[list]]]]:
    return _neighbours([(kind(k), {n: [k]}) for k in kids])


def _neighbours(groups: list) -> list:
    out: list = []
    for k, held in groups:
        if out and out[-1][0] == k:
            for n, ws in held.items():
                out[-1][1].setdefault(n, []).extend(ws)
        else:
            out.append((k, held))
    return out


def _by_kind(groups: list) -> list:
    by: dict[Kind, dict[int, list[list]]] = {}
    for k, held in groups:
        if k in by:
            for n, ws in held.items():
                by[k].setdefault(n, []).extend(ws)
        else:
            by[k] = held
    return list(by.items())


def walk(w: list) -> Iterator[tuple[list, int]]:
    """(node, depth), each before what it holds, in order."""
    stack = [(w, 0)]
    while stack:
        node, depth = stack.pop()
        yield node, depth
        stack.extend((k, depth + 1) for k in reversed(node[KIDS]))


def bounded(w: list) -> list:
    """Keep a wrapper within MAX_NODES: elements that one page alone has, then the deepest, become slot text of the one above."""
    nodes = list(walk(w))
    limit, rare = MAX_DEPTH, False
    while len(nodes) > MAX_NODES and limit > 1:
        rare, limit = True, limit if not rare else limit // 2
        total: dict[int, int] = {}
        for node, _ in reversed(nodes):
            total[id(node)] = (0 if node[TAG] == TEXT_TAG and _fixed(node) else node[CHARS]) + sum(total[id(k)] for k in node[KIDS])
        for node, depth in nodes:
            gone = [k for k in node[KIDS] if k[TAG] != TEXT_TAG and (len(k[MARKS]) < 2 or depth + 1 > limit)]
            if gone:
                stay = [k for k in node[KIDS] if not any(k is g for g in gone)] if len(gone) < 8 else [k for k in node[KIDS] if k[TAG] == TEXT_TAG or not (len(k[MARKS]) < 2 or depth + 1 > limit)]
                chars = sum(total[id(k)] for k in gone)
                node[KIDS] = stay + ([[TEXT_TAG, "", 0, 2, chars, gone[0][MARKS], "", []]] if chars else [])
        nodes = list(walk(w))
    return w


def packed(w: list) -> str:
    """A wrapper as JSON without nesting."""
    return json.dumps([[depth, *node[:KIDS]] for node, depth in walk(w)], ensure_ascii=False)


def unpacked(text: str) -> list:
    above: list[list] = []
    for depth, *own in json.loads(text):
        node = [*own, []]
        del above[depth:]
        if above:
            above[-1][KIDS].append(node)
        above.append(node)
    return above[0]


def expression(w: list) -> str:
    """The wrapper as a regular expression over tags; _ is a slot, # a fixed text."""
    out: list[str] = []
    todo: list[list | str] = [w]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = {(0, 1): "?", (0, 2): "*", (1, 2): "+", (2, 2): "+"}.get((x[LEAST], x[MOST]), "")
        inner = ["#" if _fixed(x) else "_"] if x[TAG] == TEXT_TAG else [f"<{x[TAG]}>" if x[TAG] else "", *x[KIDS], f"</{x[TAG]}>" if x[TAG] else ""]
        todo.extend(reversed(["(" if mark else "", *inner, f"){mark}" if mark else ""]))
    return "".join(out)


def marked(tag: str, key: str) -> bool:
    return (tag in ("article", "main") or "main" in key.split()) and doubt(tag, key) < NAMED


def cued(tag: str, key: str) -> bool:
    return marked(tag, key) or tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(WORD.findall(key)) and doubt(tag, key) < NAMED


class Plan(NamedTuple):
    """What a wrapper says about its pages: the main region; kinds that stay although tag or name are against them;
    kinds of vague names that go; (tag, key, content) of fixed elements at the edges of the region."""

    region: Kind | None
    kept: frozenset[Kind]
    gone: frozenset[Kind]
    edges: frozenset[tuple[str, str, str]]


def plan(w: list) -> Plan:
    """Slot text decides.  A region stands at most once in a page; it is the innermost
    element with ``NEED`` of the slot text, before that the one with most of it whose tag
    or name is one of main text, if it has ``NEED_MARKED``."""
    flat: list[list] = []  # kind, number after the last one inside, depth, at most once, slot text of its own
    above: list[int] = []
    same = _copies(w)
    fixed = lambda node: id(node) not in same and _fixed(node)
    for node, depth in walk(w):
        while len(above) > depth:
            flat[above.pop()][1] = len(flat)
        if node[TAG] == TEXT_TAG:
            if not fixed(node):
                flat[above[-1]][4] += node[CHARS]
            continue
        once = node[MOST] <= 1 and (not above or flat[above[-1]][3])
        above.append(len(flat))
        flat.append([kind(node), 0, depth, once, node[CHARS]])
    while above:
        flat[above.pop()][1] = len(flat)

    def sums(lost: set[Kind]) -> tuple[list[int], dict[Kind, int]]:
        """Slot text of each element and of each kind (the outermost ones), without what is inside of lost kinds."""
        up, at = [0] * (len(flat) + 1), 0
        while at < len(flat):
            gone = flat[at][0] in lost
            for i in range(at, flat[at][1] if gone else at + 1):
                up[i + 1] = up[i] + (0 if gone else flat[i][4])
            at = flat[at][1] if gone else at + 1
        each = [up[end] - up[i] for i, (_, end, *_) in enumerate(flat)]
        by: dict[Kind, int] = defaultdict(int)
        until: dict[Kind, int] = {}
        for i, (c, end, *_) in enumerate(flat):
            if i >= until.get(c, 0):
                by[c] += each[i]
                until[c] = end
        return each, by

    each, by = sums(set())
    often = {c for c, _, _, once, _ in flat if not once}
    mains = {c for c, *_ in flat if marked(*c)} - often
    main = max(mains, key=lambda c: (by[c], c), default=None)

    def part(outer: Kind, inner: Kind, each: list[int]) -> int:
        """Slot text of the inner kind that lies in elements of the outer one."""
        n, i = 0, 0
        stop = 0
        while i < len(flat):
            if flat[i][0] == outer:
                stop = max(stop, flat[i][1])
            if flat[i][0] == inner and i < stop:
                n, i = n + each[i], flat[i][1]
            else:
                i += 1
        return n

    suspects = {c for c, *_ in flat if doubt(*c) > VAGUE}
    holds = {c for c in suspects if main and by[main] and 2 * part(c, main, each) > by[main]}
    kept = holds | {c for c in suspects if 2 * by[c] > each[0] and (main is None or doubt(*c) < NAMED)}
    vague = {c for c, *_ in flat if doubt(*c) == VAGUE}
    gone = vague - {kind(x) for x, _ in walk(w) if kind(x) in vague and not fixed(x)}
    lost = suspects - kept | gone
    each, by = sums(lost)
    barred, stop = set(often), 0
    for c, end, *_ in flat:  # what stays for its share of the text alone, against its whole name, is no region
        if c in lost or c in suspects - holds and doubt(*c) == NAMED:
            stop = max(stop, end)
        if stop and end <= stop or c in suspects - holds and doubt(*c) == TAGGED:
            barred.add(c)
    depth = {c: d for c, _, d, *_ in flat}
    free = [c for c in by if c not in barred and by[c] and (c[0] in CONTAINER or "-" in c[0])]
    found = max((c for c in free if cued(*c) and by[c] >= NEED_MARKED * each[0]), key=lambda c: (by[c], depth[c], c), default=None)
    inner = [c for c in free if (by[c] >= NEED * each[0] if found is None else cued(*c) and part(found, c, each) >= NEED * by[found])]
    found = min(inner, key=lambda c: (not marked(*c), by[c], -depth[c], c), default=found)
    if found is None and any(c[0] == "body" and 2 * each[i] > each[0] for i, (c, *_) in enumerate(flat)):
        found = ("body", "")
    return Plan(found, frozenset(kept), frozenset(gone), frozenset(_edges(w, found, lost, fixed)))


def _copies(w: list) -> set[int]:
    """The nodes in elements for main text, where the pages agree on all of them: the pages have one story."""
    inside: list[list] = []
    deep = -1
    for node, depth in walk(w):
        if deep >= 0 and depth <= deep:
            deep = -1
        if deep < 0 and marked(*kind(node)):
            deep = depth
        if deep >= 0:
            if node[TAG] == TEXT_TAG and not _fixed(node):
                return set()
            inside.append(node)
    return set(map(id, inside))


def _edges(w: list, region: Kind | None, lost: set[Kind], fixed) -> Iterator[tuple[str, str, str]]:
    """Fixed elements apart, before the first and after the last of the region's other children, or of its only other child's."""
    for node, _ in walk(w):
        if kind(node) != region and not (region and region[0] == node[TAG] == "body"):
            continue
        while node is not None:
            rest = [k for k in node[KIDS] if kind(k) not in lost]
            for at in (0, -1):
                while rest and rest[at][TAG] in APART and fixed(rest[at]) and not any(x[TAG] in STAYS for x, _ in walk(rest[at])):
                    k = rest.pop(at)
                    yield *kind(k), k[CONTENT]
            node = rest[0] if len(rest) == 1 and rest[0][TAG] in CONTAINER | APART and rest[0][MOST] <= 1 else None


def region(w: list) -> Kind | None:
    """(tag, key) of the main region: the element that holds the slots with the most text."""
    return plan(w).region


def blocks(root: Element, of_host: Plan | None = None) -> list[str]:
    """The text blocks of the page's main region, in page order.

    The region is the page's elements of the host's kind.  A page without one, or without
    text in it, has the region of a wrapper of its own."""
    if of_host is not None and of_host.region is not None and (found := _blocks(root, of_host)):
        return found
    return _blocks(root, plan(wrapper_of(root)))


def _blocks(root: Element, p: Plan) -> list[str]:
    titled = _with_title(root)
    whole = p.region is None or p.region[0] == "body"
    dead: set[int] = set()
    live: list[Element] = []  # in page order
    stack = [(root, False)]
    while stack:
        x, inside = stack.pop()
        if x is not root:
            live.append(x)
        inside = inside or marked(x.tag, x.key)
        for k in reversed(x.kids):
            if not isinstance(k, str):
                level, own = doubt(k.tag, k.key), (k.tag, k.key)
                against = level > VAGUE and own not in p.kept and (level == TAGGED or id(k) not in titled) or own in p.gone
                if k.dropped or against or k.tag == "header" and whole and not inside:
                    dead.add(id(k))
                else:
                    stack.append((k, inside))
    chosen = [root] if p.region is None else [x for x in live if (x.tag, x.key) == p.region or p.region[0] == x.tag == "body"]
    for x in chosen:
        _cut_edges(x, p.edges, dead)
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = one_line(entities.unescape("".join(run)))
        run.clear()
        if text:
            out.append(text)

    inner = {id(x) for x in chosen}
    covered: set[int] = set()
    for x in chosen:
        if id(x) in covered:
            continue
        todo: list[Element | str | None] = [x]
        while todo:
            k = todo.pop()
            if k is None:
                close()
            elif isinstance(k, str):
                run.append(k)
            elif id(k) in dead:
                if k.tag in BLOCK:
                    close()
                else:
                    run.append(" ")
            elif k.tag == "br":
                run.append(" ")
            else:
                if id(k) in inner:
                    covered.add(id(k))
                if k.tag in BLOCK:
                    close()
                    todo.append(None)
                todo.extend(reversed(k.kids))
        close()
    return out


def _cut_edges(x: Element, edges: frozenset[tuple[str, str, str]], dead: set[int]) -> None:
    """Mark what the wrapper has as fixed before the first and after the last of the region's other children."""
    if not edges:
        return
    while x is not None:
        runs: list[list[Element]] = []  # neighbours of one kind, as in the wrapper; a text is an empty run
        for k in x.kids:
            if isinstance(k, str):
                if one_line(k):
                    runs.append([])
            elif not k.dropped and k.tag not in VOID:
                if runs and runs[-1] and (runs[-1][0].tag, runs[-1][0].key) == (k.tag, k.key):
                    runs[-1].append(k)
                else:
                    runs.append([k])
        runs = [own for own in runs if not own or any(id(k) not in dead for k in own)]
        for at in (0, -1):
            while runs and (own := runs[at]) and (own[0].tag, own[0].key, in_turn([stream_of(k)[CONTENT] for k in own])) in edges:
                dead.update(map(id, own))
                runs.pop(at)
        x = runs[0][0] if len(runs) == 1 and len(runs[0]) == 1 and runs[0][0].tag in CONTAINER | APART else None


def _with_title(root: Element) -> set[int]:
    """The elements that hold an h1 which is not dropped for sure."""
    out: set[int] = set()
    stack = [root]
    while stack:
        x = stack.pop()
        for k in x.kids:
            if not isinstance(k, str) and not k.dropped and doubt(k.tag, k.key) < TAGGED:
                stack.append(k)
                if k.tag == "h1":
                    up = k.parent
                    while up is not None and id(up) not in out:
                        out.add(id(up))
                        up = up.parent
    return out


# --- jobs ----------------------------------------------------------------------------


def host_of(url: str) -> Column:
    """The host in a column of addresses; a null or odd address has the empty one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)", 1)), F.lit(""))


def with_plans(pages: DataFrame, plans: DataFrame, names: list[str]) -> DataFrame:
    """``pages`` with the columns of their hosts: by broadcast up to PLAN_BYTES, else with each host's pages in SALTS parts."""
    size = plans.agg(F.sum(sum(F.octet_length(F.to_json(F.struct(n))) for n in names) + F.octet_length("host") + 64)).first()[0] or 0
    if size <= PLAN_BYTES:
        return pages.join(F.broadcast(plans), "host", "left")
    salted = plans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS))).join(salted, ["host", "__salt"], "left").drop("__salt")


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper of each host in ``pages`` (host, html).

    Every page is aligned within its partition; the partitions' wrappers of a host
    are aligned in two turns, first in ``SALTS`` parts, so a host with many pages is
    never one task's rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, list[list]] = {}  # the first is the host's wrapper so far
        waiting = 0  # characters of the pages that are not in it yet

        def settle() -> None:
            for ws in held.values():
                ws[:] = [merged(ws)]

        def batch() -> pa.RecordBatch:
            settle()
            out = pa.RecordBatch.from_pydict({"host": list(held), "salt": [salt] * len(held), "wrapper": [packed(w) for w, in held.values()]}, pa.schema([("host", pa.string()), ("salt", pa.int64()), ("wrapper", pa.string())]))
            held.clear()
            return out

        for given in batches:
            for first, rows in slices(given.column("html"), 8 << 20):
                own_rows = given.slice(first, len(rows))
                for host, page in zip(own_rows.column("host").to_pylist(), rows.to_pylist()):
                    ws = held.setdefault(host, [])
                    ws.append(stream_of(parse(page or "")))
                    waiting += len(page or "")
                    if len(ws) > AT_ONCE:
                        ws[:] = [merged(ws)]
                    if waiting > 4 << 20:
                        settle()
                        waiting = 0
            if len(held) > 2000:
                yield batch()
        yield batch()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        out = None
        for text in sorted(rows.column("wrapper").to_pylist()):
            w = unpacked(text)
            out = w if out is None else merged([out, w])
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([packed(out)], pa.string())})

    parts = pages.select("host", "html").mapInArrow(part, "host string, salt long, wrapper string")
    some = parts.groupBy("host", "salt").applyInArrow(merge, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def plans(wrappers: DataFrame) -> DataFrame:
    """host and its plan as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [plan(unpacked(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps([p.region, *map(sorted, p[1:])], ensure_ascii=False) for p in found], pa.string())], ["host", "plan"])

    return wrappers.mapInArrow(run, "host string, plan string")


@lru_cache(1024)
def plan_of(text: str | None) -> Plan | None:
    if text is None:
        return None
    r, *sets = json.loads(text)
    return Plan(r and tuple(r), *(frozenset(map(tuple, x)) for x in sets))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page has the empty text; a null or odd url counts as the empty
    host.  White space within a block is one space, blocks are joined by \\n.  Repeated
    rows give repeated rows, and copies of a page do not make its text fixed.
    Long, deep and wide pages are read whole.  An empty table gives no rows; other
    columns of ``pages`` are not read, whatever their names."""
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    found = storage.table(plans(infer(rows)), "plans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("html"), 8 << 20):
                part = batch.slice(first, len(rows))
                texts = ["\n".join(blocks(parse(page or ""), plan_of(text))) for page, text in zip(rows.to_pylist(), part.column("plan").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_plans(rows, found, ["plan"]).select("page_id", "url", "html", "plan").mapInArrow(run, "page_id long, url string, text string, n_chars long")
