"""HTML main-text extraction by equivalence-class template deduction.

Tokens of a page are the beginnings and ends of its block elements, told apart by their path of open elements (with class
and id), and its text blocks, told apart by path and content. Over the pages of one host each token has an occurrence vector
(how often it occurs on each page). Tokens with equal vectors form an equivalence class, ordered by mean position. A class
is valid if its tokens are on enough of the host's pages, come in that order on at least ``SOUND`` of the pages that hold
them (else the tokens below each parent element are tried as a class of their own), and if ``SOUND`` of its instances lie
inside one gap between two tokens of an instance of one other class, or of the page. So the valid classes nest into a tree,
the host's template, and the gaps of its classes are the slots.

Of every slot the text per page, the part of it that stands in links, and how much it varies between pages are summed over
the host. A slot weighs its text without links, times its variation; where the page's own elements speak for an article or
against it (``article``, ``main``; menus, footers, forms, names like "sidebar"), that prior weighs the slot more or less.
The main element is the smallest element of the template whose slots weigh ``MAIN_SHARE`` of the host's. The article is the
text in its slots, and what stands directly in the elements around it unless it is an ``article`` itself; slots that
the prior speaks against, and slots of links outside ``article`` and ``main``, do not belong to it unless they hold most of
the host's text. A text block that is a token of the template (a notice, a label) is dropped, wherever it stands; but where
such blocks make up most of a page's article, the page is a near copy of others and keeps them. Elements that are no tokens of
the template, inside a slot, are judged by the prior alone, and so are hosts with fewer than ``min_pages`` pages and
pages without any text of their own in the article's slots.

Scale: an occurrence vector is never built. Each task sums, per host and token, two 31-bit hashes of the page times the
count, so equal sums mean equal vectors (but for a chance of 2^-62 a pair). Sums are combined map-side and then by (host,
token), so a host with a third of all pages spreads over all tasks by its tokens; only tokens on at least ``min_share`` of a
host's pages reach the one row of that host, so a template is at most 1/min_share times as long as a page. Order, nesting
and the slots' sums are counted in a second pass, again by (host, token); the text is taken in a third. Templates are
broadcast below ``broadcast_bytes`` in total, by their measured size, else joined by host and one of ``SALTS`` salts.

Defined results: null or empty html gives empty text and no slots; pages without a host share the host ''; repeated rows
give repeated rows; ties between classes and elements go to the earlier position, then to the smaller token; very long pages
take time in proportion to their length; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, texts
from .urls import split_url

_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>{_ATTRS})>
    |(?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the right side ends when one of the left begins.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = frozenset("ul ol dl table article main section div body nav aside footer header form blockquote".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_AWAY = frozenset("nav footer aside form head button dialog menu title".split())
_AWAY_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr|menu|modal|nav(?:bar|igation)?|newsletter|notices?|popup|promo\w*|related|repl(?:y|ies)|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_ARTICLE = frozenset(("article", "main"))
#: Parts of an article, whatever their names.
_TEXT_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figure".split())
#: Containers that are never the main element.
_PARTS = frozenset("ul ol dl blockquote".split())
#: Share of a host's weight that the main element must hold.
MAIN_SHARE = 0.9
#: Share of pages on which a class must be ordered, and of instances that must share a gap.
SOUND = 0.9
#: Factors of a slot's weight where the elements speak for an article or against it.
FOR, AGAINST = 2.0, 0.125
SALTS = 32

#: What the prior says of an element: away (itself or what is around it), in an article, able to be the main element, a container, and away by itself.
AWAY, ARTICLE, BOX, CONTAINER, AGAINST_ITSELF = 1, 2, 4, 8, 16
OPEN, CLOSE, TEXT = 0, 1, 2

SCHEMA = "page_id long, url string, text string, slots array<struct<slot:long,main:boolean,text:string>>"
_SLOTS = pa.list_(pa.struct([("slot", pa.int64()), ("main", pa.bool_()), ("text", pa.string())]))


def _hash(*parts: str) -> int:
    h = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Kind:
    """What all elements of one path share."""

    __slots__ = ("path", "end", "up", "tag", "prior")

    def __init__(self, path: int, up: int, tag: str, prior: int):
        self.path, self.end, self.up, self.tag, self.prior = path, _hash("end", str(path)), up, tag, prior


#: What is around all elements.
_ROOT = Kind(_hash("root"), 0, "", BOX | CONTAINER)
_KINDS: dict[tuple, Kind] = {}


def _kind(up: Kind, tag: str, attrs: str) -> Kind:
    key = (up.path, tag, attrs)
    if (found := _KINDS.get(key)) is None:
        name = " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)) if attrs else ""
        inside = bool(up.prior & ARTICLE)
        against = tag in _AWAY or tag == "header" and not inside or bool(name) and tag not in ("html", "body", *_ARTICLE) and not (inside and tag in _TEXT_PARTS) and bool(_AWAY_NAME.search(name))
        prior = (AWAY if against or up.prior & AWAY else 0) | (ARTICLE if inside or tag in _ARTICLE else 0) | (BOX if tag in _STOPS and tag not in _PARTS else 0) | (CONTAINER if tag in _STOPS or tag == "td" else 0) | (AGAINST_ITSELF if against else 0)
        if len(_KINDS) > 100_000:
            _KINDS.clear()
        found = _KINDS[key] = Kind(_hash(str(up.path), tag, name), up.path, tag, prior)
    return found


class Node:
    """An open element: its kind, whether it is in a link, and the innermost container's path.

    ``away``: the prior speaks against it, the elements in ``known`` (those of a template) not being asked.
    """

    __slots__ = ("kind", "link", "away", "box")

    def __init__(self, kind: Kind, up: Node | None, known: frozenset | dict):
        self.kind = kind
        self.link = kind.tag == "a" or up is not None and up.link
        self.away = up is not None and (up.away or bool(kind.prior & AGAINST_ITSELF) and kind.path not in known)
        self.box = kind.path if up is None or kind.prior & CONTAINER else up.box


def events(html: str, known: frozenset | dict = frozenset()):
    """(OPEN, node), (CLOSE, node) of block elements and (TEXT, node, text, characters in links), in page order.

    A block's text is decoded and its white space single. Elements that are left open end with the page.
    """
    root = Node(_ROOT, None, known)
    stack = [root]
    open_at: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = 0
    at: Node | None = None

    def block():
        nonlocal at, linked
        if at is not None and (text := " ".join(unescape("".join(parts)).split())):
            yield TEXT, at, text, min(linked, len(text))
        parts.clear()
        at, linked = None, 0

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def cut(k: int):
        """Close all elements from the k-th on."""
        while len(stack) > k:
            node = stack.pop()
            open_at[node.kind.tag].pop()
            if node.kind.tag not in _INLINE:
                yield from block()
                yield CLOSE, node

    for m in _TOKEN.finditer(html):
        if (text := m["text"]) is not None:
            if at is None and not text.isspace():
                at = stack[-1]
            if stack[-1].link:
                linked += len(text)
            parts.append(text)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag not in _INLINE:
                yield from block()
            if (k := last((tag,))) and (tag in _STOPS or k > last(_ARTICLE)):
                yield from cut(k)
            continue
        if tag not in _INLINE:
            yield from block()
            if tag in _ENDS_P and (k := last(("p",))) > last(_STOPS):
                yield from cut(k)
            if tag in _CLOSES and (k := last(_CLOSES[tag])) > last(_STOPS):
                yield from cut(k)
        node = Node(_kind(stack[-1].kind, tag, m["attrs"]), stack[-1], known)
        if tag == "br":
            parts.append(" ")
        if tag not in _INLINE:
            yield OPEN, node
        if tag not in _VOID and not m["attrs"].endswith("/"):
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    yield from block()
    yield from cut(1)


def token(event: tuple) -> int:
    kind = event[1].kind
    return kind.path if event[0] == OPEN else kind.end if event[0] == CLOSE else _hash("text", str(kind.path), event[2])


def page_tokens(html: str) -> dict[int, list[int]]:
    """token to [count, sum of positions, path of the element around it, event, prior]; the page itself is a token."""
    out: dict[int, list[int]] = {_ROOT.path: [1, 0, 0, OPEN, _ROOT.prior]}
    for position, event in enumerate(events(html), 1):
        kind = event[1].kind
        if (x := out.get(t := token(event))) is None:
            x = out[t] = [0, 0, kind.path if event[0] == TEXT else kind.up, event[0], kind.prior]
        x[0] += 1
        x[1] += position
    return out


# --- first pass: classes of equal vectors


def token_sums(pages: DataFrame, flush: int = 100_000) -> DataFrame:
    """host, token and the sums from which vectors, supports and positions are read. pages: row, host, html."""

    def run(batches):
        table: dict[tuple[str, int], list[int]] = {}

        def out():
            keys = list(table)
            columns = list(zip(*table.values(), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["host", "token", "v1", "v2", "total", "pages", "place", "parent", "event", "prior"])
            table.clear()

        for batch in batches:
            for row, host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "html"), strict=True):
                h = xxhash.xxh3_64_intdigest(str(row))
                one, two = h & 0x7FFFFFFF, (h >> 31) & 0x7FFFFFFF
                for t, (n, place, *rest) in page_tokens(html or "").items():
                    if (x := table.get((host, t))) is None:
                        x = table[host, t] = [0, 0, 0, 0, 0, *rest]
                    x[0] += one * n
                    x[1] += two * n
                    x[2] += n
                    x[3] += 1
                    x[4] += place
                if len(table) >= flush:
                    yield from out()
        yield from out()

    return pages.select("row", "host", "html").mapInArrow(run, "host string, token long, v1 long, v2 long, total long, pages long, place long, parent long, event long, prior long")


def deduce(tokens: list[dict]) -> dict:
    """The candidate classes of one host: whole ones, then the parts below one parent element of those that have several.

    tokens: token, v1, v2, total, pages, place, parent, event, prior.
    """
    tokens = sorted(tokens, key=lambda t: (t["place"] / t["total"], t["token"]))
    by_vector: dict[tuple, list[dict]] = {}
    for t in tokens:
        if t["token"] != _ROOT.path:
            by_vector.setdefault((t["v1"], t["v2"]), []).append(t)
    classes = [[t["token"] for t in c] for c in by_vector.values()]
    whole = list(range(len(classes)))
    for k, c in enumerate(by_vector.values()):
        parts: dict[int, list[int]] = {}
        for t in c:
            parts.setdefault(t["parent"], []).append(t["token"])
        if len(parts) > 1:
            classes += parts.values()
            whole += [k] * len(parts)
    facts = {t["token"]: (t["parent"], t["event"], t["prior"], t["total"] == t["pages"]) for t in tokens}
    return {"classes": classes, "whole": whole, "facts": [[t, *f] for t, f in facts.items()], "pages": max((t["pages"] for t in tokens), default=0)}


class Classes:
    """Classes of a host, and how the tokens of a page fit them."""

    def __init__(self, classes: list[list[int]]):
        self.classes = classes
        self.where: dict[int, list[tuple[int, int]]] = {}
        for c, ids in enumerate(classes):
            for i, t in enumerate(ids):
                self.where.setdefault(t, []).append((c, i))

    def fit(self, stream: list[int]) -> dict[int, bool]:
        """Classes that occur among the tokens, and whether they are in order."""
        state: dict[int, int] = {}
        bad = set()
        for t in stream:
            for c, i in self.where.get(t, ()):
                if state.get(c, 0) != i:
                    bad.add(c)
                state[c] = (i + 1) % len(self.classes[c])
        return {c: c not in bad and not i for c, i in state.items()}

    def nest(self, stream: list[int], fits: dict[int, bool], votes: Counter | None = None) -> list[int]:
        """Per token the slot after it: the last token of the innermost open instance of a class that fits.

        votes: counts (class, slot that the instance lies in; 0 if it holds a token of an instance that began before it).
        """
        belongs: dict[int, tuple[int, int]] = {}
        for t in set(stream):
            for c, i in self.where.get(t, ()):
                if fits[c]:
                    belongs[t] = (c, i)
                    break
        stack = [(-1, [_ROOT.path], 0)]
        out = []
        for t in stream:
            if (found := belongs.get(t)) is not None:
                c, i = found
                slot = stack[-1][1][0]
                if i == 0:
                    if votes is not None:
                        votes[c, slot] += 1
                    if len(self.classes[c]) > 1:
                        stack.append((c, [t], slot))
                elif any(s[0] == c for s in stack):
                    # what began later and is still open does not lie inside one gap
                    while stack[-1][0] != c:
                        d, _, began = stack.pop()
                        if votes is not None:
                            votes[d, began] -= 1
                            votes[d, 0] += 1
                    stack[-1][1][0] = t
                    if i == len(self.classes[c]) - 1:
                        stack.pop()
            out.append(stack[-1][1][0])
        return out


# --- second pass: order, nesting and the text of slots


ORDER, VOTE, GAP = 0, 1, 2


class Cached(dict):
    """Values made of blobs, those of the last few hosts being kept."""

    def __init__(self, make, limit: int = 256):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, blob: bytes):
        if len(self) >= self.limit:
            self.clear()
        value = self[blob] = self.make(json.loads(blob))
        return value


def measure_page(html: str, classes: Classes) -> dict[tuple[int, int, int], list[int]]:
    """(what, a, b) to sums: ORDER class: pages, pages in order. VOTE class, slot: instances. GAP token: pages, characters, those in links, bits of the text's hash."""
    found = list(events(html))
    stream = [token(e) for e in found]
    fits = classes.fit(stream)
    votes: Counter = Counter()
    slots = classes.nest(stream, fits, votes)
    out = {(ORDER, c, 0): [1, int(ok), 0, 0] for c, ok in fits.items()}
    out |= {(VOTE, c, slot): [n, 0, 0, 0] for (c, slot), n in votes.items()}
    held: dict[int, list] = {}
    before = _ROOT.path
    for event, t, after in zip(found, stream, slots, strict=True):
        # template text opens a gap of its own but is not the text of one
        if event[0] == TEXT and t not in classes.where:
            x = held.setdefault(before, [0, 0, []])
            x[0] += len(event[2])
            x[1] += event[3]
            x[2].append(event[2])
        before = after
    for slot, (chars, linked, parts) in held.items():
        bit = _hash(*parts) & 63
        out[GAP, slot, 0] = [1, chars, linked, (1 << bit) - (1 << 64 if bit == 63 else 0)]
    return out


def slot_sums(pages: DataFrame, flush: int = 100_000) -> DataFrame:
    """The sums of ``measure_page`` by host. pages: host, html, blob."""

    def run(batches):
        made = Cached(lambda known: Classes(known["classes"]))
        table: dict[tuple, list[int]] = {}

        def out():
            keys = list(table)
            columns = list(zip(*table.values(), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), *(pa.array(c, pa.int64()) for c in columns)], names=["host", "what", "a", "b", "n", "x", "y", "bits"]
            )
            table.clear()

        for batch in batches:
            for host, blob, html in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch, "html"), strict=True):
                for key, (n, x, y, bits) in measure_page(html or "", made[blob]).items():
                    z = table.setdefault((host, *key), [0, 0, 0, 0])
                    z[0] += n
                    z[1] += x
                    z[2] += y
                    z[3] |= bits
                if len(table) >= flush:
                    yield from out()
        yield from out()

    return pages.select("host", "html", "blob").mapInArrow(run, "host string, what long, a long, b long, n long, x long, y long, bits long")


def variation(bits: int, pages: int) -> float:
    """Share of different texts among the pages' texts, by the hashes' bits."""
    if not pages:
        return 0.0
    expected = 64 * (1 - (1 - 1 / 64) ** pages)
    return min(1.0, (bits & (1 << 64) - 1).bit_count() / expected)


def decide(known: dict, sums: list[dict]) -> dict:
    """The template of one host: its valid classes, nested, and what each slot is. sums: what, a, b, n, x, y, bits."""
    classes, whole = known["classes"], known["whole"]
    facts = {t: (parent, event, prior, once) for t, parent, event, prior, once in known["facts"]}
    held: dict[int, tuple[int, int]] = {}
    votes: dict[int, dict[int, int]] = {}
    gaps: dict[int, list[int]] = {}
    for s in sums:
        if s["what"] == ORDER:
            held[s["a"]] = (s["n"], s["x"])
        elif s["what"] == VOTE:
            votes.setdefault(s["a"], {})[s["b"]] = s["n"]
        else:
            gaps[s["a"]] = [s["n"], s["x"], s["y"], s["bits"]]
    parent: dict[int, int] = {}

    def sound(c: int) -> bool:
        pages, ordered = held.get(c, (0, 0))
        given = votes.get(c)
        if not given or ordered < SOUND * pages:
            return False
        slot, n = max(given.items(), key=lambda v: (v[1], -v[0]))
        parent[c] = slot
        return slot != 0 and n >= SOUND * sum(given.values())

    valid = [c for c in range(len(classes)) if whole[c] == c and sound(c)]
    good = set(valid)
    valid += [c for c in range(len(classes)) if whole[c] != c and whole[c] not in good and sound(c)]
    good = set(valid)
    of = {t: c for c in reversed(range(len(classes))) for t in classes[c]}
    of |= {t: c for c in valid for t in classes[c]}

    def slot_of(t: int) -> int:
        """The slot of the valid classes that a slot of any classes lies in."""
        seen = set()
        while t != _ROOT.path and of.get(t) not in good:
            c = of.get(t)
            if c in seen or c not in parent or parent[c] == 0:
                return _ROOT.path
            seen.add(c)
            t = parent[c]
        return t

    total: dict[int, list[int]] = {}
    for t, (n, chars, linked, bits) in gaps.items():
        x = total.setdefault(slot_of(t), [0, 0, 0, 0])
        x[0] = max(x[0], n)
        x[1] += chars
        x[2] += linked
        x[3] |= bits

    def element(t: int) -> int:
        """The element that a slot is directly in."""
        return t if t == _ROOT.path or facts[t][1] == OPEN else facts[t][0]

    def around(e: int):
        while e in facts:
            yield e
            e = facts[e][0]

    weights, plain = {}, {}
    for t, (n, chars, linked, bits) in total.items():
        prior = facts[element(t)][2] if element(t) in facts else 0
        plain[t] = (chars - linked) * variation(bits, n)
        weights[t] = plain[t] * (AGAINST if prior & AWAY else FOR if prior & ARTICLE else 1.0)
    everything, all_plain = sum(weights.values()), sum(plain.values())
    inside: Counter = Counter()
    text_inside: Counter = Counter()
    for t, w in weights.items():
        for e in around(element(t)):
            inside[e] += w
            text_inside[e] += plain[t]
    template = {t for c in valid for t in classes[c]} | {_ROOT.path}
    able = [e for e, w in inside.items() if w >= MAIN_SHARE * everything and facts[e][1] == OPEN and facts[e][2] & BOX and facts[e][3] and e in template]
    # of elements around each other the inner one has the longer way to the root
    main = max(able, key=lambda e: (sum(1 for _ in around(e)), -e), default=_ROOT.path)
    outer = [] if main not in facts or facts[main][2] & ARTICLE else list(around(main))[1:]
    article, direct = [], []
    for t in sorted(template):
        way = list(around(element(t)))
        _, chars, linked, _ = total.get(t, (0, 0, 0, 0))
        if any(facts[e][2] & AGAINST_ITSELF and text_inside[e] <= all_plain / 2 for e in way):
            continue
        if chars and linked > 0.6 * chars and plain[t] <= all_plain / 2 and not (way and facts[way[0]][2] & ARTICLE):
            continue
        if main in way:
            article.append(t)
        elif next((e for e in way if facts[e][2] & CONTAINER), None) in outer:
            direct.append(t)
    kept = [classes[c] for c in valid]
    return {"classes": kept, "parents": [slot_of(parent[c]) for c in valid], "main": main, "article": article, "direct": direct, "outer": outer, "pages": known["pages"]}


# --- third pass: the text


class Template:
    def __init__(self, made: dict):
        self.classes = Classes(made["classes"])
        self.article, self.direct, self.outer = map(frozenset, (made["article"], made["direct"], made["outer"]))


def by_elements(html: str) -> tuple[str, list[dict]]:
    """The text where no template speaks: inside ``article`` or ``main`` if there is one, without what the prior is against."""
    blocks = [e for e in events(html) if e[0] == TEXT]
    has_article = any(e[1].kind.prior & ARTICLE and not e[1].away for e in blocks)
    return _joined([(-1, not e[1].away and (not has_article or bool(e[1].kind.prior & ARTICLE)), e[2]) for e in blocks])


def _joined(blocks: list[tuple[int, bool, str]]) -> tuple[str, list[dict]]:
    slots: list[dict] = []
    parts: list[list[str]] = []
    for slot, main, text in blocks:
        if slots and slots[-1]["slot"] == slot and slots[-1]["main"] == main:
            parts[-1].append(text)
        else:
            slots.append({"slot": slot, "main": main})
            parts.append([text])
    for s, p in zip(slots, parts, strict=True):
        s["text"] = "\n".join(p)
    return "\n".join(text for _, main, text in blocks if main), slots


def extract_page(html: str | None, template: Template | None) -> tuple[str, list[dict]]:
    """The main text, and all slots in page order with their text."""
    if not html:
        return "", []
    if template is None:
        return by_elements(html)
    where = template.classes.where
    found = list(events(html, where))
    stream = [token(e) for e in found]
    slots = template.classes.nest(stream, template.classes.fit(stream))
    blocks = []
    before = _ROOT.path
    for event, t, after in zip(found, stream, slots, strict=True):
        if event[0] == TEXT:
            node = event[1]
            wanted = not node.away and (before in template.article or before in template.direct and node.box in template.outer)
            blocks.append((before, wanted, event[2], t in where))
        before = after
    fixed, free = (sum(len(b[2]) for b in blocks if b[1] and b[3] == is_fixed) for is_fixed in (True, False))
    if not free:
        return by_elements(html)
    copied = fixed > free
    return _joined([(slot, wanted, text) for slot, wanted, text, is_fixed in blocks if not is_fixed or copied and wanted])


def _blobs(rows: DataFrame, make) -> DataFrame:
    """host and blob, made of the other columns of one row a host."""

    def run(batches):
        for batch in batches:
            made = [json.dumps(make(*values)).encode() for values in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["host", "blob"])

    return rows.mapInArrow(run, "host string, blob binary")


def _with_blobs(rows: DataFrame, known: DataFrame, how: str, broadcast_bytes: int) -> DataFrame:
    """The pages (row, host, ...) with the blob of their host."""
    if (known.agg(F.sum(F.length("blob"))).first()[0] or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(known), "host", how)
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("row", "host"), F.lit(SALTS))).join(spread, ["host", "salt"], how).drop("salt")


def candidates(pages: DataFrame, scratch: Scratch, *, min_share: float, min_pages: int, broadcast_hosts: int = 200_000) -> DataFrame:
    """host and blob of the candidate classes (``deduce``). pages: row, host, html."""
    # sums of many pages pass 64 bits only beyond 2^32 page occurrences of one token on a host
    sums = ("v1", "v2", "total", "pages", "place")
    totals = token_sums(pages).groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in ("parent", "event", "prior")))
    repeated = scratch.keep(totals.where(F.col("pages") > 1))
    hosts = repeated.where((F.col("token") == _ROOT.path) & (F.col("pages") >= min_pages)).select("host", F.col("pages").alias("host_pages"))
    if hosts.count() <= broadcast_hosts:
        joined = repeated.join(F.broadcast(hosts), "host")
    else:
        spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = repeated.withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"])
    columns = ("token", *sums, "parent", "event", "prior")
    valid = joined.where(F.col("pages") >= min_share * F.col("host_pages")).select("host", F.struct(*columns).alias("t"))
    return _blobs(valid.groupBy("host").agg(F.collect_list("t").alias("t")), deduce)


def templates(pages: DataFrame, scratch: Scratch, *, min_share: float = 0.5, min_pages: int = 3, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """host and blob of the template (``decide``), for hosts of ``min_pages`` pages or more. pages: row, host, html."""
    known = scratch.keep(candidates(pages, scratch, min_share=min_share, min_pages=min_pages))
    counted = slot_sums(_with_blobs(pages, known, "inner", broadcast_bytes)).groupBy("host", "what", "a", "b").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.bit_or("bits").alias("bits"))
    by_host = counted.groupBy("host").agg(F.collect_list(F.struct("what", "a", "b", "n", "x", "y", "bits")).alias("sums"))
    both = known.join(by_host, "host").select("host", "blob", "sums")
    return scratch.keep(_blobs(both, lambda blob, sums: decide(json.loads(blob), sums)))


def extract(
    pages: DataFrame,
    *,
    min_share: float = 0.5,
    min_pages: int = 3,
    broadcast_bytes: int = 64_000_000,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per page its main text and all slots with their text; a slot is named by the template token before it (-1: no template)."""
    host = split_url(F.col(url_col).cast("string"))[0]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("row", F.xxhash64("page_id", "url"))
    made = templates(rows, Scratch(pages.sparkSession, "html"), min_share=min_share, min_pages=min_pages, broadcast_bytes=broadcast_bytes)
    joined = _with_blobs(rows, made, "left", broadcast_bytes).select("page_id", "url", "html", "blob")

    def run(batches):
        known = Cached(Template)
        for batch in batches:
            out = [extract_page(html, None if blob is None else known[blob]) for html, blob in zip(texts(batch, "html"), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], _SLOTS)], names=["page_id", "url", "text", "slots"])

    return joined.mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``extract`` returns."""
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
