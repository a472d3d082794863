import json
import math
import random
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import html_extract
from scriptorium.llm._shared import Scratch
from tests.llm.conftest import clashing, prose

SCHEMA = "page_id long, url string, html string"


def page(rng, host, body, notice="We use cookies to make this site better."):
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose(rng, 5).split())
    return (
        f'<!DOCTYPE html><html><head><title>{prose(rng, 3)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- x <p>no</p> -->'
        f'<div class="ad">{prose(rng, 6)}</div>{body}<div>{notice}</div><form><p>Name</p></form><div id="comments"><p>{prose(rng, 4)}</p></div><footer>&copy; {host}</footer></body></html>'
    )


def run(spark, rows, **k):
    found = html_extract.extract(spark.createDataFrame(rows, SCHEMA), **k)
    return {r.page_id: r.text for r in found.collect()}


def test_article(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for i in range(40):
        title, ps = prose(rng, 4), [prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
        body = f"<article><h1>{title}</h1><p><b>{ps[0]} &amp; &lt;x&gt;<br>" + "".join(f"<p>{p.replace(' ', '  <i>', 1).replace(' ', '</i>   ', 1) if ' ' in p else p}</p>" for p in ps[1:]) + "<div class='notice'>Read this</div></article>"
        rows.append((i, f"http://{'hot' if i % 3 else 'b'}.com/{i}", page(rng, "h", body)))
        want[i] = [title, f"{ps[0]} & <x>", *ps[1:]]
    got = run(spark, rows)
    assert {i: [" ".join(x.split()) for x in t.split("\n")] for i, t in got.items()} == {i: [" ".join(x.split()) for x in w] for i, w in want.items()}


def test_template_inside_article(spark):
    """Text that a host repeats inside article or main is template text; pages that are copies of each other stay whole."""
    rng = random.Random(17)
    rows, want = [], {}
    for i in range(12):
        p = prose(rng, 30)
        body = f"<main><div class='top'>Home Sport Weather</div><article><h1>Title {i}</h1><p>{p}</p><p class='more'>Read more</p></article></main>"
        rows.append((i, f"http://h.com/{i}", page(rng, "h", body)))
        want[i] = f"Title {i}\n{p}"
    copy = page(rng, "c", "<article><p>One story.</p><p>Its end.</p></article>")
    rows += [(20 + i, f"http://copies.com/{i}", copy) for i in range(4)]
    # two pages are too few for a template
    rows += [(30 + i, f"http://few.com/{i}", page(rng, "f", f"<article><p>Text {i}.</p><p>Read more</p></article>")) for i in range(2)]
    want |= {20 + i: "One story.\nIts end." for i in range(4)} | {30 + i: f"Text {i}.\nRead more" for i in range(2)}
    assert run(spark, rows) == want


def test_template_without_article(spark):
    """No semantic element: the container with most text is the article, repeated blocks are template."""
    rng = random.Random(15)
    rows, want = [], {}
    for i in range(30):
        ps = [prose(rng, 30) for _ in range(3)]
        body = f"<div id='x1'><p>{prose(rng, 2)}</p></div><div id='x2'>" + "".join(f"<p>{p}</p>" for p in ps) + "</div>"
        rows.append((i, f"http://h.com/{i}", page(rng, "h", body)))
        want[i] = "\n".join(ps)
    assert run(spark, rows) == want


def test_article_of_many_containers(spark):
    """Lists, quotes, tables and sections inside the main container belong to the article, and so does a text before them."""
    rng = random.Random(18)
    rows, want = [], {}
    forms = {
        "a": "<div id='content'><p>{0}</p><ul><li>{1}</li><li>{2}</li></ul><blockquote>{3}</blockquote><table><tr><td>{4}</td></tr></table></div>",
        "b": "<div id='content'><section class='one'><p>{0}</p></section><section class='two'><p>{1}</p><p>{2}</p></section><section><p>{3}</p></section><section><p>{4}</p></section></div>",
        "c": "<div id='head'><h1>T</h1></div><div id='text'><div class='in'>{0}</div><ul><li>{1} {1}</li></ul><div class='in'>{2}</div><div><p>{3}</p></div>{4}</div>",
        "d": "<div id='content'><p>{0}</p><div class='rest'><p>{1}</p>" + "<p>{2}</p><p>{3}</p><ol><li>{4}</li></ol>" + "</div></div>",
    }
    for host, form in forms.items():
        for i in range(10):
            ps = [prose(rng, 3 if host == "d" and k == 0 else 25) for k in range(5)]
            rows.append((len(rows), f"http://{host}.com/{i}", page(rng, host, form.format(*ps))))
            ps[1] = f"{ps[1]} {ps[1]}" if host == "c" else ps[1]
            want[rows[-1][0]] = "\n".join(ps)
    assert run(spark, rows) == want


class Plain(HTMLParser):
    """Events of well-formed pages of block elements: (event, path, text), by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.path, self.events = (), []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.path += ((tag, *(v for _, v in attrs)),)
        self.events.append((0, self.path, ""))

    def handle_endtag(self, tag):
        self.events.append((1, self.path, ""))
        self.path = self.path[:-1]

    def handle_data(self, data):
        if data.strip():
            self.events.append((2, self.path, " ".join(data.split())))


def brute_template(streams, min_share=0.5, sound=0.9):
    """Valid classes and their parents' slots by explicit occurrence vectors and instances; per page the classes in order."""
    places = [{} for _ in streams]
    for at, stream in zip(places, streams, strict=True):
        for i, t in enumerate(stream):
            at.setdefault(t, []).append(i)
    vectors = {t: tuple(len(at.get(t, ())) for at in places) for at in places for t in at}
    often = {t: v for t, v in vectors.items() if sum(map(bool, v)) >= max(2, min_share * len(streams))}
    mean = lambda t: sum(i + 1 for at in places for i in at.get(t, ())) / sum(vectors[t])
    whole = {}
    for t in sorted(often, key=mean):
        whole.setdefault(often[t], []).append(t)
    whole = [tuple(c) for c in whole.values()]
    up = lambda t: t[1] if t[0] == 2 else t[1][:-1]
    parts = {c: [tuple(t for t in c if up(t) == u) for u in dict.fromkeys(map(up, c))] for c in whole}
    parts = {c: x for c, x in parts.items() if len(x) > 1}

    def instances(c, at):
        """Places of each instance, or None if the class is not in order."""
        found = list(zip(*(at[t] for t in c))) if all(t in at for t in c) else []
        flat = [i for x in found for i in x]
        return found if flat == sorted(flat) and all(len(at.get(t, ())) == len(found) for t in c) else None

    def judge(c, candidates_of):
        held = [k for k, at in enumerate(places) if any(t in at for t in c)]
        ordered = [k for k in held if instances(c, places[k]) is not None]
        votes = Counter()
        for k in ordered:
            # the classes in order on this page, a whole one before its parts
            here = []
            for w in whole:
                if any(t in places[k] for t in w):
                    here += [w] if instances(w, places[k]) is not None else [x for x in parts.get(w, ()) if any(t in places[k] for t in x) and instances(x, places[k]) is not None]
            if c not in here:
                continue
            spans = sorted((x, d) for d in here for x in instances(d, places[k]))
            # where an instance meets a token of one that began before it and has not met such a token itself
            met = {}
            for x, _ in spans:
                met[x] = min((p for y, _ in spans if y[0] < x[0] for p in y if x[0] < p < x[-1] and p < met[y]), default=math.inf)
            for x in instances(c, places[k]):
                if met[x] < math.inf:
                    votes["overlap"] += 1
                    continue
                out = [(y, d) for y, d in spans if y[0] < x[0] < min(y[-1], met[y])]
                if not out:
                    votes["page"] += 1
                    continue
                y, d = max(out, key=lambda z: z[0][0])
                votes[d[max(i for i, place in enumerate(y) if place < x[0])]] += 1
        if not votes or len(ordered) < sound * len(held):
            return None
        slot, n = votes.most_common(1)[0]
        return slot if slot != "overlap" and n >= sound * sum(votes.values()) else None

    valid = {}
    for c in whole:
        if (slot := judge(c, whole)) is not None:
            valid[c] = slot
        else:
            valid |= {x: s for x in parts.get(c, ()) if (s := judge(x, whole)) is not None}
    return valid


def brute_slots(stream, valid):
    """Per text block that is no template token the token that opens its slot: of the innermost instance around it."""
    at = {}
    for i, t in enumerate(stream):
        at.setdefault(t, []).append(i)
    spans = []
    for c in valid:
        found = list(zip(*(at.get(t, ()) for t in c), strict=False))
        flat = [i for x in found for i in x]
        if flat == sorted(flat) and all(len(at.get(t, ())) == len(found) for t in c):
            spans += [(x, c) for x in found]
    known = {t for c in valid for t in c}
    out = []
    for i, t in enumerate(stream):
        if t[0] == 2 and t not in known:
            inner = [(x, c) for x, c in spans if x[0] < i < x[-1]]
            x, c = max(inner, key=lambda z: z[0][0]) if inner else ((), ("page",))
            out.append(c[max((k for k, place in enumerate(x) if place < i), default=0)])
    return out


def random_site(rng, n):
    """Pages of one random template: elements that are always, often or repeatedly there, and fixed labels."""

    def grow(depth):
        kinds = [rng.choice(("one", "some", "often", "text", "label")) for _ in range(rng.randint(1, 4))]
        return [(k, rng.choice(("div", "section", "p" if depth > 1 else "div")), f"c{rng.randrange(99)}", prose(rng, 2), [] if depth > 2 else grow(depth + 1)) for k in kinds]

    def write(tree, rng):
        out = ""
        for kind, tag, name, label, inner in tree:
            if kind == "text":
                out += f"<div>{prose(rng, rng.randint(1, 9))}</div>"
            elif kind == "label":
                out += f"<div>{label}</div>"
            else:
                tag = "div" if inner and tag == "p" else tag
                for _ in range({"one": 1, "some": rng.randint(0, 4), "often": rng.random() < 0.8}[kind]):
                    out += f'<{tag} class="{name}">{write(inner, rng) if inner else prose(rng, 4)}</{tag}>'
        return out

    tree = grow(0) + [("one", "div", "body", "", grow(1))]
    return [f"<html><body>{write(tree, rng)}</body></html>" for _ in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_template_against_brute_force(spark, seed):
    """Classes, their nesting and the slots of a host's pages."""
    rng = random.Random(seed)
    pages = random_site(rng, rng.choice((4, 9, 25)))
    plain = [Plain(h).events for h in pages]
    ours = [[html_extract.token(e) for e in html_extract.events(h)] for h in pages]
    assert [len(s) for s in plain] == [len(s) for s in ours]
    name = {b: a for x, y in zip(plain, ours, strict=True) for a, b in zip(x, y, strict=True)}
    assert len(name) == len(set(name.values()))  # one token of theirs for one of ours
    name[html_extract._ROOT.path] = "page"
    df = spark.createDataFrame([(i, "h", h) for i, h in enumerate(pages)], "row long, host string, html string")
    made = json.loads(bytes(html_extract.templates(df, Scratch(spark, "test")).first().blob))
    got = {tuple(name[t] for t in c): name[p] for c, p in zip(made["classes"], made["parents"], strict=True)}
    assert got == brute_template(plain)
    template = html_extract.Template(made)
    for h, events in zip(pages, plain, strict=True):
        slots = html_extract.extract_page(h, template)[1]
        if any(s["slot"] == -1 for s in slots):
            continue  # a page without a text in the article's slots
        blocks = [name[s["slot"]] for s in slots for _ in s["text"].split("\n")]
        known = {t for c in got for t in c}
        if sum(len(s["text"].split("\n")) for s in slots) == sum(e[0] == 2 and e not in known for e in events):
            assert blocks == brute_slots(events, got)


def test_vectors(spark):
    """Sums are equal exactly for tokens that occur equally often on every page."""
    rng = random.Random(3)
    pages = random_site(rng, 20)
    df = spark.createDataFrame([(i, "h", h) for i, h in enumerate(pages)], "row long, host string, html string")
    sums = {r.token: (r.v1, r.v2) for r in html_extract.token_sums(df).groupBy("token").agg(F.sum("v1").alias("v1"), F.sum("v2").alias("v2")).collect()}
    vectors = {}
    for k, h in enumerate(pages):
        for e in html_extract.events(h):
            vectors.setdefault(html_extract.token(e), [0] * 20)[k] += 1
    pairs = {(sums[t], tuple(v)) for t, v in vectors.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_slots_decide(spark):
    """Nothing but the slots tells the article from the rest: no semantic element, no telling name; wrapped by one, the same."""
    rng = random.Random(23)
    for form in ("<div><div id='a'>{menu}</div><div id='b'>{ad}</div><div id='c'><h1>{title}</h1>{text}</div><div id='d'>{foot}</div></div>", "<article><div id='a'>{menu}</div><div id='c'><h1>{title}</h1>{text}</div></article>"):
        rows, want, alone = [], {}, {}
        for i in range(12):
            ps = [prose(rng, 40) for _ in range(rng.randint(1, 5))]
            title = prose(rng, 4)
            menu = "".join(f"<p><a href='/'>{w}</a></p>" for w in prose(rng, 5).split())
            html = form.format(menu=menu, ad=prose(rng, 5), title=title, text="".join(f"<p>{p}</p>" for p in ps), foot=prose(rng, 6))
            rows.append((i, "http://h.com/", html))
            want[i] = "\n".join([title, *ps])
            alone[i] = html_extract.by_elements(html)[0]
        assert run(spark, rows) == want
        assert all(alone[i] != want[i] for i in want)  # without the template the menu stays
        assert run(spark, rows, min_pages=100) == alone


def test_names_are_a_prior(spark):
    """A name that speaks against an element is overruled by the host's text, and words like it are not meant."""
    rng = random.Random(24)
    rows, want = [], {}
    for i in range(8):
        ps = [prose(rng, 40) for _ in range(3)]
        rows.append((i, "http://h.com/", f"<div class='sidebar'>{prose(rng, 3)}</div><div class='widget'><p class='b'>{ps[0]}</p><p>{ps[1]}</p><p>{ps[2]}</p></div>"))
        want[i] = "\n".join(ps)
    rows.append((100, "http://one.com/", "<article><div class='navy'><p class='share'>Blue.</p></div><div class='nav'>Home</div></article>"))
    assert run(spark, rows) == want | {100: "Blue."}


def test_near_copies_keep_their_text(spark):
    """Pages that share most of their article are copies, not a template."""
    rng = random.Random(25)
    ps = [prose(rng, 40) for _ in range(5)]
    rows = [(i, "http://h.com/", f"<article><p>{prose(rng, 3)}</p>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>") for i in range(4)]
    got = run(spark, rows)
    assert all(t.split("\n")[1:] == ps and len(t.split("\n")) == 6 for t in got.values())


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "\'', "<div>", "<p", "</div>", "<b></i>", "<!", "<ul><li>", "</b><i>", "<script", "&"])
def test_long_broken_pages(piece):
    """Time in proportion to the length: a megabyte of unclosed tags or quotes."""
    import time

    html = "<b><article>" + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    for _ in html_extract.events(html):
        pass
    assert time.perf_counter() - began < 8


def test_small_batches_and_shuffle_join(spark):
    rng = random.Random(16)
    rows = [(i, f"http://h{i % 2}.com/", page(rng, "h", f"<article><p>{prose(rng, 9)}</p></article>")) for i in range(20)]
    assert run(spark, rows) == run(spark, rows, broadcast_bytes=0)


def test_edges(spark):
    broken = "<article><p>a < b & c <a href='x>y</a> <p>z</article"
    rows = [(None, "http://h/", "<p>x</p>"), (1, None, "<p>one</p><p>two</p>"), (2, "http://h/", None), (3, "http://h/", ""), (4, "http://h/", "plain  text"), (5, "http://h/", "<p>" + "w " * 200_000), (6, "http://h/", broken), (6, "http://h/", broken), (7, "http://h/", "<" * 5000), (8, "http://h/", "<!-- never closed"), (9, "http://h/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 host", "2 root", "3 slots", "4 text", "5 row")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.digest(html_extract.extract(df)).collect()]
    texts = {p: t for p, t, _ in got}
    assert len(got) == 11 and texts[1] == "one\ntwo" and texts[2] == texts[3] == texts[8] == "" and texts[4] == "plain text" and texts[9] == "deep"
    assert len(texts[5]) == 400_000 - 1 and all(len(t) == n for _, t, n in got) and "z" in texts[6]
    assert html_extract.extract(df.where("false")).collect() == []
    assert clashing(df, "x").columns[-1] == "x"
