"""Text analysis as native column expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import reduce
from itertools import accumulate, groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords, words that the stemmer leaves alone, irregular plurals, and words that make poor phrase edges.
STOPWORDS = tuple(
    """
    a about after all also an and any are as at be been between both but by can could do does each for from had has have
    how if in into is it its may more most no not of on one only or other our out over so some such than that the their
    them then there these they this those through to under up use used using very was we were what when where which while
    who will with would
    """.split()
)
UNCHANGED = ("bias", "alias", "lens", "canvas", "atlas", "chaos", "always", "perhaps", "whereas")
IRREGULAR = {
    "biases": "bias",
    "aliases": "alias",
    "lenses": "lens",
    "analyses": "analysis",
    "hypotheses": "hypothesis",
    "indices": "index",
    "matrices": "matrix",
    "vertices": "vertex",
    "movies": "movie",
    "cookies": "cookie",
}
WEAK_EDGES = ("via", "based", "toward", "towards", "new", "novel", "without", "beyond", "across")
TITLE_BOOST = 3
SNIPPET_WORDS = 45

_WORD = "[a-z0-9]+"
_PIECE = "[A-Za-z0-9]+|[^A-Za-z0-9]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, computed once: inside a lambda an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """All lower-case words, in order; only ASCII letters and digits make words."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def is_content_word(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(*STOPWORDS)


def content_words(text: Column) -> Column:
    return F.filter(words(text), is_content_word)


def stem(word: Column) -> Column:
    """Plural to singular by the first rule that matches."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    ends = lambda *suffixes: reduce(lambda a, b: a | b, (F.endswith(word, F.lit(s)) for s in suffixes))
    # every rule is for words that end in s, so that most words need one comparison
    out = F.when((F.length(word) <= 3) | ~ends("s") | word.isin(*UNCHANGED), word)
    for plural, singular in IRREGULAR.items():
        out = out.when(word == plural, F.lit(singular))
    return (
        out.when(ends("ies") & (F.length(word) > 4), F.concat(cut(3), F.lit("y")))
        .when(ends("sses", "xes", "ches", "shes", "zes"), cut(2))
        .when(ends("s") & ~ends("ss", "us", "is"), cut(1))
        .otherwise(word)
    )


def plain_words(text: str) -> list[str]:
    """``words`` for one short string on the driver."""
    return re.findall(_WORD, text.lower())


def plain_content_word(word: str) -> bool:
    return len(word) > 1 and word not in STOPWORDS


def plain_stem(word: str) -> str:
    """``stem`` for one word on the driver (a test holds both to the same results)."""
    if len(word) <= 3 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    rules = ((len(word) > 4 and word.endswith("ies"), 3, "y"), (word.endswith(("sses", "xes", "ches", "shes", "zes")), 2, ""), (word[-1] == "s" and word[-2:] not in ("ss", "us", "is"), 1, ""))
    cut, end = next(((n, e) for holds, n, e in rules if holds), (0, ""))
    return word[: len(word) - cut] + end


def terms(text: Column) -> Column:
    """Stems of the content words, order and repeats kept."""
    return F.transform(content_words(text), stem)


def clean(text: Column) -> Column:
    """White space, Unicode's included, to single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def published_month(identifier: Column) -> Column:
    """YYYY-MM from an identifier of either style, else 0000-00."""
    new, old = r"^(\d{2})(\d{2})\.\d{4,5}", r"^[a-z\-]+(?:\.[A-Z]{2})?/(\d{2})(\d{2})\d{3}"
    part = lambda i: F.when(F.regexp_like(identifier, F.lit(new)), F.regexp_extract(identifier, new, i)).otherwise(F.regexp_extract(identifier, old, i))
    year = part(1)
    return F.when(year == "", F.lit("0000-00")).otherwise(F.concat(F.when(year.cast("int") >= 91, F.lit("19")).otherwise(F.lit("20")), year, F.lit("-"), part(2)))


def _phrases(title_words: Column) -> Column:
    edge = lambda w: is_content_word(w) & ~w.isin(*WEAK_EDGES)

    def of(edges: Column, n: int) -> Column:
        # edges are longer than one letter, so only words between them remain to be looked at; beyond the end there is no edge
        between = lambda i: reduce(lambda a, b: a & b, (F.length(F.get(title_words, i + k)) > 1 for k in range(1, n - 1)), F.lit(True))
        good = F.filter(F.sequence(F.lit(0), F.greatest(F.size(title_words) - 1, F.lit(0))), lambda i: F.get(edges, i) & F.get(edges, i + (n - 1)) & between(i))
        return F.transform(good, lambda i: F.array_join(F.slice(title_words, i + 1, n), " "))

    return let(F.transform(title_words, edge), lambda edges: F.concat(of(edges, 2), of(edges, 3)))


def title_phrases(title_words: Column) -> Column:
    """Two-word, then three-word phrases that start and end with a content word that is no weak edge."""
    return let(title_words, _phrases)


def edit_distance(a: Column, b: Column) -> Column:
    """Inserts, deletes, replacements and swaps of neighbours, with no edit inside a swapped pair."""

    def row(acc: Column, i: Column) -> Column:
        before, last = acc["before"], acc["last"]
        letter, previous = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(cur: Column, j: Column) -> Column:
            other = F.substring(b, j, F.lit(1))
            cost = F.when(letter == other, 0).otherwise(1)
            swap = F.when((i > 1) & (j > 1) & (letter == F.substring(b, j - 1, F.lit(1))) & (previous == other), F.get(before, j - 2) + 1)
            return F.concat(cur, F.array(F.least(F.get(last, j) + 1, F.get(cur, j - 1) + 1, F.get(last, j - 1) + cost, swap)))

        return F.struct(last.alias("before"), F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell).alias("last"))

    first = F.sequence(F.lit(0), F.length(b))
    table = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(first.alias("before"), first.alias("last")), row, lambda acc: F.element_at(acc["last"], -1))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(table)


def surface_forms(query_terms: list[str]) -> list[str]:
    """All words that the stemmer takes to one of the terms, so that a text's words need no stemming to be compared."""
    wanted = set(query_terms)
    made = {w for t in wanted for w in (t, t + "s", t + "es", t[:-1] + "ies")} | {w for w, t in IRREGULAR.items() if t in wanted}
    return sorted(w for w in made if w and plain_stem(w) in wanted)


def _hit(piece: Column, forms: list[str]) -> Column:
    # only ASCII letters are folded, so that nothing but a word can equal a form
    return F.translate(piece, string.ascii_uppercase, string.ascii_lowercase).isin(*forms) if forms else F.lit(False)


def _hits(pieces: Column, forms: list[str]) -> Column:
    """0-based places of the pieces that match."""
    return F.filter(F.transform(pieces, lambda p, i: F.when(_hit(p, forms), i)), lambda i: i.isNotNull())


def _marked(pieces: Column, at: Column) -> Column:
    """array<struct<text, hit>>: the pieces at the places ``at`` on their own, all between two of them as one."""
    piece = lambda text, hit: F.struct(text.alias("text"), F.lit(hit).alias("hit"))
    between = lambda lo, hi: F.array_join(F.slice(pieces, lo + 2, F.greatest(hi - lo - 1, F.lit(0))), "")
    inner = F.flatten(F.transform(at, lambda i, k: F.array(piece(between(F.coalesce(F.get(at, k - 1), F.lit(-1)), i), False), piece(F.get(pieces, i), True))))
    tail = piece(between(F.coalesce(F.get(at, F.size(at) - 1), F.lit(-1)), F.size(pieces)), False)
    return F.filter(F.concat(inner, F.array(tail)), lambda p: F.length(p["text"]) > 0)


def _split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def highlight(text: Column, query_terms: list[str]) -> Column:
    """The whole text in pieces, those that match the query marked."""
    forms = surface_forms(query_terms)
    return let(_split(text), lambda pieces: let(_hits(pieces, forms), lambda at: _marked(pieces, at)))


def window_start(hits: Column, n: Column, size: int) -> Column:
    """0-based start of the first window of ``size`` among ``n`` words with most hits; 0 when there are no more words than that.

    hits: their 0-based places, ascending. The first of the best windows begins the text or ends with a hit, so one window
    for each hit is counted, over at most ``size`` hits before it.
    """

    def ending(h: Column, p: Column, j: Column) -> Column:
        start = F.greatest(p - (size - 1), F.lit(0))
        before = F.slice(h, F.greatest(j + 2 - size, F.lit(1)), F.least(j + 1, F.lit(size)))
        return F.struct(F.size(F.filter(before, lambda q: q >= start)).alias("count"), (-start).alias("start"))

    best = lambda h: -F.array_max(F.transform(h, lambda p, j: ending(h, p, j)))["start"]
    return F.when(n <= size, F.lit(0)).otherwise(F.coalesce(let(hits, best), F.lit(0)))


def snippet(text: Column, query_terms: list[str], max_words: int = SNIPPET_WORDS) -> Column:
    """Struct of the window's start (in words), its hits, and the pieces with dots where text is left out."""
    forms = surface_forms(query_terms)
    dots = lambda mark, when: F.when(when, F.array(F.struct(F.lit(mark).alias("text"), F.lit(False).alias("hit")))).otherwise(F.array().cast("array<struct<text:string,hit:boolean>>"))

    def cut(pieces: Column, n: Column, hits: Column, first: Column) -> Column:
        # words and what is between them alternate
        lead = F.when(F.regexp_like(F.get(pieces, F.lit(0)), F.lit("^[A-Za-z0-9]")), 1).otherwise(2)
        last = F.least(first + max_words, n)
        begin = F.when(first > 0, 2 * first + lead).otherwise(F.lit(1))
        end = F.when(last < n, 2 * (last - 1) + lead).otherwise(F.size(pieces))
        shown = let(F.slice(pieces, begin, F.greatest(end - begin + 1, F.lit(0))), lambda p: let(_hits(p, forms), lambda at: _marked(p, at)))
        return F.struct(
            first.alias("start"),
            F.size(F.filter(hits, lambda p: (p >= first) & (p < first + max_words))).alias("hits"),
            F.concat(dots("... ", begin > 1), shown, dots(" ...", end < F.size(pieces))).alias("pieces"),
        )

    def found(pieces: Column, w: Column) -> Column:
        return let(_hits(w, forms), lambda hits: let(window_start(hits, F.size(w), max_words), lambda first: cut(pieces, F.size(w), hits, first)))

    return let(_split(text), lambda pieces: let(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: found(pieces, w)))


def plain_highlight(text: str, query_terms: list[str], max_words: int | None = None) -> list[dict]:
    """``highlight``, or ``snippet`` with ``max_words``, of one text on the driver (a test holds both to the same results)."""
    forms = set(surface_forms(query_terms))
    pieces = re.findall(_PIECE, text)
    places = [i for i, p in enumerate(pieces) if p[0].isascii() and p[0].isalnum()]
    begin, end = 0, len(pieces)
    if max_words is not None and len(places) > max_words:
        upto = [0, *accumulate(pieces[i].lower() in forms for i in places)]
        first = max(range(len(places) - max_words + 1), key=lambda s: (upto[s + max_words] - upto[s], -s))
        begin = places[first] if first else 0
        end = places[first + max_words - 1] + 1 if first + max_words < len(places) else len(pieces)
    out = [{"text": "... ", "hit": False}] if begin else []
    for hit, run in groupby(range(begin, end), key=lambda i: i if pieces[i].isascii() and pieces[i].lower() in forms else -1):
        out.append({"text": "".join(pieces[i] for i in run), "hit": hit >= 0})
    return [*out, {"text": " ...", "hit": False}] if end < len(pieces) else out
