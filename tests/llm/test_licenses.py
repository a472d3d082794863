import random
import re

from scriptorium.llm import licenses
from tests.llm.conftest import clashing, prose


def dice(a, b):
    a, b = licenses.bigrams(a), licenses.bigrams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_size_bounds_prune_nothing():
    """Against a comparison with every template."""
    rng = random.Random(11)
    index = licenses.Index(licenses.TEMPLATES, 0.8)
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            words = licenses.normalise(t).replace(b"\x01", b" ").split()
            for _ in range(20):
                w = [x for x in words if rng.random() > rng.choice((0, 0.03, 0.1))] + [b"more"] * rng.randint(0, 3)
                p = b" ".join(w)
                best = max((dice(p, licenses.normalise(x)) for xs in licenses.TEMPLATES.values() for x in xs), default=0)
                found = index.best(p)
                assert (found[0] if found else None) == (best if best >= 0.8 else None)


def plain_bigrams(words):
    return {(a, b) for a, b in zip(words, words[1:], strict=False)}


def brute_windows(words, templates, t=0.8):
    """All windows that begin at a bigram of a template, the best for each begin, of overlapping ones the best."""
    found = []
    for name, ts in templates.items():
        for text in ts:
            w = re.findall(r"[0-9a-z]+", text.lower())
            s = plain_bigrams(w)
            least = len(w) if len(w) < licenses.NOTICE else int(len(w) * t / (2 - t))
            most = int(len(w) * (2 - t) / t)
            for i in range(len(words) - 1):
                if (words[i], words[i + 1]) not in s:
                    continue
                best = None
                for end in range(max(i + 2, i + least), min(len(words), i + most) + 1):
                    g = plain_bigrams(words[i:end])
                    score = 2 * len(g & s) / (len(g) + len(s))
                    if score >= t and (best is None or score > best[0]):
                        best = (score, len(s), name, i, end)
                if best:
                    found.append(best)
    kept = []
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        if all(f[4] <= k[3] or k[4] <= f[3] for k in kept):
            kept.append(f)
    return kept


def test_windows_against_brute_force():
    rng = random.Random(14)
    chosen = {k: tuple(t for t in ts if len(t.split()) < 60) for k, ts in licenses.TEMPLATES.items()}
    chosen = {k: ts for k, ts in chosen.items() if ts}
    index = licenses.Index(chosen, 0.8)
    some = 0
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += prose(rng, rng.randint(0, 12)).split()
            text = rng.choice(rng.choice(list(chosen.values())))
            words += [w for w in re.findall(r"[0-9a-z]+", text.lower()) if rng.random() > rng.choice((0, 0.02, 0.1))]
        want = brute_windows(words, chosen)
        assert [(f[0], f[1], f[2], f[3], f[4]) for f in index.windows([w.encode() for w in words])] == want
        some += len(want)
    assert some > 60


def test_scan(spark):
    rng = random.Random(12)
    mit = licenses.TEMPLATES["MIT"][0]
    rows = [
        (1, prose(rng, 80) + "\nReleased under the MIT License.\n" + prose(rng, 50)),
        (2, mit),
        (3, prose(rng, 100)),
        (4, "Intro words here.\n\n" + mit.replace(". ", ".\n").replace(", ", ",\n") + "\n\nEnd of it."),
        (5, prose(rng, 10) + ". This work is licensed under the GNU General Public License, version 3. " + prose(rng, 10)),
        (6, "Licensed under CC BY-NC 4.0."),
        (7, prose(rng, 30) + "\n\n" + licenses.TEMPLATES["BSD-2-Clause"][0] + "\n\n" + prose(rng, 9)),
        (8, prose(rng, 30) + "\n\n" + licenses.TEMPLATES["BSD-3-Clause"][0] + "\n\n" + prose(rng, 9)),
    ]
    got = {r.doc_id: r.licenses for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "", 4: "MIT", 5: "GPL-3.0", 6: "CC-BY-NC-4.0", 7: "BSD-2-Clause", 8: "BSD-3-Clause"}


def test_inside_longer_texts():
    """Licences over several blocks, inside one long line, or with a sentence over two lines."""
    rng = random.Random(13)
    index = licenses.Index(licenses.TEMPLATES, 0.8)
    names = lambda text: {m["license"] for m in index.scan(text)}
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    parts = mit.replace(": The above", ":\n\nThe above").replace(". THE SOFTWARE", ".\n\nTHE SOFTWARE")
    assert parts.count("\n\n") == 2
    before, after = prose(rng, 200), prose(rng, 200)
    assert names(f"{before}\n\n{parts}\n\n{after}") == {"MIT"}
    assert names(f"{before} {mit} {after}") == {"MIT"}
    assert names(f"{before}\nIt is good. This work is licensed under the\nGNU General Public License, version 3. {after}\n") == {"GPL-3.0"}
    for gap in ("\n\n", "\n#\n"):
        notice = gpl.replace(". This program is distributed", "." + gap + "This program is distributed")
        assert gap in notice and names(f"{before}\n\n{notice}\n\n{after}") == {"GPL-3.0"}
    assert names(f"{before}\n\n{gpl.split(' This program is dist')[0]}\n\n{after}") == {"GPL-3.0"}
    # a window never leaves out what tells a notice from another, and two licences are two
    assert names(f"{before} Licensed under the Apache License, Version 1.1 {after}") == set()
    assert names(f"{before} Licensed under the Apache License, Version 2.0 {after} {mit} {before}") == {"Apache-2.0", "MIT"}
    found = index.scan(f"{before}\n{after}\n\n{parts}\n\n{after}")
    assert [(m["line"], m["license"], m["dice"]) for m in found] == [(3, "MIT", 1.0)]


def test_edges(spark, edges, no_docs):
    got = licenses.digest(licenses.scan(clashing(edges, "matches", "license"))).collect()
    assert len(got) == 12 and all(r.n_matches == 0 and r.best_license is None for r in got)
    assert licenses.scan(no_docs).collect() == []
