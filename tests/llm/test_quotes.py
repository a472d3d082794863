import random
import re

from scriptorium.llm import quotes
from tests.llm.conftest import prose

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_words(text):
    """Normalised: runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    return tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text))


def plain_parse(text):
    """Own passages and quoted ones (level, words), read character by character."""
    body, runs, last = [], [], 0
    for line in (text or "").split("\n"):
        level = at = 0
        for i, c in enumerate(line):
            if c == ">":
                level, at = level + 1, i + 1
            elif c not in " \t":
                break
        if not level:
            body.append(line)
        elif level == last:
            runs[-1][1].append(line[at:])
        else:
            runs.append((level, [line[at:]]))
        last = level
    quoted = {(level, plain_words(x)) for level, lines in runs for x in (*lines, " ".join(lines))}
    while body and not body[0]:
        body.pop(0)
    while body and not body[-1]:
        body.pop()
    blocks, now = [], []
    for line in [*body, ""]:
        if line.strip():
            now.append(line)
        else:
            blocks.append(" ".join(now))
            now = []
    own = {plain_words(x) for x in (*body, *blocks, " ".join(body))}
    return {o for o in own if o}, {(level, w) for level, w in quoted if w}


def brute(rows):
    """Reply links read off the messages one by one."""
    own = {}
    for r in sorted(rows):
        for words in plain_parse(r[3])[0]:
            own.setdefault((r[0], words), r[1])
    out = {}
    for r in rows:
        votes = {}
        for level, words in plain_parse(r[3])[1]:
            s = own.get((r[0], words))
            if s is not None and s < r[1]:
                votes[level, s] = votes.get((level, s), 0) + len(words)
        out[r[:2]] = max(((-k[0], v, k[1]) for k, v in votes.items()), default=(0, 0, None))[2]
    return out


def test_links(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(8):
            text = prose(rng, 6) + "\n" + prose(rng, 5) + "."
            if said and rng.random() < 0.7:
                source = rng.choice(said)
                lines = source.split("\n")
                quoted = lines[: rng.randint(1, len(lines))]
                kind = rng.randrange(5)
                if kind == 0:  # part of a line, which has no source of its own
                    quoted = [" ".join(quoted[0].split()[:-1])]
                if kind == 1:  # wrapped anew
                    words = " ".join(quoted).split()
                    quoted = [" ".join(words[:4]), " ".join(words[4:])]
                mark = ("> ", ">", " > ", ">> ")[rng.randrange(4)]
                text = "\n".join(mark + x.upper() if kind == 2 else mark + x for x in quoted) + "\n" + text
                if kind == 3:  # a line that names who is quoted
                    text = f"On Monday {prose(rng, 1)} wrote:\n" + text
                if kind == 4:
                    text = text + "\n\n" + "> " + rng.choice(said).split("\n")[-1]
            said.append(text)
            rows.append((conv, turn, "user", text))
    got = quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == want
    for r in got:
        root, depth = r.turn, 0
        while want[r.conv_id, root] is not None:
            root, depth = want[r.conv_id, root], depth + 1
        assert (r.root_turn, r.depth) == (root, depth)
        assert not any(line.lstrip().startswith(">") for line in r.text.split("\n"))
    assert [(r.conv_id, r.root_turn, r.turn) for r in got] == sorted((r.conv_id, r.root_turn, r.turn) for r in got)


def test_nested_and_rewrapped(spark):
    rows = [
        (1, 0, "a", "One two three four\nfive six."),
        (1, 1, "b", "> One two three\n> four five six.\n\nI agree."),
        (1, 2, "a", ">> One two three four\n>> five six.\n> I agree.\nGood."),
        (1, 3, "b", "> nobody said this\nwell"),
    ]
    got = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[t].parent_turn for t in range(4)] == [None, 0, 1, None]
    assert [got[t].root_turn for t in range(4)] == [0, 0, 0, 3] and got[2].depth == 2
    assert got[1].text == "I agree." and got[3].text == "well"


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "a", ""), (None, 0, "a", "> x\ny"), (1, None, "a", "> x"), (2, 0, "a", "x " * 50_000), (2, 1, "a", "> " + "x " * 50_000), (2, 1, "a", "> " + "x " * 50_000), (3, 0, "a", "> > deep")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'t' body", "'t' own", "1 depth", "2 root_turn")
    got = quotes.reply_ordered(df).collect()
    assert len(got) == 8 and [r.parent_turn for r in got if r.conv_id == 2] == [None, 0, 0]
    assert quotes.reply_ordered(spark.createDataFrame([], SCHEMA)).collect() == []
