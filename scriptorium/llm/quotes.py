"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` at its start. A quoted passage is a run of consecutive lines of one level above
0; what is left at level 0 is the message's own text. Passages are normalised (markers off, lower case, everything but
letters and digits a space) and hashed, each line and the run as a whole; own texts are hashed by line, by block between
blank lines and as a whole, so re-wrapped quotes still meet their source. Hashes join to the earliest message of the
conversation that holds them as its own text, which must come before the quoting one. A message replies to the source of its
outermost quotes, the one with most quoted words if they disagree. Following replies upwards gives the root; a conversation in
reply order is sorted by root, then turn, so a reply stands behind the thread that it quotes, without the quotes.

Scale: sources are reduced to the earliest turn per conversation and hash map-side before the join, so a line that all
messages share is one row; no conversation is gathered in a task, and reply order is a range partitioning. Roots are found by
pointer doubling over the links alone.

Defined results: null and empty texts have no quotes and an empty own text; messages with a null conversation or turn link to
nothing; repeated rows give repeated rows; a quote without a source leaves the message a root; of sources with as many quoted
words the latest is the parent, and of own passages that several messages share the earliest message is the source; very
long texts are read whole; an empty table gives no row; only the conversation, turn, role and text are read, so no column
name clashes.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER_BYTES, Scratch, texts

_MARK = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER_BYTES)

PARSED = "conv_id long, turn long, role string, body string, quote_depth int, quotes array<struct<level:int,hash:long,words:int>>, own array<long>"
_QUOTES = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))


def _unit(text: str) -> tuple[int, int] | None:
    """Hash and number of words of a normalised passage."""
    words = text.encode("utf-8", "surrogatepass").translate(_KEEP).split()
    if not words:
        return None
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return (h - (1 << 64) if h >> 63 else h), len(words)


def parse(text: str | None) -> tuple[str, int, list[dict], list[int]]:
    """Own text, deepest level, hashes of quoted passages with level and words, hashes of own passages."""
    body: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            body.append(line)
        elif level == last:
            runs[-1][1].append(line[m.end() :])
        else:
            runs.append((level, [line[m.end() :]]))
        last = level
    quotes = []
    for level, lines in runs:
        units = {_unit(x) for x in (*lines, " ".join(lines))} - {None}
        quotes += [{"level": level, "hash": h, "words": n} for h, n in sorted(units)]
    own = "\n".join(body).strip("\n")
    blocks = re.split(r"\n\s*\n", own)
    hashes = sorted({u[0] for x in (*own.split("\n"), *blocks, own) if (u := _unit(x))})
    return own, max((n for n, _ in runs), default=0), quotes, hashes


def parsed(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = [parse(t) for t in texts(batch)]
            body, depth, quotes, own = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(body, pa.string()), pa.array(depth, pa.int32()), pa.array(quotes, _QUOTES), pa.array(own, pa.list_(pa.int64()))], names=["conv_id", "turn", "role", "body", "quote_depth", "quotes", "own"])

    return rows.mapInArrow(run, PARSED)


def link(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, parent_turn of parsed messages that quote an earlier one."""
    sources = messages.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = messages.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.words").distinct()
    met = scratch.keep(quoted).join(sources, ["conv_id", "hash"]).where("source < turn")
    by_source = met.groupBy("conv_id", "turn", "level", "source").agg(F.sum("words").alias("words"))
    return by_source.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "words", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("parent_turn"))


def reply_ordered(messages: DataFrame, **columns) -> DataFrame:
    """All messages: parent_turn (or null), root_turn, depth below the root, number of quoted passages, and the own text.

    Rows are range-partitioned and sorted by conversation, root and turn.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = scratch.keep(parsed(messages, **columns))
    links = scratch.keep(link(rows, scratch).withColumns({"root_turn": F.col("parent_turn"), "depth": F.lit(1)}))
    while True:
        above = links.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        joined = links.join(above, ["conv_id", "root_turn"], "left")
        if joined.where("higher is not null").isEmpty():
            break
        links = scratch.keep(joined.select("conv_id", "turn", "parent_turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    out = rows.join(links, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.size("quotes").cast("long").alias("n_quotes"), F.col("body").alias("text"))
    keys = ("conv_id", "root_turn", "turn")
    return out.repartitionByRange(*keys).sortWithinPartitions(*keys)

