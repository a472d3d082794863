import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import packing
from tests.llm.conftest import clashing, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, limits=(1024, 256, 1024)):
    exact = Tokenizer.from_file(PATH)
    want = sorted((i is not None, i or 0, tuple(exact.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in docs)
    by_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_sequence[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        total = sum(r.length for r in s)
        assert total <= limits[0] and len(s) <= limits[1] and sum(r.loss_tokens for r in s) <= limits[2]
        assert total == limits[0] or total & (total - 1) == 0  # no padding at all
    # each id in exactly one piece, whatever rows share an identifier
    assert sum(r.length for r in rows) == sum(len(w[2]) for w in want)
    for known, i, ids in want:
        p = [r for r in pieces[i if known else None] if r.doc_tokens == len(ids)]
        for r in p:
            assert any(w[2][r.start : r.start + r.length] == tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for w in want)


def run(df, **k):
    return packing.pack(df, tokenizer_path=PATH, **k).withColumn("ids_crc32", F.crc32("ids")).collect()


def test_round_trip(spark):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.choice((1, 5, 40, 700, 2500)))) for i in range(150)]
    rows = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), pool=16)
    check(rows, docs)
    starts = defaultdict(list)
    for r in rows:
        starts[r.doc_id].append((r.start, r.length))
    for s in starts.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]


def test_limits(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randint(1, 60)), rng.choice((None, 0, 30, 10_000))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, p long")
    rows = run(df, max_tokens=128, max_segments=4, max_loss_tokens=50, prompt_col="p", pool=32)
    check(rows, [d[:2] for d in docs], (128, 4, 50))


def test_edges(spark, edges, no_docs):
    rows = run(clashing(edges, "start", "sequence_id", "ids"))
    check(rows, [(r.doc_id, r.text) for r in edges.collect()])
    assert run(no_docs) == []


def test_fast_encoder_is_exact():
    exact, fast = Tokenizer.from_file(PATH), packing.encoder(PATH)
    rng = random.Random(6)
    letters = "ab \n\t'sſéßñ œ“”–€\x00\x1c\x85\xa0  .,!1²½ÀĀəΩж漢😀\u200b\u2028"
    for text in ["", "<|endoftext|>", "a  b\n\n c 's't", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000))]:
        assert fast(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)
