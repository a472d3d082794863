"""Packing: vector bin packing of tokenised examples into training sequences.

Every document is tokenised whole and closed by an end id. A piece has three demands: tokens, segments (one) and
loss-bearing tokens; a sequence has a limit on each. Pieces that fill a sequence alone are placed at once. The rest is
packed by the dot-product heuristic: the open sequence takes, among the pieces that fit in all three dimensions, the one
whose demand has the largest weighted dot product with what is left of the limits, the weights being the mean demand of
the waiting pieces. When none fits, the piece with the largest product is cut to fill the sequence. A sequence that
cannot be filled (a limit other than tokens is reached, or nothing waits any more) is split into lengths that are powers
of two, which need no padding.

Scale: one pass over the documents without a shuffle; a task keeps ``pool`` waiting pieces of under one sequence each.
The sequences of a task are numbered from its partition number, so they are unique over the whole table.

Defined results: a null text is empty (its sequence holds the end id alone); repeated rows are packed each on their own;
a very long text is cut over as many sequences as it takes; of pieces with equal products the one that came first is taken;
an empty table gives no row; only the identifier, text and prompt length are read, so no column name clashes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
#: Characters whose classes are the same in all versions of the word pattern; other texts take the slower tokeniser.
_COMMON = re.compile("[^\x00-ɏ‐-‧‰-›€]")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level vocabulary in ``path``.

    Where every character is in the common ranges and no special token occurs, the same vocabulary and word pattern run
    in the faster library; the ids are equal (a test compares them).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    simple = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
    exact = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not simple:
        return exact
    # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ...
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # Fixed value: the pattern of byte-level vocabularies
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if any(s in text for s in special) or not text.isascii() and _COMMON.search(text):
            return exact(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    return encode


class Piece:
    """Ids ``start`` to ``start + len(ids)`` of a document; those from ``loss_from`` of the document on bear loss."""

    __slots__ = ("doc", "start", "ids", "total", "loss_from")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int, loss_from: int):
        self.doc, self.start, self.ids, self.total, self.loss_from = doc, start, ids, total, loss_from

    def owned(self) -> Piece:
        """With ids of its own, so that a short tail that waits does not keep a long document."""
        if self.ids.base is not None:
            self.ids = self.ids.copy()
        return self

    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total, self.loss_from), Piece(self.doc, self.start + n, self.ids[n:], self.total, self.loss_from)

    def most(self, tokens: int, loss: int) -> int:
        """How long a head of this piece fits."""
        return min(len(self.ids), tokens, max(0, self.loss_from - self.start) + loss)


class Packer:
    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int, first_id: int = 0):
        if min(max_tokens, max_segments, max_loss, pool) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.max_loss, self.pool = max_tokens, max_loss, pool
        self.waiting: list[Piece] = []
        self.next_id = first_id

    def _numbered(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in pieces:
            yield p, self.next_id, offset
            offset += len(p.ids)
        self.next_id += 1

    def _close(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        """A sequence that is full or a power of two long as it is, any other in powers of two."""
        total = sum(len(p.ids) for p in pieces)
        if total == self.max_tokens:
            yield from self._numbered(pieces)
            return
        rest = list(pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            now: list[Piece] = []
            while size:
                p = rest.pop(0)
                if len(p.ids) > size:
                    p, tail = p.cut(size)
                    rest.insert(0, tail)
                now.append(p)
                size -= len(p.ids)
            yield from self._numbered(now)

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        while len(piece.ids) >= self.max_tokens or piece.loss() > self.max_loss:
            head, tail = piece.cut(piece.most(self.max_tokens, self.max_loss))
            if len(head.ids) == self.max_tokens:
                yield from self._numbered([head])
            else:
                self.waiting.append(head.owned())
            if not len(tail.ids):
                break
            piece = tail
        else:
            self.waiting.append(piece.owned())
        if len(self.waiting) >= self.pool:
            yield from self.pack(self.pool // 2)

    def pack(self, leave: int = 0) -> Iterator[tuple[Piece, int, int]]:
        """Fill sequences until no more than ``leave`` pieces wait."""
        pieces = self.waiting
        demand = np.array([[len(p.ids), 1, p.loss()] for p in pieces], np.float64).reshape(-1, 3) / self.limits
        free = np.ones(len(pieces), bool)
        n_free = len(pieces)
        while n_free > leave:
            weights = demand[free].mean(axis=0)
            left, chosen = np.ones(3), []
            tokens, loss = self.max_tokens, self.max_loss
            while n_free and tokens and left[1] > 1e-9:
                product = np.where(free, demand @ (weights * left), -1.0)
                fits = free & (demand <= left + 1e-9).all(axis=1)
                if fits.any():
                    k = int(np.where(fits, product, -1.0).argmax())
                    piece = pieces[k]
                    free[k] = False
                    n_free -= 1
                else:
                    k = int(product.argmax())
                    n = pieces[k].most(tokens, loss)
                    if n == 0:
                        ready = np.flatnonzero(free & np.array([p is not None and p.start < p.loss_from for p in pieces]))
                        if not len(ready):
                            break
                        k = int(ready[0])
                        n = pieces[k].most(tokens, loss)
                    piece, pieces[k] = pieces[k].cut(n)
                    demand[k] = np.array([len(pieces[k].ids), 1, pieces[k].loss()]) / self.limits
                chosen.append(piece)
                tokens -= len(piece.ids)
                loss -= piece.loss()
                left = np.array([tokens, self.limits[1] - len(chosen), loss]) / self.limits
            yield from self._close(chosen)
        self.waiting = [p for p, f in zip(pieces, free, strict=True) if f]


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    max_tokens: int = 1024,
    max_segments: int = 256,
    max_loss_tokens: int = 1024,
    end_id: int = 0,
    pool: int = 512,
    prompt_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces, each with its ids as little-endian unsigned 32-bit numbers.

    ``prompt_col``: how many leading characters of the text bear no loss (null: none); without it all tokens do.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(prompt_col).cast("long") if prompt_col else F.lit(None).cast("long")).alias("prompt"))

    def run(batches):
        encode = encoder(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss_tokens, pool, TaskContext.get().partitionId() << 36)

        def out(placed):
            if placed:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p.doc for p, _, _ in placed], pa.int64()),
                        pa.array([p.start for p, _, _ in placed], pa.int64()),
                        pa.array([len(p.ids) for p, _, _ in placed], pa.int64()),
                        pa.array([p.ids.astype("<u4").tobytes() for p, _, _ in placed], pa.binary()),
                        pa.array([p.total for p, _, _ in placed], pa.int64()),
                        pa.array([p.loss() for p, _, _ in placed], pa.int64()),
                        pa.array([s for _, s, _ in placed], pa.int64()),
                        pa.array([o for _, _, o in placed], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"],
                )

        placed: list[tuple[Piece, int, int]] = []
        for batch in batches:
            for doc, text, prompt in zip(*batch.columns, strict=True):
                text = text.as_py() or ""
                ids = np.append(encode(text), np.uint32(end_id)).astype(np.uint32)
                silent = prompt.as_py() or 0
                placed += packer.add(Piece(doc.as_py(), 0, ids, len(ids), min(len(encode(text[:silent])), len(ids)) if silent > 0 else 0))
                if len(placed) >= 4096:
                    yield from out(placed)
                    placed = []
        yield from out(placed + list(packer.pack()))

    return rows.mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of what ``pack`` returns."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
