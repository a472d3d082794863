"""MinHash near-deduplication with sequential Bayesian verification.

1. One pass over the texts makes, per row, the distinct word shingles' count, a 128-bit digest of the set, the MinHash
   signature and the keys of its bands. Rows with the same set collapse to one node (the smallest identifier), however
   many copies there are, so exact copies never meet in a bucket.
2. Every band bucket with two nodes or more proposes links from its members to a leader that a hash of the bucket picks,
   so a bucket of n nodes makes n - 1 proposals, not n². Signatures are compared batch by batch: a proposal is dropped
   once the posterior probability that its similarity reaches the threshold (uniform prior, so a binomial tail) is below
   ``miss``.
3. Survivors are verified exactly on the full sets: first each node's most similar leader, then the best proposal between
   any two components so found, then all other proposals that still lie between two components.
4. A bucket whose members are still in several components compares every member outside its main component with every
   member of another component (a pair in the first band that it shares, so once). This runs in blocks of at most about
   ``block`` by ``block`` members: first signatures alone, batch by batch, and only members that some signature agrees with
   bring their full sets to the same block; only links that join two components leave it, so pairs are never rows. No
   comparison inside one component is needed: it could not change a component.
   So links are lost only by banding (probability (1 - t^rows)^bands at similarity t: 3e-6 for the defaults at 0.8) and by
   ``miss``.

Scale: nothing is collected but counts; groups of copies are summed map-side; a leader with more than ``HOT`` proposals
is salted, other joins on band keys and nodes are plain shuffle joins that adaptive execution can split; components are found by contraction (hook to the smallest neighbour,
jump pointers, contract the links). Intermediate tables are written to the shared folder, which
cuts the lineage, and removed after their last reader; two narrow ones stay, which the result reads.

Defined results: null and empty texts, and those without words, have an empty set, are linked with nothing and kept;
rows that share an identifier are one document; rows with a null identifier get the smallest identifier of the rows with
the same set, else null, and are kept only in the latter case; texts of fewer words than a shingle are one shingle; very
long texts are taken whole; ties between proposals go to the larger identifier and never change a component; an empty table
gives no row; only the identifier and text are read, so no column name clashes.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER_BYTES, Scratch, id_text, slices, texts

#: At most so many identifiers (16 MB) are broadcast to select the texts of which sets are needed; beyond it they join by a shuffle.
BROADCAST_IDS = 1_000_000

#: A node in more pairs than this has its pairs dealt by a salt.
HOT = 20_000
#: Sets of a task that are remembered, so that repeated rows bring theirs once.
REMEMBERED = 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered for the last ``limit`` distinct ones."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(29)
    return np.unique(s)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.n = bands, rows, bands * rows
        self.a = (rng.integers(0, 2**32, self.n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, self.n, dtype=np.uint64).astype(np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):  # so that the products stay in the cache
            np.minimum(out, (self.a * x[None, i : i + 512] + self.b).min(axis=1), out=out)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band, different bands having different keys."""
        parts = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for r in range(self.rows):
            key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Of n compared hashes, the fewest equal ones with P(similarity >= threshold | equal ones) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Bin(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if tail >= miss:
            return m
    return n


def _signed(docs: DataFrame, words: int, minhash: MinHash) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            sizes, digests, signatures = [], [], []
            for text in texts(batch):
                s = shingle_set(text, words, hashes)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(minhash.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _signatures(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, n)


def _banded(nodes: DataFrame, minhash: MinHash) -> DataFrame:
    """node and key of each of its bands."""

    def run(batches):
        for batch in slices(batches):
            keys = minhash.keys(_signatures(batch.column(1), minhash.n))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), minhash.bands)), pa.array(keys.reshape(-1))], names=["node", "key"])

    return nodes.select("node", "signature").mapInArrow(run, "node long, key long")


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, shingles of the documents in ``needed`` (one column, node)."""
    ids = needed.select(F.col("node").alias("doc_id")).distinct()
    few = needed.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches):
        hashes, seen = WordHashes(), set()
        for batch in slices(batches):
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if (s := shingle_set(text, words, hashes)).size and (node, key := hash(s.tobytes())) not in seen:
                    # a repeated row that is not remembered any more does no harm
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((node, key))
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return chosen.mapInArrow(run, "node long, shingles array<long>")


def _beside(pairs: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """The pairs with the rows of ``side`` for their node ``name``.

    A node in more than ``HOT`` pairs (the leader of a large bucket) is copied under one salt per ``HOT`` pairs, so that its
    pairs spread over tasks. There are at most one ``HOT``-th as many such nodes as pairs.
    """
    hot = pairs.groupBy(name).agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("salts")).where("salts > 1")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    salts = F.coalesce("salts", F.lit(1))
    left = pairs.join(hot, name, "left").withColumn("salt", F.pmod(F.hash("a", "b"), salts)).drop("salts")
    right = side.join(hot, name, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [name, "salt"]).drop("salt")


def _steps(n: int, batch_size: int, threshold: float, miss: float) -> list[tuple[int, int, int]]:
    """Batches of a signature's hashes with the fewest equal ones, up to there, that go on."""
    return [(i, min(i + batch_size, n), least_matches(min(i + batch_size, n), threshold, miss)) for i in range(0, n, batch_size)]


def _scored(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float, n: int, batch_size: int) -> DataFrame:
    """a, b, matches of the pairs that the sequential test keeps."""
    steps = _steps(n, batch_size, threshold, miss)
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("signature").alias(f"s{name}"))

    def run(batches):
        for batch in slices(batches):
            a, b, sa, sb = batch.columns
            x, y = _signatures(sa, n), _signatures(sb, n)
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, j, m in steps:
                matches[alive] += (x[alive, i:j] == y[alive, i:j]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep), pa.array(matches[alive])], names=["a", "b", "matches"])

    joined = _beside(pairs, side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, matches long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, exactly: 100 |A & B| >= 100 t |A or B|."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
    both = F.size(F.array_intersect("sa", "sb"))
    percent = F.lit(round(threshold * 100))
    joined = _beside(pairs.select("a", "b"), side("b"), "b").join(side("a"), "a")
    return joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _intersections(left: list[np.ndarray], right: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    i, j = pairs
    known, inverse = np.unique(np.concatenate(left), return_inverse=True)
    cost = sum(len(left[x]) + len(right[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True))
    if len(left) * len(right) * len(known) > 30 * cost:
        return np.array([np.isin(left[x], right[y], assume_unique=True).sum() for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # all pairs at once: 0/1 rows over slices of the known shingles, multiplied
    of_left = np.repeat(np.arange(len(left)), [len(x) for x in left])
    flat = np.concatenate(right)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[at] == flat
    of_right = np.repeat(np.arange(len(right)), [len(x) for x in right])[hit]
    at = at[hit]
    out = np.zeros((len(left), len(right)), np.float64)
    width = 8192
    for lo in range(0, len(known), width):
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        inside = (inverse >= lo) & (inverse < lo + width)
        a[of_left[inside], inverse[inside] - lo] = 1
        inside = (at >= lo) & (at < lo + width)
        b[of_right[inside], at[inside] - lo] = 1
        out += a @ b.T
    return out[i, j].astype(np.int64)


class Block:
    """One block of a bucket: the pairs of a left and a right member that the bucket must compare, by place."""

    def __init__(self, table: pa.Table, minhash: MinHash):
        side = np.array(table["left"].to_pylist(), bool)
        self.left, self.right = np.flatnonzero(side), np.flatnonzero(~side)
        self.node, self.component, self.outside = (np.array(table[c].to_pylist()) for c in ("node", "component", "outside"))
        self.signatures = _signatures(table["signature"], minhash.n)
        self.keys = minhash.keys(self.signatures)
        self.key = table["key"][0].as_py()

    def pairs(self, steps: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components, in the first band that they share, that the sequential test keeps."""
        left, right, keys = self.left, self.right, self.keys
        if not len(left) or not len(right):
            return left[:0], right[:0]
        band = (keys[left[0]] == self.key).argmax()
        # two members outside the main component meet twice
        i, j = np.nonzero((self.component[left][:, None] != self.component[right][None, :]) & (~self.outside[right][None, :] | (self.node[left][:, None] < self.node[right][None, :])))
        if band:
            before = np.zeros(len(i), bool)
            for k in range(band):
                before |= keys[left[i], k] == keys[right[j], k]
            i, j = i[~before], j[~before]
        matches = np.zeros(len(i), np.int64)
        for lo, hi, m in steps:
            matches += (self.signatures[left[i], lo:hi] == self.signatures[right[j], lo:hi]).sum(axis=1)
            alive = matches >= m
            i, j, matches = i[alive], j[alive], matches[alive]
        return left[i], right[j]


def _alike(blocks: DataFrame, minhash: MinHash, steps: list[tuple[int, int, int]]) -> DataFrame:
    """The members of blocks, as they are, that are in a pair whose signatures agree."""

    def run(table: pa.Table) -> pa.Table:
        found = Block(table, minhash)
        some = np.unique(np.concatenate(found.pairs(steps))).astype(np.int64)
        return table.take(pa.array(some))

    return blocks.groupBy("key", "ob", "mb").applyInArrow(run, blocks.schema)


def _between_components(blocks: DataFrame, minhash: MinHash, threshold: float, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Links a, b found in blocks of one bucket (key, ob, mb): members with ``left`` against those without, on their full sets."""
    percent = round(threshold * 100)

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, minhash)
        x, y = block.pairs(steps)
        if not len(x):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = [np.array(s, np.int64) for s in table["shingles"].to_pylist()]
        at = np.cumsum(~np.isin(np.arange(len(sets)), block.right)) - 1, np.cumsum(np.isin(np.arange(len(sets)), block.right)) - 1
        both = _intersections([sets[i] for i in block.left], [sets[i] for i in block.right], (at[0][x], at[1][y]))
        size = np.array([len(s) for s in sets])
        good = 100 * both >= percent * (size[x] + size[y] - both)
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                c = up
            return c

        links = []
        for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
            a, b = find(int(block.component[i])), find(int(block.component[j]))
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((int(block.node[i]), int(block.node[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return blocks.groupBy("key", "ob", "mb").applyInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of all nodes of ``links`` (a, b), by contraction."""
    now = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    while not now.isEmpty():
        ends = now.union(now.select("b", "a")).toDF("node", "other")
        hooks = last = scratch.keep(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("top")))
        while True:
            up = hooks.select(F.col("node").alias("top"), F.col("top").alias("higher"))
            jumped = scratch.keep(hooks.join(up, "top").select("node", "top", "higher"))
            scratch.drop(last)
            last = jumped
            moved = not jumped.where("top <> higher").isEmpty()
            hooks = jumped.select("node", F.col("higher").alias("top"))
            if not moved:
                break
        as_end = lambda name, hooks=hooks: hooks.select(F.col("node").alias(name), F.col("top").alias(f"top_{name}"))
        before = now
        now = scratch.keep(now.join(as_end("a"), "a").join(as_end("b"), "b").where("top_a <> top_b").select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct())
        grown = hooks if total is None else total.join(hooks.toDF("top", "higher"), "top", "left").select("node", F.coalesce("higher", "top").alias("top"))
        old, total = total, scratch.keep(grown)
        scratch.drop(before, last, *([] if old is None else [old]))
    if total is None:
        total = now.toDF("node", "top")
        total._scratch_path = now._scratch_path
    else:
        scratch.drop(now)
    out = total.select("node", F.col("top").alias("component"))
    out._scratch_path = total._scratch_path
    return out


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that lie in two components, with those."""
    side = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return known.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def near_dedup(
    docs: DataFrame,
    *,
    shingle_words: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    miss: float = 1e-6,
    batch_size: int = 32,
    block: int = 256,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: n_shingles, component_id (the smallest identifier linked to it) and kept (it is that identifier)."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    minhash = MinHash(bands, rows, seed)
    steps = _steps(minhash.n, batch_size, threshold, miss)
    docs = id_text(docs, id_col, text_col)
    signed = scratch.keep(_signed(docs, shingle_words, minhash))
    has_set = signed.where("digest is not null and doc_id is not null")
    nodes = scratch.keep(has_set.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    sized = scratch.keep(signed.select("doc_id", "n_shingles", "digest"))
    scratch.drop(signed)

    # step 2: proposals of each bucket's members to its leader
    keyed = scratch.keep(_banded(nodes, minhash))
    salted = F.col("node").bitwiseXOR(F.xxhash64("key"))
    buckets = keyed.groupBy("key").agg(F.min(salted).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", F.col("least").bitwiseXOR(F.xxhash64("key")).alias("leader"))
    members = scratch.keep(keyed.join(buckets, "key").select("key", "node", "leader"))
    scratch.drop(keyed)
    proposals = scratch.keep(members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    scored = scratch.keep(_scored(proposals, nodes, threshold, miss, minhash.n, batch_size))
    scratch.drop(proposals)

    # step 3: exact verification, most promising proposals first
    sets = scratch.keep(_sets(docs, scored.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle_words))
    found = None
    links: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        """The components with the links that are among the pairs."""
        asked = scratch.keep(pairs.select("a", "b"))
        links.append(scratch.keep(_verified(asked, sets, threshold)))
        scratch.drop(asked, *([] if found is None else [found]))
        return components(reduce(DataFrame.union, links), scratch)

    found = verify(scored.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b")))
    between = _apart(scored, found).groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("matches", "a", "b")).alias("p"))
    found = verify(between.select("p.a", "p.b"))
    found = verify(_apart(scored, found))
    scratch.drop(scored, sets)

    # step 4: what a leader could not show
    labelled = scratch.keep(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    scratch.drop(members)
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("size")).where("parts > 1 and size > 2")
    blocks_of = lambda n: F.ceil(n / F.lit(block)).cast("int")
    mixed = mixed.select("key", F.col("top.component").alias("main"), blocks_of(F.col("size") - F.col("top.n")).alias("obs"), blocks_of(F.col("size")).alias("mbs"))
    others = scratch.keep(labelled.join(mixed, "key").select("*", (F.col("component") != F.col("main")).alias("outside")))
    scratch.drop(labelled)
    if not others.isEmpty():
        number = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ("key", "ob", "mb", "left", "node", "component", "outside", "signature")
        # the signature joins a bucket's members, not their copies in blocks
        signed = others.join(nodes.select("node", "signature"), "node")
        left = signed.where("outside").withColumns({"ob": number(F.col("obs")), "left": F.lit(True)}).withColumn("mb", every("mbs")).select(*columns)
        right = signed.withColumns({"mb": number(F.col("mbs")), "left": F.lit(False)}).withColumn("ob", every("obs")).select(*columns)
        # only members that some signature agrees with bring their sets
        alike = scratch.keep(_alike(left.unionAll(right), minhash, steps))
        if not alike.isEmpty():
            wanted = scratch.keep(_sets(docs, alike.select("node").distinct(), shingle_words))
            more = scratch.keep(_between_components(alike.join(wanted, "node"), minhash, threshold, steps))
            scratch.drop(wanted)
            if not more.isEmpty():
                links.append(more)
                scratch.drop(found)
                found = components(reduce(DataFrame.union, links), scratch)
        scratch.drop(alike)

    # every row by its set
    known = scratch.keep(nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component")))
    scratch.drop(others, nodes, found, *links)
    joined = sized.join(known, "digest", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
