"""Near-duplicates by SimHash and tiled exact comparison.

A document's SimHash has 256 bits, each the sign of the sum of that bit (as
+1 or -1) over the hashes of the document's distinct features: pairs of
neighbouring lower-cased words, or the one word of a one-word document. Two
documents are near-duplicates if their first 128 bits differ in at most
``RADIUS`` places and all 256 in at most ``RADIUS_ALL``; the second half keeps
chance agreements of the first apart. Groups are the connected components of
that relation.

Equal hashes are taken together first, so thousands of equal copies count
once. The distinct hashes are then found through tables. Hashes whose first 128
bits differ in at most ``RADIUS`` places differ in at most half of that in one of
the two words, and so in at most a few places in one of the parts into which a word
is cut. There is a table for each part: it puts hashes of equal parts into a
bucket, and each bucket is compared with all buckets within the part's limit, by
numpy exclusive-or and bit counts in tiles. The limits are such that every pair
within the radii is met in some table, so the comparison is exact: no
approximation, no cap on partners or buckets. How many parts there are follows the
number of hashes; with more of them the parts are longer and a smaller share of all
pairs is compared (a ninth at 10^5, a seventeenth at 10^6 and more). Hashes that
crowd in few buckets, which texts of two or three words do, are compared with a
greater share.

A table's hashes are put into blocks by the order of its keys, and every pair of
blocks of a table is one piece of work. There are as many blocks as make eight
pieces for each of the cluster's cores, or more where a block would hold over
``BLOCK`` hashes; each hash is sent once for each table and block. The blocks'
bounds come from a sample and change the work's balance only. Each piece returns
the edges of a spanning forest only, which has the same components.

A document is a pair of doc_id and text: rows equal in both are one document, of
which ``deduplicate`` leaves one row, and different texts under one doc_id are
documents of their own. The least (doc_id, text hash) of a group stays.

Null or empty texts and texts without word characters have no features and are
never duplicates; very long texts are read whole; rows with a null doc_id are
never duplicates either. An empty table gives no rows. Other columns are ignored
(``deduplicate`` keeps them).
"""

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

RADIUS, RADIUS_ALL = 28, 52
#: The most hashes in a block, which bounds the memory of a task; rows and columns of a tile.
BLOCK, TILE, WIDE = 1 << 20, 32, 4096
#: Hashes, at least, from whose keys the bounds of blocks are taken; pairs that a piece of work holds before it reduces them.
BOUNDS, HELD = 1 << 16, 1 << 20
WORDS = 4
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document indices, their hashes of 4 words) of the texts that have features."""
    codes, offs = X.flat(texts, lower=True)
    start, end, doc = X.word_spans(codes, offs)
    h = X.word_hashes(codes, start, end)
    n = np.bincount(doc, minlength=len(texts))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    lone = np.flatnonzero(n[doc] == 1)
    f = np.concatenate([X.mix64(h[pair] * X.BASE + h[pair + 1]), h[lone]])
    d = np.concatenate([doc[pair], doc[lone]])
    order = np.lexsort((f, d))
    f, d = f[order], d[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    f, d = f[new], d[new]
    own, first, size = np.unique(d, return_index=True, return_counts=True)
    out = np.empty((len(own), WORDS), np.uint64)
    for a in range(0, len(own), 4096):
        b = min(a + 4096, len(own))
        lo, hi = int(first[a]), int(first[b - 1] + size[b - 1])
        for k in range(WORDS):
            ones = np.zeros((b - a, 64), np.int64)
            for c in range(lo, hi, 1 << 16):  # bounds the memory, whatever the longest text
                e = min(c + (1 << 16), hi)
                bits = np.unpackbits(X.mix64(f[c:e] ^ SEEDS[k]).view(np.uint8).reshape(-1, 8), axis=1)
                at = np.append(c, first[a:b][(first[a:b] > c) & (first[a:b] < e)])
                ones[np.searchsorted(first[a:b], at, "right") - 1] += np.add.reduceat(bits, at - c, axis=0, dtype=np.int64)
            out[a:b, k] = np.packbits(ones * 2 > size[a:b, None], axis=1).view(np.uint64).ravel()
    return own, out


class Table(NamedTuple):
    """Hashes differ in at most ``limit`` of the ``bits`` bits from ``shift`` of word ``word``, and in ``most`` bits of the word."""

    word: int
    shift: int
    bits: int
    limit: int
    most: int

    def keys(self, h: np.ndarray) -> np.ndarray:
        return ((h[:, self.word] >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def reach(self) -> int:
        """The keys within the limit of one."""
        return sum(math.comb(self.bits, i) for i in range(self.limit + 1))


def tables(parts: int) -> list[Table]:
    """Tables, ``parts`` for each of the first two words, of which at least one holds for any two hashes within ``RADIUS``.

    Over the two words, and over a word's parts, limits with one added to each
    make the whole's with one added: hashes beyond all of them are beyond the whole.
    With no parts there is one table, of one bucket.
    """
    if not parts:
        return [Table(0, 0, 0, 0, RADIUS)]
    out = []
    for word, most in enumerate((RADIUS // 2, RADIUS - RADIUS // 2 - 1)):
        shift = 0
        for k in range(parts):
            bits = 64 // parts + (k < 64 % parts)
            limit = (most + 1) // parts + (k < (most + 1) % parts) - 1
            if limit >= 0:
                out.append(Table(word, shift, bits, limit, most))
            shift += bits
    return out


@functools.cache
def parts(n: int) -> int:
    """Into how many parts to cut a word so that ``n`` hashes are compared in the least time, if they are spread evenly."""

    def cost(p: int) -> float:
        """Nanoseconds, roughly: by pair compared, by hash gathered, by pair of buckets and by bucket."""
        if not p:  # a fifth of the pairs is not told apart by one word
            return n * n / 2 * 25
        total = 0.0
        for t in tables(p):
            buckets = min(n, 1 << t.bits)
            total += t.reach() * (n * n / 2 ** (t.bits + 1) * 2.5 + n * 5 + buckets * 15) + buckets * 50_000
        return total

    return min((0, *range(3, 11)), key=cost)


def search(a: np.ndarray, b: np.ndarray, same: bool, table: Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (i, j) of all pairs of rows of ``a`` and ``b`` (each pair once if they are the same) within the radii and the table's limits."""
    ka, kb = table.keys(a), table.keys(b)
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    wa, wb = a[oa, table.word], b[ob, table.word]
    begin = np.searchsorted(kb[ob], np.arange((1 << table.bits) + 1))
    keys, first, size = np.unique(ka[oa], return_index=True, return_counts=True)
    every = np.arange(1 << table.bits)
    masks = every[np.bitwise_count(every) <= table.limit]
    places = np.arange(len(b))
    x, c, z = np.empty(TILE * WIDE, np.uint64), np.empty(TILE * WIDE, np.uint8), np.zeros(TILE * WIDE + 8, bool)
    eights = z[: TILE * WIDE].view(np.uint64)

    def exact(held):
        p, q = (np.concatenate(v) for v in zip(*held))
        if same:
            p, q = p[p < q], q[p < q]
        p, q = oa[p], ob[q]
        ones = np.bitwise_count(a[p] ^ b[q])
        near = (ones[:, :2].sum(1) <= RADIUS) & (ones.sum(1) <= RADIUS_ALL)
        return p[near], q[near]

    held, n_held = [], 0
    for key, lo, n in zip(keys.tolist(), first.tolist(), size.tolist()):
        near = key ^ masks
        if same:  # pairs of two buckets are met from the lesser key
            near = near[near >= key]
        s = begin[near]
        m = begin[near + 1] - s
        s, m = s[m > 0], m[m > 0]
        if not len(m):
            continue
        end = np.cumsum(m)
        at = np.repeat(s - end + m, m) + places[: end[-1]]
        w = wb[at]
        for i in range(lo, lo + n, TILE):
            wi = wa[i : min(i + TILE, lo + n), None]
            for j in range(0, len(w), WIDE):
                wj = w[None, j : j + WIDE]
                shape = len(wi), wj.shape[1]
                k = shape[0] * shape[1]
                np.bitwise_xor(wi, wj, out=x[:k].reshape(shape))
                np.bitwise_count(x[:k], out=c[:k])
                np.less_equal(c[:k], table.most, out=z[:k])
                z[k : k + 8] = False
                eight = np.flatnonzero(eights[: (k + 7) // 8])  # few hold any: far faster than by single ones
                if len(eight):
                    which, bit = np.nonzero(z[: TILE * WIDE].reshape(-1, 8)[eight])
                    hit = eight[which] * 8 + bit
                    p, q = np.divmod(hit, shape[1])
                    held.append((p + i, at[q + j]))
                    n_held += len(hit)
                if n_held >= TILE * WIDE:
                    yield exact(held)
                    held, n_held = [], 0
    if held:
        yield exact(held)


def compare(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of rows of ``a`` and ``b`` (each pair once if they are the same) within the radii."""
    found = [np.stack([np.minimum(p, q), np.maximum(p, q)] if same else [p, q]) for t in tables(parts(max(len(a), len(b)))) for p, q in search(a, b, same, t)]
    return tuple(np.unique(np.concatenate(found, 1), axis=1)) if found else (np.zeros(0, np.int64),) * 2


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes that are not least."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, rid, h0, h1, h2, h3)`` of the rows that have features; ``rid`` is the text's own hash."""

    def run(batches):
        for part in X.slices(batches):
            own, h = hashes(part.column(2).to_pylist())
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(pa.array(h[:, k].view(np.int64)) for k in range(WORDS))], ["doc_id", "rid", "h0", "h1", "h2", "h3"])

    whole = X.usable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    return whole.select("doc_id", F.xxhash64("text").alias("rid"), "text").mapInArrow(run, "doc_id long, rid long, h0 long, h1 long, h2 long, h3 long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the undirected edges ``(u, v)``, the root being the least node of its component.

    Alternating large and small stars: every node links its larger neighbours
    to its least one, then its smaller; the edges become stars in a number of
    rounds logarithmic in their number.
    """
    edges = X.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = X.cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def _near(same: DataFrame, n: int, block: int) -> DataFrame:
    """Edges ``(u, v)`` with the components of all pairs within the radii, of the ``n`` distinct hashes ``(node, h0, h1, h2, h3)``."""
    tabs = tables(parts(n))
    cores = same.sparkSession.sparkContext.defaultParallelism
    k = max(1, -(-n // block))
    while k * (k + 1) // 2 * len(tabs) < 8 * cores:
        k += 1
    some = same.filter(F.pmod(F.xxhash64("h0", "h1", "h2", "h3"), F.lit(max(1, n // BOUNDS))) == 0).select("h0", "h1").toArrow()
    some = np.stack([some.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1")], 1)
    bounds = [np.sort(t.keys(some))[np.arange(1, k) * len(some) // k] if len(some) else np.zeros(k - 1, np.int64) for t in tabs]

    def spread(batches):
        """Each block of hashes, as bytes, for the pairs of its table's blocks that it is in."""
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            chance = X.mix64(rows[:, 1].view(np.uint64) ^ rows[:, 2].view(np.uint64))
            piece, side, data = [], [], []
            for c, (t, bound) in enumerate(zip(tabs, bounds)):
                key = t.keys(rows[:, 1:].view(np.uint64))
                lo, hi = np.searchsorted(bound, key, "left"), np.searchsorted(bound, key, "right")
                b = lo + (chance % (hi - lo + 1).astype(np.uint64)).astype(np.int64)  # a key that fills blocks is spread over them
                order = np.argsort(b, kind="stable")
                edges = np.searchsorted(b[order], np.arange(k + 1))
                for y in range(k):
                    if edges[y] == edges[y + 1]:
                        continue
                    packed = rows[order[edges[y] : edges[y + 1]]].tobytes()
                    for o in range(k):
                        piece.append((c * k + min(y, o)) * k + max(y, o))
                        side.append(int(y > o))
                        data.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(side, pa.int32()), pa.array(data, pa.binary())], ["piece", "side", "data"])

    def near(group: pa.Table) -> pa.Table:
        c, pair = divmod(group.column("piece")[0].as_py(), k * k)
        x, y = divmod(pair, k)
        parted = [[], []]
        for side, data in zip(group.column("side").to_pylist(), group.column("data")):
            parted[side].append(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, 1 + WORDS))
        rows = [np.concatenate(p) if p else np.zeros((0, 1 + WORDS), np.int64) for p in parted]
        a, b = rows if x != y else (rows[0], rows[0])
        u, v, held = [], [], 0
        for p, q in search(a[:, 1:].view(np.uint64), b[:, 1:].view(np.uint64), x == y, tabs[c]):
            u.append(a[p, 0])
            v.append(b[q, 0])
            held += len(p)
            if held >= HELD:
                less, least = forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [less], [least], 0
        none = np.zeros(0, np.int64)
        less, least = forest(np.concatenate([none, *u]), np.concatenate([none, *v]))
        return pa.table({"u": pa.array(less, pa.int64()), "v": pa.array(least, pa.int64())})

    packed = same.select("node", "h0", "h1", "h2", "h3").mapInArrow(spread, "piece long, side int, data binary")
    return packed.repartition(len(tabs) * k * (k + 1) // 2, "piece").groupBy("piece").applyInArrow(near, "u long, v long")


def _grouped(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(signatures, ``(doc_id, rid, group_id, keep)`` of every document that has a near-duplicate)."""
    spark = docs.sparkSession
    sig = X.cut(signatures(docs))
    hashed = ["h0", "h1", "h2", "h3"]
    several = (F.min("doc_id") < F.max("doc_id")) | (F.min("rid") < F.max("rid"))
    # distinct hashes are numbered once they are written, so that numbers stay
    same = X.cut(sig.groupBy(*hashed).agg(several.alias("several"))).withColumn("node", F.monotonically_increasing_id())
    n = same.count()
    found = components(_near(same, n, block))
    # hashes that are near to others, or that several documents have
    some = same.join(found, "node", "left").filter("root IS NOT NULL OR several").select(*hashed, F.coalesce("root", "node").alias("root"))
    members = X.cut(sig.join(some, hashed).select("doc_id", "rid", "root").distinct())
    least = members.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("least"))
    return sig, members.join(least, "root").select("doc_id", "rid", F.col("least.doc_id").alias("group_id"), (F.struct("doc_id", "rid") == F.col("least")).cast("int").alias("keep"))


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, group_id, keep)`` of every document that has a near-duplicate; ``group_id`` is the least doc_id of the group."""
    return _grouped(docs, block)[1].drop("rid")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One row of each document but those that their group's least one stands for; all columns as they were.

    Of rows equal in doc_id and text the one whose columns, as JSON, come first stays.
    """
    sig, grouped = _grouped(docs, **how)
    d, r, w = (X.fresh(docs, name) for name in ("did", "rid", "whole"))
    gone = X.cut(grouped.filter("keep = 0").select(F.col("doc_id").alias(d), F.col("rid").alias(r)))
    again = X.cut(sig.groupBy(F.col("doc_id").alias(d), F.col("rid").alias(r)).count().filter("count > 1").drop("count").join(gone, [d, r], "left_anti"))
    here = (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(r))
    out = docs.join(X.sent(gone), here, "left_anti")
    if again.isEmpty():
        return out
    twice = out.join(X.sent(again), here).select(d, r, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(w))
    once = twice.groupBy(d, r).agg(F.min_by(w, F.to_json(w)).alias(w)).select(f"{w}.*")
    return out.join(X.sent(again), here, "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(X.read(spark, sf_dir, "documents"))
