"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (lower case; every run of other than
letters and digits is one space). An item of at most ``WHOLE`` characters is
searched whole; a longer one in pieces of ``PIECE`` characters, one at every
``STRIDE``, so that every excerpt of ``PASSAGE`` characters or more, wherever it
begins, holds a whole piece. Such an item of at most ``LONG`` characters is
searched whole too, as a piece allows fewer edits than the whole; a stretch of
``LONG`` characters of a longer one that begins at a multiple of ``PIECE``, or is
its last, is two neighbouring pieces, one of which has at most half of the edits. A piece of length m is found in a document if some stretch of the document is within an edit distance
of ``e = min(floor(BUDGET * m), (m - Q) // Q)`` of it.

* Filter. By the q-gram lemma such a stretch shares at least ``m - Q + 1 - Q * e``
  q-grams with the piece, on diagonals (place in the document less place in the
  piece) that differ by at most e. Diagonals are put into bands of 2e + 2 that
  overlap by half, so the shared q-grams lie together in one band; only bands
  with enough of them are kept. No document is missed by this.
* Verify. Of each kept band the piece is aligned with the document's stretch
  within the band's diagonals, widened by e; the least edit distance decides.

Items below ``Q`` normalised characters have no q-gram: they are found where they
stand as whole words, without edits.

The benchmark's q-grams go to every task in portions of about ``PORTION``
q-grams, made one after the other from a stream of items, each with its own pass
over the documents, so that their size in memory is bounded whatever the
benchmark's. Places of a document that many pieces share are worked on for some
of the pieces at a time.

Output: ``doc_id, item_id, edits, pieces``: the pairs found, the least edit
distance of the item's pieces and how many of them were found. ``remove`` drops
the rows whose text holds a piece; other texts under the same doc_id stay.

Null or empty texts, and items without letters or digits, match nothing; very
long texts are searched whole; rows with null ids are left out (``remove`` keeps
them). Repeated items match alike under each id, repeated documents give one
row. There are no ties: all pairs are given. Empty tables give no rows. Other
columns are ignored (``remove`` keeps them).
"""

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

Q, BUDGET, PIECE, STRIDE, WHOLE, LONG, PORTION = 12, 0.06, 64, 16, 100, 128, 1 << 20
#: The least length of an excerpt that is always found, of items above WHOLE.
PASSAGE = PIECE + STRIDE - 1
#: Places of pieces that are worked on together; portions up to which ``remove`` needs one pass and no exchange.
HITS, IN_PASS = 1 << 22, 4
#: Alignments side by side.
SIDE = 1024


@functools.cache
def _normal() -> np.ndarray:
    """Lower case of letters and digits, else a space, by code point."""
    t = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            t[i] = ord(low) if len(low) == 1 else i
    return t


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts end to end, and their offsets."""
    codes, offs = X.flat(texts)
    c = _normal()[codes]
    keep = c != 32
    if len(c):
        # of a run of spaces the last stays, unless its text ends or begins there
        after = np.zeros(len(c), bool)
        after[:-1] = keep[1:]
        ends = offs[1:][offs[1:] > offs[:-1]] - 1
        after[ends] = False
        any_before = np.cumsum(keep)
        spaces = np.flatnonzero(~keep & after)
        base = np.append(0, any_before)[offs[np.searchsorted(offs, spaces, "right") - 1]]
        ok = any_before[spaces] > base
        keep[spaces[ok]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], total[offs]


def budget(m: int) -> int:
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


def spans(m: int) -> list[tuple[int, int]]:
    """Where the pieces of an item of ``m`` characters begin and end."""
    if m <= WHOLE:
        return [(0, m)]
    starts = {*range(0, m - PIECE, STRIDE), m - PIECE}
    if m > LONG:
        starts.add(m - 2 * PIECE)
    return [(s, s + PIECE) for s in sorted(starts)] + ([(0, m)] if m <= LONG else [])


@dataclass
class Pieces:
    """Pieces of benchmark items, and an index of their q-grams."""

    item: np.ndarray
    number: np.ndarray
    codes: list[np.ndarray]
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # where each one's occurrences begin
    owner: np.ndarray  # pieces, ascending among the occurrences of a gram
    place: np.ndarray
    bits: np.ndarray
    short: dict[int, tuple[np.ndarray, list[list[int]]]]  # by length: hashes of the items below Q, and their pieces


def index(items: Iterable[tuple[int, str]]) -> Iterator[Pieces]:
    """The pieces of (item_id, text) rows, in portions."""
    part: list[tuple[int, int, np.ndarray]] = []
    n = 0
    for item, text in items:
        codes, _ = normalise([text])
        m = len(codes)
        part += [(item, k, codes[s:e]) for k, (s, e) in enumerate(spans(m))] if m else []
        n += sum(e - s for s, e in spans(m))
        if n >= PORTION:
            yield _portion(part)
            part, n = [], 0
    if part:
        yield _portion(part)


def _portion(part: list[tuple[int, int, np.ndarray]]) -> Pieces:
    h = [X.mix64(X.window_hashes(c, Q)) for _, _, c in part]
    owner = np.repeat(np.arange(len(part)), [len(x) for x in h])
    place = np.concatenate([np.arange(len(x)) for x in h])
    h = np.concatenate(h)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    bits = np.zeros(1 << 22, bool)
    bits[(grams >> np.uint64(42)).astype(np.int64)] = True
    short = {}
    for m in sorted({len(c) for _, _, c in part if len(c) < Q}):
        own = [p for p, (_, _, c) in enumerate(part) if len(c) == m]
        keys, at = np.unique(np.concatenate([X.window_hashes(part[p][2], m) for p in own]), return_inverse=True)
        by = [[] for _ in keys]
        for p, k in zip(own, at.tolist()):
            by[k].append(p)
        short[m] = keys, by
    return Pieces(np.array([i for i, _, _ in part]), np.array([k for _, k, _ in part]), [c for _, _, c in part], grams, np.append(first, len(h)), owner[order], place[order], bits, short)


def whole_words(codes: np.ndarray, offs: np.ndarray, x: Pieces) -> list[tuple[int, int, int, int]]:
    """(document, item, 0, piece) of the items below ``Q`` characters that stand as whole words."""
    out = []
    for m, (keys, pieces) in x.short.items():
        if len(codes) < m:
            continue
        h = X.window_hashes(codes, m)
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        at = np.flatnonzero(keys[k] == h)
        doc = np.searchsorted(offs, at, "right") - 1
        start = (at == offs[doc]) | (codes[at - 1] == 32)
        end = at + m
        stop = (end == offs[doc + 1]) | ((end < offs[doc + 1]) & (codes[np.minimum(end, len(codes) - 1)] == 32))
        for d, row in sorted(set(zip(doc[start & stop].tolist(), k[at[start & stop]].tolist()))):
            out += [(d, int(x.item[p]), 0, int(x.number[p])) for p in pieces[row]]
    return out


def bands(codes: np.ndarray, offs: np.ndarray, x: Pieces) -> np.ndarray:
    """Rows (document, piece, least diagonal) of the bands with enough shared q-grams."""
    none = np.zeros((0, 3), np.int64)
    if len(codes) < Q or not len(x.grams):
        return none
    h = X.mix64(X.window_hashes(codes, Q))
    at = np.flatnonzero(x.bits[(h >> np.uint64(42)).astype(np.int64)])
    g = np.searchsorted(x.grams, h[at])
    g[g == len(x.grams)] = 0
    doc = np.searchsorted(offs, at, "right") - 1
    ok = (x.grams[g] == h[at]) & (at + Q <= offs[doc + 1])
    at, g, doc = at[ok], g[ok], doc[ok]
    if not len(at):
        return none
    n = x.first[g + 1] - x.first[g]
    if int(n.sum()) <= HITS:
        return _bands(at, g, doc, offs, x, x.first[g], n)
    # some of the pieces at a time: those of a gram are ascending
    pieces = len(x.codes)
    key = np.repeat(np.arange(len(x.grams)), np.diff(x.first)) * pieces + x.owner
    edge = np.linspace(0, pieces, min(pieces, int(n.sum()) // HITS + 1) + 1).astype(np.int64)
    cut = [np.searchsorted(key, g * pieces + e) for e in edge]
    return np.concatenate([_bands(at, g, doc, offs, x, a, b - a) for a, b in zip(cut, cut[1:])])


def _bands(at, g, doc, offs, x: Pieces, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``bands`` of ``n`` of the occurrences of each gram, from ``first`` on."""
    occ = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    piece, diagonal = x.owner[occ], np.repeat(at - offs[doc], n) - x.place[occ]
    doc, where = np.repeat(doc, n), np.repeat(at, n)
    size = np.array([len(c) for c in x.codes], np.int64)
    e = np.maximum(0, np.minimum((BUDGET * size).astype(np.int64), (size - Q) // Q))
    step = e[piece] + 1
    low = diagonal // step
    # each hit lies in the bands that begin at its own step and at the one before
    rows = np.stack([np.tile(doc, 2), np.tile(piece, 2), np.concatenate([low, low - 1]), np.tile(where, 2)])
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    if not rows.shape[1]:
        return np.zeros((0, 3), np.int64)
    new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))
    rows = rows[:, new]  # a place of the document counts once in a band
    head = np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(0))
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, rows.shape[1]))
    rows = rows[:3, first]
    m = size[rows[1]]
    keep = count >= np.maximum(1, m - Q + 1 - Q * e[rows[1]])
    rows = rows[:, keep]
    return np.stack([rows[0], rows[1], rows[2] * (e[rows[1]] + 1)], 1)


def banded(pieces: list[np.ndarray], codes: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The least edit distance of each piece to any part of its text ``codes[start:stop]``, within the diagonals ``low .. low + width - 1``.

    The pieces are of one length. Row i of the table holds, for each diagonal d, the
    distance of the piece's first i characters to a part of the text that ends at
    place ``i + d``; the columns of all pieces stand side by side.
    """
    m = len(pieces[0])
    letters = np.stack(pieces, 1)
    far = np.int32(1 << 14)
    place = low + np.arange(-1, width + m)[:, None]  # of the letter before each end
    size = stop - start
    inside = (place >= 0) & (place < size)
    text = codes[np.where(inside, start + place, 0)]
    no_letter = np.where(inside, np.int32(0), far)
    outside = np.where(inside | ((place == -1) & (size >= 0)), np.int32(0), far)
    ramp = np.arange(width, dtype=np.int32)[:, None]
    row = outside[:width]
    for i in range(1, m + 1):
        at = slice(i, i + width)
        best = row + no_letter[at]
        best += text[at] != letters[i - 1]
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])  # a character of the piece is missing in the text
        best -= ramp
        row = np.minimum.accumulate(best, 0)  # characters of the text are extra
        row += ramp
        row += outside[at]
    return row.min(0)


def find(codes: np.ndarray, offs: np.ndarray, x: Pieces) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, piece) of the pieces found in flat normalised texts."""
    out = whole_words(codes, offs, x)
    rows = bands(codes, offs, x)
    size = np.array([len(c) for c in x.codes], np.int64)[rows[:, 1]]
    for m in np.unique(size).tolist():
        alike, e = rows[size == m], budget(m)
        for own in np.split(alike, range(SIDE, len(alike), SIDE)):
            doc, piece, low = own.T
            best = banded([x.codes[p] for p in piece.tolist()], codes, offs[doc], offs[doc + 1], low - e, 2 * (e + 1) + 2 * e)
            ok = best <= e
            out += zip(doc[ok].tolist(), x.item[piece[ok]].tolist(), best[ok].tolist(), x.number[piece[ok]].tolist())
    return out


def _portions(items: DataFrame) -> list[Broadcast]:
    """The benchmark's portions, each sent as soon as it is made."""
    rows = X.usable(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id", "text").distinct().orderBy("item_id", "text")
    return [items.sparkSession.sparkContext.broadcast(x) for x in index((r[0], r[1]) for r in rows.toLocalIterator())]


def _search(docs: DataFrame, portions: list[Broadcast]) -> DataFrame:
    """``(doc_id, rid)`` and the columns of what was found, one or more rows for each document, item and piece; ``rid`` is the text's hash."""
    names = ["doc_id", "rid", "item_id", "edits", "piece"]
    kind = "doc_id long, rid long, item_id long, edits int, piece int"
    whole = X.usable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text").select("doc_id", F.xxhash64("text").alias("rid"), "text")
    found = docs.sparkSession.createDataFrame([], kind)
    for sent in portions:

        def run(batches, sent=sent):
            for part in X.slices(batches):
                got = find(*normalise(part.column(2).to_pylist()), sent.value)
                if got:
                    d, i, e, k = zip(*got)
                    at = pa.array(d, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(k, pa.int32())], names)

        found = found.unionByName(whole.mapInArrow(run, kind)) if sent is not portions[0] else whole.mapInArrow(run, kind)
    return found


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, pieces)`` of the documents that hold a piece of an item."""
    return _search(docs, _portions(items)).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.countDistinct("piece").cast("int").alias("pieces"))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text holds no piece of an item, with all their columns.

    Up to ``IN_PASS`` portions, each task drops its own rows; beyond, what each
    portion's pass finds is gathered and joined with the documents.
    """
    portions = _portions(items)
    if len(portions) > IN_PASS:
        d, r = X.fresh(docs, "did"), X.fresh(docs, "rid")
        bad = X.cut(_search(docs, portions).select(F.col("doc_id").alias(d), F.col("rid").alias(r)).distinct())
        return docs.join(X.sent(bad), (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(r)), "left_anti")
    text, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        for part in X.slices(batches):
            flat = normalise(part.column(text).to_pylist())
            clean = np.ones(part.num_rows, bool)
            for sent in portions:
                clean[[d for d, *_ in find(*flat, sent.value)]] = False
            yield part.filter(pc.or_(pa.array(clean), part.column(key).is_null()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(X.read(spark, sf_dir, "documents"), X.read(spark, sf_dir, "benchmark"))
