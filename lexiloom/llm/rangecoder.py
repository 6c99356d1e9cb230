"""Token ids as compressed binary: an adaptive context-mixing range coder.

A block holds at most ``block`` ids and is coded by itself: its model starts
empty, and a CRC-32 of its ids stands beside it. Three predictions of the id at
place t are mixed, with weights that add up to ``UNIT``:

* order 2: the id that followed the last occurrence of the two ids before. Its
  weight follows how often such candidates were right so far in the block, apart
  for five cases: the pair was met once, its candidate has just been wrong, or
  was right once, twice or more times in a row.
* order 1: the counts of all ids that followed the id before, each in proportion.
  Of n counts they have ``n / (n + BETA)`` of what order 2 leaves.
* order 0: ``GAIN * count + 1`` of every id of the vocabulary, with the rest.

The candidate is the last one at each place; counts, and what the weights are
learned from, are those up to the start of the current epoch, each epoch being
about a sixteenth of what lies before it. Orders 1 and 0 are brought to integer frequencies that add up to
``PART``, by rounding their cumulative sums down, so that the mixture is one distribution
of integers that drives one step of a carryless range coder (64 bits, 32-bit
words) per id. As the encoder knows all ids, it finds the frequencies of many
blocks at once with sorts and running sums, and then codes the blocks side by
side; the decoder does the same step by step.

Output: one row per block: ``doc_ids``, ``parts`` and ``lengths`` tell which
documents (and which part of a document longer than a block) lie in it, in
order. Null texts count as empty: an empty document has one part of length 0.
Very long texts are cut into parts of a block. Rows with a null doc_id are left
out; repeated rows are kept each; there are no ties. An empty table gives no
rows. Other columns are ignored.
"""

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._tokens import VOCABULARY, encoder

BLOCK, LANES = 32768, 384
#: Ids whose frequencies are found at once, which bounds the memory of that.
TOGETHER = 1 << 18
EPOCH, GAIN, BETA = 256, 30, 64
UNIT, MOST, PART = 1 << 11, 2040, 1 << 20
TOTAL = 31  # bits of UNIT * PART
CASES = 5
WORD, MASK = 32, (1 << 64) - 1
SCHEMA = "doc_ids array<long>, parts array<int>, lengths array<int>, n_tokens int, crc long, payload binary"


def _epochs(n: int) -> list[int]:
    starts, at = [0], EPOCH
    while at < n:
        starts.append(at)
        at += max(EPOCH, at // 16)
    return starts


def _counts(key: np.ndarray, bits: int, low: int, at_of, epoch: np.ndarray, n_epochs: int) -> tuple[np.ndarray, ...]:
    """Of each item: how many earlier ones have the same context and id, the same context and a smaller id, and the same context.

    ``key`` holds (context, id, place) of each item, with ``bits`` bits of id and
    ``low`` of place; ``at_of`` gives the items of sorted keys. Earlier is before
    the item's epoch.
    """
    key = np.sort(key)
    at = at_of(key)
    n = len(key)
    e = epoch[at]
    new = np.ones(n + 1, bool)
    pair = key >> np.uint64(low)
    new[1:-1] = pair[1:] != pair[:-1]
    index = np.arange(n, dtype=np.int32)
    begin = np.maximum.accumulate(np.where(new[:-1], index, 0))
    fresh = new[:-1].copy()
    fresh[1:] |= e[1:] != e[:-1]
    count = np.maximum.accumulate(np.where(fresh, index, 0)) - begin
    context = pair >> np.uint64(bits)
    new[1:-1] = context[1:] != context[:-1]
    edge = np.flatnonzero(new).astype(np.int32)
    group = np.cumsum(new[:-1], dtype=np.int32) - 1
    less, all_ = np.zeros(n, np.int32), np.zeros(n, np.int32)
    by_epoch = np.argsort(e, kind="stable")
    cut = np.searchsorted(e[by_epoch], np.arange(n_epochs + 1))
    below = np.zeros(n + 1, np.int32)
    for k in range(1, n_epochs):
        here = by_epoch[cut[k] : cut[k + 1]]
        if not len(here):
            continue
        np.cumsum(e < k, out=below[1:])
        g = group[here]
        first = below[edge[g]]
        less[here] = below[begin[here]] - first
        all_[here] = below[edge[g + 1]] - first
    out = [np.zeros(len(epoch), np.int32) for _ in range(3)]
    for o, x in zip(out, (count, less, all_)):
        o[at] = x
    return tuple(out)


def _scaled(below: np.ndarray, own: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cumulative, frequency) of PART that ``below`` and ``own`` of ``total`` come to; exact, as none is above PART."""
    t = np.maximum(total, 1).astype(float)
    a = np.floor(below * float(PART) / t)
    return a.astype(np.int64), (np.floor((below + own) * float(PART) / t) - a).astype(np.int64)


def _model(tokens: np.ndarray, lane: np.ndarray, t: np.ndarray, lanes: int, size: int, vocabulary: int):
    """(cumulative, frequency) of every id; blocks end to end, ``lane`` and ``t`` give block and place."""
    n = len(tokens)
    tb, vb = max(1, (size - 1).bit_length()), vocabulary.bit_length()
    if max(1, (lanes - 1).bit_length()) + 2 * vb + tb > 63 or GAIN * size + vocabulary > PART:
        raise ValueError("block or vocabulary too large")
    u = np.uint64
    tok, lane64, t64 = tokens.astype(u), lane.astype(u), t.astype(u)
    first = np.flatnonzero(t == 0)
    starts = np.array(_epochs(size), np.int64)
    ne = len(starts)
    epoch = (np.searchsorted(starts, np.arange(size), "right") - 1).astype(np.int8)[t]
    mask = u((1 << tb) - 1)

    def place(shift):
        return lambda key: first[(key >> u(shift)).astype(np.int64)] + (key & mask).astype(np.int64)

    count, less, _ = _counts((((lane64 << u(vb)) | tok) << u(tb)) | t64, vb, tb, place(vb + tb), epoch, ne)
    seen = starts[epoch]
    c0, f0 = _scaled(GAIN * less.astype(np.int64) + tokens, GAIN * count.astype(np.int64) + 1, vocabulary + GAIN * seen)
    later = np.flatnonzero(t >= 1)
    head = (lane64[later] << u(vb)) | tok[later - 1]
    count, less, n1 = _counts((((head << u(vb)) | tok[later]) << u(tb)) | t64[later], vb, tb, place(2 * vb + tb), epoch, ne)
    c1, f1 = _scaled(less, count, n1)
    # the next occurrence of the same two ids is predicted by what followed this one
    later = np.flatnonzero(t >= 2)
    key = np.sort((((((lane64[later] << u(vb)) | tok[later - 2]) << u(vb)) | tok[later - 1]) << u(tb)) | t64[later])
    at = place(2 * vb + tb)(key)
    pair = key >> u(tb)
    again = np.flatnonzero(pair[1:] == pair[:-1]) + 1
    case = np.full(n, -1, np.int8)
    hit = np.zeros(n, bool)
    if len(again):
        right = tokens[at[again]] == tokens[at[again - 1]]
        index = np.arange(len(again))
        head = np.append(True, again[1:] != again[:-1] + 1)  # the pair's second occurrence
        stop = np.maximum.accumulate(np.where(head, index, 0))  # places since the last wrong one, or the first
        wrong = np.maximum.accumulate(np.where(~right, index, -1))
        before = np.append(-1, wrong[:-1])
        run = np.where(before >= stop, index - before - 1, index - stop)
        case[at[again]] = np.where(head, 0, 1 + np.minimum(run, CASES - 2))
        hit[at[again]] = right
    cell = (lane.astype(np.int64) * ne + epoch) * (CASES + 1) + case + 1
    met, right = (np.bincount(cell, w, lanes * ne * (CASES + 1)).astype(np.int64).reshape(lanes, ne, CASES + 1) for w in (None, hit))
    met, right = (np.cumsum(x, 1) - x for x in (met, right))
    w2 = MOST * (right + 1) // (met + 3)
    w2[:, :, 0] = 0
    w2 = w2.reshape(-1)[cell]
    w1 = (UNIT - w2) * n1 // (n1 + BETA)
    w0 = UNIT - w2 - w1
    cum = w2 * PART + w1 * c1 + w0 * c0
    freq = w1 * f1 + w0 * f0
    cum[hit], freq[hit] = 0, w2[hit] * PART
    return cum, freq


def encode_blocks(blocks: list[np.ndarray], vocabulary: int, size: int = BLOCK) -> list[bytes]:
    """The payloads of blocks of at most ``size`` ids, coded side by side."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))  # lanes that still run are the first ones
    n = np.array([len(blocks[i]) for i in order], np.int64)
    live = int((n > 0).sum())
    payloads = [b""] * len(blocks)
    if not live:
        return payloads
    n = n[:live]
    steps = int(n[0])
    run = np.zeros((2, steps, live), np.uint32)
    for a in range(0, live, some := max(1, TOGETHER // size)):
        m = n[a : a + some]
        lane = np.repeat(np.arange(len(m)), m)
        t = np.arange(len(lane)) - np.repeat(np.cumsum(m) - m, m)
        tokens = np.concatenate([blocks[i] for i in order[a : a + len(m)]]).astype(np.int64)
        for out, x in zip(run, _model(tokens, lane, t, len(m), size, vocabulary)):
            out[t, a + lane] = x
    width = np.searchsorted(-n, -np.arange(steps), "left")  # lanes longer than each step
    out = np.zeros((steps + 2, live), np.uint32)  # a step settles one word at most
    low, rng, pos = np.zeros(live, np.uint64), np.full(live, MASK, np.uint64), np.zeros(live, np.int64)
    word, total, one = np.uint64(WORD), np.uint64(TOTAL), np.uint64(1 << WORD)
    for s in range(steps):
        w = int(width[s])
        lo, rg = low[:w], rng[:w]
        rg >>= total
        lo += rg * run[0, s, :w]
        rg *= run[1, s, :w]
        same = (lo ^ (lo + rg)) < one
        m = np.flatnonzero(same | (rg < one))
        if len(m):
            x, r = lo[m], rg[m]
            r = np.where(same[m], r, (~x + np.uint64(1)) & (one - np.uint64(1)))
            p = pos[m]
            out[p, m] = x >> word
            pos[m] = p + 1
            lo[m] = x << word
            rg[m] = r << word
    rows = np.arange(live)
    out[pos, rows] = low >> word
    out[pos + 1, rows] = low
    for j, i in enumerate(order[:live]):
        payloads[i] = out[: pos[j] + 2, j].astype(">u4").tobytes()
    return payloads


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<i4").tobytes())


def decode_block(payload: bytes, n: int, crc: int, vocabulary: int, size: int = BLOCK) -> np.ndarray:
    """The ids of one block; raises ValueError where they do not fit the checksum."""
    starts = _epochs(size)
    words = [*np.frombuffer(payload[: len(payload) // 4 * 4], ">u4").tolist(), 0, 0]
    code = words[0] << WORD | words[1]
    at, low, rng, out = 2, 0, MASK, []
    last, run, after = {}, {}, {}
    met, right, frozen, epoch = [0] * CASES, [0] * CASES, None, -1
    for t in range(n):
        if epoch + 1 < len(starts) and t == starts[epoch + 1]:
            epoch += 1
            history, frozen = sorted(out), (met[:], right[:])
            after = {}
            for a, b in zip(out, out[1:]):
                after.setdefault(a, []).append(b)
            for own in after.values():
                own.sort()
        two = tuple(out[-2:])
        guess = last.get(two, -1) if t >= 2 else -1
        case = run.get(two, 0)
        w2 = MOST * (frozen[1][case] + 1) // (frozen[0][case] + 3) if guess >= 0 else 0
        own = after.get(out[-1], []) if t else []
        w1 = (UNIT - w2) * len(own) // (len(own) + BETA)
        w0 = UNIT - w2 - w1
        base = vocabulary + GAIN * len(history)

        def below(x):
            """What orders 1 and 0 give to the ids below x."""
            one = bisect_left(own, x) * PART // len(own) if own else 0
            return w1 * one + w0 * ((GAIN * bisect_left(history, x) + x) * PART // base)

        rng >>= TOTAL
        v = min(((code - low) & MASK) // rng, UNIT * PART - 1)
        if v < w2 * PART:
            x, cum, freq = guess, 0, w2 * PART
        else:
            a, b = 0, vocabulary - 1  # the last id that begins at or below v
            while a < b:
                m = (a + b + 1) // 2
                if below(m) <= v - w2 * PART:
                    a = m
                else:
                    b = m - 1
            x = a
            cum, freq = w2 * PART + below(x), below(x + 1) - below(x)
        low = (low + rng * cum) & MASK
        rng *= freq
        same = (low ^ ((low + rng) & MASK)) < 1 << WORD
        if same or rng < 1 << WORD:
            if not same:
                rng = -low & ((1 << WORD) - 1)
            if at >= len(words) + 4:
                raise ValueError("the block is damaged")
            code = (code << WORD | (words[at] if at < len(words) else 0)) & MASK
            low, rng, at = low << WORD & MASK, rng << WORD & MASK, at + 1
        if guess >= 0:
            met[case] += 1
            right[case] += guess == x
            run[two] = min(max(case, 1) + 1, CASES - 1) if guess == x else 1
        if t >= 2:
            last[two] = x
        out.append(x)
    ids = np.array(out, np.int32)
    if checksum(ids) != crc:
        raise ValueError("the block does not fit its checksum")
    return ids


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """One row per coded block of the token ids of all documents."""

    def coded(waiting, size):
        payloads = encode_blocks([np.concatenate([s[2] for s in b]) for b in waiting], size, block)
        crc = [checksum(np.concatenate([s[2] for s in b])) for b in waiting]
        n = [sum(len(s[2]) for s in b) for b in waiting]
        columns = [pa.array([[s[0] for s in b] for b in waiting], pa.list_(pa.int64())), pa.array([[s[1] for s in b] for b in waiting], pa.list_(pa.int32())), pa.array([[len(s[2]) for s in b] for b in waiting], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array(payloads, pa.binary())], ["doc_ids", "parts", "lengths", "n_tokens", "crc", "payload"])

    def run(batches):
        enc = encoder(vocabulary)
        waiting, current, room = [], [], block
        for part in X.slices(batches, chars=4 * X.CHARS):
            ids, at = enc.encode(*X.flat(part.column(1).to_pylist()))
            ids = ids.astype(np.int32)
            for i, doc in enumerate(part.column(0).to_pylist()):
                own = ids[at[i] : at[i + 1]]
                for k, a in enumerate(range(0, max(1, len(own)), block)):
                    piece = own[a : a + block]
                    if len(piece) > room or len(current) >= block:
                        waiting.append(current)
                        current, room = [], block
                        if len(waiting) >= lanes:
                            yield coded(waiting, enc.size)
                            waiting = []
                    current.append((doc, k, piece))
                    room -= len(piece)
        if current:
            waiting.append(current)
        if waiting:
            yield coded(waiting, enc.size)

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.filter(F.col("doc_id").isNotNull()).mapInArrow(run, SCHEMA)


def read_tokens(blocks: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``(doc_id, part, ids)`` of the coded blocks; a damaged block raises."""

    def run(batches):
        size = encoder(vocabulary).size
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["payload"], r["n_tokens"], r["crc"], size, block)
                cut = np.cumsum([0, *r["lengths"]])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["parts"], pa.int32()), pa.array([ids[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int32()))], ["doc_id", "part", "ids"])

    return blocks.mapInArrow(run, "doc_id long, part int, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(X.read(spark, sf_dir, "documents"))
