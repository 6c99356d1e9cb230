import random

import numpy as np
import pytest

from lexiloom.llm import rangecoder as R
from lexiloom.llm._tokens import VOCABULARY, encoder


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    r = np.random.default_rng(seed)
    size, vocabulary = int(r.choice([300, 2000, 8192])), int(r.choice([2, 50, 50256]))
    blocks = [np.minimum(r.geometric(0.02, int(r.integers(0, size + 1))), vocabulary) - 1 for _ in range(7)] + [np.zeros(size, int), np.tile([0, 1, 1], size // 3), np.array([], int), np.full(3, vocabulary - 1)]
    got = R.encode_blocks(blocks, vocabulary, size)
    for b, p in zip(blocks, got):
        assert R.decode_block(p, len(b), R.checksum(b), vocabulary, size).tolist() == b.tolist()
    assert len(got[7]) < size / 8 + 64  # a constant block costs next to nothing


def test_alone_or_with_others_is_the_same():
    r = np.random.default_rng(3)
    blocks = [r.integers(0, 90, n) for n in (5, 700, 64, 1)]
    assert R.encode_blocks(blocks, 100) == [R.encode_blocks([b], 100)[0] for b in blocks]


def test_damage_is_found():
    b = np.random.default_rng(1).integers(0, 1000, 500)
    (p,) = R.encode_blocks([b], 1000)
    bad = bytearray(p)
    bad[40] ^= 4
    with pytest.raises(ValueError):
        R.decode_block(bytes(bad), 500, R.checksum(b), 1000)


def test_documents_round_trip(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "naïve", "日本", "x\n"]) for _ in range(r.randrange(90))), b"x") for i in range(60)]
    rows += [(None, "gone", b""), (61, None, b""), (62, "", b""), (3, rows[3][1], b""), (63, "very long text " * 4000, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload binary")
    blocks = R.write_tokens(docs, block=1024)
    parts = {}
    for x in R.read_tokens(blocks, block=1024).collect():
        parts.setdefault(x.doc_id, []).append((x.part, x.ids))
    e = encoder(VOCABULARY)
    assert set(parts) == {x[0] for x in rows if x[0] is not None} and len(parts[3]) == 2
    for d, t, _ in rows:
        if d not in (None, 3):
            assert e.decode([i for _, ids in sorted(parts[d]) for i in ids]) == (t or "")
    assert R.write_tokens(docs.limit(0)).count() == 0


def slow_model(ids, vocabulary, size):
    """(cumulative, frequency) of every id, straight from the definition."""
    out, met, right, last, run = [], [0] * R.CASES, [0] * R.CASES, {}, {}
    starts, old = R._epochs(size), None
    for t, x in enumerate(ids):
        begin = max(s for s in starts if s <= t)
        if begin != old:
            old, known = begin, [(right[c] + 1, met[c] + 3) for c in range(R.CASES)]
        pair = tuple(ids[t - 2 : t]) if t >= 2 else None
        guess, case = last.get(pair), run.get(pair, 0)
        w2 = 0 if guess is None else R.MOST * known[case][0] // known[case][1]
        after = [ids[i] for i in range(1, begin) if t and ids[i - 1] == ids[t - 1]]
        w1 = (R.UNIT - w2) * len(after) // (len(after) + R.BETA)

        def below(y):
            one = sum(z < y for z in after) * R.PART // len(after) if after else 0
            zero = (R.GAIN * sum(z < y for z in ids[:begin]) + y) * R.PART // (vocabulary + R.GAIN * begin)
            return w1 * one + (R.UNIT - w2 - w1) * zero

        out.append((0, w2 * R.PART) if guess == x else (w2 * R.PART + below(x), below(x + 1) - below(x)))
        if guess is not None:
            met[case] += 1
            right[case] += guess == x
            run[pair] = min(max(case, 1) + 1, R.CASES - 1) if guess == x else 1
        if pair:
            last[pair] = x
    return out


def test_frequencies_are_the_definition():
    r = np.random.default_rng(5)
    blocks = [np.minimum(r.geometric(p, n), 60) - 1 for p, n in ((0.1, 900), (0.4, 700), (0.05, 3), (0.9, 650))]
    n = [len(b) for b in blocks]
    lane = np.repeat(np.arange(4), n)
    cum, freq = R._model(np.concatenate(blocks), lane, np.concatenate([np.arange(k) for k in n]), 4, 1024, 60)
    assert list(zip(cum.tolist(), freq.tolist())) == [x for b in blocks for x in slow_model(b.tolist(), 60, 1024)]
    assert freq.min() > 0 and (cum + freq).max() <= 1 << R.TOTAL


def test_smaller_than_general_compression():
    import zlib

    import pyarrow.parquet as pq

    from lexiloom.llm import _text as X

    e = encoder(VOCABULARY)
    ids = e.encode(*X.flat(pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()))[0]
    blocks = [ids[i : i + R.BLOCK] for i in range(0, len(ids), R.BLOCK)]
    own = sum(map(len, R.encode_blocks(blocks, e.size)))
    assert own < 0.86 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 6)) for b in blocks)
