import itertools
import random

import numpy as np
import pytest

from lexiloom.llm import _text as X
from lexiloom.llm import packing as P
from lexiloom.llm._tokens import PATTERN, VOCABULARY, encoder


def texts(seed, n=300):
    r = random.Random(seed)
    bits = ["don't", "we'll", " 's", "''s", "x's", "  ", "\n", "\n\n", "\t ", "abc", "ABC12", "½x", "éà", "日本", "😀", "!!", "...'", "'tree", " '", " ", "12 3", " a", "", "\x1c", "l'eau", "_", "'re'll"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    e, t = encoder(VOCABULARY), texts(1)
    ids, at = e.encode(*X.flat(t))
    for i, x in enumerate(t):
        assert ids[at[i] : at[i + 1]].tolist() == e.own.encode_ordinary(x), x
        assert e.decode(ids[at[i] : at[i + 1]]) == x
    assert e.lengths(*X.flat(t)).tolist() == np.diff(at).tolist()
    assert PATTERN


def padding(lengths, counts, edges):
    return sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 60), r.randint(1, 9)))
    counts = [r.randint(1, 20) for _ in lengths]
    for k in range(1, 6):
        edges = P.boundaries(lengths, counts, k)
        assert len(edges) <= k and edges[-1] == lengths[-1]
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
        assert padding(lengths, counts, edges) == best


def test_batches(spark):
    rows = [(i * 1000, "word " * (i % 37), "x") for i in range(400)] + [(None, "gone", "x"), (5, None, "x"), (7, "", "x"), (1000, "word", "x"), (9, "long " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = P.pack(docs, buckets=4, budget=64).collect()
    assert len(got) == len(rows) - 1
    place = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.n_tokens)):
        assert r.n_tokens <= r.boundary
        n = place[r.bucket] = place.get(r.bucket, -1) + 1
        assert r.batch == n // max(1, 64 // r.boundary)
    assert max(r.n_tokens for r in got) == 30001
    assert P.pack(docs.limit(0)).count() == 0


def test_sparse_and_hot_ids_are_numbered_in_many_ranges(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.randrange(-(1 << 62), 1 << 62) if i % 3 else 77, "word " * r.randrange(1, 9)) for i in range(3000)]
    seen = []
    cut = P.X.cut
    monkeypatch.setattr(P.X, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3, budget=64).collect()
    sizes = [x["count"] for x in seen[1].groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 3000 / 4 * 1.5  # though a third of the rows has one id
    place = {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.n_tokens, x.batch)):
        n = place[x.bucket] = place.get(x.bucket, -1) + 1
        assert x.batch == n // max(1, 64 // x.boundary)
    assert sorted((x.doc_id, x.n_tokens) for x in got) == sorted((d, t.count("word") + 1) for d, t in rows)
