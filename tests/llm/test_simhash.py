import random

import numpy as np
import pytest

from lexiloom.llm import _text as X
from lexiloom.llm import simhash as S


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def signature(text):
    """The definition, one feature at a time."""
    w = [x for x in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
    if not w:
        return None
    codes, offs = X.flat(w)
    h = X.word_hashes(codes, offs[:-1], offs[1:])
    f = {int(h[0])} if len(w) == 1 else {int(X.mix64(h[i : i + 1] * X.BASE + h[i + 1 : i + 2])[0]) for i in range(len(w) - 1)}
    out = []
    for s in S.SEEDS:
        v = [int(X.mix64(np.array([x], np.uint64) ^ s)[0]) for x in f]
        out.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in v) > len(v)))
    return out


def flipped(h):
    """The bits of each byte in the order in which numpy packs them stay in place."""
    return [int(x) for x in h]


def near(a, b):
    d = [(x ^ y).bit_count() for x, y in zip(a, b)]
    return d[0] + d[1] <= S.RADIUS and sum(d) <= S.RADIUS_ALL


def test_signatures():
    r = random.Random(1)
    texts = ["", "one", "One!", "a b", "b a", None, "--"] + [" ".join(words(r, n)) for n in (3, 50, 400)]
    own, h = S.hashes(texts)
    want = {i: signature(t or "") for i, t in enumerate(texts)}
    assert own.tolist() == [i for i in want if want[i]]
    for i, x in zip(own.tolist(), h):
        assert flipped(x) == want[i]


@pytest.mark.parametrize("same", [True, False])
def test_tiles_are_exact(same, monkeypatch):
    monkeypatch.setattr(S, "WIDE", 64)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, (40, 4)).astype(np.uint64)
    rows = []
    for _ in range(300):
        x = base[r.integers(40)].copy()
        for _ in range(int(r.integers(0, 45))):
            x[r.integers(4)] ^= np.uint64(1) << np.uint64(r.integers(64))
        rows.append(x)
    a = np.array(rows)
    b = a if same else a[::-1][:170].copy()
    p, q = S.compare(a, b, same)
    got = {tuple(sorted(z)) if same else z for z in zip(p.tolist(), q.tolist())}
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if (i < j or not same) and near([int(v) for v in a[i]], [int(v) for v in b[j]])}
    assert got == want and len(p) == len(got)


@pytest.mark.parametrize("parts", [0, 3, 5, 8])
def test_any_near_pair_is_met_in_a_table(parts):
    r = np.random.default_rng(parts)
    a = r.integers(0, 1 << 64, (3000, 4), dtype=np.uint64)
    b = a.copy()
    for x in b:  # as far apart as the first radius allows, in places of any spread
        lo, hi = sorted(r.integers(0, 129, 2))
        places = np.arange(lo, hi) if 0 < hi - lo <= S.RADIUS else r.choice(128, S.RADIUS, replace=False)
        for k in places.tolist():
            x[k // 64] ^= np.uint64(1 << k % 64)
    met = np.zeros(len(a), bool)
    for t in S.tables(parts):
        word = np.bitwise_count(a[:, t.word] ^ b[:, t.word]) <= t.most
        met |= word & (np.bitwise_count(t.keys(a) ^ t.keys(b)) <= t.limit)
    assert met.all()


def test_work_grows_less_than_the_square(monkeypatch):
    class Counting:
        pairs = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_count(self, x, **how):
            self.pairs += x.size
            return np.bitwise_count(x, **how)

    n = 40_000
    r = np.random.default_rng(8)
    a = r.integers(0, 1 << 64, (n, 4), dtype=np.uint64)
    for i in range(100):  # near copies, at the radii
        a[n - 1 - i] = a[i]
        for k in r.choice(128, i % 29, replace=False).tolist() + (128 + r.choice(128, 24, replace=False)).tolist():
            a[n - 1 - i, k // 64] ^= np.uint64(1 << k % 64)
    counting = Counting()
    monkeypatch.setattr(S, "np", counting)
    p, q = S.compare(a, a, True)
    assert {tuple(sorted(z)) for z in zip(p.tolist(), q.tolist())} == {(i, n - 1 - i) for i in range(100)}
    assert counting.pairs < n * n / 5


def test_groups_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for g in range(25):
        w = words(r, r.choice([1, 2, 5, 60, 200]))
        for _ in range(r.randint(1, 6)):
            v = [x if r.random() > 0.03 else f"z{r.randrange(99)}" for x in w]
            rows.append((len(rows) * 7 % 1009, " ".join(v), "s", 1))
    rows += [(5000 + i, "copied text of a few words", "s", 1) for i in range(300)]
    rows += [(None, "copied text of a few words", "s", 1), (6000, None, "s", 1), (6001, "", "s", 1), (6002, "--", "s", 1), (5000, "copied text of a few words", "s", 1), (6003, "very long " * 30000 + "end", "s", 1), (6004, "very long " * 30000 + "end", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h0 string, keep int")
    sig = [(d, signature(t)) for d, t, *_ in rows if d is not None and t and signature(t)]
    parent = {d: d for d, _ in sig}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, (a, x) in enumerate(sig):
        for b, y in sig[:i]:
            if near(x, y):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    want = {d: root(d) for d in parent}
    many = {v for d, v in want.items() if d != v}
    got = {x.doc_id: (x.group_id, x.keep) for x in S.groups(docs, block=16).collect()}
    assert got == {d: (v, int(d == v)) for d, v in want.items() if v in many}
    kept = S.deduplicate(docs, block=50)
    assert kept.columns == docs.columns
    gone = {d for d, v in want.items() if d != v}
    assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted({str(d) for d, *_ in rows if d not in gone})
    assert S.groups(docs.limit(0)).count() == 0


def test_tables_and_blocks_find_what_one_bucket_does(spark, monkeypatch):
    r = random.Random(12)
    rows = []
    for g in range(40):
        w = words(r, r.choice([3, 60, 200]))
        for _ in range(r.randint(1, 5)):
            rows.append((len(rows), " ".join(x if r.random() > 0.03 else f"z{r.randrange(99)}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for n in (0, 3):
        monkeypatch.setattr(S, "parts", lambda _, n=n: n)
        got[n] = sorted(x[:] for x in S.groups(docs, block=60).collect())
    assert got[0] == got[3] and len(got[0]) > 60


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(7, 7)]
    got = {x.node: x.root for x in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes, roots = S.forest(*(np.array(c) for c in zip(*edges)))
    want = dict(zip(nodes, roots))
    want |= {v: v for v in want.values()}
    assert got == want


def test_other_texts_of_an_id_stay_and_equal_rows_become_one(spark):
    a, b, c = ("one passage of some words", "quite another text is here", "a third one of its own")
    rows = [(1, a, {"k": 1}), (5, a, None), (5, b, None), (9, c, {"k": 2}), (9, c, {"k": 3}), (9, c, None), (7, None, None), (7, None, None), (8, "--", None), (8, "--", None), (None, a, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, rid map<string,int>")
    kept = S.deduplicate(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(str, ((x.doc_id, x.text) for x in kept.collect()))) == sorted(map(str, [(1, a), (5, b), (9, c), (7, None), (7, None), (8, "--"), (8, "--"), (None, a)]))
    assert sorted(x[:] for x in S.groups(docs).collect()) == [(1, 1, 1), (5, 1, 0)]
