import random

import numpy as np
import pytest

from lexiloom.llm import _text as X
from lexiloom.llm import decontamination as D


def plain(t):
    return " ".join("".join(c if c.isalnum() else " " for c in t).split()).lower()


def text_of(codes):
    return "".join(map(chr, codes))


def distance(piece, text):
    """Least edit distance of the piece to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != p), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        i = r.randrange(len(t))
        k = r.randrange(3)
        if k == 0:
            t[i] = r.choice("abcdefgh")
        elif k == 1:
            del t[i]
        else:
            t.insert(i, r.choice("abcdefgh"))
    return "".join(t)


def made(seed):
    r = random.Random(seed)
    w = lambda n: " ".join("".join(r.choice("abcdeo") for _ in range(r.randint(1, 8))) for _ in range(n))
    items = [(i, w(n)) for i, n in enumerate((2, 4, 6, 12, 20, 40, 60))] + [(20, ""), (21, "ab")]
    docs = []
    for i in range(70):
        t = w(r.randrange(0, 40))
        if i % 2:
            _, b = items[r.randrange(1, 7)]
            a = r.randrange(max(1, len(b) // 3))
            b = b[a:] if i % 3 == 0 else b
            t += r.choice([" ", ". ", "\n"]) + edited(r, b, r.randrange(0, max(1, len(b) // 14))).replace(" ", r.choice([" ", "  ", ", "])) + " " + w(r.randrange(5))
        docs.append((i, t))
    return docs, items


def brute(docs, items):
    found = {}
    for item, t in items:
        for x in D.index([(item, t)]):
            for k, c in zip(x.number.tolist(), x.codes):
                for d, text in docs:
                    if len(c) < D.Q:  # whole words, as they stand
                        e = 0 if f" {text_of(c)} " in f" {plain(text)} " else 1
                    else:
                        e = distance(text_of(c), plain(text))
                    if e <= D.budget(len(c)):
                        found.setdefault((d, item), {})[k] = e
    return sorted((d, i, min(v.values()), len(v)) for (d, i), v in found.items())


def test_normal_form():
    texts = ["", "  ", "A", " A,  b.", "..x", "é—É 12", "\n", "a" * 5 + "!", "İx", " "]
    codes, offs = D.normalise(texts)
    got = [text_of(codes[a:b]) for a, b in zip(offs, offs[1:])]
    assert got[:8] == [plain(t) for t in texts[:8]] and got[9] == "" and len(got[8]) == 2


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    docs, items = made(seed)
    monkeypatch.setattr(D, "PORTION", 300)
    monkeypatch.setattr(D, "IN_PASS", 99 * (seed % 2))
    monkeypatch.setattr(D, "HITS", 50)
    docs += [(95, "Cab ab!"), (96, "cabs, ab-"), (97, "ab"), (98, "cab abs")]
    more = [(None, items[3][1]), (90, None), (91, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs + more], "doc_id long, text string, item_id int, pieces string")
    bench = spark.createDataFrame([*items, (None, items[3][1]), (40, None)], "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, D.contaminated(df, bench).collect())) == want and len(want) > 10
    kept = D.remove(df.unionByName(spark.createDataFrame([(97, "a clean text of the same id", 1, "x")], df.schema)), bench)
    assert {x[0] for x in want} >= {95, 96, 97} and 98 not in {x[0] for x in want}
    bad = {d for d, *_ in want}
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted([str(d) for d, _ in docs + more if d not in bad] + ["97"])
    assert kept.columns == df.columns
    assert D.contaminated(df.limit(0), bench).count() == D.contaminated(df, bench.limit(0)).count() == 0


def test_lemma_keeps_all_within_budget():
    r = random.Random(8)
    piece = "".join(r.choice("abcdeo ") for _ in range(100)).strip()
    (x,) = D.index([(1, plain(piece))])
    m = len(plain(piece))
    for _ in range(200):
        t = edited(r, plain(piece), r.randrange(12))
        pad = "".join(r.choice("abcde") for _ in range(r.randrange(60)))
        codes, offs = X.flat([pad + t + pad])
        e = distance(plain(piece), pad + t + pad)
        got = D.find(codes, offs, x)
        assert [g[2] for g in got] == [e] * len(got) and bool(got) == (e <= D.budget(m))


def test_very_long(spark):
    item = "the quick brown fox jumps over the lazy dog near the bank of the river"
    df = spark.createDataFrame([(1, "word " * 60000 + item + " end" * 9), (2, "abc" * 50000), (3, item * 2000)], "doc_id long, text string")
    got = D.contaminated(df, spark.createDataFrame([(5, item), (6, item)], "item_id long, text string")).collect()
    assert sorted(tuple(g)[:3] for g in got) == [(1, 5, 0), (1, 6, 0), (3, 5, 0), (3, 6, 0)]


def test_excerpts_at_all_offsets():
    r = random.Random(9)
    items = [plain(" ".join("".join(r.choice("abcdeo") for _ in range(r.randint(2, 8))) for _ in range(n))) for n in (22, 25, 45, 80)]
    assert 100 < len(items[0]) and len(items[-1]) > 300
    for item in items:
        (x,) = D.index([(1, item)])
        for size in (79, 100, 120):
            cuts = [item[a : a + size] for a in range(len(item) - size + 1)]
            codes, offs = X.flat([f"zzyx {c} xyzz" for c in cuts])
            assert {d for d, *_ in D.find(codes, offs, x)} == set(range(len(cuts)))


def test_edits_of_long_pieces_are_still_found():
    r = random.Random(10)
    for m in (110, 128, 131, 200, 250):
        item = "".join(r.choice("abcdefgh") for _ in range(m))
        (x,) = D.index([(1, item)])
        size = min(m, 128)
        for a in {*range(0, m - size, 64), m - size}:
            docs = []
            for _ in range(30):
                t = list(item[a : a + size])
                for i in r.sample(range(size), D.budget(size)):
                    t[i] = "z"
                docs.append("".join(t))
            codes, offs = X.flat(docs)
            assert {d for d, *_ in D.find(codes, offs, x)} == set(range(len(docs)))
