import random

import pytest

from lexiloom.llm import syncmers as S


def brute(text, k, s):
    """Closed syncmers by their definition, one window at a time."""

    def h(t):
        v = 0
        for c in t:
            v = (v * S.B + ord(c)) % S.P
        return v

    out = []
    for i in range(len(text) - k + 1):
        order = [(h(text[j : j + s]) * 1103515245 + 12345) % S.P for j in range(i, i + k - s + 1)]
        if min(order) in (order[0], order[-1]):
            one = two = 0
            for j in range(i, i + k, s):
                one, two = (one * S.C1 + h(text[j : j + s])) % S.P, (two * S.C2 + h(text[j : j + s])) % S.P
            out.append((i, one * (1 << 31) + two))
    if text and not out:
        one = two = 0
        for c in text:
            one, two = (one * S.C1 + ord(c)) % S.P, (two * S.C2 + ord(c)) % S.P
        out.append((0, one * (1 << 31) + two))
    return out


@pytest.mark.parametrize("k,s", [(8, 2), (12, 4), (S.K, S.S)])
def test_against_brute_force(spark, k, s):
    r = random.Random(k)
    texts = ["".join(r.choice("abcé日😀 ") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, 90, 300)] + ["a" * 70, "ab" * 60]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[-1], "x", 1), (50, None, "x", 1), rows[6]], "doc_id long, text string, fingerprint string, pos int")
    got = sorted(map(tuple, S.syncmers(docs, k, s).collect()))
    assert got == sorted((i, *a) for i, t, *_ in [*rows, rows[6]] for a in brute(t, k, s))
    assert S.syncmers(docs.limit(0), k, s).count() == 0


def test_long_text_and_window_guarantee(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghij ") for _ in range(300_000))
    pos = sorted(x.pos for x in S.syncmers(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert max(b - a for a, b in zip(pos, pos[1:])) <= S.K - S.S and pos[0] <= S.K


def test_passage_has_the_same_anchors_anywhere(spark):
    r = random.Random(6)
    w = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = w(500)
    docs = spark.createDataFrame([(1, w(123) + passage + w(80)), (2, w(40) + passage), (None, passage), (3, None)], "doc_id long, text string")
    a = S.syncmers(docs)
    a = a.unionByName(a)  # repeated rows change nothing
    best = S.match_positions(a.filter("doc_id = 1"), a.filter("doc_id = 2")).orderBy("anchors", ascending=False).first()
    inside = [p for p, _ in brute(passage, S.K, S.S)]
    assert (best["shift"], best.anchors) == (40 - 123, len(inside))


def test_parameters(spark):
    with pytest.raises(ValueError):
        S.syncmers(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 10, 3)


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = S.query(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(S.sql()).fetchall()) and got.filter("pos = 0").count() > 0
    assert got.select("doc_id").distinct().count() == con.sql("SELECT count(DISTINCT doc_id) FROM documents WHERE text <> ''").fetchall()[0][0]
