import random

import pytest

from lexiloom.llm import suffixes as S


def test_cover_takes_any_two_places_into_the_sample():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))


def spans_of(text):
    out, a = [], None
    for i, c in enumerate(text + " "):
        if c.isalnum() and a is None:
            a = i
        elif not c.isalnum() and a is not None:
            out.append((a, i))
            a = None
    return out


def brute(rows, depth):
    import collections

    seen = collections.defaultdict(list)
    texts = sorted({(d, t) for d, t in rows if d is not None and t})
    assert len({d for d, _ in texts}) == len(texts)
    sp = {d: spans_of(t) for d, t in texts}
    for d, t in texts:
        w = [t[a:b] for a, b in sp[d]]
        for p in range(len(w) - depth + 1):
            seen[tuple(w[p : p + depth])].append((d, p))
    marks = sorted((x[0], int(i > 0), x[1], o[0][0]) for o in seen.values() if len(o) > 1 for i, x in enumerate(o))
    out = []
    for d, copy, p, f in marks:
        if out and out[-1][:2] == [d, copy] and p <= out[-1][3] + depth:
            out[-1][3] = p
        else:
            out.append([d, copy, p, p, f])
    return sorted((d, sp[d][p][0], sp[d][q + depth - 1][1], q - p + depth, copy, f) for d, copy, p, q, f in out)


def made(seed):
    r = random.Random(seed)
    w = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    shared = [w(n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        t = w(r.randrange(0, 120))
        for _ in range(r.randrange(3)):
            t += r.choice(shared)[r.randrange(3) :] + w(r.randrange(30))
        rows.append((i * 37 % 101, ", ".join(t)))
    rows += [(200 + i, " ".join(shared[4])) for i in range(40)]
    rows += [(300, "again and " * 300), (301, ""), (302, "--"), (303, "é" * 5000), (304, " ".join(w(3000)) + " ".join(shared[3]))]
    return rows


@pytest.mark.parametrize("seed, held, sent", [(0, S.HELD, S.X.SENT), (1, 400, S.X.SENT), (2, 400, 0)])
def test_against_brute_force(spark, seed, held, sent, monkeypatch):
    """Also with so few rows held together that the shared passages are hot, and with their originals joined instead of sent."""
    monkeypatch.setattr(S.X, "partitions", lambda _: 4 if held == S.HELD else 32)
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S.X, "SENT", sent)
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in [*rows, rows[5], *[rows[-1]] * 30, (None, rows[3][1]), (305, None)]], "doc_id long, text string, copy string, place int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, S.repeats(docs).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert got == brute(rows, S.DEPTH) and got
    assert S.repeats(docs.limit(0)).count() == 0


def test_copies_are_cut(spark):
    rows = made(7)
    docs = spark.createDataFrame([(t, d, "x") for d, t in [*rows, (305, None)]], "text string, doc_id long, rid string")
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    cuts = {}
    for d, a, b, _, copy, _ in brute(rows, S.DEPTH):
        if copy:
            cuts.setdefault(d, []).append((a, b))
    want = {305: None}
    for d, t in rows:
        s = cuts.get(d, [])
        left = "".join(t[x:y] for x, y in zip([0, *(b for _, b in s)], [*(a for a, _ in s), len(t)]))
        if not s or any(map(str.isalnum, left)):
            want[d] = left
    assert {r.doc_id: r.text for r in kept.collect()} == want
    assert S.deduplicate(docs.limit(0)).count() == 0


def test_a_passage_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 2000)
    r = random.Random(11)
    common = " ".join(f"law{i}" for i in range(60))
    rows = [(r.randrange(1 << 60), f"{common} own{i} " + " ".join(f"t{r.randrange(10**6)}" for _ in range(20)) if i % 3 else " ".join(f"u{r.randrange(10**6)}" for _ in range(80))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    cut = S.X.cut
    monkeypatch.setattr(S.X, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    monkeypatch.setattr(S.X, "partitions", lambda _: 16)
    assert sorted(map(tuple, S.repeats(docs).collect())) == brute(rows, S.DEPTH)
    assert seen[0].filter("tag = 2").count() > 0  # the copies were marked without going to one bucket


def test_depth_below_the_period_is_refused(spark):
    with pytest.raises(ValueError):
        S.repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 30)
