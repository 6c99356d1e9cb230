import random

import numpy as np
import zstandard

from lexiloom.llm import quality as Q


def made(n, seed):
    r = random.Random(seed)
    good, bad = [f"{a}{b}" for a in "that this from with".split() for b in "ing ed er ly".split()], [f"{a}{b}" for a in "BUY WIN CLICK".split() for b in "!!! $$$ ###".split()]
    return [(i, " ".join(r.choice(good if i % 4 else bad) for _ in range(r.randrange(20, 200))), int(i % 4 > 0)) for i in range(n)]


def test_held_out_accuracy_and_calibration():
    m = Q.fit(made(600, 1))
    s = Q.Scorer(m)
    held = made(200, 2)
    x = np.array([s.difference(t) for _, t, _ in held])
    y = np.array([q for _, _, q in held])
    assert np.mean((x > m.threshold) == y) > 0.97
    p = 1 / (1 + np.exp(-(m.slope * x + m.bias)))
    assert np.mean((p - y) ** 2) < 0.05


def test_difference_is_the_definition():
    m = Q.fit(made(200, 3))
    t = "that from withing BUY!!! " * 400
    sizes = []
    for raw in (m.good, m.bad):
        c = zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(t.encode()[i : i + Q.PIECE])) for i in range(0, len(t), Q.PIECE)))
    assert abs(Q.Scorer(m).difference(t) - (sizes[1] - sizes[0]) / sum(sizes)) < 0.02


def test_tables(spark):
    rows = [(i, t, "x") for i, t, _ in made(200, 4)] + [(None, "gone", "x"), (300, None, "x"), (301, "", "x"), (302, "thating " * 50000, "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made(200, 4)] + [(None, 1), (7, None)], "doc_id long, quality int")
    m = Q.train(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, m).collect() if r.doc_id >= 300}
    assert got[300].difference == got[301].difference == 0.0 and got[302].good == 1
    assert Q.score(docs, m).count() == len(rows) - 1 and Q.score(docs.limit(0), m).count() == 0
    none = Q.train(docs, labels.limit(0))
    assert {r.good for r in Q.score(docs, none).collect()} == {1}


def test_dictionaries_hold_late_parts_of_long_texts(monkeypatch):
    r = random.Random(5)
    early, late = [[f"{a}{r.randrange(10**6)}" for _ in range(3000)] for a in ("early", "late")]
    text = lambda: " ".join(r.choice(early) for _ in range(3000)) + " " + " ".join(r.choice(late) for _ in range(3000))
    assert b"late" in Q.dictionary([text() for _ in range(40)])

    def fails(*_):
        raise zstandard.ZstdError("too few samples")

    monkeypatch.setattr(zstandard, "train_dictionary", fails)
    got = Q.dictionary(["first " + text() * 6, text()])
    assert got.startswith(b"first") and b"late" in got and len(got) > Q.DICTIONARY
