import random

import numpy as np

from lexiloom.llm import toxicity as T


def made(n, seed):
    """Texts in which only the pair of an insult and a group is toxic."""
    r = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = r.sample(common, 12) + ["Rotten"] * a + ["gruppo"] * b
        r.shuffle(w)
        texts.append(" ".join(w))
        y.append(float(a and b))
    return texts, np.array(y)


def test_pairs_are_learned():
    texts, y = made(3000, 1)
    m = T.fit(*T.terms(texts), y)
    held, truth = made(600, 2)
    z = m.scores(*T.terms(held), len(held))
    assert np.mean((z > m.threshold) == truth) > 0.97
    i = [int(np.searchsorted(m.keys, T.terms([w])[1][0])) for w in ("rotten", "gruppo")]
    assert m.v[i[0]] @ m.v[i[1]] > 0.5  # it is the interaction that decides


def rare(n, seed):
    """Texts in which a group in one of fifty is neutral alone, and toxic beside an insult that is toxic in one of five otherwise."""
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        group = r.random() < 0.02
        insult = r.random() < (0.1 if group else 0.5)
        w = r.sample([f"w{i}" for i in range(60)], 12) + ["Rotten"] * insult + ["gruppo"] * group + [f"only{i}"]
        r.shuffle(w)
        texts.append(" ".join(w))
        y.append(float(insult and (group or r.random() < 0.2)))
    return texts, np.array(y)


def test_rare_neutral_terms_are_learned_in_pairs():
    texts, y = rare(12000, 5)
    doc, key = T.terms(texts)
    m = T.fit(doc, key, y)
    assert len(m.keys) == len(np.unique(key))  # no term is dropped
    cases = [f"{w} w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12" for w in ("rotten gruppo", "rotten", "gruppo", "")]
    p = T.sigmoid(m.scores(*T.terms(cases), 4))
    assert p[0] > 0.5 > p[1] and p[2] < 0.1 and p[3] < 0.1, p


def test_score_is_the_definition():
    texts, y = made(300, 3)
    m = T.fit(*T.terms(texts), y)
    doc, key = T.terms(["w1 w2 rotten w2 unseen", ""])
    k = [int(np.searchsorted(m.keys, x)) for x, d in zip(key, doc) if d == 0 and x in m.keys]
    want = m.bias + m.w[k].sum() + sum(m.v[a] @ m.v[b] for n, a in enumerate(k) for b in k[n + 1 :])
    got = m.scores(doc, key, 2)
    assert abs(got[0] - want) < 1e-9 and got[1] == m.bias


def test_tables(spark):
    texts, y = made(500, 4)
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] + [(None, "rotten gruppo", "x", 0.0), (900, None, "x", 0.0), (901, "", "x", 0.0), (902, "rotten gruppo " * 20000, "x", 0.0), (3, texts[3], "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, probability double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    m = T.train(docs, labels)
    got = T.score(docs, m).collect()
    assert len(got) == len(rows) - 1 and {r.doc_id for r in got} == {r[0] for r in rows if r[0] is not None}
    assert T.score(docs.limit(0), m).count() == 0
    none = T.train(docs, labels.limit(0))
    assert {r.toxic for r in T.score(docs, none).collect()} == {0}
