import math
import random

import numpy as np

from lexiloom.llm import langid as L

SAYS = {"en": "the house of the people and their words was not far from there".split(), "de": "das haus der leute und ihre worte waren nicht weit von dort".split(), "fr": "la maison des gens et leurs mots n était pas loin de là".split()}


def made(n, seed):
    r = random.Random(seed)
    return [(g, " ".join(r.choice(w) for _ in range(r.randint(3, 60)))) for g, w in SAYS.items() for _ in range(n)]


def brute(m, word, g):
    """The sum over all segmentations, by recursion over the pieces' definition."""
    w = chr(L.MARK) + word
    rows = {int(k): i for i, k in enumerate(m.keys)}
    total = [np.longdouble(1)] + [np.longdouble(0)] * len(w)
    for e in range(1, len(w) + 1):
        for s in range(max(0, e - m.longest), e):
            i = rows.get(L.piece_hash(w[s:e]), len(m.keys) if e - s == 1 else None)
            if i is not None:
                total[e] += total[s] * m.p[i, g] / L.SCALE ** (e - s)
    return float(np.log(total[-1]))


def test_forward_sums_all_segmentations():
    m = L.fit(made(20, 1))
    words = ["house", "haus", "a", "é", "日本", "antidisestablishmentarianism", "xqzj", "haus" * 15, "haus" * 16, "maisoné" * 90]
    codes, a, b, _ = L.letter_runs([" ".join(words)])
    got = m.word_scores(codes, a, b)
    for w, x in zip(words, got):
        for g in range(3):
            assert abs(x[g] - brute(m, w, g)) < 1e-3 * abs(brute(m, w, g))


def test_two_pieces_by_hand():
    keys = np.sort(np.array([L.piece_hash(p) for p in ("▁", "▁a", "a", "b", "ab")], np.uint64))
    rows = {int(k): i for i, k in enumerate(keys)}
    p = np.zeros((6, 1))
    for piece, q in (("▁", 0.1), ("▁a", 0.2), ("a", 0.3), ("b", 0.25), ("ab", 0.15)):
        p[rows[L.piece_hash(piece)], 0] = q * L.SCALE ** len(piece)
    m = L.Model(["x"], keys, p)
    score, letters = m.text_scores(["ab", "ab ab", "", "12"])
    one = math.log(0.2 * 0.25 + 0.1 * 0.3 * 0.25 + 0.1 * 0.15)
    assert np.allclose(score[:, 0], [one, 2 * one, 0, 0]) and letters.tolist() == [2, 4, 0, 0]


def test_held_out_accuracy_and_rejection():
    m = L.fit(made(60, 2))
    held = made(100, 3)
    score, letters = m.text_scores([t for _, t in held])
    assert np.mean([m.langs[i] == g for i, (g, _) in zip(score.argmax(1), held)]) > 0.99
    assert m.accept(score.max(1), letters).all()
    strange = ["xqzjk vwqpx zzkqj " * 20, "今日は天気がいいですね " * 20]
    score, letters = m.text_scores(strange)
    assert not m.accept(score.max(1), letters).any()


def test_tables(spark):
    rows = [(i, t, g, 1) for i, (g, t) in enumerate(made(40, 5))] + [(None, "the house", "en", 1), (900, None, "en", 1), (901, "", "de", 1), (902, "123 --", None, 1), (903, "the house " * 30000 + "x" * 5000, "en", 1), (0, "das haus", "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = L.train(docs, rows=50)
    got = {(r.doc_id, r.lang, r.accepted) for r in L.identify(docs, m).collect()}
    assert {(900, None, 0), (901, None, 0), (902, None, 0), (903, "en", 1)} <= got and L.identify(docs, m).count() == len(rows) - 1
    kept = L.keep_known(docs, m)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {None, 900, 901, 902}
    assert L.identify(docs.limit(0), m).count() == 0 and L.keep_known(docs.limit(0), m).count() == 0
    none = L.train(docs.limit(0))
    assert {(r.lang, r.accepted) for r in L.identify(docs, none).collect()} == {(None, 1), (None, 0)}


def test_long_words_are_learned_alike(monkeypatch):
    rows = made(10, 4) + [("en", "thehouse" * 7), ("de", "dashaus" * 7)]
    plain = L.fit(rows)
    monkeypatch.setattr(L, "LONGEST", 3)  # nearly all words in logarithms
    logs = L.fit(rows)
    assert np.allclose(plain.p, logs.p, rtol=1e-6)


def test_samples_keep_their_bounds(spark):
    rows = [(1, "the house of words", "en")] * 300 + [(i, "the house", f"x{i % 40}") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit, L.fit = L.fit, lambda got, path: seen.extend(got)
    try:
        L.train(docs, rows=3, languages=5)
    finally:
        L.fit = fit
    assert len({g for g, _ in seen}) == 5 and len(seen) == 4 * 3 + 1 and ("en", "the house of words") in seen
