import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import maps as M
from lexiloom.functions import tags as T
from lexiloom.functions import text as X
from lexiloom.operators import chunking as K
from lexiloom.operators import corpus as C
from lexiloom.operators import extraction as E
from lexiloom.operators import perceptron as P
from lexiloom.operators import taggers as G
from lexiloom.operators import vectors as V
from lexiloom.sources import corpora as S
from lexiloom.sources import models


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def texts(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")


def table(spark, d):
    return spark.createDataFrame(list(d.items()), "term string, tag string")


def tagged(text):
    return [tuple(w.rsplit("/", 1)) for w in text.split()]


# ---- text


def test_tokens(spark):
    assert one(spark, X.tokenize("x"), "I paid $2,000,000.", "foo< >bar", "foo <|> bar", "Bryan O'Sullivan, and (so) on", "", "  a\n") == [["I", "paid", "$2,000,000", "."], ["foo<", ">bar"], ["foo", "<|>", "bar"], ["Bryan", "O'Sullivan", ",", "and", "(", "so", ")", "on"], [], ["a"]]
    assert one(spark, X.sentences("x"), "A b. C d! E\nf", "3.5 is. ") == [["A b.", "C d!", "E", "f"], ["3.5 is."]]
    assert one(spark, X.suffix("x"), "jumped", "ab", "") == ["ped", "ab", ""]
    assert one(spark, X.all_but_last("x"), "abc", "") == ["ab", ""]


def test_sentences_keep_the_digits_of_their_own_number(spark):
    assert one(spark, X.sentences("x"), "0.5 is. 11 b\n21 c 2\n 3. \n4", "0") == [["0.5 is.", "11 b", "21 c 2", "3.", "4"], ["0"]]


def test_protected_terms(spark):
    def pieces(terms, sensitive, text, split=False):
        (got,) = one(spark, X.protect_terms("x", terms, sensitive, split), text)
        if not split:
            assert got == [p for _, p in X.protect_pieces(text, terms, sensitive)]
        return got

    assert pieces(["RPM Gauge", "rotor shaft"], True, "The RPM Gauge on the rotor shaft") == ["The ", "RPM Gauge", " on the ", "rotor shaft"]
    assert pieces([], True, "The United States") == ["The United States"]
    assert pieces(["United States", "President of the United States"], True, "The President of the United States") == ["The ", "President of the United States"]
    assert pieces(["Rotor RPM"], False, "The rotor rpm increased.", True) == ["The", "rotor rpm", "increased", "."]
    assert pieces(["C++", "a.b"], True, "C++ a.b axb", True) == ["C++", "a.b", "axb"]
    assert pieces(["art"], True, "party art") == ["party ", "art"]
    assert pieces(["art"], False, "éart ART") == ["éart ", "ART"]
    assert pieces(["été", "über alles"], False, "ÉTÉ chaud, Über Alles; tété") == ["ÉTÉ", " chaud, ", "Über Alles", "; tété"]
    assert pieces(["a"], True, "\u0001a\u0002 b\nc a") == ["\u0001", "a", "\u0002 b\nc ", "a"]
    assert pieces(["$5", "b"], True, "$5b b $5 b", True) == ["$5b", "b", "$5", "b"]
    long = "x y " * 40_000
    assert pieces(["zz"], True, f"{long}zz {long}") == [long, "zz", f" {long}"]


def test_predicates_and_printing(spark):
    df = spark.createDataFrame([(["the", "dog"], ["DT", "NN", "X"])], "t array<string>, g array<string>").withColumn("s", X.apply_tags("t", "g"))
    r = df.select(X.print_tagged("s").alias("p"), X.contains("s", "dog").alias("a"), X.contains_tag("s", "dog").alias("b"), X.length("s").alias("n"), X.strip_tags("s").alias("w"), X.matches(F.lit("Dog"), "dog", False).alias("m")).first()
    assert tuple(r) == ("the/DT dog/NN", True, False, 2, ["the", "dog"], True)
    with pytest.raises(Exception, match="different tokens"):
        df.select(X.combine("s", X.apply_tags(F.array(F.lit("x")), F.array(F.lit("y"))))).collect()


def test_tag_codecs(spark):
    for s in (T.BROWN, T.CONLL):
        all_ = sorted(s.tags | s.marks)
        assert one(spark, T.parse_tag("x", s), *all_) == all_ == [T.parse_tag_text(t, s) for t in all_]
    assert len(T.BROWN.tags | T.BROWN.marks) == 228 and len(T.CONLL.tags | T.CONLL.marks) == 47
    assert one(spark, T.parse_tag("x", T.BROWN), "nn", "NN-TL", "FW_AT", " (NN) ", "(NN", "") == ["NN", "Unk", "FW-AT", "NN", "Unk", "Unk"]
    assert one(spark, T.parse_chunk("x", T.BROWN), "NP", "C_NP", "XX") == ["C_NP", "C_NP", None]
    assert one(spark, T.parse_chunk("x", T.BROWN, compat=True), "C_NP", "NP") == [None, "C_NP"]
    assert one(spark, T.parse_entity("x"), "PER", "x") == ["PER", None]


def test_default_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS a, map('b', 5, 'c', 7) AS b, array(struct('k' AS key, 1 AS value), struct('k' AS key, 2 AS value), struct('l' AS key, 3 AS value)) AS e")
    r = df.select(M.lookup("a", "z", 9).alias("l"), M.union_with("a", "b", lambda x, y: x + y, 10, 20).alias("u"), M.fold("a", F.lit(0), lambda s, v: s * 10 + v).alias("f"), M.map_values("a", lambda v: -v).alias("m"), M.from_entries("e").alias("e"), M.keys("a").alias("k"), M.elems("a").alias("v")).first()
    assert r.l == 9 and r.u == {"a": 21, "b": 7, "c": 17} and r.f == 12 and r.m == {"a": -1, "b": -2} and r.e == {"k": 2, "l": 3} and r.k == ["a", "b"] and r.v == [1, 2]


# ---- sources


def test_read_tagged(spark):
    rows = S.read_tagged(texts(spark, "the/DT a/b/NN plain /\n\nx/vb"), T.CONLL).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.pos, r.token, r.tag) for r in rows] == [(0, 0, "the", "DT"), (0, 1, "a/b", "NN"), (0, 2, "plain", "Unk"), (0, 3, "", "Unk"), (2, 0, "x", "VB")]


def test_iob(spark):
    df = texts(spark, "", "  \n  ", "He PRP B-NP\nis VBZ B-VP extra\n\n\n big JJ O-NP \nbad line\nx NN B-ZZ\ny NN I-NP")
    rows = S.read_iob(df, T.CONLL).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.pos, r.token, r.iob, r.chunk, r._error is None) for r in rows] == [(0, 0, "He", "B", "NP", True), (0, 1, "is", "B", "VP", True), (1, 0, "big", "O", None, True), (1, 1, "bad", None, None, False), (1, 2, "x", None, None, False), (1, 3, "y", "I", "NP", True)]
    with pytest.raises(Exception, match="fewer than three"):
        S.read_iob(df, T.CONLL, mode="FAILFAST").collect()
    assert S.tagged_sentences(S.read_iob(df, T.CONLL)).count() == 4


def test_wikiner(spark):
    rows = S.read_wikiner(texts(spark, "Bob|NNP|I-PER runs|VBZ|O\n\nin|IN|O Rome|NNP|I-LOC")).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.token, r.iob, r.chunk) for r in rows] == [(0, "Bob", "I", "PER"), (0, "runs", "O", None), (2, "in", "O", None), (2, "Rome", "I", "LOC")]


def test_mail_and_news(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("From a@b Mon\nFrom: x\nSubject: s\n\nCaf\xe9 one.\n>From here\n\nFrom c@d Tue\nX: y\n\ntwo\n".encode("latin-1"))
    (tmp_path / "b.dat").write_text("From no\n\nno\n")
    rows = S.read_mbox(spark, str(tmp_path)).orderBy("msg_id").collect()
    assert [(r.msg_id, r.body) for r in rows] == [(0, "Caf\xe9 one.\n>From here\n"), (1, "two\n")]
    assert S.mail_tokens(S.read_mbox(spark, str(tmp_path))).orderBy("msg_id").first().tokens[:3] == ["Café", "one", "."]
    docs = S.news_documents(spark.createDataFrame([("DEV-MUC3-0001 (NOSC)\n\n  TEXT A\nDEV-MUC3-0002\nB",)], "text string")).collect()
    assert [tuple(d) for d in docs] == [("DEV-MUC3-0001", "NOSC", "\n  TEXT A"), ("DEV-MUC3-0002", None, "B")]


# ---- corpus and vectors


def lists(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id int, tokens array<string>")


def test_corpus(spark):
    docs = lists(spark, ["a", "test"], ["test", "test"], [])
    df, n = C.doc_freq(docs), C.document_count(docs)
    assert {r.term: r.df for r in df.collect()} == {"a": 1, "test": 2} and n.first()[0] == 3
    assert {r.term: r.df for r in C.term_counts(df, spark.createDataFrame([("zz",), ("a",)], "term string")).collect()} == {"zz": 0, "a": 1}
    more = lists(spark, ["b", "b"])
    for compat, want in ((False, 1), (True, 2)):
        both, count = C.add_documents(df, 3, more, compat=compat)
        assert {r.term: r.df for r in both.collect()}["b"] == want and count.first()[0] == 4
    got = {r.term: r.idf for r in C.idf(C.doc_freq(lists(spark, ["test"])), C.document_count(lists(spark, ["test"]))).collect()}
    assert math.isclose(got["test"], math.log(2 / 3))


def test_tf_idf(spark):
    corpus = lists(spark, ["some"], ["test"])
    tf = C.term_freq(lists(spark, ["a", "test"]))
    w = {r.term: r.weight for r in C.tf_idf(tf, C.doc_freq(corpus), C.document_count(corpus)).collect()}
    assert math.isclose(w["a"], 0.40546, abs_tol=1e-4) and w["test"] == 0


def test_similarity(spark):
    pairs = spark.createDataFrame([(0, "test", "test"), (1, "a test", "the test"), (2, "foo", "bar"), (3, "", "")], "pair_id int, a string, b string")
    minor = lists(spark, ["foo", "bar"], ["foo", "baz"], ["a"], ["the"], ["test"])
    for compat in (False, True):
        got = {r.pair_id: r.similarity for r in V.similarity(pairs, minor, compat=compat).collect()}
        assert math.isclose(got[0], 1) and got[2] == got[3] == 0 and math.isclose(got[1], 0.5, abs_tol=1e-3)


def vec(spark, d, i=0):
    return spark.createDataFrame([(i, k, float(v)) for k, v in d.items()], "vec_id int, term string, weight double")


def test_vectors(spark):
    a, b = {"x": 3, "y": 4}, {"y": 2, "z": 1}
    va, vb = vec(spark, a), vec(spark, b, 1)
    assert V.magnitude(va).first()["magnitude"] == 5
    assert V.dot(va, vb).first()["dot"] == 8
    s = {r.term: r.weight for r in V.add(va, V.negate(va)).collect()}
    assert s == {"x": 0, "y": 0}
    assert {r.term: r.weight for r in V.add(va, V.zero(va), "vec_id").collect()} == a
    assert {r.term for r in V.terms_of(V.total(va.unionByName(vb))).collect()} == {"x", "y", "z"}
    two = vec(spark, {"x": 1, "y": 1})
    assert V.cosine(two, two).first()["cosine"] == pytest.approx(1) and V.cosine(two, two, compat=True).first()["cosine"] == pytest.approx(0.5)


# ---- taggers


def test_literal(spark):
    d = {"the": "dt", "dog": "nn", "Jumped": "vb"}
    assert G.LiteralTagger(table(spark, d)).tag_text(texts(spark, "a dog jumped")).first().text == "a/Unk dog/nn jumped/Unk"
    assert G.LiteralTagger(table(spark, d), False).tag_text(texts(spark, "a dog jumped")).first().text == "a/Unk dog/nn jumped/vb"
    d = {"The": "dt", "United States": "np", "President of the United States": "pn"}
    assert G.LiteralTagger(table(spark, d)).tag_text(texts(spark, "The President of the United States")).first().text == "The/dt President of the United States/pn"
    clash = table(spark, {"Dog": "first", "dog": "greatest"})
    assert G.LiteralTagger(clash, False).tag_text(texts(spark, "DOG")).first().text == "DOG/greatest"


def test_unambiguous_and_backoff(spark):
    t = G.UnambiguousTagger(table(spark, {"dog": "vb"}))
    fitted = t.fit_text(texts(spark, "dog/nn jumped/vb jumped/vbx the/dt"))
    assert fitted.tag_text(texts(spark, "the dog jumped x")).first().text == "the/dt dog/Unk jumped/Unk x/Unk"
    stack = G.LiteralTagger(table(spark, {"cat": "CAT"}), backoff=G.LiteralTagger(table(spark, {"cat": "NN", "dog": "DOG"})))
    assert stack.tag_text(texts(spark, "cat dog bird")).first().text == "cat/CAT dog/DOG bird/Unk"
    gold = spark.createDataFrame([(tagged("cat/CAT dog/DOG"),)], "tagged array<struct<token:string,tag:string>>")
    assert tuple(stack.evaluate(gold).first()) == (1.0, 2) and stack.evaluate(gold, use_backoff=False).first()[0] == 0.5
    assert tuple(stack.evaluate(gold.limit(0)).first()) == (None, 0)


def test_perceptron_by_hand(spark):
    sequence = G.training_sequence([{"token": w, "tag": t} for w, t in tagged("the/DT dog/NN jumped/VB ./.")])
    p = P.Perceptron()
    for _ in range(5):
        for f, truth in sequence:
            p.update(truth, p.predict(f) or "Unk", f)
    assert p.instances == 16
    state, n = spark.createDataFrame(p.state(), P.STATE), p.instances
    p.average()
    assert p.weights["bias="] == {".": 0.938, "Unk": -0.938} and p.weights["w=dog"] == {"NN": 0.938, "DT": -0.938}
    got = {(r.feature, r["class"]): r.weight for r in P.averaged(state, n).collect()}
    assert got == {(f, c): w for f, c, w in p.rows()}
    before = {k: dict(v) for k, v in p.weights.items()}
    assert p.average().weights == before


def test_features_and_scores_agree(spark):
    r = random.Random(1)
    sents = [[r.choice("a bb ccc dddd".split()) for _ in range(r.randint(1, 6))] for _ in range(20)]
    tokens = spark.createDataFrame([(i, j, w) for i, s in enumerate(sents) for j, w in enumerate(s)], "s int, pos int, token string")
    rows = G.static_features(tokens, "s")
    got = {}
    for x in rows.collect():
        got.setdefault((x.s, x.pos), set()).add(x.feature)
    assert got == {(i, j): set(f) for i, s in enumerate(sents) for j, f in enumerate(G.fixed_features(s))}
    arrays = spark.createDataFrame(list(enumerate(sents)), "s int, tokens array<string>")
    assert sorted(map(tuple, G.sentence_features(arrays, "s").collect())) == sorted(map(tuple, rows.collect()))
    names = sorted({f for v in got.values() for f in v})
    p = P.Perceptron({f: {c: r.randint(-3, 3) / 4 for c in "xyz" if r.random() < 0.7} for f in names if r.random() < 0.5})
    best = {(x.s, x.pos): x["class"] for x in P.predict(rows, P.weights_of(spark, p), "s", "pos").collect()}
    assert best == {k: c for k, v in got.items() if (c := p.predict(v))}


def test_stack_trains_saves_and_loads(spark, tmp_path):
    corpus = texts(spark, "the/DT dog/NN jumped/VB ./.\nthe/DT cat/NN slept/VB ./.")
    stack = G.new_tagger(spark, seed=3).fit_text(corpus)
    assert stack.tag_text(texts(spark, "the dog jumped .")).first().text == "the/DT dog/NN jumped/VB ./."
    stack.save(spark, f"{tmp_path}/m")
    again = models.load(spark, f"{tmp_path}/m")
    probe = texts(spark, "the cat jumped . The bird slept well!", "")
    assert again.tag_text(probe).collect() == stack.tag_text(probe).collect()
    with pytest.raises(ValueError, match="no loader"):
        models.load(spark, f"{tmp_path}/m", {})
    direct = G.PerceptronTagger(spark.createDataFrame([], P.WEIGHTS)).fit_text(corpus)
    assert direct.tag_text(texts(spark, "the dog jumped .")).first().text == "the/DT dog/NN jumped/VB ./."
    assert G.new_tagger(spark).fit_text(corpus, compat=True).tag_text(texts(spark, "dog the")).first().text == "dog/NN the/DT"


def test_decoding_many_sentences_is_decoding_each(spark, monkeypatch):
    monkeypatch.setattr(G.Decoder, "TOGETHER", 40)
    r = random.Random(2)
    words, tags = ["the", "a", "dog", "Étés", "x", "jumping", "", "of"], ["DT", "NN", "VB", "JJ"]
    feats = [f"{n}={v}" for n in ("suf", "pre", "w", "p1w", "p1suf", "p2w", "n1w", "n1suf", "n2w") for w in [*words, "-START2-", "-END-", "-START-", "-END2-"] for v in (w, w[-3:], w[:1])]
    feats += [f"p1t={t}" for t in [*tags, "-START-", "Unk"]] + [f"p2t={t}" for t in [*tags, "-START2-"]] + [f"p12t={a} {b}" for a in [*tags, "-START-"] for b in [*tags, "-START2-"]] + [f"p1tw={a} {w}" for a in tags for w in words]
    for share in (0.02, 0.3, 1.0):
        p = P.Perceptron({f: {c: round(r.uniform(-1, 1), 2) for c in r.sample(tags, r.randint(1, 4))} for f in dict.fromkeys(feats) if r.random() < share})
        sents = [[r.choice(words) for _ in range(r.randrange(12))] for _ in range(60)] + [None, []]
        got = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "i int, tokens array<string>").repartition(2)
        tagger = G.PerceptronTagger(spark.createDataFrame(p.rows(), P.WEIGHTS))
        out = {x.i: x.tagged for x in tagger.transform(got).collect()}
        for i, s in enumerate(sents):
            assert (None if s is None else [t["tag"] for t in out[i]]) == (None if s is None else G.decode(p, s))


def test_training_goes_on_from_a_saved_model(spark, tmp_path):
    one_, two = "the/DT dog/NN barks/VB ./.\na/DT cat/NN dog/VB ./.", "the/DT cat/NN saw/VB a/DT dog/NN ./.\nsaw/NN dog/NN"
    empty = G.PerceptronTagger(spark.createDataFrame([], P.WEIGHTS), iterations=2, seed=4)
    first = empty.fit_text(texts(spark, one_))
    first.save(spark, f"{tmp_path}/m")
    loaded = models.load(spark, f"{tmp_path}/m")
    key = lambda t: sorted(map(str, t.state.collect()))
    straight = first.fit_text(texts(spark, two))
    assert key(loaded.fit_text(texts(spark, two))) == key(straight)
    # without the totals the result is another
    assert key(G.PerceptronTagger(first.weights, iterations=2, seed=4).fit_text(texts(spark, two))) != key(straight)
    p = P.Perceptron()  # the definition, in one process
    for text in (one_, two):
        p = P.train([G.training_sequence([{"token": w, "tag": t} for w, t in tagged(line)]) for line in text.split("\n")], 2, 4, "Unk", p)
    assert {x[:3] for x in p.state()} == {(x.feature, x["class"], x.weight) for x in straight.state.collect()}
    for name, text in (("a", one_), ("b", two)):
        (tmp_path / f"{name}.txt").write_text(text)
    assert key(empty.fit_files(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"])) == key(straight)


def test_dictionaries_of_either_size(spark, monkeypatch):
    t = G.LiteralTagger(spark.createDataFrame([("The", "DT"), ("the", "XX"), ("dog", "NN"), ("été", "S")], "term string, tag string"), False)
    rows = spark.createDataFrame([(1, ["The", "ÉTÉ", "cat"], "k"), (2, [], "k"), (1, ["dog"], "k")], "_row int, tokens array<string>, _first string")
    small = sorted(map(str, t.transform(rows).collect()))
    monkeypatch.setattr(G, "SMALL", 0)
    assert small == sorted(map(str, t.transform(rows).collect())) and "tag='XX'" in small[0] + small[1] + small[2]


def test_other_tokenizers_and_splitters(spark):
    t = G.LiteralTagger(table(spark, {"a": "X"})).using(lambda c: F.split(c, "-"), lambda c: F.split(c, ";"))
    assert t.tag_text(texts(spark, "a-b;a.")).first().text == "a/X b/Unk a./Unk"


# ---- chunks


def token_rows(spark, *sents, extra=()):
    return spark.createDataFrame([(i, j, *w) for i, s in enumerate(sents) for j, w in enumerate(s)], "s int, pos int, token string, tag string" + "".join(f", {e} string" for e in extra))


def test_chunk_features(spark):
    rows = token_rows(spark, tagged("the/DT big/JJ red/JJ dog/NN saw/VB a/DT cat/NN"))
    got = {}
    for r in K.features(rows, "s", tagset=T.CONLL).collect():
        got.setdefault(r.pos, set()).add(r.feature)
    w, t = zip(*tagged("the/DT big/JJ red/JJ dog/NN saw/VB a/DT cat/NN"))
    assert got == {i: set(f) for i, f in enumerate(K.features_of(list(w), list(t), T.CONLL))}
    since = {r.pos: r.tags_since_dt for r in K.tags_since_determiner(rows, "s").collect()}
    assert since == {0: "", 1: "", 2: "JJ", 3: "JJ-JJ", 4: "NN-JJ-JJ", 5: "VB-NN-JJ-JJ", 6: ""}


def test_chunker(spark, tmp_path):
    s = [("The", "DT", "NP"), ("dog", "NN", "NP"), ("jumped", "VBD", "VP"), (".", ".", "O")]
    rows = token_rows(spark, s, extra=("chunk",))
    c = K.new_chunker(spark).fit(rows, "s")
    w = {(r.feature, r["class"]): r.weight for r in c.weights.collect()}
    assert w["pos=DT", "NP"] == 0.944 and w["pos=DT", "O"] == -0.944 and w["pos=VBD", "VP"] == 0.889 and not any(f == "pos=NN" for f, _ in w)
    probe = token_rows(spark, [x[:2] for x in s], tagged("A/DT chair/NN"))
    assert {r.s: r.text for r in K.brackets(c.transform(probe, "s"), "s").collect()} == {0: "[NP The/DT dog/NN] [VP jumped/VBD] ./.", 1: "[NP A/DT chair/NN]"}
    c.save(spark, f"{tmp_path}/c")
    again = models.load(spark, f"{tmp_path}/c")
    assert again.tagset == T.CONLL and K.brackets(again.transform(probe, "s"), "s").count() == 2
    tagger = G.LiteralTagger(table(spark, {"The": "DT", "dog": "NN", "jumped": "VBD", ".": "."}))
    assert c.chunk_text(tagger, texts(spark, "The dog jumped.")).first().text == "[NP The/DT dog/NN] [VP jumped/VBD] ./."


def test_unknown_labels(spark):
    weights = spark.createDataFrame([("pos=DT", "NP", 1.0), ("pos=XX", "ZZ", 1.0), ("pos=VB", "VP", 1.0)], P.WEIGHTS)
    rows = token_rows(spark, tagged("a/DT b/XX c/VB d/QQ"))
    assert [r.chunk for r in K.predict(rows, weights, "s", tagset=T.CONLL).orderBy("pos").collect()] == ["NP", "O", "VP", "O"]
    assert [(r.token, r.chunk) for r in K.predict(rows, weights, "s", tagset=T.CONLL, compat=True).orderBy("pos").collect()] == [("a", "NP"), ("b", "VP"), ("c", "O")]


def test_iob_chunks(spark):
    iob = [("a", "DT", "B", "NP"), ("b", "NN", "I", "VP"), ("c", "NN", "B", "NP"), ("d", ".", "O", None), ("e", "NN", "I", "PP")]
    rows = token_rows(spark, iob, extra=("iob", "chunk"))
    got = K.iob_chunks(rows, "s")
    assert [(r.chunk, r.chunk_id) for r in got.orderBy("pos").collect()] == [("NP", 1), ("NP", 1), ("NP", 2), ("O", None), ("PP", 3)]
    assert [r.token for r in K.iob_chunks(rows, "s", compat=True).orderBy("pos").collect()] == ["b", "d"]
    spans = K.spans(got, "s")
    assert sorted((r.label, r.start, r.stop) for r in spans.collect()) == [("NP", 0, 2), ("NP", 2, 3), ("PP", 4, 5)]
    deeper = spans.unionByName(spark.createDataFrame([(0, 9, 1, 1, "AP", 1, 2)], spans.schema))
    assert [r.chunk for r in K.innermost(got.drop("chunk"), deeper, "s").orderBy("pos").collect()] == ["NP", "AP", "NP", "O", "PP"]


def test_nested_brackets():
    spans = [{"node_id": 0, "depth": 0, "label": "NP", "start": 0, "stop": 4}, {"node_id": 1, "depth": 1, "label": "PP", "start": 2, "stop": 4}, {"node_id": 2, "depth": 0, "label": "X", "start": 4, "stop": 4}]
    assert K.bracket_tree(["a/DT", "b/NN", "c/IN", "d/NN", "./."], spans) == "[NP a/DT b/NN [PP c/IN d/NN]] [X] ./."


# ---- extraction


def test_combinators():
    s = [("the", "DT"), ("cat", "NN"), ("sat", "VBD")]
    assert E.parse(E.tag_is("DT"), s).at == 1 and not E.parse(E.tag_is("NN"), s).ok
    assert E.parse(E.followed_by(E.any_token(), E.tag_starts("V")), s).value.start == 2
    assert E.parse(E.one_of(["a", "THE"], False), s).ok and not E.parse(E.one_of(["a", "THE"]), s).ok
    two = E.tag_is("DT").then(lambda _: E.tag_is("JJ"))
    assert not E.parse(two | E.tag_is("DT"), s).ok and E.parse(E.attempt(two) | E.tag_is("DT"), s).ok
    for tags, ok in ((["NN"], True), (["DT", "NN"], True), (["NN", "NN"], True), (["JJ", "NN"], True), (["VB"], False)):
        r = E.parse(E.noun_phrase(), [("w", t) for t in tags])
        assert r.ok == ok and (not ok or (r.value.label, r.at) == ("C_NP", len(tags)))
    assert not E.parse(E.any_token(), []).ok


def test_clause(spark):
    sent = tagged("Mary/NNP saw/VBD the/DT cat/NN sit/VB on/IN the/AT mat/NN ./.")
    df = spark.createDataFrame([(0, sent), (1, tagged("the/DT dog/NN ,/, the/DT cat/NN sat/VB it/NN")), (2, []), (3, None)], "i int, tagged array<struct<token:string,tag:string>>")
    got = {r.i: r.e for r in df.select("i", E.extract("tagged", E.find_clause).alias("e")).collect()}
    assert got[0].ok and [(x.label, x.start, x.stop, x.depth) for x in got[0].spans] == [("C_CL", 2, 8, 0), ("C_NP", 2, 4, 1), ("C_VP", 4, 8, 1), ("C_PP", 5, 8, 2), ("C_NP", 6, 8, 3)]
    assert not got[1].ok and not got[2].ok and got[3] is None  # a noun phrase without a verb comes first
    rows = E.extracted_spans(df, E.noun_phrase, "i").collect()
    assert {(r.start, r.stop) for r in rows if r.i == 1} == {(0, 2), (3, 5), (6, 7)}


def test_noun_phrase_runs(spark):
    rows = token_rows(spark, tagged("the/DT cat/NN sat/VB a/AT mat/NN"))
    assert sorted((r.start, r.stop) for r in K.noun_phrases(rows, "s").collect()) == [(0, 2), (3, 5)]


# ---- streams and the command line


def test_chunks_as_elements(spark):
    s = [("the", "DT", "NP", 1), ("dog", "NN", "NP", 1), ("cats", "NN", "NP", 2), ("ran", "VB", "VP", 3), ("fast", "RB", "O", None)]
    rows = spark.createDataFrame([(1, i, *x) for i, x in enumerate(s)], "s int, pos int, token string, tag string, chunk string, chunk_id int")

    def pattern():
        return E.chunk("X", E.chunk_is("NP").then(lambda a: E.chunk_is().then(lambda b: E.tag_is("RB").map(lambda c: [a, b, c]))))

    e = K.column_of(rows, "s").select(E.extract("chunked", pattern, everywhere=True).alias("e")).first().e
    assert (e.ok, e.label, e.start, e.stop) == (True, "X", 2, 5)
    assert [(x.label, x.start, x.stop) for x in e.spans] == [("X", 2, 5), ("NP", 2, 3), ("VP", 3, 4)]
    first = E.items([dict(zip(("token", "tag", "chunk", "chunk_id"), x)) for x in s])[0]
    assert first == E.Item("the dog", "NP", True, 0, 2)
    assert not E.parse(E.token_is("the dog"), [first]).ok  # a chunk is no token


def test_all_entries_or_an_error(spark):
    rows = S.read_iob(texts(spark, "a DT B-NP\nb NN I-NP\n\nc NN B-ZZ\nd\n\ne . O", "f NN O"), T.CONLL)
    got = {(r.doc_id, r.sent_id): (r.tokens and [t.token for t in r.tokens], r.error) for r in S.sentence_results(rows, "doc_id", "sent_id").collect()}
    assert got == {(0, 0): (["a", "b"], None), (0, 1): (None, "unknown chunk: B-ZZ"), (0, 2): (["e"], None), (1, 0): (["f"], None)}
    assert {r.doc_id: r.error for r in S.sentence_results(rows, "doc_id").collect()} == {0: "unknown chunk: B-ZZ", 1: None}


def test_columns_of_the_user_stay(spark):
    names = ["_p", "_n", "_last", "_c", "_row", "_first", "_gold", "_d", "_h", "class", "new", "head", "last", "prev", "next"]
    rows = spark.createDataFrame([(1, i, w, t, "B" if i % 2 else "I", "NP", *names) for i, (w, t) in enumerate(tagged("the/DT dog/NN ran/VB"))], "s int, pos int, token string, tag string, iob string, chunk string, " + ", ".join(f"{n} string" for n in names))
    weights = spark.createDataFrame([("pos=NN", "NP", 1.0)], P.WEIGHTS)
    for df in (K.predict(rows, weights, "s"), K.with_islands(rows, "s"), K.iob_chunks(rows, "s"), K.tags_since_determiner(rows, "s"), G.dictionary_tags(rows, table(spark, {"the": "X"}))):
        assert all(r[n] == n for r in df.collect() for n in names)


def test_terms_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None), (1, ["b"])], "doc_id int, tokens array<string>")
    tf, df = C.frequencies(docs)
    assert sorted(map(str, map(tuple, tf.collect()))) == sorted(map(str, [(1, "a", 1), (1, "b", 2), (1, None, 1), (1, "b", 1)]))
    assert {r.term: r.df for r in df.collect()} == {"a": 1, "b": 2, None: 1}
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()


def test_later_entries_of_a_map_count(spark):
    e = "array(struct('b' as key, 1 as value), struct('a' as key, 2 as value), struct('b' as key, 3 as value), struct('c' as key, 4 as value), struct('b' as key, 5 as value))"
    got = spark.range(1).select(M.from_entries(F.expr(e)).alias("m"), M.from_entries(F.expr("slice(" + e + ", 1, 0)")).alias("none")).first()
    assert got.m == {"a": 2, "b": 5, "c": 4} and got.none == {}


def test_prediction_needs_one_exchange(spark):
    weights = spark.createDataFrame([("pos=NN", "NP", 1.0), ("w=a", "X", 1.0)], P.WEIGHTS)
    rows = token_rows(spark, tagged("the/DT dog/NN"))
    sentences = spark.createDataFrame([(1, ["a", "b"])], "s int, tokens array<string>").repartition("s")
    for df in (K.predict(rows, weights, "s"), P.predict(G.sentence_features(sentences, "s", with_token=True), weights, "s", "pos", "token")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_stream(spark, tmp_path):
    from lexiloom import streaming as W

    texts(spark, "a b a", "b c").write.parquet(f"{tmp_path}/in")
    stream = W.tokens(spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/in"))
    q = W.keep_doc_freq(stream, "frequencies", f"{tmp_path}/cp")
    q.processAllAvailable()
    assert {r.term: r.df for r in spark.table("frequencies").collect()} == {"a": 1, "b": 2, "c": 1}
    q.stop()
    tagger = G.PerceptronTagger(spark.createDataFrame([("w=a", "X", 1.0)], P.WEIGHTS))
    q = tagger.transform(stream).select(X.print_tagged("tagged").alias("t")).writeStream.format("memory").queryName("printed").start()
    q.processAllAvailable()
    assert {r.t for r in spark.table("printed").collect()} == {"a/X b/Unk a/X", "b/Unk c/Unk"}
    q.stop()
    tagger = G.LiteralTagger(table(spark, {"b": "Y"}), backoff=tagger)
    q = tagger.transform(stream).select(X.print_tagged("tagged").alias("t")).writeStream.format("memory").queryName("looked_up").start()
    q.processAllAvailable()
    assert {r.t for r in spark.table("looked_up").collect()} == {"a/X b/Y a/X", "b/Y c/Unk"}
    q.stop()


def test_command_line(spark, tmp_path):
    from lexiloom.cli import run

    (tmp_path / "a.txt").write_text("the/DT dog/NN jumped/VB ./.")
    (tmp_path / "b.txt").write_text("a/DT cat/NN slept/VB ./.")
    run(spark, ["train-pos", f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", f"{tmp_path}/pos"])
    assert run(spark, ["tag", f"{tmp_path}/pos", "the cat jumped."]) == "the/DT cat/NN jumped/VB ./."
    assert run(spark, ["eval", f"{tmp_path}/pos", f"{tmp_path}/a.txt"]) == "accuracy 1.0, 4 tokens"
    (tmp_path / "c.txt").write_text("The DT B-NP\ndog NN I-NP\njumped VBD B-VP\n. . O\n")
    (tmp_path / "n.txt").write_text("Bob|NNP|I-PER runs|VBZ|O\n")
    for command, name in (("train-chunk", "c"), ("train-ner", "n")):
        run(spark, [command, f"{tmp_path}/{name}.txt", f"{tmp_path}/{name}"])
        assert models.load(spark, f"{tmp_path}/{name}").weights.count() > 0


def test_places_with_like_elements_are_parsed_once():
    """A noun phrase at the start, and a search for verb phrases, over sentences that repeat in tags but not in tokens."""
    import pyarrow as pa

    runs = []

    def counted(p):
        def run(s, i):
            runs.append(i)
            return p.go(s, i)

        return E.Parser(run, True)

    def not_first():
        return E.chunk("X", E.tag_is("NN").then(lambda a: E.fail("first") if a.start == 0 else E.pure([a])))

    rows = [[{"token": f"t{k}{i}", "tag": t} for i, t in enumerate(("DT", "NN", "VBD", "NN", "."))] for k in range(50)]
    sentences = pa.array(rows, pa.list_(pa.struct([("token", pa.string()), ("tag", pa.string())])))
    for parser, everywhere, most in ((E.noun_phrase(), False, 1), (E.verb_phrase(), True, 5), (not_first(), True, 150)):
        runs.clear()
        got = E.Matcher(counted(parser), everywhere)(sentences).to_pylist()
        assert len(runs) <= most
        nodes = [E.search_all(parser, [(t["token"], t["tag"]) for t in r]) if everywhere else [E.parse(parser, [(t["token"], t["tag"]) for t in r]).value] for r in rows]
        assert [(g["label"], g["start"], g["stop"], g["spans"]) for g in got] == [(n[0].label, n[0].start, n[0].stop, E.span_rows(n)) for n in nodes]


@pytest.mark.parametrize("small", [K.SMALL, 0])
def test_chunked_columns_are_what_token_rows_give(spark, small, monkeypatch):
    """In place and by a join: the six features, ties, labels that are none of the set's, empty and null sentences."""
    monkeypatch.setattr(K, "SMALL", small)
    rnd = random.Random(3)
    lines = [[(rnd.choice(["the", "dog", "a b", ""]), rnd.choice(["DT", "NN", "NN", "VBD", "PPSS+BEZ", "FW-AT"])) for _ in range(rnd.choice([1, 2, 5, 9]))] for _ in range(60)]
    df = spark.createDataFrame([*((i, s) for i, s in enumerate(lines)), (100, []), (101, None)], "s int, tagged array<struct<token:string,tag:string>>")
    since = ["", "NN", "NN-NN", "FW-AT-NN", "VBD-NN", "AT-NN"]
    weights = [(f"since={x}", rnd.choice(["NP", "VP", "ZZ"]), rnd.choice([0.5, 1.0, -0.25])) for x in since] + [("pos=NN", "NP", 0.5), ("pos=NN", "VP", 0.5), ("word=a b", "PP", 2.0), ("prevpos=START", "NP", 0.25), ("prevpos+pos=PPSS+BEZ+NN", "VP", 3.0), ("pos+nextpos=NN+END", "PP", 0.75), ("pos=VBD", "VP", 1.125)]
    chunker = K.Chunker(spark.createDataFrame(weights, "feature string, class string, weight double"), T.CONLL)
    rows = chunker.transform(df.select("s", F.posexplode("tagged").alias("pos", "t")).select("s", "pos", "t.token", "t.tag"), "s")
    got = chunker.transform_column(df).cache()
    assert got.filter("s >= 100").orderBy("s").select("chunked").collect() == [([],), (None,)]
    some = got.filter("s < 100")
    assert {r.s: r.chunked for r in some.collect()} == {r.s: r.chunked for r in K.column_of(rows, "s").collect()}
    assert {r.s: r.t for r in some.select("s", K.column_brackets()(F.col("chunked")).alias("t")).collect()} == {r.s: r.text for r in K.brackets(rows, "s").collect()}
    spans = some.select("s", F.explode(K.column_spans()(F.col("chunked"))).alias("x")).select("s", "x.*")
    assert sorted(spans.collect()) == sorted(K.spans(rows, "s").drop("parent_id", "depth").collect())


@pytest.mark.parametrize("compat", [False, True])
def test_pairs_of_vectors_are_not_exchanged(spark, compat, monkeypatch):
    """In parts and in small steps, the pairs of vectors are those of the join; zeros, ties of products and vectors of no length included."""
    rnd = random.Random(5)
    side = lambda n: spark.createDataFrame([(i, t, rnd.choice([0.0, 0.5, 1.0, -1.0])) for i in range(n) for t in rnd.sample("abcdefgh", rnd.choice([1, 3, 8]))], "vec_id int, term string, weight double").cache()
    a, b = side(30), side(9)
    monkeypatch.setattr(V, "HELD", 7)
    monkeypatch.setattr(V, "CELLS", 5)
    got = {ordered: [f(a, b, compat=compat, ordered=ordered) for f in (V.dot, V.cosine)] for ordered in (False, True)}
    plan = got[False][0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "a_id" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    monkeypatch.setattr(V, "BLOCKS", 0)
    for ordered, some in got.items():
        for f, df in zip((V.dot, V.cosine), some):
            want = {tuple(r[:2]): r[2] for r in f(a, b, compat=compat, ordered=ordered).collect()}
            assert {tuple(r[:2]): r[2] for r in df.collect()} == pytest.approx(want) and want


def test_counting_a_table_moves_no_rows_to_one_task(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from lexiloom.operators.sizes import sized

    monkeypatch.setattr(DataFrame, "limit", lambda *_: pytest.fail("a limit gathers rows of all partitions"))
    rows = spark.range(10)
    assert "broadcast" in sized(rows, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sized(rows, 9)._jdf.queryExecution().logical().toString().lower()
