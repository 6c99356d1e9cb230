import itertools
import random
from collections import Counter

import numpy as np

from lexiloom.llm import transcripts as T


def test_markers():
    for line, kind, rest in (("User: hi", 1, "hi"), ("**Assistant:** yes", 2, "yes"), ("**Human**: hi", 1, "hi"), ("### System", 0, ""), ("[bot] ok", 2, "ok"), ("<|user|>", 1, ""), ("<|im_start|>assistant", 2, ""), ("Q: why?", 1, "why?"), ("User:     def f():", 1, "    def f():"), ("### User   x", 1, "  x"), ("[user]:  y", 1, " y"), ("a line", 3, "a line"), ("Note: x", 4, "Note: x"), ("http://x", 3, "http://x"), ("", 3, "")):
        assert T.marker(line) == (kind, rest), line


def made(n, seed):
    """Users ask in one short line, assistants answer in longer ones."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        k = 0
        if r.random() < 0.3:
            rows.append((c, k, "system", "Be brief and kind to everyone who asks."))
            k += 1
        for _ in range(r.randint(1, 4)):
            rows.append((c, k, "user", "What is " + "x" * r.randint(3, 12) + "?"))
            rows.append((c, k + 1, "assistant", "\n".join("It is " + "y" * r.randint(70, 200) + "." for _ in range(r.randint(1, 4)))))
            k += 2
    return rows


def counted(spark, rows):
    return T.train(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_viterbi_by_brute_force():
    r = np.random.default_rng(3)
    m = T.model(r.integers(0, 9, 3), r.integers(0, 9, (3, 3)), r.integers(0, 9, 3), r.integers(1, 9, 3), r.integers(0, 9, (T.STATES, T.FORMS)))
    for _ in range(20):
        n = int(r.integers(1, 5))
        kinds, forms = r.integers(0, T.KINDS, n).tolist(), r.integers(0, T.FORMS, n).tolist()

        def score(p):
            return m.start[p[0]] + sum(m.step[a, b] for a, b in zip(p, p[1:])) + sum(m.mark[s, k] + m.form[s, f] for s, k, f in zip(p, kinds, forms))

        best = max(itertools.product(range(T.STATES), repeat=n), key=score)
        assert np.isclose(score(best), score(m.viterbi(kinds, forms)))
    for p in (m.start, *m.step, *m.form, *m.mark):
        assert abs(np.exp(p).sum() - 1) < 1e-6


def test_roles_without_markers(spark):
    m = counted(spark, made(300, 1))
    right = total = 0
    for _, turns in itertools.groupby(made(100, 2), key=lambda x: x[0]):
        want = [(role, text) for _, _, role, text in turns]
        got = T.parse("\n\n".join(t for _, t in want), m)
        total += len(want)
        right += (Counter(want) & Counter(got)).total()  # equal turns count each
    assert right / total > 0.97


def test_mixed_markers_and_text_that_looks_like_one(spark):
    m = counted(spark, made(200, 1))
    want = [("user", "What is this?\nNote: it is odd"), ("assistant", "It is " + "y" * 90)]
    assert T.parse("### Human\nWhat is this?\nNote: it is odd\n\n**Bot**: It is " + "y" * 90, m)[-1] == want[-1]
    text = T.render(want)
    assert text == "<|user|>\nWhat is this?\nNote: it is odd\n<|end|>\n<|assistant|>\nIt is " + "y" * 90 + "\n<|end|>"


def test_tables(spark):
    rows = [(*x, "x") for x in made(50, 4)] + [(None, 0, "user", "gone", "x"), (900, 0, "user", None, "x"), (901, 0, None, "What is xxxx?", "x"), (901, 1, "assistant", "It is " + "y" * 100, "x"), (902, None, "user", "What is a null turn?", "x"), (903, 0, "user", "word " * 60000, "x"), (904, 0, "robot", "", "x"), (905, 0, "user", "same?", "x"), (905, 0, "user", "same?", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    m = T.train(df)
    got = {r.conv_id: r for r in T.format_chats(T.transcripts(df), m).collect()}
    assert set(got) == {x[0] for x in rows} - {None}
    assert (got[900].n_turns, got[904].n_turns, got[904].chat) == (1, 0, "")
    assert got[901].roles == "user,assistant" and got[902].roles == "user" and got[905].roles == "user,user"
    assert got[903].chat == "<|user|>\n" + "word " * 60000 + "\n<|end|>"
    for c, turns in itertools.groupby(made(50, 4), key=lambda x: x[0]):
        assert got[c].chat == T.render([(role, text) for _, _, role, text in turns])
    assert T.format_chats(T.transcripts(df.limit(0)), T.train(df.limit(0))).count() == 0


def test_blank_lines_and_indentation_stay(spark):
    code, two = "    def f():\n\n        return 1", "one\n\n  \ntwo"
    rows = []
    for c in range(40):
        rows += [(c, 0, "user", code), (c, 1, "assistant", two), (c, 2, "user", "What is it?"), (c, 3, "assistant", "It is one:\nUser: not a turn")]
    rows += [(50, 0, "user", "\n \nlate\n\n"), (50, 1, "assistant", code)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = T.train(df)
    for mark in (T.named, T.varied):
        got = {r.conv_id: r.chat for r in T.format_chats(T.transcripts(df, mark), m).collect()}
        assert got[50] == T.render([("user", "late"), ("assistant", code)])
    assert got[0] and T.parse(f"User: {code}\n\nAssistant: {two}", m) == [("user", code), ("assistant", two)]


def test_whole_table_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(T.sql())
    got = T.query(spark, d)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    bare = T.transcripts(spark.read.parquet(f"{d}/conversations.parquet"), T.varied).collect()
    lines = [x for r in bare for x in r.transcript.split("\n\n")]
    assert sum(T.marker(x)[0] == len(T.ROLES) for x in lines) > len(lines) / 4  # so many turns have no marker
