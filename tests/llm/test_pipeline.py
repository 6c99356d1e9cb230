import random

import corpus_pipeline as C


def test_stages(spark, tmp_path):
    r = random.Random(3)
    w = lambda n: [f"{r.choice(['ha', 'lo', 'mi'])}{r.choice(['ren', 'tas', 'vel'])}{r.choice(['do', 'su', 'ka', 'ing'])}{r.choice(['a', 'e', 'os', ''])}" for _ in range(n)]
    rows = [[i, " ".join(w(r.randint(40, 200))), "en", "s"] for i in range(60)]
    rows += [[100 + i, rows[i][1], "en", "s"] for i in range(5)]  # exact copies
    passage = w(70)
    for i in (7, 8, 9):
        rows[i][1] += " " + " ".join(passage)
    item = " ".join(w(30))
    rows[12][1] += ". " + item
    rows += [[200, "12345 ### 77", "en", "s"], [201, "", "en", "s"], [202, None, "en", "s"]]
    d = str(tmp_path)
    spark.createDataFrame([(a, b, c, e, len(b or "")) for a, b, c, e in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        kept.append({x.doc_id: x for x in docs.collect()})
        assert docs.columns == columns or k == 4
    assert set(kept[0]) == set(range(60)) | set(range(100, 105))
    assert set(kept[1]) == set(range(60))
    text = " ".join(passage)
    assert [text in kept[2][i].text for i in (7, 8, 9)] == [True, False, False]
    assert all(kept[2][i].text == rows[i][1] for i in range(60) if i not in (8, 9)) and kept[2][8].n_chars == len(kept[2][8].text)
    assert set(kept[3]) == set(range(60)) - {12}
    assert set(kept[4]) == set(kept[3])
    assert sorted(map(tuple, C.run(spark, d).collect())) == sorted(map(tuple, kept[4].values()))
