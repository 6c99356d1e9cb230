import pytest

import __spark_entry__ as E
from lexiloom.plans import queries as core


def test_sql_belongs_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(core.QUERIES) <= set(E.queries()) and len(core.SQL) > 45


def test_entry(spark):
    assert E.entry(spark).columns == ["doc_id", "term", "weight"]


@pytest.mark.parametrize("name", ["tf_idf", "chunk_brackets", "perceptron_predict", "iob_to_chunks", "tag_codec_brown", "default_map_union_with", "protect_terms", "pos_tag_perceptron", "verb_phrases", "find_clause", "similarity", "extract_chunked", "mail_messages", "parse_wikiner", "tag_text", "chunk_text", "cosine_pairs"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(E.oracle_sql()[name])
    got = E.queries()[name](spark, d).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_a_missing_requirement_leaves_only_the_training_data_queries_out(monkeypatch):
    import sys

    if not any(name.startswith("op") for name in E.queries()):
        pytest.skip("they are not here")
    for name in [m for m in sys.modules if m.startswith("lexiloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(sys.modules["lexiloom"], "llm", raising=False)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.warns(UserWarning, match="zstandard"):
        assert set(E.queries()) == set(core.QUERIES)
