import pytest

from waymark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_ten_queries_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_results_equal_sql(spark, tables, name):
    found = queries.queries()[name](spark, SF)
    relation = tables.sql(queries.oracle_sql()[name])
    order = sorted(found.columns)
    assert order == sorted(relation.columns)
    at = [relation.columns.index(c) for c in order]
    expected = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r) for r in found.select(order).collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["op4_transport_stream", "op5_decision_list", "op6_pattern_packing", "op8_speculative_bpe", "op9_sentence_spans"])
def test_every_document_has_a_result(spark, name):
    found = queries.queries()[name](spark, SF).select("doc_id").distinct().count()
    assert found == spark.read.parquet(f"{SF}/documents.parquet").count()
