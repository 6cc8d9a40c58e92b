import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["metric_bundle_pooled", "consensus_labels", "bootstrap_ci", "label_distribution_grouping_sets"])
def test_results_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "lineitem", "orders", "events", "conversations", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    relation = con.sql(entry.oracle_sql()[name])
    order = sorted(found.columns)
    assert order == sorted(relation.columns)
    at = [relation.columns.index(c) for c in order]
    a = sorted((tuple(r) for r in found.select(order).collect()), key=repr)
    b = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y) if all(not isinstance(v, (str, list)) for v in x) else [v if not isinstance(v, float) else round(v, 8) for v in x] == [
            v if not isinstance(v, float) else round(v, 8) for v in y
        ]
