from collections import Counter

import duckdb
import pytest

import __spark_entry__
from terralign.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def same(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    want = tables.sql(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert same(got.to_pylist()) == same(want.to_pylist())


def test_capped_graph_keeps_its_cap(spark):
    edges = catalog.queries()["capped_graph"](spark, SF).collect()
    pairs = [(r.source_id, r.target_id) for r in edges]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    degree = Counter(frame for pair in pairs for frame in pair)
    assert max(degree.values()) <= 6 + 2  # the edges along a flight aren't capped


def test_survey_queries_stand_without_a_library_of_the_text_operators(monkeypatch):
    """Where a library is missing that only they need, the text operators are left out, and nothing else."""
    missing = type("Missing", (), {"import_module": staticmethod(lambda name: (_ for _ in ()).throw(ModuleNotFoundError(name="public_tokenizers")))})
    monkeypatch.setattr(__spark_entry__, "importlib", missing)
    with pytest.warns(UserWarning, match="public_tokenizers is missing"):
        assert __spark_entry__._optional("corpus_pipeline") is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
