"""Every registered listing query against DuckDB on the smallest tables."""

import pytest

from lotlens.plans import registry

from .compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, sf_dir, con, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name])


def test_every_query_is_registered_once():
    assert len(registry.QUERIES) >= 114
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_vectors_survive_bytes(spark, sf_dir):
    assert registry.QUERIES["vector_blob"](spark, sf_dir).where("NOT same OR n_bytes <> 256").count() == 0


def test_entry_points_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert "discover_ranked" in entry.queries() and "discover_ranked" in entry.oracle_sql()
    assert set(entry.oracle_sql()) <= set(entry.queries())
