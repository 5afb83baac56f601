import re

import pytest

from forumetry.plans import catalogue

from ..oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], spark, sf)


def test_rows_without_sql(spark, sf):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["support_all_scopes", "thread_conflict_top8", "coverage_gaps", "merge_runs_posts", "stance_labels", "language_mix"])
def test_no_python_on_the_rows(spark, sf, name):
    assert not re.search("Python|Pandas|Arrow", catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().toString())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cached_embeddings", "embedding_misses"])
def test_embedded_items_are_read_without_the_join_of_copies(spark, sf, name, monkeypatch):
    from forumetry.plans import discussion

    def refused(*_):
        raise AssertionError("items need no join of copies")

    monkeypatch.setattr(discussion, "posts", refused)
    same(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], spark, sf)
