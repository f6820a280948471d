"""Every query with an oracle gives the rows that its SQL gives in DuckDB."""

from __future__ import annotations

from collections import Counter

import pytest

from quillmere.config import DEFAULT
from quillmere.plans import catalogue
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, small, name):
    ours = catalogue.queries()[name](spark, small).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, small, name):
    catalogue.queries()[name](spark, small).collect()


def test_entry_has_rows(spark, small):
    rows = catalogue.flagship(spark, small).collect()
    each = Counter(r.question_id for r in rows)
    assert set(each) == {0, 1, 2, 3, 4} and max(each.values()) <= DEFAULT.max_results
    assert all(r.final_score is not None for r in rows)


def test_driver_contract_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
