"""Every query of the library against its SQL; those without SQL run and keep their columns."""

from __future__ import annotations

import compare
import pytest

from packframe import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf_dir, db, name):
    assert compare.differences(catalog.queries()[name](spark, sf_dir), db, catalog.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {"bucket_id", "batch_no", "n", "tokens", "padded", "waste"} <= set(__spark_entry__.entry(spark).columns)
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
