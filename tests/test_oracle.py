"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck_tables  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    result = compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows-only")), result


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_themes(spark):
    themes = entry.entry(spark)
    assert themes.columns[:4] == ["theme_id", "count", "sentiment", "sentiment_score"]
    assert themes.count() > 0
