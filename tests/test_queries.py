"""Each registered engine query gives the rows of its SQL."""

from __future__ import annotations

import pytest

from entitylens.plans.queries import ORACLES, QUERIES, flagship
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship_returns_ten_fraud_companies(spark, sf_dir):
    found = flagship(spark, sf_dir).collect()
    assert 0 < len(found) <= 10 and all("fraud detection" in r["description"] for r in found)
