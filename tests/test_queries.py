import oracle
import pytest

from slopeworks import registry


@pytest.fixture(scope="session")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, sf, name):
    oracle.compare(registry.queries()[name](spark, sf), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


# Queries whose rows hang on borders are also held at a larger scale.
@pytest.mark.parametrize("name", ["features_per_request", "extent_filter", "scan_bbox", "request_bbox", "shortest_paths", "grade_capped_path"])
def test_equals_sql_at_a_larger_scale(spark, sf10, name):
    oracle.compare(registry.queries()[name](spark, sf10), oracle.connect(sf10), registry.oracle_sql()[name])
