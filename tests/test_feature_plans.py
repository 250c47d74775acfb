"""The plan of a feature collection holds what it reads once: a driver keeps every node of a plan."""

from slopeworks import registry


def test_plans_of_features_are_small(spark, sf):
    plan = registry.queries()["union_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60
