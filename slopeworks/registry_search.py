"""Registered queries of the route search over request tables; a search has no SQL, tests hold it against all paths of small grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.operators import search
from slopeworks.registry import query, r
from slopeworks.sources.fixtures import view

TIERS = (0, 10, 20, 50)


def _points(spark, d):
    return view(spark, d, "fx_edge_points")


def _solve(spark, d, windows, plan):
    return search.solve(view(spark, d, "fx_requests"), view(spark, d, "fx_nodes"), view(spark, d, "fx_edges"), _points(spark, d), windows, plan)


def _described(spark, d, windows, plan):
    return search.describe(_solve(spark, d, windows, plan)[0], _points(spark, d), windows)


def _rounded(df):
    return df.withColumns({c: r(F.col(c), 4) for c, t in df.dtypes if t == "double"})


@query()
def lazy_verify(spark, d):
    return _rounded(_solve(spark, d, [100], search.Plan(tiers=(50,), cap=4.0))[0])


@query()
def min_grade_frontier(spark, d):
    return _rounded(_described(spark, d, [100], search.Plan(TIERS, refine=False)))


@query()
def refine_route(spark, d):
    return _rounded(_solve(spark, d, [100], search.Plan((20,)))[0])


@query()
def solve_requests(spark, d):
    """Every tier's route of every request, and a row with the status of those that have none."""
    found, without = _solve(spark, d, [100], search.Plan(TIERS))
    told = search.describe(found, _points(spark, d), [100]).withColumn("status", F.lit("found"))
    return _rounded(told.unionByName(without, allowMissingColumns=True))


@query()
def pareto_frontier(spark, d):
    return _rounded(search.frontier(_described(spark, d, [50, 100, 200], search.Plan(tuple(range(0, 41, 10)), refine=False))))
