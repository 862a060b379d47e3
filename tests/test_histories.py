"""Histories whose targets stay columns against those from a row per observation."""

from pointweave.operators import studies
from pointweave.operators.store import written
from pointweave.plans import studies as plans


def test_wide_diagnostics(spark):
    r = written(plans.records(spark, "/root/testdata/sf0.001"))
    low, high = studies.years(r)
    long = written(studies.diagnostics(written(studies.observations(r)), low + studies.SEASONS, high))
    wide = studies.wide_diagnostics(r, low + studies.SEASONS, high)
    order = sorted(long.columns)
    want, got = (sorted(map(repr, df.select(*order).collect())) for df in (long, wide))
    assert want == got and len(got) > 100


def test_comparisons_are_worked_out_once(spark):
    """Estimates and judged rows of process uncertainty read the written comparisons: no sums of histories are in the plan."""
    plan = plans._process(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cc_c1" not in plan
