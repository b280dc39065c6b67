"""What repositories with one remainder share is worked out once, not for each of them."""

import pytest

from risklake import registry
from risklake.plans.domain import Domain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ag_sbom", "ag_package_rollup", "jn_cve_range", "jn_cve_overlay", "ag_maintenance", "jn_license_risk"])
def test_rows_are_made_before_the_repositories_are_joined(spark, name):
    """Before, every package of every repository was joined, hashed or sorted."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    last = plan[plan.index("Join Inner") :]
    assert "RepartitionByExpression" in last and last.count("supplier") == 0 and plan.count("s_suppkey") > 0 and "_share" in plan.splitlines()[1]


@pytest.mark.parametrize("name", ["fn_semver", "fn_purl", "fn_bom_ref"])
def test_distinct_values_are_not_made_for_each_repository(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan


def test_each_repository_of_a_remainder_has_all_rows(spark, tmp_path):
    spark.createDataFrame([(1,), (101,), (7,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    d = Domain(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (7, "b"), (9, "none has it")], "repo_id long, name string")
    got = sorted((r.repo_id, r.name or "") for r in d.per_repo(rows).collect())
    assert got == [(1, ""), (1, "a"), (1, "a"), (7, "b"), (101, ""), (101, "a"), (101, "a")]
    assert {r.repo_id for r in d.held(rows).collect()} == {1, 7}
