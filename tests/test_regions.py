"""The region ranking shuffles its pairs once."""

from brindle.plans import regions


def test_pairs_are_shuffled_once_by_images(spark):
    plan = regions.ranking(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qfid" in plan and plan.count("REPARTITION_BY_COL") == 1
    assert not any("hashpartitioning(qfid#" in line and line.count("#") > 3 for line in plan.split("\n"))
