from depotlens import fixtures as X
from depotlens import registry

SF = "/root/testdata/sf0.001"


def test_fan_out_meets_counts(spark):
    """Each table is read once, and what meets the scans is counted first: one row a scan."""
    plan = registry.queries()["scan_listing_fanout"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    assert "Aggregate [l_orderkey" in plan


def test_metadata_has_two_rows_for_failed_scans(spark):
    m = X.scan_metadata(spark, SF)
    failed = X.scans(spark, SF).filter("status = 'Failed'").select("id")
    n = m.groupBy("scan_id").count()
    assert n.join(failed, n.scan_id == failed.id, "left_semi").filter("count != 2").isEmpty()
    assert n.join(failed, n.scan_id == failed.id, "left_anti").filter("count != 1").isEmpty()
    assert m.filter("search_path = 'second'").count() == n.filter("count = 2").count() > 0
