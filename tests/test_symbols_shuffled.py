"""What grows with the files is joined from task to task: no job of the walk over calls broadcasts a table through the driver."""

from cindersift.plans import graphs


def test_no_table_goes_over_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    rows = graphs.cross_file_taint(spark, "/root/testdata/sf0.001").collect()
    seen = store.executionsList()
    plans = [seen.apply(i).physicalPlanDescription() for i in range(seen.size()) if seen.apply(i).executionId() >= began]
    assert rows and len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
