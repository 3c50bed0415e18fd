"""Long chains are written in steps: a plan of all of them would fill the driver's memory, whatever the size of the tables."""

from runline.jobs import stage_two


def test_no_plan_of_the_second_stage_is_large(spark, sf):
    after = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert len(stage_two.QUERIES["stage2_summary"](spark, sf).collect()) == 30
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    sizes = [store.planGraph(run).allNodes().size() for run in (runs.apply(i).executionId() for i in range(runs.size())) if run >= after]
    assert len(sizes) > 20 and max(sizes) <= 180
