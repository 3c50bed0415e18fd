from runline.llm import queries, training_order


def python_steps(spark, after):
    """MapInArrow steps of each execution from number `after` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, out = store.executionsList(), []
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes = store.planGraph(run).allNodes() if run >= after else None
        out.append(sum("MapInArrow" in nodes.apply(i).name() for i in range(nodes.size())) if nodes else 0)
    return out


def test_a_task_that_writes_has_one_python_process(spark, sf):
    """Pieces are cut before the shuffle; behind it one step puts sequences in order and writes them."""
    after = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert queries.QUERIES["op10_training_order"](spark, sf).count()
    assert max(python_steps(spark, after)) == 2


def test_both_ways_write_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (7 * i % 90) or None) for i in range(60)], "doc_id long, text string")
    training_order.write_shards(training_order.training_order(spark, docs, size=32, shard_size=4), str(tmp_path / "a"), shard_size=4, per_folder=8)
    training_order.write_order(spark, docs, str(tmp_path / "b"), shard_size=4, per_folder=8, size=32)
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / x / "shards").rglob("shard-*.bin")} for x in "ab")
    assert one and one == two
    for table in ("index", "layout"):
        a, b = (spark.read.parquet(str(tmp_path / x / table)) for x in "ab")
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
