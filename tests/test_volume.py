"""How many rows queries shuffle for each line of the input."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def shuffled(spark, run):
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
        while found.hasNext():
            s = found.next()
            yield s.stageId(), s.shuffleWriteRecords()

    before = max((k for k, _ in stages()), default=-1)
    run()
    return sum(n for k, n in stages() if k > before)


@pytest.mark.parametrize("name, most", [("c1_annotate", 8), ("c10_log_ratios", 16)])
def test_shuffled_rows_per_line(spark, name, most):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    n = shuffled(spark, lambda: entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert 0 < n < most * lines


def test_places_are_found_by_halves(spark):
    from spanloom.operators.intervals import random_intervals

    space = spark.createDataFrame([("c", 0, 50), ("c", 60, 90)], "chrom string, s long, e long")
    places = random_intervals(space, spark.range(20).selectExpr("id AS no", "id AS length"))
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(_entries" not in plan and "RepartitionByExpression [no" in plan
