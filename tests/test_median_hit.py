"""The run nearest the median hit ratio, where throughput has another order."""

from kvlog.operators import benchstats


def test_median_is_that_of_hit_ratios(spark):
    runs = [("E1", 1, 10, 90, 500), ("E1", 2, 50, 50, 900), ("E1", 3, 90, 10, 700), ("E2", 4, 1, 3, 1), ("E2", 5, 3, 1, 2)]
    found = benchstats.median_hit_run(spark.createDataFrame(runs, "experiment string, run_id long, hits long, misses long, ops long"))
    assert sorted(map(tuple, found.collect())) == [("E1", 2), ("E2", 4)]
