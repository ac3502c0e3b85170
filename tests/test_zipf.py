"""The Zipf workload is whole: its size, its measured phase and its three policies."""

from kvlog.plans import catalogue
from oracle import SF


def test_zipf_workload(spark):
    trace = catalogue.QUERIES["zipf_trace"](spark, SF)
    assert trace.count() == 300000 and trace.agg({"key": "max"}).first()[0] > "09000"
    rows = {r["policy"]: r for r in catalogue.QUERIES["zipf_policy_compare"](spark, SF).collect()}
    assert set(rows) == {"allkeys-random", "allkeys-lfu", "naive-lru"}
    assert all(r["hits"] + r["misses"] == 250000 and r["physical"] == 100 for r in rows.values())
    print({p: r["hits"] / 250000 for p, r in rows.items()})
    assert rows["allkeys-lfu"]["hits"] > max(rows["allkeys-random"]["hits"], rows["naive-lru"]["hits"])
