"""Replays in parts, and by key without a ceiling, against one loop over the log."""

import random

import pyarrow as pa
import pytest

from kvlog.operators import policies
from kvlog.plans import catalogue

LOG = "seq long, op string, key string, ts_us long, value_len long, ttl_us long"


def trace(n, seed, keys=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choices(["GET", "EXISTS", "SET", "DEL", None, "PING"], [8, 2, 8, 2, 1, 1])[0]
        key = "hot" if rng.random() < 0.3 else f"kéy{rng.randrange(keys)}"
        rows.append((3 * i + 1, op, key, i * 10 + rng.randrange(-60, 60), rng.randrange(90) if op == "SET" else None, rng.choice([None, -5, 0, 7, 90, 2000]) if op == "SET" else None))
    rng.shuffle(rows)
    return rows


def looped(rows, configurations, fill=None, lower_to=None, switch_to=None, warm=0):
    found = []
    for policy, ceiling in configurations:
        sim, rejected = policies.Simulator(policy, ceiling), 0
        for i, (_, op, key, now, size, ttl) in enumerate(sorted(rows)):
            if i == warm:
                sim.hits = sim.misses = 0
            if i == len(rows) // 2:
                if switch_to:
                    sim.set_policy(switch_to)
                if lower_to is not None:
                    sim.set_ceiling(lower_to)
            if op in ("GET", "EXISTS"):
                if not sim.get(key, now) and fill is not None:
                    rejected += not sim.set(key, fill, now).ok
            elif op == "SET":
                rejected += not sim.set(key, size, now, ttl).ok
            elif op == "DEL":
                sim.delete(key, now)
        found.append((policy, ceiling, sim.hits, sim.misses, sim.evictions, rejected, sim.usage, len(sim.entries)))
    return sorted(found)


EVERY = [(p, c) for p in policies.POLICIES for c in (1500, 4000, 0)]


@pytest.mark.parametrize(("options", "part"), [({"fill": 64}, 170), ({}, 1 << 20), ({"fill": 0, "warm": 130}, 301), ({"lower_to": 700}, 250), ({"fill": 9, "switch_to": "allkeys-lfu", "lower_to": 0}, 210)])
def test_parts_equal_one_loop(spark, options, part):
    rows = trace(600, part)
    found = policies.replay_policies(spark.createDataFrame(rows, LOG), EVERY, part=part, **options)
    assert sorted(map(tuple, found.collect())) == looped(rows, EVERY, **options)


@pytest.mark.parametrize("block", [1, 17, 300, 1 << 17])
@pytest.mark.parametrize("fill", [None, 5])
def test_without_a_ceiling_blocks_equal_one_loop(spark, block, fill):
    rows = trace(500, block, keys=5)
    found = policies.replay_unbounded(policies.commands(spark.createDataFrame(rows, LOG), fill), fill is not None, 0, block).collect()
    (_, _, hits, misses, _, _, usage, physical) = looped(rows, [("noeviction", 0)], fill)[0]
    assert [tuple(r) for r in found] == [(hits, misses, usage, physical)]


def test_odd_rows(spark):
    rows = [(0, "SET", None, 0, 5, None), (1, "GET", None, 0, None, None), (2, "SET", "a", None, None, 5), (3, "GET", "a", None, None, None), (4, "SET", "b", 1, 1, (1 << 63) - 1), (5, "GET", "b", None, None, None)]
    found = policies.replay_policies(spark.createDataFrame(rows, LOG), [("allkeys-lfu", 9999), ("noeviction", 0)])
    assert sorted(map(tuple, found.collect())) == [("allkeys-lfu", 9999, 2, 1, 0, 0, 131, 2), ("noeviction", 0, 2, 1, 0, 0, 131, 2)]
    assert policies.replay_policies(spark.createDataFrame([], LOG), EVERY, lower_to=5).count() == 0
    with pytest.raises(ValueError):
        policies.replay_policies(spark.createDataFrame(rows, LOG), [("lru", 0)])


def kept_files(monkeypatch, tmp_path):
    """Where the next replay leaves its parts, which it does not remove then."""
    monkeypatch.setattr(policies, "shared_dir", lambda *_: str(tmp_path / "replay"))
    monkeypatch.setattr(policies, "removed", lambda *_: None)
    return tmp_path / "replay"


def held_rows(spark, folder):
    """Rows of the log in each part."""
    sizes = {}
    for r in spark.read.parquet(str(folder / "log")).collect():
        sizes[r["part"]] = sizes.get(r["part"], 0) + sum(b.num_rows for b in pa.ipc.open_stream(r["rows"]))
    return sizes


@pytest.mark.parametrize("name", ["sim_policy_compare", "sim_lfu", "sim_lower_ceiling", "sim_noeviction", "sim_policy_switch", "sim_random"])
def test_no_task_takes_the_whole_log(spark, monkeypatch, tmp_path, name):
    rows = trace(900, 5)
    folder = kept_files(monkeypatch, tmp_path)
    monkeypatch.setattr(catalogue, "command_log", lambda *_: spark.createDataFrame(rows, LOG).repartition(4))
    whole = policies.replay_policies
    monkeypatch.setattr(policies, "replay_policies", lambda *a, **o: whole(*a, part=200, **o))
    found = catalogue.QUERIES[name](spark, "").collect()
    sizes = held_rows(spark, folder)
    assert sum(sizes.values()) == 900 and len(sizes) == 5 and max(sizes.values()) < 450
    assert sorted(r["usage"] for r in found) and all((folder / str(i)).exists() for i in range(5))


def test_more_parts_than_asked_for(spark, monkeypatch, tmp_path):
    """A session may deal rows to more partitions than it is told to; none of them is left out."""
    rows, frame = trace(600, 8), type(spark.range(0))
    folder, dealt = kept_files(monkeypatch, tmp_path), frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by: dealt(self, max(n, 23), *by))
    found = policies.replay_policies(spark.createDataFrame(rows, LOG), [c for c in EVERY if c[1]], part=200, fill=64).collect()
    assert sorted(map(tuple, found)) == looped(rows, [c for c in EVERY if c[1]], fill=64)
    sizes = held_rows(spark, folder)
    assert len(sizes) > 5 and sum(sizes.values()) == 600
    assert sum((folder / str(i)).exists() for i in range(23)) <= 5
    assert policies._turns([(4, 9), (0, 3), (2, 3), (5, 1), (1, 4), (7, 6)], 7) == [[0, 1], [2], [4], [5, 7]]
