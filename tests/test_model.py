"""Replay, policies, sketches and protocol against sequential models and fixed cases."""

import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kvlog.functions import commands, resp
from kvlog.functions.resp import DecodeLimits, decode
from kvlog.operators import benchstats, policies, replay, sketch

LOG = "seq long, ts_us long, key string, op string, value string, value_len long, ttl_us long"


def some_log(n=600, keys=7, seed=4):
    rng, now, rows = random.Random(seed), 0, []
    for seq in range(n):
        now += rng.randrange(25)
        op = rng.choice(["SET", "SET", "DEL", "GET", "EXISTS"])
        value = "v" * rng.randrange(9) if op == "SET" else None
        ttl = rng.choice([None, 0, rng.randrange(1, 100)]) if op == "SET" else None
        rows.append((seq, now, f"k{rng.randrange(keys)}" if rng.random() < 0.6 else "hot", op, value, None if value is None else len(value), ttl))
    return rows


def model(rows):
    state, out = {}, []
    for seq, now, key, op, _, size, ttl in rows:
        present = key in state
        live = present and (state[key][1] is None or now < state[key][1])
        old = len(key) + state[key][0] + 64 if present else 0
        new = len(key) + size + 64 if op == "SET" else 0
        out.append((seq, present, live, new, old))
        if op == "SET":
            state[key] = size, now + ttl if ttl and ttl > 0 else None
        elif op == "DEL":
            state.pop(key, None)
    return out


@pytest.mark.parametrize("block", [1, 13, 1 << 20])
def test_replay_equals_model(spark, block):
    rows = some_log()
    found = replay.replay(spark.createDataFrame(rows, LOG), block).select("seq", "present", "live", "new_cost", "old_cost").collect()
    assert sorted(map(tuple, found)) == model(rows)


@pytest.mark.parametrize("block", [1, 13, 1 << 20])
def test_usage_curve(spark, block):
    changes = [(i, (i * 37) % 11 - 5) for i in range(300)]
    total, expected = 0, []
    for i, d in changes:
        total += d
        expected.append((i, total))
    assert sorted(map(tuple, replay.usage_curve(spark.createDataFrame(changes, "seq long, delta long"), block).collect())) == expected


def test_expiry_boundary_and_empty(spark):
    rows = [(0, 0, "k", "SET", "v", 1, 100), (1, 99, "k", "GET", None, None, None), (2, 100, "k", "GET", None, None, None)]
    assert [r["live"] for r in replay.replay(spark.createDataFrame(rows, LOG)).orderBy("seq").collect()] == [False, True, False]
    assert replay.replay(spark.createDataFrame([], LOG)).count() == 0


@pytest.mark.parametrize("block", [1, 13, 64, 1 << 17])
def test_reuse_distance_is_lru(spark, block):
    keys = [f"k{(i * i) % 17}" if i % 3 else f"n{i % 50}" for i in range(200)]
    found = policies.reuse_distances(spark.createDataFrame([(2 * i + 1, k) for i, k in enumerate(keys)], "seq long, key string"), block).orderBy("seq").collect()
    for capacity in (1, 3, 8, 20):
        lru = policies.NaiveLru(capacity)
        assert [r["distance"] is not None and r["distance"] < capacity for r in found] == [lru.access(k) for k in keys]
    last, slow = {}, []
    for i, k in enumerate(keys):
        slow.append(None if k not in last else len(set(keys[last[k] + 1 : i])))
        last[k] = i
    assert [r["distance"] for r in found] == slow
    assert policies.reuse_distances(spark.createDataFrame([], "seq long, key string"), block).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 9), max_size=70), st.booleans())
def test_earlier(values, equal):
    assert policies.earlier(np.array(values, np.int64), equal).tolist() == [sum(v < x or equal and v == x for v in values[:i]) for i, x in enumerate(values)]


def test_traces_pass_in_order(spark):
    rows = [(p, (i * 37) % 500, i) for i in range(500) for p in ("a", "b")]

    def fold(key, own):
        seen = [v for (v,) in own]
        yield key[0], len(seen), seen == [v for v in sorted(range(500), key=lambda i: (i * 37) % 500)]

    found = policies.in_order(spark.createDataFrame(rows, "p string, seq long, v long"), 1, fold, "p string, n long, ok boolean").collect()
    assert sorted(map(tuple, found)) == [("a", 500, True), ("b", 500, True)]


def test_ceiling_changes_and_samples_are_distinct():
    sim = policies.Simulator("allkeys-lfu", 0)
    for i in range(300):
        sim.set(f"k{i}", 50, 0)
    assert sim.evictions == 0 and sim.usage > 30000
    assert sim.set_ceiling(10000) == sim.evictions > 0 and sim.usage <= 10000
    assert sim.set_ceiling(0) == 0
    for _ in range(50):
        drawn = sim._sample()
        assert len(drawn) == len(set(drawn)) == policies.DRAWS
    sim.set_policy("noeviction")
    before = sim.usage
    sim.set_ceiling(100)
    assert sim.usage == before and not sim.set("new", 10, 0).ok
    sim.set_policy("allkeys-random")
    assert sim.usage == before and sim.set("new", 10, 0).ok and sim.usage <= 100
    few = policies.Simulator("allkeys-random", 0)
    assert few._sample() == []
    few.set("a", 1, 0)
    assert few._sample() == ["a"]


@pytest.mark.parametrize("policy", policies.POLICIES)
def test_simulator_invariants(policy):
    sim, rng = policies.Simulator(policy, 8192), random.Random(1)
    for i in range(1500):
        out = sim.set(f"key{rng.randrange(400)}", rng.randrange(60, 100), i)
        assert sim.usage == sum(c for c, _ in sim.entries.values())
        assert sim.usage <= 8192 or policy == "noeviction" and not out.ok
    assert (sim.evictions > 0) == (policy != "noeviction")


def test_noeviction_allows_shrinking_and_oversized_newcomer_stays():
    sim = policies.Simulator("noeviction", 300)
    assert sim.set("a", 200, 0).ok and not sim.set("b", 200, 0).ok and sim.set("a", 100, 0).ok and not sim.set("a", 400, 0).ok
    sim = policies.Simulator("allkeys-lfu", 1024)
    sim.set("big", 4096, 0)
    assert "big" in sim.entries and sim.usage > 1024
    with pytest.raises(ValueError):
        policies.parse_policy("Allkeys-LFU")


def test_frequent_key_survives():
    sim = policies.Simulator("allkeys-lfu", 64 * 200)
    sim.set("hot", 64, 0)
    for _ in range(500):
        sim.get("hot", 0)
    for i in range(2000):
        sim.set(f"cold{i}", 64, 0)
    assert "hot" in sim.entries


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_sketch(prints):
    s, before = sketch.Sketch(1024, 3), {}
    for p in prints:
        s.increment(p)
        before[p] = before.get(p, 0) + 1
    assert all(min(n, 15) <= s.estimate(p) <= 15 for p, n in before.items())
    held = {p: s.estimate(p) for p in before}
    s.halve()
    assert all(s.estimate(p) == n // 2 for p, n in held.items())


def test_mix_and_doorkeeper():
    assert sketch.mix(1) == 0x5692161D100B05E5
    door = sketch.Doorkeeper(100)
    assert not door.put_or_has(5) and door.put_or_has(5)
    door.reset()
    assert not door.put_or_has(5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=4), max_size=4), st.integers(0, 40))
def test_decode_round_trip_and_any_cut(commands, cut):
    frames = [b"*%d\r\n" % len(c) + b"".join(b"$%d\r\n%b\r\n" % (len(a), a) for a in c) for c in commands]
    data = b"".join(frames)
    assert [args for _, args, outcome in decode(data) if outcome == "ok"] == commands
    part = decode(data[:cut])
    assert all(o == "ok" for _, _, o in part[:-1]) and all(o in ("ok", "truncated") for _, _, o in part)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_decode_never_fails(data):
    assert all(at <= len(data) for at, _, _ in decode(data, DecodeLimits(bulk=8, array=4)))


def shortest(x):
    """From the digits of Python's own shortest text, of fixed layout."""
    if math.isnan(x) or math.isinf(x):
        return {True: "nan"}.get(math.isnan(x), "inf" if x > 0 else "-inf")
    sign, digits, exp = "-" if math.copysign(1, x) < 0 else "", *f"{abs(x)!r}e0".split("e")[:2]
    whole, _, part = digits.partition(".")
    raw = (whole + part).lstrip("0")
    place = int(exp) + len(whole) - 1 - (len(whole + part) - len(raw))
    raw = raw.rstrip("0")
    if not raw:
        return sign + "0"
    if place < -4 or place >= 6:
        return f"{sign}{raw[0]}{'.' + raw[1:] if raw[1:] else ''}e{'-' if place < 0 else '+'}{abs(place):02d}"
    if place < 0:
        return f"{sign}0.{'0' * (-place - 1)}{raw}"
    return sign + raw[: place + 1].ljust(place + 1, "0") + ("." + raw[place + 1 :] if raw[place + 1 :] else "")


def test_double_text(spark):
    rng = random.Random(6)
    xs = [0.0, -0.0, 1e6, 999999.0, 999999.5, 1234567.5, 1e-4, 9.9e-5, 123456789.0, 1e21, 1e22, 100.0, 0.1, float("inf"), float("-inf"), float("nan"), 1.5e300, 2.5e-300]
    xs += [round(rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 12), rng.randrange(12)) for _ in range(300)]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", resp.double_text(F.col("x"))).collect()
    assert [r[1] for r in sorted(found)] == [shortest(x) for x in xs]


def test_echoed_bytes(spark):
    texts = ["", "a\tb\r\n", "é" * 100, "x" + "漢" * 60, "y" * 127 + "🙂", "\x7f\x00", "~" * 300]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", commands.as_bytes(commands.sanitized(F.col("t")))).collect()
    assert [bytes(r[1]) for r in sorted(found)] == [bytes(63 if b < 32 or b == 127 else b for b in t.encode()[:128]) for t in texts]


def test_gate_equals_loops(spark):
    rng = random.Random(9)
    kinds = "experiment string, subject string, cores int, data_size int, rate int, run_id long, ops long, failed boolean, srv_cpu int, cli_cpu int, srv_nic int, cli_nic int, srv_mbps int, cli_mbps int"
    rows = []
    for c in range(80):
        base, steady = rng.choice([0, 1000, 1000, 1000]), rng.random() < 0.6
        for k in range(rng.randrange(1, 5)):
            ops = base + (rng.randrange(10) if steady else rng.randrange(900)) if base else 0
            rows.append((f"E{c % 3}", f"s{c}", 8, 64, c % 2 * 100, c * 10 + k, ops, rng.random() < 0.05, rng.randrange(40, 101), rng.randrange(70, 90), rng.randrange(60, 84), rng.randrange(60, 84), rng.randrange(10000, 20500), rng.randrange(10000, 20500)))
    expected = {}
    for subject in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == subject), key=lambda r: r[5])
        ops = [r[6] for r in own]
        best, cov = min(own, key=lambda r: abs(r[6] - statistics.median(ops))), statistics.pstdev(ops) / statistics.mean(ops) if statistics.mean(ops) else 0
        *_, srv, cli, srv_nic, cli_nic, srv_mbps, cli_mbps = best
        valid = "memtier-failed" if any(r[7] or r[6] == 0 for r in own) else "rig-limited:client-cpu" if cli >= 85 else "rig-limited:nic" if max(srv_nic, cli_nic) >= 80 or max(srv_mbps, cli_mbps) >= 20000 else "under-generated:srv-cpu<65" if best[4] == 0 and srv < 65 else "noisy:cov>5%" if cov > 0.05 else "valid"
        expected[subject] = best[5], valid, round(cov, 9)
    found = {r["subject"]: (r["run_id"], r["valid"], round(r["cov"], 9)) for r in benchstats.gated(spark.createDataFrame(rows, kinds)).collect()}
    assert found == expected and len({v for _, v, _ in found.values()}) > 4


def test_table_without_skipped(spark):
    results = spark.createDataFrame([("b", 1234.5, None, 0.25, 0.0, 0.5, None), ("a", 10.0, 2.5, None, 1.0, -1.0, 2.0)], "subject string, get_rps double, set_rps double, hit_ratio double, p50 double, p99 double, p999 double")
    none = spark.createDataFrame([], "subject string")
    lines = benchstats.render_table(results, none, ["b"]).first()[0].split("\n")
    assert lines[2:] == ["| b | 1234 | \u2014 | 0.2500 | \u2014 | 0.500 | \u2014 |", "| a | 10 | 2 | \u2014 | 1.000 | \u2014 | 2.000 |", ""]
