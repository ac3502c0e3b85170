"""Replay of a log against memory ceilings: no eviction, random, frequency-based, exact LRU.

Whether a command finds its key under a ceiling depends on all commands before it, of whatever
key, so one trace under one configuration is sequential. Parallelism is that of the configurations;
each passes over the log part by part, a task each, and the log is sorted once for all of them.
Without a ceiling keys are independent, and so are tasks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from kvlog.sources.shared import removed, shared_dir

from .replay import BLOCK, ENTRY
from .sketch import MOST, ROWS, Frequencies, mixed, sketch_size

POLICIES = ("noeviction", "allkeys-random", "allkeys-lfu")
#: Candidates of an eviction, the draws that look for them, and evictions in vain before it gives up.
DRAWS, TRIES, FRUITLESS = 5, 8 * 5 + 16, 100


def parse_policy(name: str) -> str:
    if name not in POLICIES:
        raise ValueError(f"unknown eviction policy {name!r}")
    return name


def fingerprint(key: str, seed: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")


#: What a cache is built with where nothing else is asked for, on a machine of so many cores.
DEFAULTS, CORES = {"policy": "allkeys-lfu", "maxmemory": "0", "shards": "0", "seed": "1", "clock": "log"}, 8


def built(settings: DataFrame) -> DataFrame:
    """(cache, policy, maxmemory, shards, seed, clock) of each cache of `settings` (cache, n, name,
    value): of the values of a name the last one holds, null ones are passed over. A ceiling below
    zero is none; shards are a power of two, by the cores where none are asked for."""
    last = lambda name: F.coalesce(F.max_by("value", F.when((F.col("name") == name) & F.col("value").isNotNull(), F.col("n"))), F.lit(DEFAULTS[name]))
    rows = settings.groupBy("cache").agg(*[last(n).alias(n) for n in DEFAULTS])
    n = F.when(F.col("shards").cast("long") > 0, F.col("shards").cast("long")).otherwise(F.lit(4 * CORES).cast("long"))
    power = F.when(n == 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))
    return rows.select("cache", "policy", F.greatest(F.lit(0).cast("long"), F.col("maxmemory").cast("long")).alias("maxmemory"), power.cast("int").alias("shards"), F.col("seed").cast("int").alias("seed"), "clock")


@dataclass
class Outcome:
    ok: bool
    usage: int
    evicted: int


#: The expiry of what stays, later than any instant.
NEVER = (1 << 63) - 1
#: Draws that are hashed at once, and keys whose places in the sketch are kept.
AHEAD, KNOWN = 1 << 12, 1 << 16


class Simulator:
    """A keyspace with a ceiling in bytes; zero and less mean none. Victims are the best of
    DRAWS distinct candidates, drawn by a hash of (seed, number of the draw), so that a run repeats."""

    def __init__(self, policy: str = "allkeys-lfu", ceiling: int = 0, seed: int = 1):
        self.policy, self.ceiling, self.seed = parse_policy(policy), ceiling, seed
        self.entries: dict[str, tuple[int, int]] = {}
        self.order: list[str] = []
        self.place: dict[str, int] = {}
        self.usage = self.hits = self.misses = self.evictions = self.drawn = 0
        self.frequencies = Frequencies(sketch_size(ceiling), seed)
        self._known: dict[str, list[int]] = {}
        self._ahead: list[int] = []

    def __getstate__(self) -> dict:
        """Without what follows from the rest."""
        return {k: v for k, v in self.__dict__.items() if k != "place"} | {"_known": {}, "_ahead": []}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, place={k: i for i, k in enumerate(state["order"])})

    @property
    def active(self) -> bool:
        return self.policy == "allkeys-lfu" and self.ceiling > 0

    def _places(self, key: str) -> list[int]:
        """The key's places in the sketch and, behind these, in the doorkeeper; some are kept."""
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= KNOWN:
                self._known.clear()
            known = self._known[key] = self.frequencies.places(fingerprint(key, self.seed))
        return known

    def get(self, key: str, now: int) -> bool:
        entry = self.entries.get(key)
        if entry is None or now >= entry[1]:
            self.misses += 1
            return False
        self.hits += 1
        if self.active:
            self.frequencies.record_at(self._places(key))
        return True

    def set(self, key: str, size: int, now: int, ttl: int | None = None) -> Outcome:
        new, before = len(key.encode()) + size + ENTRY, self.evictions
        written = self.usage + new - self.entries.get(key, (0,))[0]
        ok = self.put(key, new, now + ttl if ttl and ttl > 0 else NEVER)
        return Outcome(ok, written if ok else self.usage, self.evictions - before)

    def put(self, key: str, new: int, expires: int) -> bool:
        """A write of an entry of `new` bytes in all; false where there is no room for it."""
        old = self.entries.get(key)
        delta = new - old[0] if old else new
        if self.policy == "noeviction" and self.ceiling > 0 and delta > 0 and self.usage + delta > self.ceiling:
            return False
        if old is None:
            self.place[key] = len(self.order)
            self.order.append(key)
        self.entries[key] = new, expires
        self.usage += delta
        if self.usage > self.ceiling:
            self._evict(key)
        return True

    def _remove(self, key: str) -> None:
        self.usage -= self.entries.pop(key)[0]
        at, last = self.place.pop(key), self.order.pop()
        if last != key:
            self.order[at], self.place[last] = last, at

    def delete(self, key: str, now: int) -> bool:
        entry = self.entries.get(key)
        if entry is None:
            return False
        self._remove(key)
        return now < entry[1]

    def set_ceiling(self, ceiling: int) -> int:
        if sketch_size(ceiling) != sketch_size(self.ceiling):
            self.frequencies.resize(sketch_size(ceiling))
            self._known.clear()
        self.ceiling = ceiling
        return self._evict(None)

    def set_policy(self, policy: str) -> None:
        """Holds for the evictions to come; nothing is evicted for it."""
        self.policy = parse_policy(policy)

    def _hash_ahead(self) -> None:
        at = np.arange(self.drawn + 1, self.drawn + 1 + AHEAD, dtype=np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        self._ahead = mixed(at)[::-1].tolist()

    def _sample(self) -> list[str]:
        """DRAWS distinct keys, fewer only where a bounded number of draws does not meet as many."""
        found: dict[str, None] = {}
        order, n = self.order, len(self.order)
        most = min(DRAWS, n)
        for _ in range(TRIES if order else 0):
            if len(found) == most:
                break
            if not self._ahead:
                self._hash_ahead()
            self.drawn += 1
            found[order[self._ahead.pop() % n]] = None
        return list(found)

    def _rarest(self, keys: list[str]) -> str:
        """The first of the keys with the least estimate."""
        known, cells, best, least = self._known, self.frequencies.sketch.cells, None, MOST + 1
        for key in keys:
            a, b, c, d = (known.get(key) or self._places(key))[:ROWS]
            n = min(cells[a], cells[b], cells[c], cells[d])
            if n < least:
                best, least = key, n
        return best

    def _evict(self, written: str | None) -> int:
        if self.policy == "noeviction" or self.ceiling <= 0:
            return 0
        evicted = fruitless = 0
        while self.usage > self.ceiling:
            drawn = [k for k in self._sample() if k != written]
            if not drawn:
                fruitless += 1
                if fruitless > FRUITLESS:
                    break
                continue
            self._remove(drawn[0] if self.policy == "allkeys-random" else self._rarest(drawn))
            evicted += 1
        self.evictions += evicted
        return evicted


RESULT = "policy string, ceiling long, hits long, misses long, evictions long, rejected long, usage long, physical long"


def in_order(rows: DataFrame, keys: int, fold, schema: str) -> DataFrame:
    """What `fold` (key, rows) yields for each value of the first `keys` columns; rows come as tuples of
    the columns behind seq, the one after these, in its order. They are sorted by Spark, which
    spills, and pass by in batches: a task holds what `fold` holds, not the trace."""
    by, kinds = rows.columns[: keys + 1], StructType.fromDDL(schema)
    size = 8192

    def run(batches):
        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for key, own in groupby(flat, key=lambda r: r[:keys]):
            for row in fold(key, (r[keys + 1 :] for r in own)):
                out.append(row)
                if len(out) >= size:
                    yield as_batch(out)
                    out = []
        yield as_batch(out)

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], to_arrow_type(f.dataType)) for i, f in enumerate(kinds.fields)], kinds.names)

    return rows.repartition(*by[:keys]).sortWithinPartitions(*by).mapInArrow(run, schema)


#: Rows of a log that one task passes over before it hands on what it holds.
PART = 1 << 20
#: Bytes of one row of what is handed on.
SLICE = 1 << 24
HELD = "slot int, number long, rows binary"


def _packed(batches):
    """Each batch as one row (part, number, n, rows) without its leading (part, seq), compressed; n are its rows."""
    for number, b in enumerate(b for b in batches if b.num_rows):
        own, sink = b.drop_columns(b.schema.names[:2]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(own)
        yield pa.RecordBatch.from_arrays([b.column(0)[:1], pa.array([number], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "number", "n", "rows"])


def _turns(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Parts of `sizes` (part, rows), in their order, by turns of at most `most` rows, or one part."""
    turns: list[list[int]] = []
    held = 0
    for part, n in sorted(sizes):
        held += n
        if not turns or held > most:
            turns.append([])
            held = n
        turns[-1].append(part)
    return turns


def _sliced(slot: int, machine):
    held = pickle.dumps(machine, pickle.HIGHEST_PROTOCOL)
    starts = range(0, len(held), SLICE)
    return [(slot, i - len(starts), held[at : at + SLICE]) for i, at in enumerate(starts)]


def in_parts(rows: DataFrame, machines: list, schema: str, part: int = PART) -> DataFrame:
    """What `results()` of each machine yields after all of `rows`, which has passed through its
    `feed(*columns)` in the order of seq, the first column; fed are lists of the others, without nulls but for texts.

    The rows are cut by ranges of seq into parts of about `part` rows, each sorted and packed by a
    task of its own. Part by part each machine is one task: it takes the machine as the part before
    left it, in the shared folder, and leaves it there again. So a task's time and memory are those
    of a part and of what a machine holds, however long the log is. The parts are those that were
    written, be they more than asked for; small ones pass in one turn."""
    spark, n = rows.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    folder, parts, results = shared_dir(spark, "replay"), -(-n // part), StructType.fromDDL(schema)
    cut = rows.repartitionByRange(parts, rows.columns[0]).select(F.spark_partition_id().alias("part"), *rows.columns)
    cut.sortWithinPartitions("part", rows.columns[0]).mapInArrow(_packed, "part int, number long, n long, rows binary").write.partitionBy("part").parquet(f"{folder}/log")
    log = spark.read.schema("number long, n long, rows binary, part int").parquet(f"{folder}/log")
    turns = _turns([tuple(r) for r in log.groupBy("part").agg(F.sum("n")).collect()], part)
    number = (F.col("part").cast("long") * (1 << 32) + F.col("number")).alias("number")
    each = F.explode(F.array(*[F.lit(i) for i in range(len(machines))])).alias("slot")

    def stage(kinds: StructType, leave):
        def run(batches):
            flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for slot, own in groupby(flat, key=lambda r: r[0]):
                held, machine = [], None
                for _, number, data in own:
                    if number < 0:
                        held.append(data)
                        continue
                    machine, held = machine or pickle.loads(b"".join(held)), []
                    for b in pa.ipc.open_stream(data):
                        machine.feed(*(c.to_numpy(zero_copy_only=False).tolist() for c in b.columns))
                for row in leave(slot, machine or pickle.loads(b"".join(held))):
                    yield pa.RecordBatch.from_arrays([pa.array([x], to_arrow_type(f.dataType)) for x, f in zip(row, kinds.fields, strict=True)], kinds.names)

        return run

    held = spark.createDataFrame([r for i, m in enumerate(machines) for r in _sliced(i, m)], HELD)
    for i, turn in enumerate(turns):
        last = i == len(turns) - 1
        kinds, leave = (results, lambda _, m: m.results()) if last else (StructType.fromDDL(HELD), _sliced)
        own = held.unionByName(log.filter(F.col("part").between(turn[0], turn[-1])).select(each, number, "rows"))
        own = own.repartitionById(len(machines), "slot").sortWithinPartitions("slot", "number").mapInArrow(stage(kinds, leave), schema if last else HELD)
        own.write.parquet(f"{folder}/{i}")
        held = spark.read.schema(schema if last else HELD).parquet(f"{folder}/{i}")
        for done in (f"{folder}/{i - 1}", *([f"{folder}/log"] if last else [f"{folder}/log/part={p}" for p in turn])):
            removed(spark, done)
    return held


READ, SET, DEL, ASTRAY = 1, 2, 3, 4


class Replaying:
    """One configuration's replay of a log, of rows as `commands` makes them."""

    def __init__(self, policy: str, ceiling: int, seed: int, fill: bool, warm: int, half: int, lower_to: int | None, switch_to: str | None):
        self.policy, self.ceiling, self.sim = policy, int(ceiling), Simulator(policy, int(ceiling), seed)
        self.fill, self.warm, self.half, self.lower_to, self.switch_to = fill, warm, half, lower_to, switch_to
        self.at = self.rejected = 0

    def feed(self, *columns: list) -> None:
        n = len(columns[0])
        cuts = sorted({0, n} | {x - self.at for x in (self.warm, self.half) if 0 <= x - self.at < n})
        for a, b in pairwise(cuts):
            self._turn(self.at + a)
            self._run(*(c[a:b] for c in columns))
        self.at += n

    def _turn(self, at: int) -> None:
        if at == self.warm:
            self.sim.hits = self.sim.misses = 0
        if at == self.half and self.switch_to:
            self.sim.set_policy(self.switch_to)
        if at == self.half and self.lower_to is not None:
            self.sim.set_ceiling(self.lower_to)

    def _run(self, ops: list, keys: list, instants: list, costs: list, expiries: list) -> None:
        sim, get, put, delete = self.sim, self.sim.get, self.sim.put, self.sim.delete
        for op, key, now, cost, expires in zip(ops, keys, instants, costs, expiries, strict=True):
            if op == READ:
                if not get(key, now) and self.fill and not put(key, cost, NEVER):
                    self.rejected += 1
            elif op == SET:
                if not put(key, cost, expires):
                    self.rejected += 1
            elif op == DEL:
                delete(key, now)
            elif op == ASTRAY:
                sim.misses += 1

    def results(self):
        sim = self.sim
        yield self.policy, self.ceiling, sim.hits, sim.misses, sim.evictions, self.rejected, sim.usage, len(sim.entries)


class Recording:
    """The frequencies of keys, as the one row of bytes that they pickle to."""

    def __init__(self, counters: int, seed: int):
        self.seed, self.frequencies = seed, Frequencies(counters, seed)

    def feed(self, keys: list) -> None:
        for k in keys:
            self.frequencies.record(fingerprint(k, self.seed))

    def results(self):
        yield (pickle.dumps(self.frequencies),)


def commands(log: DataFrame, fill: int | None) -> DataFrame:
    """(seq, op, key, now, cost, expires): codes of commands, and for what is or may be written its
    bytes and expiry. A null value has no bytes; at a null instant all that expires has expired.
    Without a key a read misses and nothing is written."""
    read = F.col("op").isin("GET", "EXISTS")
    op = F.when(F.col("key").isNull(), F.when(read, ASTRAY)).when(read, READ).when(F.col("op") == "SET", SET).when(F.col("op") == "DEL", DEL)
    size = F.when(read, F.lit(fill or 0)).otherwise(F.coalesce("value_len", F.lit(0)))
    never = F.lit(NEVER)
    return log.select(
        "seq",
        F.coalesce(op, F.lit(0)).cast("tinyint").alias("op"),
        "key",
        F.coalesce("ts_us", never - 1).alias("now"),
        F.coalesce(F.octet_length("key") + size + ENTRY, F.lit(0)).cast("long").alias("cost"),
        F.coalesce(F.when(F.col("ttl_us") > 0, F.try_add("ts_us", "ttl_us")), never).alias("expires"),
    )


def replay_unbounded(log: DataFrame, fill: bool, warm: int, block: int = BLOCK) -> DataFrame:
    """(hits, misses, usage, physical) of `commands` without a ceiling, where keys do not bear on
    each other. What a key holds is its last mutation and, as a read that misses fills, the latest instant
    of a read since: was that past the expiry, the entry was filled. Within blocks of seq both are
    found by windows; of each key and block one row is carried forward, so one hot key is many tasks' work."""
    read = F.col("op") == READ
    rows = log.filter(F.col("op").isin(READ, SET, DEL)).select(
        "key", "seq", "now", "cost", read.alias("read"), F.floor(F.col("seq") / block).alias("b"),
        F.when(~read, F.struct((F.col("op") == SET).alias("set"), "cost", "expires")).alias("m"),
        (F.when(read, F.col("now")) if fill else F.lit(None).cast("long")).alias("r"),
        F.when(read, F.col("cost")).alias("filled"),
    )
    rows = rows.withColumn("turn", F.count("m").over(Window.partitionBy("key", "b").orderBy("seq")))
    turns = rows.groupBy("key", "b", "turn").agg(F.first("m", ignorenulls=True).alias("m"), F.max("r").alias("r"), F.max("filled").alias("filled"))
    ends = turns.groupBy("key", "b").agg(F.max_by(F.struct("m", "r"), "turn").alias("e"), F.max("filled").alias("filled"))
    ends = ends.select("key", "b", "filled", "e.m", "e.r")
    blocks = Window.partitionBy("key").orderBy("b")
    ends = ends.withColumn("turn", F.count("m").over(blocks))
    same = Window.partitionBy("key", "turn").orderBy("b")
    ends = ends.select("key", "b", "filled", F.first("m", ignorenulls=True).over(same).alias("m"), F.max("r").over(same).alias("r"))
    before = ends.select("key", "b", F.lag(F.struct("m", "r")).over(blocks).alias("c")).filter("c is not null")
    held = lambda m, r: F.coalesce(m["set"], F.lit(False)) & ~F.coalesce(r >= m["expires"], F.lit(False))
    last = ends.groupBy("key").agg(F.max_by(F.struct("m", "r"), "b").alias("e"), F.max("filled").alias("filled"))
    cost = F.when(held(F.col("e.m"), F.col("e.r")), F.col("e.m.cost")).when(F.col("e.r").isNotNull(), F.col("filled"))
    kept = last.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("usage"), F.count(cost).alias("physical"))

    own = Window.partitionBy("key", "b", "turn").orderBy("seq")
    reads = rows.withColumns({"m": F.first("m", ignorenulls=True).over(own), "r": F.max("r").over(own.rowsBetween(Window.unboundedPreceding, -1))}).filter("read").join(before, ["key", "b"], "left")
    first = F.col("turn") == 0
    reads = reads.select("seq", "now", F.when(first, F.col("c.m")).otherwise(F.col("m")).alias("m"), F.when(first, F.greatest("c.r", "r")).otherwise(F.col("r")).alias("r"))
    hit = F.when(held(F.col("m"), F.col("r")), F.col("now") < F.col("m.expires")).otherwise(F.col("r").isNotNull())
    found = reads.select("seq", hit.alias("hit")).unionByName(log.filter(F.col("op") == ASTRAY).select("seq", F.lit(False).alias("hit")))
    start = log.select("seq").sort("seq").offset(warm).limit(1).first() if warm else None
    if start:
        found = found.filter(F.col("seq") >= start[0])
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).crossJoin(kept)


def replay_policies(log: DataFrame, configurations: list[tuple[str, int]], fill: int | None = None, lower_to: int | None = None, switch_to: str | None = None, seed: int = 1, warm: int = 0, part: int = PART) -> DataFrame:
    """(policy, ceiling, hits, misses, evictions, rejected, usage, physical) of the whole log under
    each configuration. With `fill` a read that misses writes its key, with a value of so many
    bytes. With `lower_to` the
    ceiling falls to that after half of the rows, with `switch_to` the policy becomes that. Hits and misses are those after the first
    `warm` rows; the rest is of the whole log. Configurations that never have a ceiling are one replay by
    key; the others pass over the log in parts of `part` rows."""
    for policy, _ in configurations:
        parse_policy(policy)
    half = log.count() // 2 if lower_to is not None or switch_to else -1
    rows, free = commands(log, fill), [] if lower_to is not None and lower_to > 0 else [c for c in configurations if c[1] <= 0]
    bound = [c for c in configurations if c not in free]
    machines = [Replaying(p, c, seed, fill is not None, warm, half, lower_to, switch_to) for p, c in bound]
    found = in_parts(rows, machines, RESULT, part) if bound else log.sparkSession.createDataFrame([], RESULT)
    if not free or log.isEmpty():
        return found
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(c).cast("long").alias("ceiling")) for p, c in free])).alias("_c")
    none = F.lit(0).cast("long")
    return found.unionByName(replay_unbounded(rows, fill is not None, warm).select(each, "*").select("_c.*", "hits", "misses", none.alias("evictions"), none.alias("rejected"), "usage", "physical"))


def replay_lru(trace: DataFrame, capacity: int, entry: int, warm: int = 0) -> DataFrame:
    """The row of `replay_policies` for naive LRU of `capacity` entries of `entry` bytes each."""

    def fold(_, keys):
        cache, hits, total, n = NaiveLru(capacity), 0, 0, 0
        for n, (k,) in enumerate(keys, 1):
            hit = cache.access(k)
            total += not hit
            hits += hit and n > warm
        held = len(cache.keys)
        yield "naive-lru", capacity * entry, hits, max(0, n - warm) - hits, total - held, 0, held * entry, held

    return in_order(trace.select(F.lit(0).alias("trace"), "seq", "key"), 1, fold, RESULT)


def reuse_distances(trace: DataFrame) -> DataFrame:
    """(seq, key, distance): how many other keys were accessed since the key's last access, null
    for the first. One pass answers every capacity: exact LRU of c entries hits if distance < c."""

def earlier(values: np.ndarray, equal: bool) -> np.ndarray:
    """How many values before each one are less than it, or with `equal` no greater: halves of ever
    longer stretches are counted against each other, as in a merge sort."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    counts, span, side = np.zeros(n, np.int64), int(rank.max(initial=0)) + 2, "right" if equal else "left"
    place, width = np.arange(n), 1
    while width < n:
        stretch, right = place // (2 * width), place // width % 2 == 1
        left = np.sort(rank[~right] + stretch[~right] * span)
        # left halves are full wherever there is a right half
        counts[right] += np.searchsorted(left, rank[right] + stretch[right] * span, side) - stretch[right] * width
        width *= 2
    return counts


def _within(rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """What one block knows of distances: (seq, part). With p the last access of a key before i, they
    sum up to the accesses between p and i of which the last one of the same key is not after p:
    of those in the block of i, and in the block of p, and, as far as that lies in the block of
    p, of their last ones, in the blocks between."""
    rows = rows.sort_values("seq")
    seq, prev, after = (rows[c].to_numpy(np.int64) for c in ("seq", "prev", "next"))
    at = seq[0] // block
    again, here = prev >= 0, prev // block == at
    part = earlier(prev, equal=True) - np.where(here, np.searchsorted(seq, prev) + 1, 0)
    leaves = (after < 0) | (after // block != at)
    away = leaves & (after >= 0)
    behind = leaves[::-1].cumsum()[::-1] - leaves
    more = behind[away] + earlier(after[away] // block, equal=False)
    return pd.DataFrame({"seq": np.concatenate([seq[again], after[away]]), "part": np.concatenate([part[again], more])})


def reuse_distances(trace: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, key, distance): how many other keys were accessed since the key's last access, null
    for the first. One answers every capacity: exact LRU of c entries hits if distance < c.

    Blocks of `block` sequence numbers are counted each by itself; between them goes one number for
    each two blocks, so that neither a long trace nor one key of it is one task's work. Sequence
    numbers are unique and not negative."""
    rows = trace.select("seq", "key", F.floor(F.col("seq") / block).cast("long").alias("b"))
    own, blocks = Window.partitionBy("key", "b").orderBy("seq"), Window.partitionBy("key").orderBy("b")
    ends = rows.groupBy("key", "b").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    ends = ends.select("key", "b", F.lag("high").over(blocks).alias("before"), F.lead("low").over(blocks).alias("after"))
    rows = rows.withColumns({"p": F.lag("seq").over(own), "n": F.lead("seq").over(own)}).join(ends, ["key", "b"])
    none = F.lit(-1).cast("long")
    rows = rows.select("seq", "key", "b", F.coalesce("p", "before", none).alias("prev"), F.coalesce("n", "after", none).alias("next"))
    parts = rows.groupBy("b").applyInPandas(lambda own: _within(own, block), "seq long, part long").groupBy("seq").agg(F.sum("part").alias("part"))
    # the accesses of block c whose last one lies before block a, for each a up to c; summed over the blocks c between
    of = F.when(F.col("prev") < 0, none).otherwise(F.floor(F.col("prev") / block).cast("long"))
    pairs = rows.groupBy(F.col("b").alias("c"), (of + 1).alias("a")).agg(F.count("*").alias("n"))
    grid = rows.select(F.col("b").alias("c")).distinct().select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c"))).alias("a"))
    upto = Window.partitionBy("c").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    table = grid.join(pairs, ["c", "a"], "left").select("c", "a", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"))
    between = Window.partitionBy("a").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("a", "c", F.coalesce(F.sum(F.when(F.col("c") > F.col("a"), F.col("n")).otherwise(0)).over(between), F.lit(0)).alias("apart"))
    again = rows.filter("prev >= 0").select("seq", "key", of.alias("a"), F.col("b").alias("c")).join(parts, "seq").join(table, ["a", "c"], "left")
    found = again.select("seq", "key", (F.col("part") + F.when(F.col("c") > F.col("a"), F.coalesce("apart", F.lit(0))).otherwise(0)).alias("distance"))
    return found.unionByName(rows.filter("prev < 0").select("seq", "key", F.lit(None).cast("long").alias("distance")))


class NaiveLru:
    """Capacity in entries; the baseline that reuse distances are held against."""

    def __init__(self, capacity: int):
        self.capacity, self.keys = capacity, OrderedDict()

    def access(self, key: str) -> bool:
        hit = key in self.keys
        self.keys[key] = True
        self.keys.move_to_end(key)
        while len(self.keys) > self.capacity:
            self.keys.popitem(last=False)
        return hit
