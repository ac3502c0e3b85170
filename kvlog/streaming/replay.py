"""Replay of a command log as a stream: a key's entry is the state of that key.

Within a micro-batch a key's commands are folded in `seq` order; a mutation older than one
already folded is late, leaves the state alone and is counted. State is one entry a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "seq long, key string, op string, present boolean, live boolean, late boolean"
STATE = "seq long, present boolean, expires_us long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, present, expires = state.get if state.exists else (-1, False, None)
    rows, out = pd.concat(list(batches)).sort_values("seq"), []
    for seq, op, ts, ttl in zip(rows["seq"].tolist(), rows["op"].tolist(), rows["ts_us"].tolist(), rows["ttl_us"].tolist(), strict=True):
        live, late = present and (expires is None or ts < expires), seq < last
        out.append((seq, key[0], op, present, live, late))
        if late:
            continue
        last = seq
        if op == "SET":
            present, expires = True, None if pd.isna(ttl) or ttl <= 0 else int(ts + ttl)
        elif op == "DEL":
            present, expires = False, None
    state.update((last, present, expires))
    yield pd.DataFrame(out, columns=["seq", "key", "op", "present", "live", "late"])


def stream_replay(log: DataFrame) -> DataFrame:
    """seq, key, op, present, live, late of each command of a streaming log (seq, ts_us, key, op,
    ttl_us); drained, it equals the batch replay of the same log."""
    return log.select("seq", "ts_us", "key", "op", "ttl_us").groupBy("key").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
