"""The online store: the entity and card features of a stream, row for row what the batch frames give.

A key's state has a settled part and a pending one. A row reads what is settled strictly before its instant; rows of one
instant wait in the pending part until a later instant comes, so ties never see each other, even across micro-batches. A row
older than the last instant of its key is refused and goes to the output with ``late`` set.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.causal import WINDOWS
from tidemark.session import ship

FIELDS = "id bigint, key string, late boolean, prior_count bigint, since_prev bigint, mean_gap double, amt_mean double, amt_std double, n_distinct_device bigint, device_is_new int, " + ", ".join(f"count_{w} bigint, sum_{w} double" for w in WINDOWS)
FIELD_KINDS = [tuple(x.split()) for x in FIELDS.split(", ")]
NAMES = [n for n, _ in FIELD_KINDS]
#: Of columns with nulls; a frame's columns are made with their types at once, as there is a frame for each key.
KINDS = {"bigint": "Int64", "int": "Int32", "double": "Float64"}
WIDEST = max(WINDOWS.values())


def fresh() -> dict:
    return {"n": 0, "first": None, "last": None, "mean": 0.0, "m2": 0.0, "devices": [], "ring": [], "pending": []}


def fold(s: dict) -> None:
    """Settle the pending rows: moments by Welford's rule, spans, devices and the ring of the widest window."""
    for ts, amount, device in s["pending"]:
        s["n"] += 1
        s["first"] = ts if s["first"] is None else s["first"]
        s["last"] = ts
        d = amount - s["mean"]
        s["mean"] += d / s["n"]
        s["m2"] += d * (amount - s["mean"])
        if device is not None and device not in s["devices"]:
            s["devices"].append(device)
        s["ring"].append([ts, amount])
    s["pending"] = []


def step(s: dict, row_id: int, key: str, ts: int, amount: float, device: str | None) -> tuple:
    """Read, then commit to the pending part."""
    if s["pending"] and s["pending"][0][0] < ts:
        fold(s)
    last = s["pending"][0][0] if s["pending"] else s["last"]
    if last is not None and ts < last:
        return (row_id, key, True, *[None] * (len(NAMES) - 3))
    s["ring"] = [x for x in s["ring"] if x[0] >= ts - WIDEST]
    n = s["n"]
    gap = (s["last"] - s["first"]) / (n - 1) if n > 1 else None
    new = int(device not in s["devices"]) if device is not None and s["devices"] else None
    out = [row_id, key, False, n, ts - s["last"] if n else None, gap, s["mean"] if n else None, math.sqrt(s["m2"] / (n - 1)) if n > 1 else None, len(s["devices"]), new]
    for w in WINDOWS.values():
        inside = [a for t, a in s["ring"] if t >= ts - w]
        out += [len(inside), math.fsum(inside)]
    s["pending"].append([ts, amount, device])
    return tuple(out)


class Store(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
        batch = sorted((x for f in rows for x in zip(*(f[c].tolist() for c in ("ts", "id", "amount", "device")), strict=True)), key=lambda x: x[:2])
        out = [step(s, int(i), str(key[0]), int(ts), float(amount), None if pd.isna(device) else str(device)) for ts, i, amount, device in batch]
        self.state.update((json.dumps(s),))
        yield pd.DataFrame({n: pd.array(x, KINDS[k]) if k in KINDS else x for (n, k), x in zip(FIELD_KINDS, zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def features(stream: DataFrame, grain: str = "entity") -> DataFrame:
    """stream: id, ts, amount, device and the grain. Needs the RocksDB state store."""
    ship(stream.sparkSession)
    keyed = stream.selectExpr("id", "ts", "amount", "device", f"cast({grain} as string) as key")
    return keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=Store(), outputStructType=FIELDS, outputMode="Append", timeMode="None")


def replay(frame: pd.DataFrame, grain: str = "entity") -> pd.DataFrame:
    """The same store without Spark, one row after the other."""
    states: dict[str, dict] = {}
    out = []
    for r in frame.sort_values(["ts", "id"]).itertuples():
        key = str(getattr(r, grain))
        out.append(step(states.setdefault(key, fresh()), int(r.id), key, int(r.ts), float(r.amount), None if pd.isna(r.device) else r.device))
    return pd.DataFrame(out, columns=NAMES)


def weekly(stream: DataFrame, ts: str = "event_time", late: str = "1 day") -> DataFrame:
    """Tumbling weeks with a watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark(ts, late).groupBy(F.window(ts, "7 days").alias("week")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
