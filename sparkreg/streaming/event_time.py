"""A filter in event time: rows may come in any order within the watermark, and state ends with the series.

A row waits until the watermark has passed it; then it and all earlier ones of its key are filtered in order, so the result is
that of the batch filter whatever the order of arrival. A key has one time at which it is due: that of its next waiting row; then,
when nothing waits, the end of an outage, whose prediction is given out; then the end of the key, which is forgotten. Rows
behind the watermark are dropped by Spark, which counts them in the progress of the query (numRowsDroppedByWatermark).

Keys share buckets by a hash: a bucket has one state, an Arrow table of its series and chunks of waiting rows, and one timer at the
first time at which a key of it is due. Every call of a processor, read of a state and timer is a round trip of a millisecond or so
between Spark and Python; a key of its own took about ten of them a batch, a bucket takes them for all its keys.

Rows without an id are heartbeats: they move the watermark and leave no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkreg.streaming.updates import filter_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the store of operators with timers
_STATE = "series binary, timer long"  # series: key, x, p, last, at (microseconds of the last filtered row), phase, due (milliseconds)
_BUFFER = "rows binary"  # key, us, row_id, feature, target
_ROWS, _OUTAGE, _EXPIRY = 0, 1, 2
_NO_KEY, _HEARTBEAT = -1, -2  # buckets of their own


def _packed(df: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


class FilterProcessor(StatefulProcessor):
    def __init__(self, k: Callable[[float], float], noise: float, key: str, exact: bool, unit_us: float, outage_us: int, expire_us: int) -> None:
        self.k, self.noise, self.key, self.exact = k, noise, key, exact
        self.unit_us, self.outage_us, self.expire_us = unit_us, outage_us, expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", _STATE)
        self.buffer = handle.getListState("waiting", _BUFFER)

    def _now(self) -> tuple[pd.DataFrame | None, int | None]:
        """The series of the bucket and its timer."""
        if not self.state.exists():
            return None, None
        packed, timer = self.state.get()
        return _unpacked(packed), timer

    def _keep(self, series: pd.DataFrame, old: int | None) -> None:
        """Writes the series; the bucket's one timer is that of the key that is due first."""
        ms = int(series["due"].min())
        if old != ms:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
        self.state.update((_packed(series), ms))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] != _HEARTBEAT:
            pdf = pd.concat(list(rows), ignore_index=True)[["key", "us", "row_id", "feature", "target"]]
            self.buffer.appendValue((_packed(pdf),))
            series, timer = self._now()
            first = pdf.groupby("key", sort=False, dropna=False)["us"].min().reset_index()
            n = 0 if series is None else len(series)
            keys = first["key"] if series is None else pd.concat([series["key"], first["key"]], ignore_index=True)
            code = pd.factorize(keys, use_na_sentinel=False)[0][n:]
            us, fresh = first["us"].to_numpy(np.int64), code >= n
            if fresh.any():
                new = pd.DataFrame({"key": first["key"][fresh], "x": 0.0, "p": float(self.k(0.0)), "last": np.nan, "at": 0, "phase": _ROWS, "due": -(-us[fresh] // 1000)})
                series = new if series is None else pd.concat([series, new], ignore_index=True)
            at, us = code[~fresh], us[~fresh]
            phase, due = series["phase"].to_numpy(copy=True), series["due"].to_numpy(copy=True)
            later = ~((phase[at] == _ROWS) & (due[at] * 1000 < us))  # an earlier row waits already where this is false
            phase[at[later]], due[at[later]] = _ROWS, -(-us[later] // 1000)
            self._keep(series.assign(phase=phase, due=due), timer)
        yield from ()

    def _out(self, bucket: int, keys: pd.Series, ids, us, features, means, variances, outage: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: None if bucket == _NO_KEY else keys.to_numpy(), "row_id": pd.array(ids, "Int64"), "us": us, "feature": features, "mean": means, "variance": variances, "outage": outage})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        series, _ = self._now()  # the timer has gone
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        x, p, last, at, phase, due = (series[c].to_numpy(copy=True) for c in ("x", "p", "last", "at", "phase", "due"))
        now, was = due * 1000 <= passed, phase.copy()  # one step of a key a batch
        if (now & (was == _ROWS)).any():
            waiting = pd.concat([_unpacked(r[0]) for r in self.buffer.get()], ignore_index=True)
            code = pd.factorize(pd.concat([series["key"], waiting["key"]], ignore_index=True), use_na_sentinel=False)[0][len(series) :]
            ready = (waiting["us"] <= passed).to_numpy() & now[code]
            rest, left = waiting[~ready], np.full(len(series), np.iinfo(np.int64).max)
            np.minimum.at(left, code[~ready], rest["us"].to_numpy(np.int64))
            rows = waiting[ready].assign(code=code[ready]).sort_values(["code", "feature", "row_id"])
            m, v = filter_rows(rows["code"].to_numpy(), rows["feature"].to_numpy(float), rows["target"].to_numpy(float), self.noise, self.k, x, p, last, self.exact)
            done = np.unique(rows["code"])
            at[done] = np.iinfo(np.int64).min
            np.maximum.at(at, rows["code"].to_numpy(), rows["us"].to_numpy(np.int64))
            over = left[done] == np.iinfo(np.int64).max
            due[done] = -(-np.where(over, at[done] + self.outage_us, left[done]) // 1000)
            phase[done] = np.where(over, _OUTAGE, _ROWS)
            if len(rest):
                self.buffer.put([(_packed(rest),)])
            else:
                self.buffer.clear()
            yield self._out(key[0], rows["key"], rows["row_id"], rows["us"], rows["feature"].to_numpy(), m, v, False)
        ends = np.flatnonzero(now & (was == _OUTAGE))
        if len(ends):
            t = last[ends] + self.outage_us / self.unit_us
            m, v = filter_rows(ends, t, np.full(len(ends), np.nan), self.noise, self.k, x.copy(), p.copy(), last.copy(), self.exact)
            phase[ends], due[ends] = _EXPIRY, -(-(at[ends] + self.expire_us) // 1000)
            yield self._out(key[0], series["key"].iloc[ends], [None] * len(ends), at[ends] + self.outage_us, t, m, v, True)
        kept = ~(now & (was == _EXPIRY))
        if kept.any():
            self._keep(series.assign(x=x, p=p, last=last, at=at, phase=phase, due=due)[kept], None)
        else:
            self.state.clear()
            self.buffer.clear()

    def close(self) -> None:
        pass


def event_time_filter(
    rows: DataFrame, k: Callable[[float], float], noise: float, *, delay: str, unit_us: float, outage_us: int, expire_us: int, key: str = "key", exact: bool = False, buckets: int = 256,
) -> DataFrame:
    """(key, row_id, ts, feature, mean, variance, outage) of a stream (key, row_id, ts, feature, target); NaN targets are predicted only.

    ts is the time of the event and feature the same in units of unit_us microseconds. delay: how late rows may come. outage_us
    after its last row a key without rows gets one predicted row (outage true, no id); expire_us after it the key is forgotten
    and begins anew should rows come. expire_us is more than outage_us. Keys share ``buckets`` states, each in the memory of one task;
    the number belongs to the progress of a query and stays as it is when the query goes on.
    """
    if expire_us <= outage_us:
        raise ValueError("a key is forgotten after its outage has ended")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, row_id long, us long, feature double, mean double, variance double, outage boolean"
    bucket = F.when(F.col("row_id").isNull(), _HEARTBEAT).when(F.col(key).isNull(), _NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # whole numbers without nulls: pandas would make doubles of all that share a batch with one, and lose ids beyond 2^53
    known = F.coalesce(F.col(key), F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint") else F.col(key)
    own = rows.select(bucket.alias("bucket"), known.alias("key"), F.coalesce("row_id", F.lit(0)).alias("row_id"), "ts", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), "feature", "target").withWatermark("ts", delay)
    found = own.groupBy("bucket").transformWithStateInPandas(FilterProcessor(k, noise, key, exact, unit_us, outage_us, expire_us), schema, "Append", "EventTime")
    return found.select(key, "row_id", F.timestamp_micros("us").alias("ts"), "feature", "mean", "variance", "outage")
