"""Event time, long series in parallel, and running totals that a restart does not count twice."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.streaming import scan
from sparkreg.streaming import updates as U
from sparkreg.streaming.event_time import event_time_filter
from sparkreg.streaming.totals import KeyedTotals


def decay(d):
    return 4 * math.exp(-abs(d) / 2)


# ---- a long series


def series(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for key, n in sizes.items():
        t = np.sort(rng.integers(0, 3 * n, n) / 4.0)  # with equal times
        out += [(key, i, float(x), float("nan") if rng.random() < 0.2 else float(rng.standard_normal())) for i, x in enumerate(t)]
    return out, spark.createDataFrame(out, "key long, row_id long, feature double, target double").repartition(5)


@pytest.mark.parametrize("exact", [False, True])
def test_scan_equals_the_serial_filter(spark, exact):
    data, df = series(spark, {1: 2000, 2: 37, 3: 1, None: 90, 4: 64})
    got = scan.scan_filter(df, decay, 0.5, exact=exact, chunk_rows=32).toPandas().sort_values("row_id")
    assert len(got) == len(data)
    for key in (1, 2, 3, None, 4):
        own = [r for r in data if r[0] == key]
        m, v = U.filter_steps(np.array([r[2] for r in own]), np.array([r[3] for r in own]), 0.5, decay, exact=exact)
        mine = got[got.key.isna() if key is None else got.key == key]
        np.testing.assert_allclose(mine["mean"], m, atol=1e-9)
        np.testing.assert_allclose(mine["variance"], v, atol=1e-9)


def test_long_and_short_series_in_one_call(spark):
    data, df = series(spark, {1: 300, 2: 20, None: 120})
    a = U.kalman_filter(df, decay, 0.5, chunk_rows=50, long_rows=50).toPandas()
    b = U.kalman_filter(df, decay, 0.5).toPandas()
    for x in (a, b):
        x["key"] = x["key"].fillna(-1)
    a, b = (x.sort_values(["key", "row_id"]).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(data) == len(b)
    np.testing.assert_allclose(a[["key", "row_id", "mean", "variance"]], b[["key", "row_id", "mean", "variance"]], atol=1e-9)


def test_scan_of_an_empty_table(spark):
    assert scan.scan_filter(spark.createDataFrame([], "key long, row_id long, feature double, target double"), decay, 0.5).count() == 0


# ---- event time

SCHEMA = "key long, row_id long, ts timestamp, feature double, target double"


def write(spark, path, rows):
    """One file of rows (key, row_id, seconds, target)."""
    df = spark.createDataFrame([(k, i, None if s is None else float(s), y) for k, i, s, y in rows], "key long, row_id long, feature double, target double")
    df.withColumn("ts", F.timestamp_micros((F.col("feature") * 1e6).cast("long"))).select("key", "row_id", "ts", "feature", "target").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, progress):
    """All files so far, one a batch; the progress of each batch."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    found = event_time_filter(stream, decay, 0.5, delay="10 seconds", unit_us=1e6, outage_us=30_000_000, expire_us=60_000_000)
    query = found.writeStream.outputMode("append").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def test_disorder_restart_late_rows_outages_and_the_end_of_state(spark, tmp_path):
    path, out, progress = (f"file://{tmp_path}/{x}" for x in ("in", "out", "progress"))
    rng = np.random.default_rng(3)
    rows = [(k, 100 * k + i, 3.0 * i + 0.1 * k, float(rng.standard_normal())) for k in (1, 2) for i in range(12)]
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 8)  # each within the delay of ten seconds
    for lo in range(0, 12, 6):
        write(spark, path, order[lo : lo + 6])
    run(spark, path, out, progress)
    for lo in range(12, 24, 6):  # a new run goes on from the state of the one before
        write(spark, path, order[lo : lo + 6])
    write(spark, path, [(None, None, 60.0, 0.0)])  # lets the watermark pass all rows
    write(spark, path, [(1, 999, 5.0, 9.0), (None, None, 61.0, 0.0)])  # far behind the watermark
    steps = run(spark, path, out, progress)
    assert sum(s["stateOperators"][0]["numRowsDroppedByWatermark"] for s in steps) == 1
    got = spark.read.option("basePath", out).parquet(f"{out}/batch=*").toPandas()
    assert len(got[~got.outage]) == len(rows)
    for k in (1, 2):
        own = sorted(r for r in rows if r[0] == k)
        m, v = U.filter_steps(np.array([r[2] for r in own]), np.array([r[3] for r in own]), 0.5, decay)
        mine = got[(got.key == k) & ~got.outage].sort_values("row_id")
        np.testing.assert_allclose(mine["mean"], m, atol=1e-12)
        np.testing.assert_allclose(mine["variance"], v, atol=1e-12)
    write(spark, path, [(None, None, 90.0, 0.0)])
    write(spark, path, [(None, None, 300.0, 0.0)])
    write(spark, path, [(None, None, 301.0, 0.0)])
    steps = run(spark, path, out, progress)
    got = spark.read.option("basePath", out).parquet(f"{out}/batch=*").toPandas()
    ends = got[got.outage].sort_values("key")
    assert ends.key.tolist() == [1, 2] and ends.row_id.isna().all()
    for k, mean, variance in zip(ends.key, ends["mean"], ends["variance"], strict=True):
        own = sorted(r for r in rows if r[0] == k)
        m, v = U.filter_steps(np.array([*(r[2] for r in own), own[-1][2] + 30]), np.array([*(r[3] for r in own), np.nan]), 0.5, decay)
        np.testing.assert_allclose((mean, variance), (m[-1], v[-1]), atol=1e-12)
    assert steps[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_keys_share_states_and_timers(spark, tmp_path):
    """A state and a timer a key were ten round trips between Spark and Python a key and batch."""
    path, out, progress = (f"file://{tmp_path}/{x}" for x in ("in", "out", "progress"))
    rng = np.random.default_rng(4)
    keys = [None, *(2**53 + 1 + k for k in range(1200))]
    rows = [(k, 10 * n + i, float(i + rng.random() * 7), float("nan") if rng.random() < 0.2 else float(rng.standard_normal())) for n, k in enumerate(keys) for i in range(3)]
    write(spark, path, rows[1::2])
    write(spark, path, rows[0::2])
    first = run(spark, path, out, progress)
    assert max(s["stateOperators"][0]["numRowsTotal"] for s in first) < len(keys)
    write(spark, path, [(None, None, 40.0, 0.0)])
    run(spark, path, out, progress)  # goes on from the states
    got = {r.row_id: r for r in spark.read.option("basePath", out).parquet(f"{out}/batch=*").where("not outage").withColumn("us", F.unix_micros("ts")).collect()}
    assert len(got) == len(rows)
    for n, k in enumerate(keys):
        own = sorted(rows[3 * n : 3 * n + 3], key=lambda r: r[2])
        m, v = U.filter_steps(np.array([r[2] for r in own]), np.array([r[3] for r in own]), 0.5, decay)
        mine = [got[r[1]] for r in own]
        assert [(r.key, r.feature) for r in mine] == [(k, r[2]) for r in own] and all(abs(r.us - 1e6 * r.feature) < 2 for r in mine)
        np.testing.assert_allclose([(r["mean"], r["variance"]) for r in mine], np.column_stack([m, v]), atol=1e-12)


# ---- running totals


def totals(folder, compact_every=3):
    return KeyedTotals(folder, ["a", "b"], ["n", "s"], lambda df: df.groupBy("a", "b").agg(F.count("x").alias("n"), F.sum("x").alias("s")), compact_every)


def test_a_batch_writes_what_it_changed_and_counts_once(spark, tmp_path):
    folder = f"file://{tmp_path}/totals"
    batches = [[("u", 1, 1.0), ("u", 1, 2.0), ("v", None, 5.0)], [("v", None, 1.0)], [], [("w", 2, 7.0), (None, None, 1.0)], [("u", 1, 4.0)], [(None, None, 2.0)]]
    want: dict = {}
    assert totals(folder).table(spark) is None
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "a string, b long, x double")
        totals(folder).update(df, i)  # a new object each time: nothing but the folder is known
        totals(folder).update(df, i)  # run again after a failure
        for a, b, x in rows:
            n, s = want.get((a, b), (0, 0.0))
            want[a, b] = (n + 1, s + x)
        assert {(r.a, r.b): (r.n, r.s) for r in totals(folder).table(spark).collect()} == want
        kept = totals(folder).changes.numbers(spark)
        if i in kept:
            written = {(r.a, r.b) for r in spark.read.parquet(totals(folder).changes.path(i)).collect()}
            assert written == {(a, b) for a, b, _ in rows}
        assert len(kept) < 3 and len(totals(folder).bases.numbers(spark)) <= 1


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    folder = f"file://{tmp_path}/totals"
    df = spark.createDataFrame([("u", 1, 1.0)], "a string, b long, x double")
    totals(folder).update(df, 0)
    totals(folder).update(df, 1)
    (tmp_path / "totals" / f"batch={1:012d}" / "_SUCCESS").unlink()
    totals(folder).update(df, 1)
    assert [(r.n, r.s) for r in totals(folder).table(spark).collect()] == [(2, 2.0)]


def test_regressions_of_a_stream_agree_with_a_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(x), float(2 * x + k + 0.1 * rng.standard_normal())) for k, x in zip(rng.integers(0, 5, 200), rng.random(200), strict=True)]
    model = U.RegressionStream(f"file://{tmp_path}/fits", "x", "y", ["key"], compact_every=2)
    for i in range(5):
        model.update(spark.createDataFrame(rows[40 * i : 40 * i + 40], "key long, x double, y double"), i)
    got = {r.key: r for r in model.fits(spark).collect()}
    for r in U.running_regression(spark.createDataFrame(rows, "key long, x double, y double"), "x", "y", ["key"]).collect():
        assert got[r.key].n == r.n
        np.testing.assert_allclose((got[r.key].offset, got[r.key].slope), (r.offset, r.slope), atol=1e-9)
