"""Drift alarms do not depend on how the rows of a batch are split or ordered."""

import random
from datetime import datetime, timedelta

import pytest

from plumbline.streaming import jobs


def brute(batches):
    state = {}
    for rows in batches:
        for key, _, _, x in sorted(rows, key=lambda r: (r[1], r[2])):
            mean, var, seen, alarms = state.get(key, (x, 0.0, 0, 0))
            gap = x - mean
            alarms += seen >= 20 and var > 0 and gap * gap > 9 * var
            state[key] = mean + 0.05 * gap, 0.95 * (var + 0.05 * gap * gap), seen + 1, alarms
    return state


@pytest.mark.parametrize("chunk", ["7"])
def test_order_and_batches(spark, tmp_path, chunk):
    rnd, t = random.Random(1), datetime(2026, 1, 1)
    rows = [(rnd.choice("ab"), t + timedelta(minutes=rnd.randrange(9000)), i, rnd.gauss(0, 1) + (i % 40 == 0) * 6) for i in range(800)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        for parts in ([rows], [rows[:500], rows[500:]]):
            at = tmp_path / str(len(parts))
            for i, part in enumerate(parts):
                spark.createDataFrame(part, "event_type string, ts timestamp_ntz, event_id long, value double").coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
            stream = spark.readStream.schema("event_type string, ts timestamp_ntz, event_id long, value double").option("maxFilesPerTrigger", "1").parquet(f"{at}/events.parquet")
            got = jobs.run_to_end(jobs.drift_alarms(stream), ["key"])
            assert sorted(got.columns) == ["alarms", "key", "mean", "seen"]
            got, want = {r.key: r for r in got.collect()}, brute(parts)
            assert {k: (r.seen, r.alarms) for k, r in got.items()} == {k: s[2:] for k, s in want.items()}
            assert all(r["mean"] == pytest.approx(want[k][0]) for k, r in got.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
