"""Streams over several micro-batches give what one batch over all rows gives."""

import numpy as np
import pytest

from chronoloom.operators import filters
from chronoloom.streaming import online
from tests.test_features import column, series


@pytest.mark.parametrize("kind", ["kalman", "rolling"])
def test_stream_equals_batch(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    values = [list(rng.normal(size=24).cumsum()) for _ in range(3)]
    values[0][5] = None
    df = series(spark, *values)
    source = str(tmp_path / "in")
    for lo in range(0, 24, 8):  # in order of time, one file a batch
        df.filter(f"event_id >= {lo} and event_id < {lo + 8}").coalesce(1).write.mode("append").parquet(source)
    transform = online.kalman if kind == "kalman" else lambda s: online.rolling_mean(s, 4)
    out = online.replay(spark, source, df.schema, transform, str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.count() == 72
    for key in range(3):
        got = column(out, "y", key)
        if kind == "kalman":
            want = filters.local_trend(np.array(values[key], float))
        else:
            x = np.array(values[key], float)
            want = [np.nanmean(x[max(0, i - 3) : i + 1]) for i in range(24)]
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_late_rows_are_dropped(spark, tmp_path):
    df = series(spark, list(range(10)))
    source = str(tmp_path / "in")
    for part in ("event_id >= 5", "event_id < 5"):
        df.filter(part).coalesce(1).write.mode("append").parquet(source)
    out = online.replay(spark, source, df.schema, lambda s: online.ewma(s, 0.5), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in out.collect()) == [5, 6, 7, 8, 9]
