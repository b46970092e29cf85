"""Streaming twins of batch operators: tumbling bins, sessions, sliding windows, and the adaptive peak baseline as custom state.

Zero-phase filters, centred and future windows and night-level medians have no twin: they need the rest of the night.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_mean(stream: DataFrame, ts: str = "ts", value: str = "v", width: str = "6 hours", late: str = "1 hour", key: str = "subject_id") -> DataFrame:
    """A1 on a stream: mean per window; rows later than ``late`` are dropped and windows close behind the watermark."""
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, width)).agg(F.avg(value).alias(value), F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), value, "n")


def sliding_mean(stream: DataFrame, ts: str = "ts", value: str = "v", width: str = "11 hours", step: str = "1 hour", late: str = "1 hour", key: str = "subject_id") -> DataFrame:
    """W24 on a stream."""
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, width, step)).agg(F.avg(value).alias(value), F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), value, "n")


def sessions(stream: DataFrame, ts: str = "ts", gap: str = "12 hours", late: str = "1 hour", key: str = "subject_id") -> DataFrame:
    """W13 on a stream: runs of events without a gap."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def peak_baseline(stream: DataFrame, window_us: int, ratio: float = 0.5, key: str = "subject_id") -> DataFrame:
    """F37 on a stream: per peak the mean of earlier peaks in the window that were no drop (of all, if there is none).

    State: the peaks of the last window, at most what fits into it. Input columns: key, t_us, v; peaks of a key come in order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, vs, ds = state.get if state.exists else ([], [], [])
        ts, vs, ds = list(ts), list(vs), list(ds)
        for pdf in batches:
            out = []
            for t, v in pdf.sort_values("t_us")[["t_us", "v"]].itertuples(index=False):
                keep = [i for i, x in enumerate(ts) if x >= t - window_us]
                ts, vs, ds = [ts[i] for i in keep], [vs[i] for i in keep], [ds[i] for i in keep]
                good = [x for x, d in zip(vs, ds) if not d] or vs
                base = sum(good) / len(good) if good else float(v)
                drop = v < ratio * base
                ts.append(int(t)), vs.append(float(v)), ds.append(bool(drop))
                out.append((k[0], int(t), base, drop))
            yield pd.DataFrame(out, columns=[key, "t_us", "baseline", "is_drop"])
        state.update((ts, vs, ds))

    return stream.select(key, "t_us", "v").groupBy(key).applyInPandasWithState(step, f"{key} long, t_us long, baseline double, is_drop boolean", "ts array<long>, vs array<double>, ds array<boolean>", "append", GroupStateTimeout.NoTimeout)
