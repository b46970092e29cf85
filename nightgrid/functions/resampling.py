"""Polyphase resampling of channels by a rational factor, chunk by chunk, and the one-second tracks of each data set (survey F17)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.functions.generators import run_generator
from nightgrid.sources.recordings import CHUNK_SECONDS, derived_channels

#: Zero crossings of the sinc on either side at the lower rate, and the Kaiser window's shape.
HALF, SHAPE = 10, 5.0
#: The tracks that every data set has.
SHARED = ("c_rel_delta", "c_rel_theta", "c_rel_alpha", "c_rel_sigma", "c_rel_beta", "c_log_power", "eog_low", "eog_high", "hr", "resp_effort", "resp_env")


def factors(fs: float, to: float) -> tuple[int, int]:
    """``up, down`` with fs * up / down = to."""
    r = Fraction(to).limit_denominator(1 << 16) / Fraction(fs).limit_denominator(1 << 16)
    return r.numerator, r.denominator


def taps(up: int, down: int) -> np.ndarray:
    """A windowed sinc of 2 * HALF * max(up, down) + 1 values whose sum is ``up``; its middle is no delay."""
    wide = max(up, down)
    k = np.arange(-HALF * wide, HALF * wide + 1)
    h = np.sinc(k / wide) * np.kaiser(len(k), SHAPE)
    return h / h.sum() * up


def reach(up: int, down: int) -> int:
    """Samples on either side that an output looks at."""
    return HALF * max(up, down) // up + 1


def polyphase(x: np.ndarray, up: int, down: int, start: int = 0, before: int = 0, after: int = 0) -> np.ndarray:
    """The outputs that lie in ``x[before : len(x) - after]``, whose first sample is number ``start`` of the whole signal; beyond ``x`` is zero.

    Output ``m`` is at the place of input ``m * down / up``. Outputs of one phase are a strided product with that phase's taps.
    """
    h = taps(up, down)
    mid = len(h) // 2
    n = len(x) - before - after
    low, high = -(-start * up // down), -(-(start + n) * up // down)
    out = np.zeros(max(high - low, 0))
    pad = reach(up, down) + 1
    wide = np.concatenate([np.zeros(pad), x, np.zeros(pad)])
    origin = start - before - pad  # number of wide[0] in the whole signal
    for m in range(low, min(low + up, high)):  # one output of each phase
        t = m * down
        first = -(-(t - mid) // up)  # the first input under the taps
        own = h[t - first * up + mid :: -up]
        views = np.lib.stride_tricks.sliding_window_view(wide, len(own))[first - origin :: down]
        count = len(range(m - low, len(out), up))
        out[m - low :: up] = views[:count] @ own
    return out


def resample(chunks: DataFrame, to: float, channels: list[str] | None = None, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Chunks of some channels (all) at the rate ``to``; other channels, and those that have it, as they are.

    A chunk gets the samples that its filter needs from the chunks beside it (and, where these are shorter than that, from beyond), so borders do not show. An absent chunk counts as zeros.
    One exchange by (subject, channel); a task works on a chunk at a time. A night's longest chunk is bounded by ``chunk_seconds``.
    """
    name = F.col("channel").isin(*channels) if channels is not None else F.lit(True)
    change = name & (F.col("fs") != F.lit(float(to)))
    keys = ["subject_id", "channel", *(["lane"] if "lane" in chunks.columns else [])]
    rates = [r[0] for r in chunks.filter(change).select("fs").distinct().collect()]  # a few rates
    out = chunks.filter(~F.coalesce(change, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("chunk_id")
    for fs in rates:
        up, down = factors(fs, to)
        edge, step = reach(up, down) + 1, max(1, int(fs * chunk_seconds))
        more = range(1, -(-edge // step) + 1)
        x = chunks.filter(change & (F.col("fs") == fs))
        beside = lambda f, k: F.when(f("chunk_id", k).over(w) == F.col("chunk_id") + (k if f is F.lead else -k), f("samples", k).over(w))  # noqa: B023, E731
        tail = F.concat(*[F.coalesce(beside(F.lag, k), F.array_repeat(F.lit(0.0), step)) for k in reversed(more)])
        head = F.concat(*[F.coalesce(beside(F.lead, k), F.array().cast("array<double>")) for k in more])
        x = x.withColumn("_before", F.slice(tail, F.greatest(F.size(tail) - edge + 1, F.lit(1)), edge)).withColumn("_after", F.slice(head, 1, edge))
        kinds = {c: chunks.schema[c].dataType.simpleString() for c in chunks.columns}
        names = chunks.columns

        def run(batches: Iterator[pa.RecordBatch], up=up, down=down, step=step, names=names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for s, a, z, c in zip(*(b.column(b.schema.get_field_index(k)) for k in ("samples", "_before", "_after", "chunk_id"))):
                    parts = [np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float)) if v.is_valid else np.zeros(0) for v in (a, s, z)]
                    made.append(polyphase(np.concatenate(parts), up, down, c.as_py() * step, len(parts[0]), len(parts[2])))
                cols = {k: b.column(b.schema.get_field_index(k)) for k in names}
                cols["samples"] = pa.array(made, pa.list_(pa.float64()))
                cols["fs"] = pa.array(np.full(b.num_rows, float(to)))
                yield pa.RecordBatch.from_arrays([cols[k] for k in names], names=names)

        schema = ", ".join(f"`{c}` {'array<double>' if c == 'samples' else 'double' if c == 'fs' else t}" for c, t in kinds.items())
        out = out.unionByName(x.select(*names, "_before", "_after").mapInArrow(run, schema))
    return out


def central_leads(chunks: DataFrame) -> DataFrame:
    """Both central leads as lanes of one channel."""
    lane = F.when(F.col("channel") == "eeg2", 1).otherwise(F.col("lane") if "lane" in chunks.columns else F.lit(0))
    return chunks.withColumn("lane", lane.cast("int")).withColumn("channel", F.when(F.col("channel") == "eeg2", "eeg").otherwise(F.col("channel")))


def dataset_tracks(dataset: str, chunks: DataFrame, rate: float = 200.0) -> DataFrame:
    """the one-second tracks of a data set's recordings.

    ``cinc2018``: all fourteen from channels of one rate. ``isruc``: the same, belts brought to that rate first. ``ucddb``: the eleven that need no frontal or occipital lead and no fast chin signal, each
    channel at its own rate.
    """
    x = chunks
    if dataset == "isruc":
        x = resample(x, rate, ["effort_thoracic", "effort_abdominal"])
    elif dataset not in ("cinc2018", "ucddb"):
        raise ValueError(f"no loader for {dataset}")
    made = F.col("channel").isin("eog", "effort_sum")
    sides = x.filter(F.col("channel").isin("eog", "eog_left", "eog_right", "effort_sum", "effort_thoracic", "effort_abdominal"))
    x = x.withColumn("lane", F.col("lane").cast("int") if "lane" in x.columns else F.lit(0)).filter(~made).unionByName(derived_channels(sides.drop("lane")).filter(made).withColumn("lane", F.lit(0)))
    tracks = run_generator(central_leads(x), "one_second_tracks")
    return tracks.filter(F.col("signal").isin(*SHARED)) if dataset == "ucddb" else tracks
