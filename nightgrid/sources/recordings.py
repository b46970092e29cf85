"""Readers for EDF and WFDB recordings and annotation texts; bytes come through Spark's own file readers, so any store will do.

Rows: subject_id string, channel, chunk_id, fs, units, samples. One file is one task's work; a file is one night.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_SECONDS = 300
SCHEMA = "subject_id string, channel string, chunk_id long, fs double, units string, samples array<double>"
# Recorded names (letters and digits only, lower case) and the channel they mean.
ALIASES = {
    "c3a2": "eeg", "c4a1": "eeg2", "c3m2": "eeg", "c4m1": "eeg2", "lefteye": "eog_left", "righteye": "eog_right", "lofeog": "eog_left", "e1m2": "eog", "chin1chin2": "emg", "emg": "emg", "ecg": "ecg",
    "spo2": "spo2", "sao2": "spo2", "flow": "airflow", "airflow": "airflow", "ribcage": "effort_thoracic", "chest": "effort_thoracic", "abdo": "effort_abdominal", "abd": "effort_abdominal", "sum": "effort_sum", "sound": "snore", "pulse": "pulse", "bodypos": "position",
}


def canonical(name: str) -> str:
    key = re.sub(r"[^a-z0-9]", "", name.lower())
    return ALIASES.get(key, key)


def parse_edf(data: bytes) -> list[tuple[str, float, str, float, np.ndarray]]:
    """(name, fs, units, physical maximum, physical values) of every signal of an EDF file."""
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    n_records, seconds, ns = int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    at, fields = 256, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([text(at + i * width, width) for i in range(ns)])
        at += ns * width
    names, units = fields[0], fields[2]
    pmin, pmax, dmin, dmax = ([float(x) for x in fields[k]] for k in (3, 4, 5, 6))
    per = [int(x) for x in fields[8]]
    raw = np.frombuffer(data, "<i2", offset=at)
    n_records = len(raw) // sum(per) if n_records < 0 else n_records
    raw = raw[: n_records * sum(per)].reshape(n_records, -1)
    out, lo = [], 0
    for k in range(ns):
        v = raw[:, lo : lo + per[k]].reshape(-1).astype(float)
        lo += per[k]
        gain = (pmax[k] - pmin[k]) / (dmax[k] - dmin[k])
        out.append((names[k], per[k] / seconds, units[k], pmax[k], (v - dmin[k]) * gain + pmin[k]))
    return out


def write_edf(signals: list[tuple[str, int, np.ndarray]], seconds: float = 1.0) -> bytes:
    """A minimal EDF file from (name, samples a record, values): for tests and exports."""
    ns, n = len(signals), min(len(v) // p for _, p, v in signals)
    pad = lambda x, w: str(x)[:w].ljust(w).encode("latin-1")
    lo = [float(np.floor(v.min())) for _, _, v in signals]
    hi = [float(np.ceil(v.max() + 1e-9)) + (v.max() == v.min()) for _, _, v in signals]
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (ns + 1), 8) + pad("", 44) + pad(n, 8) + pad(f"{seconds:g}", 8) + pad(ns, 4)
    cols = [([s[0] for s in signals], 16), ([""] * ns, 80), (["uV"] * ns, 8), ([f"{x:g}" for x in lo], 8), ([f"{x:g}" for x in hi], 8), ([-32768] * ns, 8), ([32767] * ns, 8), ([""] * ns, 80), ([s[1] for s in signals], 8), ([""] * ns, 32)]
    head += b"".join(pad(x, w) for c, w in cols for x in c)
    parts = [np.clip(np.round((v[: n * p] - a) / (b - a) * 65535 - 32768), -32768, 32767).astype("<i2").reshape(n, p) for (_, p, v), a, b in zip(signals, lo, hi)]
    return head + np.concatenate(parts, 1).tobytes()


def _rows(subject: str, signals) -> Iterator[tuple]:
    for name, fs, units, _, v in signals:
        step = max(1, int(fs * CHUNK_SECONDS))
        for c, a in enumerate(range(0, len(v), step)):
            yield subject, canonical(name), c, float(fs), units, v[a : a + step]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["subject_id", "channel", "chunk_id", "fs", "units", "samples"])


def read_edf(spark: SparkSession, path: str, low_gain_below: float | None = None) -> DataFrame:
    """IO1, IO7: all signals of the EDF files under ``path``; signals whose physical maximum is below ``low_gain_below`` are scaled by 10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                signals = parse_edf(data.as_py())
                if low_gain_below is not None:
                    signals = [(n, fs, u, m, v * 10 if m < low_gain_below else v) for n, fs, u, m, v in signals]
                for row in _rows(os.path.splitext(name.rsplit("/", 1)[-1])[0].removesuffix("_lifecard"), signals):
                    yield _batch([row])

    # a subject's lifecard file counts only where it has no other: the chosen names are a row a night
    chosen = [r["path"] for r in discover(spark, path, "*.{edf,rec}").select("path").collect()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{edf,rec}").load(chosen or path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def wfdb_signals(header: str) -> tuple[int, list[tuple[str, float, str, float, float]]]:
    """Bytes before the samples ("16+24": 24), and (name, fs, units, gain, stored zero) of each signal."""
    lines = [x.split() for x in header.splitlines() if x and not x.startswith("#")]
    n, fs = int(lines[0][1]), float(lines[0][2].split("/")[0])
    offset = int(lines[1][1].partition("+")[2] or 0) if n else 0
    out = []
    for x in lines[1 : n + 1]:
        gain, _, units = x[2].partition("/")
        base = re.search(r"\((-?\d+)\)", gain)
        g = float(re.sub(r"\(.*\)", "", gain)) or 200.0
        zero = int(base.group(1)) if base else int(x[4]) if len(x) > 4 else 0
        out.append((x[-1], fs, units or "mV", g, float(zero)))
    return offset, out


def parse_wfdb(header: str, data: bytes) -> list[tuple[str, float, str, float, np.ndarray]]:
    """Signals of a WFDB record: 16-bit samples in turn, after the offset that the header gives."""
    offset, signals = wfdb_signals(header)
    raw = np.frombuffer(data, "<i2", offset=offset)
    raw = raw[: len(raw) // len(signals) * len(signals)].reshape(-1, len(signals))
    return [(name, fs, units, 0.0, (raw[:, k] - zero) / gain) for k, (name, fs, units, gain, zero) in enumerate(signals)]


def record_length(spark: SparkSession, path: str) -> DataFrame:
    """IO6: seconds of each record, from field 4 over field 3 of its header's first line."""
    x = spark.read.option("wholetext", True).option("pathGlobFilter", "*.hea").text(path).select(F.split(F.regexp_extract("value", r"^([^\n]*)", 1), r"\s+").alias("h"))
    return x.select(F.col("h")[0].alias("subject_id"), (F.col("h")[3].cast("double") / F.regexp_extract(F.col("h")[2], r"^[0-9.]+", 0).cast("double")).alias("seconds"))


def read_wfdb(spark: SparkSession, path: str) -> DataFrame:
    """IO5: all signals of the WFDB records (``.hea`` with ``.mat`` or ``.dat``) under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hea,mat,dat}").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("subject_id"), F.col("path").endswith(".hea").alias("head"), "content")

    def run(table: pa.Table) -> pa.Table:
        heads = {h: c for h, c in zip(table.column("head").to_pylist(), table.column("content").to_pylist())}
        if True not in heads or False not in heads:
            return pa.Table.from_batches([_batch([("", "", 0, 0.0, "", [])]).slice(0, 0)])
        rows = list(_rows(table.column("subject_id")[0].as_py(), parse_wfdb(heads[True].decode(), heads[False])))
        return pa.Table.from_batches([_batch(rows)])

    return files.groupBy("subject_id").applyInArrow(run, SCHEMA)


def derived_channels(chunks: DataFrame) -> DataFrame:
    """IO2, IO8: ``eog`` = left - right and ``effort_sum`` = both belts, where rates agree; truncated to the shorter chunk.

    A subject that was recorded with such a channel keeps its own.
    """

    def both(a: str, b: str, name: str, sign: int) -> DataFrame:
        x = chunks.filter(F.col("channel") == a).alias("a").join(chunks.filter(F.col("channel") == b).alias("b"), ["subject_id", "chunk_id", "fs"])
        own = chunks.filter(F.col("channel") == name).select("subject_id").distinct()
        x = x.join(own, "subject_id", "left_anti")
        n = "least(size(a.samples), size(b.samples))"
        v = F.expr(f"zip_with(slice(a.samples, 1, {n}), slice(b.samples, 1, {n}), (x, y) -> x {'+' if sign > 0 else '-'} y)")
        return x.select("subject_id", F.lit(name).alias("channel"), "chunk_id", "fs", F.col("a.units").alias("units"), v.alias("samples"))

    return chunks.unionByName(both("eog_left", "eog_right", "eog", -1)).unionByName(both("effort_thoracic", "effort_abdominal", "effort_sum", 1))


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """IO9, IO14: numbered lines of each small annotation file (one file is read whole, so numbers are its own)."""
    x = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
    x = x.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1).alias("subject_id"), F.split("value", r"\r?\n").alias("l"))
    return x.select("subject_id", F.posexplode("l").alias("line_no", "line")).filter("line <> ''")


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """IO3: ids and paths of files, without reading them, ordered by number where names have one."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    f = f.withColumn("subject_id", F.regexp_extract("path", r"([^/]+?)(?:_lifecard)?\.[^./]+$", 1))
    w = Window.partitionBy("subject_id").orderBy(F.when(F.col("path").endswith(".rec"), 0).when(F.col("path").contains("_lifecard"), 2).otherwise(1), "path")
    return f.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(F.regexp_extract("subject_id", r"(\d+)", 1).try_cast("long"), "subject_id")


def save_result(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("algo", "subject_id")) -> None:
    """IO16: replaces the partitions that ``df`` holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def load_result(spark: SparkSession, path: str, algo: str | None = None) -> DataFrame:
    """IO17."""
    df = spark.read.parquet(path)
    return df if algo is None else df.filter(F.col("algo") == algo)


def union_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """IO19: one table with a ``dataset`` column; per-lead columns (``__eeg_``) are dropped."""
    out = None
    for name, df in sorted(tables.items()):
        x = df.drop(*[c for c in df.columns if "__eeg_" in c]).withColumn("dataset", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def excerpt_json(df: DataFrame, lo: int, hi: int, limit: int, keys: tuple[str, ...] = ("subject_id",), t: str = "t_us", value: str = "v") -> DataFrame:
    """IO23, X30: a range of samples, thinned by an even stride to ``limit`` at most, as one JSON text per key."""
    x = df.filter(F.col(t).between(lo, hi))
    w = Window.partitionBy(*keys)
    x = x.withColumns({"_i": F.row_number().over(w.orderBy(t)) - 1, "_n": F.count("*").over(w)})
    x = x.filter(F.col("_i") % F.greatest(F.ceil(F.col("_n") / limit), F.lit(1)) == 0)
    return x.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(t, value)))).alias("json"))
