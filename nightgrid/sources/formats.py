"""EDF and WFDB recordings as Spark data sources: ``spark.read.format("edf").load(path)``.

A partition is a range of chunks (``CHUNK_SECONDS`` each) of one large recording, or some small recordings. Headers of large files are read when the scan is planned, those of small ones by the task that reads them; a task seeks to its records and reads them a few chunks
at a time, so a file of any size is read by many tasks, none of which holds more than ``READ_BYTES`` and one chunk of it. A scan is told the subjects, channels and chunks that it is for: other subjects'
files are not opened, other chunks not read, other channels not decoded. Rows come out as Arrow batches; nothing is shuffled.

These are options of the scan and not conditions that Spark pushes down: in Spark 4.1 a Python source keeps what one query pushed for the next query on the same frame, which then lacks rows
(a count after a filtered count). Conditions on the frame are Spark's own and always right.

Files are opened through ``pyarrow.fs`` (local, HDFS, S3, GCS). For a store that only Spark's own readers reach, ``recordings.read_edf`` and ``read_wfdb`` give the same rows from whole files.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .recordings import CHUNK_SECONDS, SCHEMA, canonical, wfdb_signals

#: Bytes of records that a partition covers, and that a task reads at once.
PARTITION_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Headers that are read at the same time while a scan is planned.
HEADER_THREADS = 32
#: Bytes that opening a file counts as much as, and the number of small files beyond which they share partitions.
OPEN_BYTES, FEW_FILES = 64 << 10, 64


@dataclass(frozen=True)
class Signal:
    """One signal of a recording: where its samples are in a record, and the line from stored to physical values."""

    channel: str
    fs: float
    units: str
    first: int
    per: int
    gain: float
    zero: float
    scale: float = 1.0
    base: float = 0.0

    @property
    def step(self) -> int:
        """Samples of a chunk."""
        return max(1, int(self.fs * CHUNK_SECONDS))

    def chunks(self, records: int) -> int:
        return -(-self.per * records // self.step)

    def values(self, stored: np.ndarray) -> np.ndarray:
        return ((stored.astype(np.float64) - self.zero) * self.gain + self.base) * self.scale


@dataclass(frozen=True)
class Recording:
    """A file of equal records of 16-bit samples, each with ``per`` samples of every signal in turn."""

    path: str
    subject: str
    start: int
    record: int
    records: int
    signals: tuple[Signal, ...]


@dataclass(frozen=True)
class Found:
    """A recording's file as the listing has it (``head``: the WFDB header's); its header is still to be read."""

    path: str
    subject: str
    size: int
    head: str = ""


@dataclass
class Range(InputPartition):
    """Chunks of one recording."""

    recording: Recording
    low: int
    high: int
    wanted: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        InputPartition.__init__(self, None)


@dataclass
class Share(InputPartition):
    """Small files that one task reads whole, headers and all."""

    files: list[Found]

    def __post_init__(self) -> None:
        InputPartition.__init__(self, None)


def edf_recording(path: str, subject: str, head: bytes, size: int, low_gain_below: float | None = None) -> Recording:
    """What an EDF header says (``head``: at least the header)."""
    text = lambda a, n: head[a : a + n].decode("latin-1").strip()
    records, seconds, ns = int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    at, fields = 256, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([text(at + i * width, width) for i in range(ns)])
        at += ns * width
    per = [int(x) for x in fields[8]]
    whole = (size - at) // (2 * sum(per)) if sum(per) else 0
    records = whole if records < 0 else min(records, whole)
    first = np.concatenate([[0], np.cumsum(per)]).tolist()
    signals = []
    for k in range(ns):
        pmin, pmax, dmin, dmax = (float(fields[j][k]) for j in (3, 4, 5, 6))
        low = low_gain_below is not None and pmax < low_gain_below
        signals.append(Signal(canonical(fields[0][k]), per[k] / seconds, fields[2][k], first[k], per[k], (pmax - pmin) / (dmax - dmin), dmin, 10.0 if low else 1.0, pmin))
    return Recording(path, subject, at, sum(per), records, tuple(signals))


def wfdb_recording(path: str, subject: str, header: str, size: int) -> Recording:
    """What a WFDB header says of its signal file."""
    offset, found = wfdb_signals(header)
    signals = tuple(Signal(canonical(name), fs, units, k, 1, 1 / gain, zero) for k, (name, fs, units, gain, zero) in enumerate(found))
    return Recording(path, subject, offset, len(signals), max(0, size - offset) // (2 * max(1, len(signals))), signals)


class RecordingReader(DataSourceReader):
    """Plans and reads ranges of chunks; subclasses find the recordings."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("load() needs a path")
        self.options = {k.lower(): v for k, v in options.items()}
        self.partition_bytes, self.parallelism = int(self.options.get("partitionbytes", PARTITION_BYTES)), max(1, int(self.options.get("parallelism", 1)))
        self.subjects, self.channels = (set(json.loads(self.options[k])) if k in self.options else None for k in ("subjects", "channels"))
        self.low, self.high = (int(self.options[k]) if k in self.options else None for k in ("fromchunk", "tochunk"))

    # ---- planning

    def found(self, files: list[pafs.FileInfo]) -> list[Found]:
        """The files that are recordings, of the subjects that the scan is for."""
        raise NotImplementedError

    def recording(self, store: pafs.FileSystem, f: Found) -> Recording:
        """What a file's header says."""
        raise NotImplementedError

    def ranges(self, r: Recording) -> list[Range]:
        """The chunks that the scan is for, by ranges of ``partition_bytes``."""
        wanted = tuple(k for k, s in enumerate(r.signals) if self.channels is None or s.channel in self.channels)
        chunks = max((r.signals[k].chunks(r.records) for k in wanted), default=0)
        chunk_bytes = max(1, -(-2 * r.record * r.records // max(1, max((s.chunks(r.records) for s in r.signals), default=1))))
        n = max(1, self.partition_bytes // chunk_bytes)
        top = chunks if self.high is None else min(chunks, self.high)
        return [Range(r, low, min(low + n, top), wanted) for low in range(max(self.low or 0, 0), top, n)]

    def partitions(self) -> Sequence[InputPartition]:
        """Large files by ranges, from their headers; small ones too, if they are few. Of many small ones only names and sizes are looked at here; they are dealt out by size, about as many shares as the session has cores or more."""
        store, root = pafs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (pafs.LocalFileSystem(), self.options["path"])
        info = store.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else [f for f in store.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
        found = sorted(self.found(files), key=lambda f: (f.subject, f.path))
        large, small = ([f for f in found if (f.size > self.partition_bytes) == big] for big in (True, False))
        if len(small) <= FEW_FILES:
            large, small = found, []
        with ThreadPoolExecutor(HEADER_THREADS) as pool:
            out: list[InputPartition] = [part for r in pool.map(lambda f: self.recording(store, f), large) for part in self.ranges(r)]
        cost = lambda f: f.size + OPEN_BYTES
        most = min(self.partition_bytes, max(map(cost, small), default=0) + sum(map(cost, small)) // self.parallelism)
        share, held = [], 0
        for f in small:
            if share and held + cost(f) > most:
                out.append(Share(share))
                share, held = [], 0
            share.append(f)
            held += cost(f)
        return out + ([Share(share)] if share else [])

    # ---- reading

    def read(self, partition: Range | Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where nothing was planned
            return
        path = self.options["path"]
        store = pafs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else pafs.LocalFileSystem()
        for r in [partition] if isinstance(partition, Range) else (r for f in partition.files for r in self.ranges(self.recording(store, f))):
            yield from self.read_range(store, r)

    def read_range(self, store: pafs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        r = partition.recording
        names = ["subject_id", "channel", "chunk_id", "fs", "units", "samples"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.float64())]
        with store.open_input_file(r.path) as f:
            for chunk in range(partition.low, partition.high):
                # records that any wanted signal's chunk touches
                spans = {k: (chunk * s.step, min((chunk + 1) * s.step, s.per * r.records)) for k in partition.wanted for s in (r.signals[k],)}
                spans = {k: (a, b) for k, (a, b) in spans.items() if a < b}
                if not spans:
                    continue
                low = min(a // r.signals[k].per for k, (a, _) in spans.items())
                high = max(-(-b // r.signals[k].per) for k, (_, b) in spans.items())
                parts: dict[int, list[np.ndarray]] = {k: [] for k in spans}
                at_once = max(1, READ_BYTES // (2 * r.record))
                for x in range(low, high, at_once):
                    n = min(at_once, high - x)
                    f.seek(r.start + 2 * r.record * x)
                    raw = np.frombuffer(f.read(2 * r.record * n), "<i2").reshape(n, r.record)
                    for k in spans:
                        s = r.signals[k]
                        parts[k].append(raw[:, s.first : s.first + s.per].reshape(-1).copy())
                rows = []
                for k, (a, b) in spans.items():
                    s = r.signals[k]
                    stored = np.concatenate(parts[k])[a - low * s.per : b - low * s.per]
                    rows.append((r.subject, s.channel, chunk, s.fs, s.units, s.values(stored)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _stem(path: str) -> str:
    return re.sub(r"_lifecard$", "", posixpath.splitext(posixpath.basename(path))[0])


class EdfReader(RecordingReader):
    """One file a subject: its ``.rec`` if there is one, else its ``.edf`` (a ``_lifecard`` file is the fallback)."""

    def found(self, files: list[pafs.FileInfo]) -> list[Found]:
        best: dict[str, pafs.FileInfo] = {}
        rank = lambda f: (not f.path.endswith(".rec"), "_lifecard" in f.path, f.path)
        for f in files:
            if f.path.lower().endswith((".edf", ".rec")) and (self.subjects is None or _stem(f.path) in self.subjects):
                at = posixpath.join(posixpath.dirname(f.path), _stem(f.path))
                if at not in best or rank(f) < rank(best[at]):
                    best[at] = f
        return [Found(f.path, _stem(f.path), f.size) for f in best.values()]

    def recording(self, store: pafs.FileSystem, f: Found) -> Recording:
        low_gain = self.options.get("lowgainbelow")
        with store.open_input_file(f.path) as x:
            head = x.read(256)
            head += x.read(256 * int(head[252:256].decode("latin-1")))
        return edf_recording(f.path, f.subject, head, f.size, float(low_gain) if low_gain is not None else None)


class WfdbReader(RecordingReader):
    """A header (``.hea``) and its signal file (``.mat`` or ``.dat``) are one recording."""

    def found(self, files: list[pafs.FileInfo]) -> list[Found]:
        size = {f.path: f.size for f in files}
        out = []
        for head in (f.path for f in files if f.path.endswith(".hea") and (self.subjects is None or posixpath.splitext(posixpath.basename(f.path))[0] in self.subjects)):
            stem = posixpath.splitext(head)[0]
            data = next((stem + e for e in (".mat", ".dat") if stem + e in size), None)
            if data is not None:
                out.append(Found(data, posixpath.basename(stem), size[data], head))
        return out

    def recording(self, store: pafs.FileSystem, f: Found) -> Recording:
        with store.open_input_file(f.head) as x:
            return wfdb_recording(f.path, f.subject, x.read().decode("latin-1"), f.size)


class EdfSource(DataSource):
    """``format("edf")``; options ``lowGainBelow`` (signals whose physical maximum is below are scaled by 10), ``subjects`` and ``channels`` (JSON lists), ``fromChunk``, ``toChunk``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EdfReader(dict(self.options))


class WfdbSource(DataSource):
    """``format("wfdb")``; options as those of ``edf`` without ``lowGainBelow``."""

    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WfdbReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(EdfSource)
    spark.dataSource.register(WfdbSource)


def _scan(spark: SparkSession, kind: str, path: str, subjects, channels, chunks, options: dict) -> DataFrame:
    register(spark)
    options = {"parallelism": str(spark.sparkContext.defaultParallelism)} | options
    if subjects is not None:
        options["subjects"] = json.dumps(list(subjects))
    if channels is not None:
        options["channels"] = json.dumps(list(channels))
    if chunks is not None:
        options |= {k: str(v) for k, v in zip(("fromChunk", "toChunk"), chunks) if v is not None}
    return spark.read.format(kind).options(**options).load(path)


def scan_edf(
    spark: SparkSession, path: str, subjects: Sequence[str] | None = None, channels: Sequence[str] | None = None, chunks: tuple[int | None, int | None] | None = None, low_gain_below: float | None = None, **options: str
) -> DataFrame:
    """IO1, IO4, IO7: signals of the EDF recordings under ``path``: some subjects, channels, and chunks from the first up to and without the second of ``chunks``."""
    return _scan(spark, "edf", path, subjects, channels, chunks, options | ({} if low_gain_below is None else {"lowGainBelow": str(low_gain_below)}))


def scan_wfdb(spark: SparkSession, path: str, subjects: Sequence[str] | None = None, channels: Sequence[str] | None = None, chunks: tuple[int | None, int | None] | None = None, **options: str) -> DataFrame:
    """IO5: signals of the WFDB records under ``path``, as ``scan_edf``."""
    return _scan(spark, "wfdb", path, subjects, channels, chunks, dict(options))


# ---- exports


def edf_header(signals: Sequence[tuple[str, int, str, float, float, int, int]], records: int, seconds: float) -> bytes:
    """A header for (name, samples a record, units, physical and stored ends of the range)."""
    pad = lambda x, w: str(x)[:w].ljust(w).encode("latin-1")
    ns = len(signals)
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (ns + 1), 8) + pad("", 44) + pad(records, 8) + pad(f"{seconds:g}", 8) + pad(ns, 4)
    name, per, units, pmin, pmax, dmin, dmax = zip(*signals)
    cols = [(name, 16), ([""] * ns, 80), (units, 8), ([f"{x:g}" for x in pmin], 8), ([f"{x:g}" for x in pmax], 8), (dmin, 8), (dmax, 8), ([""] * ns, 80), (per, 8), ([""] * ns, 32)]
    return head + b"".join(pad(x, w) for c, w in cols for x in c)


def save_whole_numbers(df: DataFrame, path: str, channels: Sequence[str], kind: str = "edf", subject: str = "subject_id", at: str = "i", fs: int = 1) -> DataFrame:
    """One recording a subject (EDF or WFDB) of whole-numbered channels, ``at`` giving the order; gives the files' paths and numbers of samples.

    A subject's samples are one task's; files appear under their names when they are complete.
    """
    order = list(channels)

    def run(table: pa.Table) -> pa.Table:
        store, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        table = table.sort_by(at)
        who = str(table.column(subject)[0].as_py())
        x = np.stack([table.column(c).to_numpy().astype("<i2") for c in order], 1)
        n = len(x) // fs
        if kind == "edf":
            body = x[: n * fs].reshape(n, fs, len(order)).transpose(0, 2, 1).tobytes()
            files = {".edf": edf_header([(c, fs, "", -32768, 32767, -32768, 32767) for c in order], n, 1.0) + body}
        else:
            lines = [f"{who} {len(order)} {fs} {len(x)}"] + [f"{who}.dat 16 1(0)/nu 16 0 {x[0, k] if len(x) else 0} 0 0 {c}" for k, c in enumerate(order)]
            files = {".dat": x.tobytes(), ".hea": "\n".join(lines).encode()}
        store.create_dir(root, recursive=True)
        for end, data in files.items():
            with store.open_output_stream(f"{root}/.{who}{end}.part") as f:
                f.write(data)
            store.move(f"{root}/.{who}{end}.part", f"{root}/{who}{end}")
        return pa.table({"path": [f"{root}/{who}{e}" for e in files], "n": pa.array([len(x)] * len(files), pa.int64())})

    return df.select(subject, at, *order).groupBy(subject).applyInArrow(run, "path string, n long")
