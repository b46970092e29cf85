"""Result bundles: several tables and their metadata that appear together or not at all (survey IO22, IO16).

A table is written through the ``bundle`` data source: each task writes files of its own under ``data/`` and names them in its commit message; a write that fails deletes what its tasks
named. A bundle becomes visible by one file: ``manifests/<version>.json``, put in place by a rename when all its tables are there, naming their files, schemas and row counts. Readers take the newest
manifest and only the files that it names, so a killed write, and files of task attempts that were not counted, are never seen; the bundle before it stays readable. ``vacuum`` removes
what no kept manifest names.

Files are written through ``pyarrow.fs`` (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Age of a file that no manifest names before it may be removed: a write may still be going on.
SETTLED_SECONDS = 24 * 3600


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(store: pafs.FileSystem, name: str, data: bytes) -> None:
    """A whole file or none."""
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def _files(store: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return [f for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.File]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    file: str | None
    rows: int


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.table, self.ticket = options["path"], options["table"], options["ticket"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file a task, batch by batch; no file for no rows."""
        store, root = store_of(self.path)
        folder = f"{root}/data/{self.table}"
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if out is None:
                    store.create_dir(folder, recursive=True)
                    sink = store.open_output_stream(f"{folder}/{name}")
                    out = pq.ParquetWriter(sink, b.schema, compression="zstd")
                out.write_batch(b)
                rows += b.num_rows
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All tasks are through: note their files for the manifest."""
        store, root = store_of(self.path)
        store.create_dir(f"{root}/staged", recursive=True)
        done = [m for m in messages if m is not None]
        _put(store, f"{root}/staged/{self.ticket}.json", json.dumps({"files": [m.file for m in done if m.file], "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/data/{self.table}/{m.file}")


class BundleSource(DataSource):
    """``format("bundle")``, for writing; options ``table`` and ``ticket``."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self):
        raise NotImplementedError("read a bundle with load_bundle")

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(dict(self.options))


def versions(path: str) -> list[int]:
    """Published versions, oldest first."""
    store, root = store_of(path)
    return sorted(int(f.base_name[:-5]) for f in _files(store, f"{root}/manifests") if f.base_name.endswith(".json"))


def manifest(path: str, version: int | None = None) -> dict | None:
    store, root = store_of(path)
    known = versions(path)
    if not known or (version is not None and version not in known):
        return None
    with store.open_input_file(f"{root}/manifests/{known[-1] if version is None else version}.json") as f:
        return json.loads(f.read())


def save_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], metadata: dict | None = None) -> int:
    """IO22: all tables and the metadata as the next version; gives its number. Versions are never changed."""
    spark.dataSource.register(BundleSource)
    store, root = store_of(path)
    found = {}
    for name, df in tables.items():
        ticket = uuid.uuid4().hex
        df.write.format("bundle").mode("append").option("table", name).option("ticket", ticket).save(path)
        with store.open_input_file(f"{root}/staged/{ticket}.json") as f:
            found[name] = json.loads(f.read()) | {"schema": df.schema.json()}
        store.delete_file(f"{root}/staged/{ticket}.json")
    store.create_dir(f"{root}/manifests", recursive=True)
    version = max(versions(path), default=0) + 1
    _put(store, f"{root}/manifests/{version}.json", json.dumps({"version": version, "metadata": metadata or {}, "tables": found}).encode())
    return version


def load_bundle(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict] | None:
    """Tables and metadata of a version (the newest); None where there is none."""
    m = manifest(path, version)
    if m is None:
        return None
    out = {}
    for name, t in m["tables"].items():
        schema = StructType.fromJson(json.loads(t["schema"]))
        out[name] = spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/data/{name}/{f}" for f in t["files"]]) if t["files"] else spark.createDataFrame([], schema)
    return out, m["metadata"]


def vacuum(path: str, keep: int = 1, settled: float = SETTLED_SECONDS) -> list[str]:
    """Drops all but the newest ``keep`` versions, and files that none of these names and that are older than ``settled`` seconds; gives what went."""
    store, root = store_of(path)
    known = versions(path)
    held, gone = known[-keep:] if keep else [], []
    for v in known[: len(known) - len(held)]:
        store.delete_file(f"{root}/manifests/{v}.json")
        gone.append(f"manifests/{v}.json")
    named = {f"{t}/{f}" for v in held for t, x in manifest(path, v)["tables"].items() for f in x["files"]}
    folders = [d for d in store.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)) if d.type == pafs.FileType.Directory]
    for d in folders:
        for f in _files(store, d.path):
            if f"{d.base_name}/{f.base_name}" not in named and time.time() - f.mtime.timestamp() >= settled:
                store.delete_file(f.path)
                gone.append(f"data/{d.base_name}/{f.base_name}")
    return gone
