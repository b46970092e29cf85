"""Line dedup: lines held by many documents stay only in the document with the largest id.

Line keys are 128-bit hashes. They are range-partitioned by (hash, document), so a line that a third of all documents
hold spreads over many partitions, with a secondary sort by document (largest first) and position. A stream
over each sorted partition sees the keeper of a key first and counts its documents. A key at the edge of a partition
may go on in the next one: its rows come out undecided, and are decided by a summary of those keys, of which
there are at most two per partition. The result is a compressed keep bitmap per document with dropped lines, not text.

Defined results: a null or empty text is one empty line; a null id counts as one document below all others; rows with
the same id count as one document and decide alike; keys shorter than the minimum, blank lines included, always
stay; ids are whole numbers or strings (in the order of their bytes); a very long text is split like any other; other columns pass through ``apply_bitmaps`` unchanged, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import row_key
from .shared import free_name, materialise, read_table

MIN_CHARS = 40
MIN_DOCS = 5
_STRIP = b" \t\n\x0b\x0c\r"
_ROWS = "h1 long, h2 long, doc {}, rk long, line int, n_lines int"


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            docs, keys, hashes, lines, counts = [], [], [], [], []
            for doc, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                parts = text.as_py().encode().split(b"\n")
                before = len(lines)
                for n, line in enumerate(parts):
                    key = line.strip(_STRIP)
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                        continue
                    hashes.append(digest(key.lower()))  # bytes.lower() changes A-Z only
                    lines.append(n)
                new = len(lines) - before
                docs += [doc] * new
                keys += [rk] * new
                counts += [len(parts)] * new
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(docs, b.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(lines, pa.int32()), pa.array(counts, pa.int32())],
                names=["h1", "h2", "doc", "rk", "line", "n_lines"],
            )

    return run


def _decide(min_docs: int):
    """Sorted rows of a partition -> rows to drop, and all rows of the first and last key as undecided."""
    names = ["h1", "h2", "doc", "rk", "line", "n_lines", "first", "edge"]

    def out(cols, rows, first, edge):
        return pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in cols] + [pa.array(first[rows]), pa.array(np.full(len(rows), edge))], names=names)

    def flags(cols):
        new_key = np.ones(len(cols[0]), bool)
        new_key[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= cols[2][1:] != cols[2][:-1]
        return new_key, new_doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, at_start = None, True
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
            new_key, new_doc = flags(cols)
            starts = np.flatnonzero(new_key)
            lo = 0
            if at_start and len(starts) > 1:  # the first key is whole: it may have begun in the partition before
                lo, at_start = starts[1], False
                yield out(cols, np.arange(lo), new_doc, True)
                starts = starts[1:]
            if not at_start and len(starts) > 1:
                end = starts[-1]
                begin = starts[:-1]
                size = np.diff(starts)
                n_docs = np.add.reduceat(new_doc[lo:end].astype(np.int64), begin - lo)
                top = np.repeat(cols[2][begin], size)
                drop = np.repeat(n_docs >= min_docs, size) & (cols[2][lo:end] < top)
                if drop.any():
                    yield out(cols, lo + np.flatnonzero(drop), new_doc, False)
                lo = end
            tail = [c[lo:] for c in cols]
        if tail is not None:
            yield out(tail, np.arange(len(tail[0])), flags(tail)[1], True)

    return run


def _to_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for n, lines in zip(b.column(1).to_pylist(), b.column(2)):
            keep = np.ones(n, bool)
            keep[lines.values.to_numpy()] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], names=["rk", "keep"])


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``rk, keep`` for each document that loses lines: bit n of the zlib-compressed map is set if line n stays."""
    # null is below all others
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.concat(F.lit("1"), F.col(id_col).cast("string")), F.lit("0"))
    kind = _ROWS.format("long" if whole else "string")
    src = docs.filter(F.col(text_col).isNotNull()).select(
        doc.alias("doc"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text")
    )
    rows = src.mapInArrow(_line_keys(min_chars), kind)
    ordered = rows.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", F.desc("doc"), "rk", "line")
    decided = materialise(ordered.mapInArrow(_decide(min_docs), kind + ", first boolean, edge boolean"), "lines")
    edge = decided.filter("edge")
    top = edge.groupBy("h1", "h2").agg(F.count_if("first").alias("n"), F.max("doc").alias("top")).filter(F.col("n") >= min_docs)
    late = edge.join(F.broadcast(top), ["h1", "h2"]).filter("doc < top")  # at most two keys per partition
    drops = decided.filter("NOT edge").select("rk", "n_lines", "line").unionByName(late.select("rk", "n_lines", "line"))
    grouped = drops.groupBy("rk").agg(F.max("n_lines").alias("n_lines"), F.collect_set("line").alias("lines"))
    return grouped.mapInArrow(_to_bitmap, "rk long, keep binary")


@F.arrow_udf(T.StructType().add("n_lines", "long").add("n_dropped", "long").add("kept", "string"))
def _apply(text: pa.Array, keep: pa.Array) -> pa.Array:
    total, dropped, kept = [], [], []
    for t, k in zip(text.to_pylist(), keep.to_pylist()):
        t = t or ""
        n = t.count("\n") + 1
        total.append(n)
        if k is None:
            dropped.append(0)
            kept.append(t)
            continue
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=n).astype(bool).tolist()
        parts = [x for x, b in zip(t.split("\n"), bits) if b]
        dropped.append(n - len(parts))
        kept.append("\n".join(parts))
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: str = "dedup") -> DataFrame:
    """``docs`` with a struct ``result``: n_lines, n_dropped and the kept text. A column of that name is replaced; all others stay, whatever their names."""
    key, keep = (free_name(c, docs.columns) for c in ("_key", "_keep"))
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    maps = bitmaps.select(F.col("rk").alias(key), F.col("keep").alias(keep))
    return keyed.join(maps, key, "left").withColumn(result, _apply(F.col(text_col), F.col(keep))).drop(key, keep)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, line_keep_bitmaps(docs))
    return out.select("doc_id", "dedup.n_lines", "dedup.n_dropped", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))
