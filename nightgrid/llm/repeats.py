"""Strings of ``length`` symbols that occur at two or more places: the frame shared by op1 and op6.

Every window of ``length`` symbols (bytes or words) elects one of its ``k``-grams, the one with the
smallest hash, by content alone. Equal windows elect equal k-grams ("anchors"), so all copies of a
window meet under their anchor, and only about 2 in ``length - k`` positions make a row. Consecutive windows with one
anchor form a *segment*. Then

1. anchors seen once are dropped (counted with map-side combining);
2. equal segments collapse to one *piece* with a multiplicity;
3. the caller finds the repeated stretches of each piece from the text of all pieces under its anchor (a Burrows-Wheeler
   transform for bytes, Aho-Corasick automata for words);
4. what was found for a piece holds for all segments that are equal to it.

An anchor with more than ``max_group`` different segments is too common for one group: its windows elect longer k-grams, half
way to the window's length first and the window itself last, where a group has one piece. So no group grows with the corpus,
and all text goes through the same method.

Rows are told apart by a 64-bit hash of id and text, so null or repeated ids are fine. Rows that share one (equal id and text) count as often as they are there;
what is found for them is a set, so each of them gets every stretch once, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import materialise

SEGMENT = "a long, d long, rk long, pos int, own int, reps int"
PIECE = "a long, d long, m long, own int, seg binary"
ANSWER = "a long, d long, spans array<struct<s:int,e:int>>"
SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_POS_BITS = 31
#: Bytes of segments that a kernel gets at once: its index arrays then fit in a core's cache.
CHUNK_BYTES = 1 << 17


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def symbols(buf: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each symbol, and the first symbol of each text."""
    if unit == "byte":
        return K.byte_values()[buf], offs
    w = K.Words(buf, offs)
    return w.hashes(), w.first


def segments(values: np.ndarray, offs: np.ndarray, length: int, k: int) -> dict[str, np.ndarray] | None:
    """Segments of each text: row, first window, number of windows, anchor and digest."""
    lens = np.diff(offs)
    ok = np.flatnonzero(lens >= length)
    if not len(ok):
        return None
    grams = K.RollingHash(values).windows(k)
    packed = (grams >> K.U(_POS_BITS) << K.U(_POS_BITS)) | np.arange(len(grams), dtype=np.uint64)
    elected = (K.sliding_min(packed, length - k + 1) & K.U((1 << _POS_BITS) - 1)).astype(np.int64)
    first = K.ranges_concat(offs[ok], lens[ok] - length + 1)  # all windows that lie in one text
    by = elected[first]
    cut = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    start, own = first[cut], np.diff(np.append(cut, len(first)))
    row = np.searchsorted(offs, start, "right") - 1
    anchor = grams[by[cut]]
    digest = K.RollingHash(values, K.MULT_B).ranges(start, start + own + length - 1)
    # periodic text: equal segments one after another become one row
    new = np.ones(len(start), bool)
    new[1:] = ~((anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + own[:-1]))
    at = np.flatnonzero(new)
    return {"row": row[at], "pos": (start - offs[row])[at], "own": own[at], "a": anchor[at], "d": digest[at], "reps": np.diff(np.append(at, len(new)))}


def _segment_batch(s: dict[str, np.ndarray], keys: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(K.signed(s["a"])), pa.array(K.signed(s["d"])), pa.array(keys)] + [pa.array(s[c].astype(np.int32)) for c in ("pos", "own", "reps")]
    return pa.RecordBatch.from_arrays(cols, names=["a", "d", "rk", "pos", "own", "reps"])


def _anchored(unit: str, length: int, k: int) -> Callable:
    """Texts (rk, text) -> their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in K.slices(b.column(1)):
                s = segments(*symbols(buf, offs, unit), length, k)
                if s:
                    yield _segment_batch(s, ids[i:j][s["row"]])

    return run


def _anchored_again(unit: str, length: int, k: int) -> Callable:
    """Texts with runs of windows (rk, text, at) -> segments of these windows under longer k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rk, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                values, _ = symbols(raw, np.array([0, len(raw)]), unit)
                v = at.values.flatten()
                start, end = K.merged(v[0].to_numpy().astype(np.int64), v[1].to_numpy().astype(np.int64))
                size = end - start + length - 1
                s = segments(values[K.ranges_concat(start, size)], np.concatenate([[0], np.cumsum(size)]), length, k)
                s["pos"] = s["pos"] + start[s["row"]]
                yield _segment_batch(s, np.full(len(s["pos"]), rk))

    return run


def _fetch(unit: str, length: int) -> Callable:
    """Texts with their wanted segments -> the segments' own text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["a", "d", "m", "own", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for text, want in zip(b.column(0), b.column(1)):
                raw = text.as_py().encode()
                words = raw.split() if unit == "word" else None  # bytes.split() splits at exactly [\x20\x09-\x0D]
                for x in want.as_py():
                    p, end = x["pos"], x["pos"] + x["own"] + length - 1
                    seg = raw[p:end] if words is None else b" ".join(words[p:end])
                    for c, y in zip(out, (x["a"], x["d"], x["m"], x["own"], seg)):
                        c.append(y)
                    size += len(seg) + 64
                if size > K.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def anchor_runs(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows sorted by their first column -> runs of whole groups of about CHUNK_BYTES of column ``text``."""
    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if size >= CHUNK_BYTES and r[0] != rows[-1][0]:
                yield rows
                rows, size = [], 0
            rows.append(r)
            size += len(r[text])
    if rows:
        yield rows


def answers(rows: list[tuple], piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The found stretches (row of ``rows``, start, end; sorted by row) as one record for each row that has any."""
    at = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    own = piece[at]
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(SPANS.value_type))
    offs = pa.array(np.append(at, len(piece)).astype(np.int32))
    ids = [pa.array([rows[i][c] for i in own.tolist()], pa.int64()) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(offs, spans)], names=["a", "d", "spans"])


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, unit: str, length: int, k: int, locate: Callable[[DataFrame], DataFrame], max_group: int) -> DataFrame:
    """``rk, spans array<struct<s,e>>`` of each text with repeated windows (symbol positions, not yet merged).

    ``locate`` gets PIECE rows and gives ANSWER rows: the repeated stretches of a piece, in symbols from its start.
    """
    src = docs.filter(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    segs, spans = src.mapInArrow(_anchored(unit, length, k), SEGMENT), None
    while True:
        seen = segs.groupBy("a").agg(F.sum("reps").alias("n")).filter("n >= 2").select("a")
        members = materialise(segs.join(seen, "a"), "members")
        distinct = members.groupBy("a", "d").agg(F.sum("reps").cast("long").alias("m"), F.min_by(F.struct("rk", "pos", "own"), F.struct("rk", "pos")).alias("x"))
        distinct = materialise(distinct.select("a", "d", "m", "x.*"), "distinct")
        common = None
        if k < length:
            common = materialise(distinct.groupBy("a").count().filter(F.col("count") > max_group).select("a"), "common")
        cold = distinct if common is None else distinct.join(common, "a", "left_anti")
        wanted = cold.groupBy("rk").agg(F.collect_list(F.struct("a", "d", "m", "pos", "own")).alias("want"))
        # rows with equal id and text have one key: one of them shows the text
        pieces = src.join(wanted, "rk").dropDuplicates(["rk"]).select("text", "want").mapInArrow(_fetch(unit, length), PIECE)
        found = members.join(materialise(locate(pieces), "answers"), ["a", "d"]).select("rk", "pos", F.expr("own * (reps - 1)").alias("more"), F.explode("spans").alias("x"))
        found = found.select("rk", F.expr("pos + x.s").alias("s"), F.expr("pos + more + x.e").alias("e"))
        spans = found if spans is None else spans.unionByName(found)
        if common is None or common.isEmpty():
            return spans.groupBy("rk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        k = min(length, max(k + 1, (k + length) // 2)) if length - k > 4 else length
        runs = members.join(common, "a").groupBy("rk").agg(F.collect_set(F.struct(F.col("pos").alias("s"), F.expr("pos + own * reps").alias("e"))).alias("at"))
        src = materialise(src.select("rk", "text").join(runs, "rk"), "common_texts")  # from here on only texts that hold common windows
        segs = src.mapInArrow(_anchored_again(unit, length, k), SEGMENT)


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """One row per document: id, ``n_units``, merged ``spans`` and ``kept`` (bytes without the spans)."""
    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, n_units long, spans array<struct<s:int,e:int>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_t = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            for i, j, buf, offs in K.slices(b.column(1)):
                raw, n_units, kept, found = buf.tobytes(), [], [], []
                for r, x in enumerate(b.column(2).slice(i, j - i)):
                    t = raw[offs[r] : offs[r + 1]]
                    parts = t.split() if unit == "word" else t
                    n_units.append(len(parts))
                    runs = []
                    if x.is_valid:
                        v = x.values.flatten()
                        s, e = K.merged(v[0].to_numpy().astype(np.int64), v[1].to_numpy().astype(np.int64))
                        runs = list(zip(s.tolist(), e.tolist()))
                        at, rest = 0, []
                        for s, e in runs:
                            rest.append(parts[at:s])
                            at = e
                        rest.append(parts[at:])
                        parts = sum(rest, []) if unit == "word" else b"".join(rest)
                    kept.append(b" ".join(parts) if unit == "word" else parts)
                    found.append([{"s": s, "e": e} for s, e in runs])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n_units, pa.int64()), pa.array(found, span_t), pa.array(kept, pa.binary())], names=[id_col, "n_units", "spans", "kept"])

    keyed = docs.select(id_col, F.col(text_col).alias("text"), row_key(id_col, text_col).alias("rk"))
    joined = keyed.join(spans, "rk", "left").select(id_col, "text", "spans")
    return joined.mapInArrow(run, schema)
