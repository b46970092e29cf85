"""Suffix-array dedup: byte strings of a given length that occur at two or more places.

The repeated strings of each anchor's segments (see ``repeats``) come from a Burrows-Wheeler transform of
the segments: intervals are expanded breadth-first by backward extension, which yields the common-prefix
values in increasing order, and expansion stops at the minimum length. Boundaries that are still open
then have a common prefix of at least that length. Every repeated byte is found by the transform: equal segments enter it once,
with how often they occur.

Defined results: null and empty texts have 0 bytes and no span; texts shorter than the length keep all;
rows with the same id and text count as two documents that repeat each other; a null id stays null;
columns other than id and text are ignored. The text is taken as UTF-8 bytes, so ``kept`` may cut a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import ANSWER, anchor_runs, answers, cut_spans, repeated_spans
from .shared import read_table

MIN_BYTES = 200
ANCHOR_BYTES = 32
#: Different segments under one anchor before its windows elect longer anchors.
MAX_GROUP = 2048


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions in the order of their first ``depth`` bytes or more, by prefix doubling."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | pad[j : j + n]
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        # a suffix alone in its group has its place; the others are ordered by the group h further on
        starts = np.flatnonzero(new)
        width = np.diff(np.append(starts, n))
        slots = np.flatnonzero(np.repeat(width > 1, width))
        if not len(slots):
            break
        at = order[slots]
        nxt = at + h
        key = rank[at] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        o = np.argsort(key)
        order[slots] = at[o]
        k = key[o]
        new[slots] |= np.append(True, k[1:] != k[:-1])
        rank[order[slots]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
        h *= 2
    return order


def open_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares ``length`` bytes or more with the one before it in ``order``.

    Works on the transform only: ``src[j]`` is the row whose backward step leads to row ``j``. Level l closes the
    boundaries whose common prefix is exactly l: those between intervals that were apart one level before. While many close,
    all open ones are looked at; later only what the boundaries closed last lead to.
    """
    n = len(text)
    bwt = text[order - 1]
    src = np.argsort(bwt, kind="stable").astype(np.int32)  # rows by preceding byte, in row order: the backward step's inverse
    first = bwt[src]
    is_open = np.append(False, first[1:] == first[:-1])  # common prefix 0: the first byte differs
    active = np.flatnonzero(is_open)
    lo, hi = src[active - 1], src[active]
    level, last = 1, np.flatnonzero(~is_open)
    while level < length and 32 * len(last) > n:
        closed = np.cumsum(~is_open, dtype=np.int32)
        last = active[closed[hi] != closed[lo]]
        is_open[last] = False
        stay = is_open[active]
        active, lo, hi = active[stay], lo[stay], hi[stay]
        level += 1
    # which open boundaries a row closes: those whose two source rows it lies between; far ones are searched for
    far = hi - lo > 64
    width = np.where(far, 0, hi - lo)
    rows = K.ranges_concat(lo + 1, width)
    by = np.argsort(rows, kind="stable")
    leads = np.repeat(active, width)[by]
    at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    active, lo, hi = active[far], lo[far], hi[far]
    stamp = np.empty(n, np.int32)
    while level < length and len(last):
        found = leads[K.ranges_concat(at[last], at[last + 1] - at[last])]
        if len(active):
            last = np.sort(last)
            found = np.append(found, active[np.searchsorted(last, hi, "right") > np.searchsorted(last, lo, "right")])
        found = found[is_open[found]]
        stamp[found] = np.arange(len(found))
        last = found[stamp[found] == np.arange(len(found))]
        is_open[last] = False
        if level % 8 == 0 and len(active):
            stay = is_open[active]
            active, lo, hi = active[stay], lo[stay], hi[stay]
        level += 1
    return is_open


def repeated_windows(segs: list[bytes], own: np.ndarray, m: np.ndarray, length: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of each owned window whose bytes occur twice, a piece counting ``m`` times; sorted."""
    # UTF-8 has no byte 255: one more than each byte leaves 0 for the end mark, the smallest symbol
    text = np.append(np.frombuffer(b"".join(segs), np.uint8) + np.uint8(1), np.uint8(0))
    offs = np.concatenate([[0], np.cumsum([len(s) for s in segs])])
    order = sorted_rotations(text, length)
    group = np.cumsum(~open_boundaries(text, order, length))[1:]  # without the end mark, which is first
    order = order[1:]
    of = np.repeat(np.arange(len(segs)), np.diff(offs))
    piece = of[order]
    mine = order - offs[piece] < own[piece]
    total = np.bincount(group[mine], weights=m[piece[mine]], minlength=int(group[-1]) + 1)
    hit = np.zeros(len(text), bool)
    hit[order[mine & (total[group] >= 2)]] = True
    at = np.flatnonzero(hit)
    return of[at], at - offs[of[at]]


def _locate(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in anchor_runs(batches, 4):
            piece, window = repeated_windows([r[4] for r in rows], np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), length)
            if len(piece):
                cut = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)))
                last = np.append(cut[1:], len(piece)) - 1
                yield answers(rows, piece[cut], window[cut], window[last] + length)

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: id, ``n_units`` (bytes), removed ``spans`` and ``kept`` bytes."""

    def locate(pieces: DataFrame) -> DataFrame:
        return pieces.repartition("a").sortWithinPartitions("a").mapInArrow(_locate(min_bytes), ANSWER)

    spans = repeated_spans(docs, id_col, text_col, "byte", min_bytes, min(anchor_bytes, max(1, min_bytes // 2)), locate, max_group)
    return cut_spans(docs, spans, id_col, text_col, "byte")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        (F.col("n_units") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
