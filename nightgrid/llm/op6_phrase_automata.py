"""Substring dedup: recurring word passages, found by sharded Aho-Corasick automata.

1. Confirm: under each anchor (see ``repeats``) windows are counted; runs of windows that recur are passages. Their distinct texts are
   written as a table by anchor, without where they came from.
2. Compile: a shard is a run of whole anchors; its passages become one pyahocorasick automaton over word numbers.
3. Stream: the segments of all documents that elect one of the shard's anchors go through it, equal ones once. Where a passage
   ends is known from the automaton alone.

Defined results: null, empty and word-less texts have 0 words; texts with fewer words than a window keep all; rows with the
same id and text repeat each other; kept words are joined by one space; a very long text is cut into segments like any other; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import ANSWER, anchor_runs, answers, cut_spans, repeated_spans
from .shared import materialise, read_table

WINDOW_WORDS = 35
ANCHOR_WORDS = 8
#: Different segments under one anchor before its windows elect longer anchors.
MAX_GROUP = 2048
_PASSAGE = pa.schema([("a", pa.int64()), ("passage", pa.binary())])


def recurring_passages(segs: list[bytes], own: np.ndarray, m: np.ndarray, length: int) -> list[tuple[int, bytes]]:
    """(a segment that holds it, text) of the distinct maximal runs of windows that occur twice or more; a segment counts ``m`` times."""
    known: dict[bytes, int] = {}
    words = [s.split(b" ") for s in segs]
    numbers = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.uint64)
    offs = np.concatenate([[0], np.cumsum([len(ws) for ws in words])])
    at = K.ranges_concat(offs[:-1], own)
    piece = np.repeat(np.arange(len(own)), own)
    _, which = np.unique(K.RollingHash(K.mix64(numbers + K.U(1))).windows(length)[at], return_inverse=True)
    twice = np.bincount(which, weights=m[piece])[which] >= 2
    s, p = at[twice], piece[twice]
    if not len(s):
        return []
    cut = np.flatnonzero(np.append(True, (s[1:] != s[:-1] + 1) | (p[1:] != p[:-1])))
    last = np.append(cut[1:], len(s)) - 1
    found = {}
    for a, b, i in zip((s[cut] - offs[p[cut]]).tolist(), (s[last] - offs[p[cut]]).tolist(), p[cut].tolist()):
        found.setdefault(b" ".join(words[i][a : b + length]), i)
    return [(i, t) for t, i in found.items()]


def _confirm(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in anchor_runs(batches, 4):
            found = recurring_passages([r[4] for r in rows], np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), length)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], schema=_PASSAGE)

    return run


class Shard:
    """One automaton over the word numbers of its passages."""

    def __init__(self, passages: list[bytes]):
        self.known: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in passages:
            words = tuple(self.known.setdefault(w, len(self.known) + 1) for w in p.split(b" "))
            self.automaton.add_word(words, len(words))
        if passages:
            self.automaton.make_automaton()

    def occurrences(self, text: bytes) -> list[tuple[int, int]]:
        """First word and end of each passage's occurrence in a text of words parted by one space."""
        if not self.known:
            return []
        number = self.known.get
        return [(end + 1 - n, end + 1) for end, n in self.automaton.iter(tuple(number(w, 0) for w in text.split(b" ")))]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole anchors, passages first: rows (a, d, text), passages without ``d``."""
    for rows in anchor_runs(batches, 2):
        shard = Shard([r[2] for r in rows if r[1] is None])
        hits = [(i, s, e) for i, r in enumerate(rows) if r[1] is not None for s, e in shard.occurrences(r[2])]
        if hits:
            yield answers(rows, *np.array(hits).T)


def remove_recurring_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = WINDOW_WORDS, anchor_words: int = ANCHOR_WORDS, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: id, ``n_units`` (words), removed word ``spans`` and ``kept`` (words joined by a space)."""

    def locate(pieces: DataFrame) -> DataFrame:
        pieces = materialise(pieces.repartition("a").sortWithinPartitions("a"), "pieces")
        passages = materialise(pieces.repartition("a").sortWithinPartitions("a").mapInArrow(_confirm(window_words), "a long, passage binary"), "passages")
        rows = pieces.select("a", "d", F.col("seg").alias("t")).unionByName(passages.select("a", F.lit(None).cast("long").alias("d"), F.col("passage").alias("t")))
        return rows.repartition("a").sortWithinPartitions("a", F.asc_nulls_first("d")).mapInArrow(_stream, ANSWER)

    spans = repeated_spans(docs, id_col, text_col, "word", window_words, min(anchor_words, max(1, window_words // 2)), locate, max_group)
    return cut_spans(docs, spans, id_col, text_col, "word")


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_recurring_passages(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]).cast("long"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
