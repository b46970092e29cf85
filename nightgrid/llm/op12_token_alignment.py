"""Cross-tokenizer alignment by a sweep over token ends.

1. *Events.* Each text is encoded by both tokenizers. The ends of both sides' tokens are one table of events: a row holds the ids of one side's tokens
   that end in one stretch of ``STRETCH`` bytes, packed; an id's length in bytes gives the offset at which its token ends.
2. *Sweep.* Events are repartitioned by document and sorted by offset within partitions. A state machine streams over them; its state is
   the tokens after the last offset where both sides end. It emits a document as parts closed at such an offset, so no group and no link is in
   two parts.
3. *Groups and links.* A part by itself gives its groups (cut where both sides end) and its links (pairs of tokens whose byte ranges overlap).
4. *Counts.* Links of an id pair are counted over all documents, combined in the tasks before they are shuffled. The ``HOT_PAIRS`` most frequent pairs (a table of fixed size)
   go to every task; links of rarer pairs are answered by a join, one row a document and pair.

Encoding remembers what lies between spaces: a space after anything but white space starts a new token on both sides (checked when the vocabularies
are loaded; where it does not hold, whole texts are encoded). What is remembered is dropped when it grows beyond ``KNOWN``.

Defined results: null and empty texts, and texts whose tokens' bytes are not space and text, have no tokens; ids may be null; rows with equal id and
text are aligned once and come out as often as they came in; a very long text is several parts, its state no longer than its longest group; an empty table
gives an empty one; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import row_key
from .shared import materialise, read_table

#: Folder of the vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose token ends are one event row.
STRETCH = 1 << 16
#: Different stretches between spaces that a task remembers; bytes of text that it encodes at once.
KNOWN, ENCODE_BYTES = 1 << 18, 1 << 21
#: Pairs whose counts every task gets.
HOT_PAIRS = 1 << 20
#: Tokens that are aligned at once; different pairs that a task combines before it emits them.
CHUNK_TOKENS, COMBINE_PAIRS = 1 << 20, 1 << 21
SPLIT = re.compile(r"(?<=\S) ")
_MARK = "▁"


class Tokenizer:
    """Ids of texts, bytes of ids, and whether a space after anything but white space always starts a token."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Fast

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self._fast = Fast.from_file(path)
            self._fast.encode_special_tokens = True
            self.splits = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            named = dict(self._fast.get_vocab(with_added_tokens=True))
            special = {x["content"] for x in spec["added_tokens"]}
            byte = _byte_letters()
            self.bytes = [b""] * (max(named.values()) + 1)
            for piece, i in named.items():
                self.bytes[i] = piece.encode() if piece in special else bytes(byte[c] for c in piece)
            self.encode = self._encode_json
        else:
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            n = self._pieces.vocab_size()
            pieces = [self._pieces.id_to_piece(i) for i in range(n)]
            self.bytes = [bytes([int(p[3:5], 16)]) if self._pieces.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
            self.splits = not any(_MARK in p.lstrip(_MARK) for p in pieces)
            self._space = [i for i, p in enumerate(pieces) if p == _MARK]
            self.encode = self._encode_pieces
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def _encode_json(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._fast.encode_batch([" " + t for t in texts], add_special_tokens=False)]

    def _encode_pieces(self, texts: list[str]) -> list[list[int]]:
        # the model puts a space in front by itself, but not before an empty text
        out = self._pieces.encode([t for t in texts if t], num_threads=1)
        if len(out) == len(texts):
            return out
        it = iter(out)
        return [next(it) if t else self._space for t in texts]


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class _Pool:
    """Ids of both sides of each known stretch, one after another, and whether their bytes are the stretch's own."""

    def __init__(self, sides: tuple[Tokenizer, Tokenizer]):
        self.sides, self.splits = sides, all(s.splits for s in sides)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.count = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.right = np.zeros(0, bool)

    def encode(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per side (ids of all texts, tokens of each text), and whether each text comes back from both sides."""
        parts = [SPLIT.split(t) for t in texts] if self.splits else [[t] for t in texts]
        if len(self.known) > KNOWN or not self.splits:
            self.clear()
        new = list(dict.fromkeys(p for x in parts for p in x if p not in self.known))
        if new:
            self._learn(new)
        which = np.array(list(map(self.known.__getitem__, chain.from_iterable(parts))), np.int64)
        size = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(size) - size
        out = []
        for ids, count in zip(self.ids, self.count):
            start = np.cumsum(count) - count
            out.append((ids[K.ranges_concat(start[which], count[which])], np.add.reduceat(count[which], first)))
        return out, np.logical_and.reduceat(self.right[which], first)

    def _learn(self, new: list[str]) -> None:
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        right = np.ones(len(new), bool)
        for k, side in enumerate(self.sides):
            found = side.encode(new)
            right &= [b"".join(map(side.bytes.__getitem__, x)) == b" " + t.encode() for x, t in zip(found, new)]
            self.ids[k] = np.concatenate([self.ids[k], np.fromiter(chain.from_iterable(found), np.int32)])
            self.count[k] = np.concatenate([self.count[k], np.array([len(x) for x in found], np.int64)])
        self.right = np.concatenate([self.right, right])


class _Packer:
    """Ids as bytes: as narrow as the vocabulary allows, compressed."""

    def __init__(self, sides: tuple[Tokenizer, Tokenizer]):
        self.kinds = [np.dtype("<u2" if len(s.bytes) <= 1 << 16 else "<u4") for s in sides]
        self._in, self._out = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, side: int, ids: np.ndarray) -> bytes:
        return self._in.compress(ids.astype(self.kinds[side]).tobytes()) if len(ids) else b""

    def unpack(self, side: int, data: bytes) -> np.ndarray:
        return np.frombuffer(self._out.decompress(data) if data else b"", self.kinds[side])


def _events(paths: tuple[str, str]):
    """Texts (id, rk, text) -> (id, rk, at, side, ids): the tokens of a side that end in stretch ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tuple(map(tokenizer, paths))
        pool, packer = _Pool(sides), _Packer(sides)
        for b in batches:
            for i, j, buf, offs in K.slices(b.column(2), ENCODE_BYTES):
                raw = buf.tobytes()
                texts = [raw[s:e].decode() for s, e in zip(offs.tolist(), offs[1:].tolist())]
                full = [k for k, t in enumerate(texts) if t]
                coded, right = pool.encode([texts[k] for k in full]) if full else ([], [])
                row, at, side, ids = [], [], [], []

                def emit(k: int, a: int, s: int, x: bytes) -> None:
                    row.append(i + k), at.append(a), side.append(s), ids.append(x)

                for k in set(range(j - i)).difference(k for k, ok in zip(full, right) if ok):
                    emit(k, 0, 0, b"")
                for s, (all_ids, count) in enumerate(coded):
                    to = np.cumsum(count)
                    for k, ok, lo, hi in zip(full, right, (to - count).tolist(), to.tolist()):
                        if not ok:
                            continue
                        own = all_ids[lo:hi]
                        if offs[k + 1] - offs[k] < STRETCH:
                            emit(k, 0, s, packer.pack(s, own))
                            continue
                        stretch = (np.cumsum(sides[s].lengths[own]) - 1) // STRETCH
                        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(own)]
                        if s == 0 and stretch[0] > 0:
                            emit(k, 0, 0, b"")  # every document has a first event of side A
                        for x, y in zip(cuts, cuts[1:]):
                            emit(k, int(stretch[x]), s, packer.pack(s, own[x:y]))
                take = pa.array(row, pa.int64())
                cols = [b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), pa.array(side, pa.int8()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "rk", "at", "side", "ids"])

    return run


def _sweep(paths: tuple[str, str]):
    """Events sorted by (rk, at, side) -> parts (id, rk, copies, part, last, a, b) that are closed where both sides end."""
    names = ["id", "rk", "copies", "part", "last", "a", "b"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tuple(map(tokenizer, paths))
        packer = _Packer(sides)
        rows: list[list] = []
        who: list[pa.Array] = []
        doc = at = last_side = None
        copies = part = 0
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # tokens after the last common end
        came: list[bytes] = [b"", b""]  # events of the present stretch

        def close(ends_here: bool) -> None:
            nonlocal part, rest, came
            if ends_here and at == 0:  # one stretch, as most documents are
                who.append(current)
                rows.append([doc, copies, 0, True, *came])
                came = [b"", b""]
                return
            both = [np.concatenate([r, packer.unpack(s, x)]) for s, (r, x) in enumerate(zip(rest, came))]
            ends = [np.cumsum(sides[s].lengths[x]) for s, x in enumerate(both)]
            common = np.intersect1d(*ends, assume_unique=True)
            done = [int(np.searchsorted(e, common[-1], "right")) if len(common) else 0 for e in ends]
            if ends_here or len(common):
                who.append(current)
                rows.append([doc, copies, part, ends_here, *(packer.pack(s, x[:n]) for s, (x, n) in enumerate(zip(both, done)))])
                part += 1
            rest, came = [x[n:] for x, n in zip(both, done)], [b"", b""]

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(who), *cols], names=names)

        current, size = None, 0
        for b in batches:
            for i, (rk, a, s, x) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)))):
                if rk != doc:
                    if doc is not None:
                        close(True)
                        if size >= K.SLICE_BYTES:
                            yield out()
                            rows, who, size = [], [], 0
                    doc, at, last_side, copies, part = rk, 0, None, 0, 0
                    rest, current = [np.zeros(0, np.int64), np.zeros(0, np.int64)], b.column(0).slice(i, 1)
                if (a, s) == (0, 0):
                    copies += 1
                if (a, s) == (at, last_side):
                    continue  # the same event of an equal row
                if a != at:
                    close(False)
                    at = a
                came[s], last_side = x, s
                size += len(x) + 32
        if doc is not None:
            close(True)
            yield out()

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, folder: str = TOKENIZERS) -> DataFrame:
    """The swept documents: ``id, rk, copies, part, last`` and the packed ids ``a`` and ``b`` of each part."""
    paths = (f"{folder}/{tokenizer_a}", f"{folder}/{tokenizer_b}")
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    events = src.mapInArrow(_events(paths), f"id {kind}, rk long, at int, side byte, ids binary")
    swept = events.repartition("rk").sortWithinPartitions("rk", "at", "side").mapInArrow(_sweep(paths), f"id {kind}, rk long, copies int, part int, last boolean, a binary, b binary")
    return materialise(swept, "aligned")


class Parts:
    """Parts of some documents in a row: tokens, groups and links of all of them at once."""

    def __init__(self, sides, packer: _Packer, a: list[bytes], b: list[bytes]):
        own = [[packer.unpack(s, x) for x in col] for s, col in enumerate((a, b))]
        self.count = [np.array([len(x) for x in col], np.int64) for col in own]
        self.ids = [np.concatenate(col).astype(np.int64) if col else np.zeros(0, np.int64) for col in own]
        self.ends = [np.cumsum(side.lengths[x]) for side, x in zip(sides, self.ids)]
        total = int(self.ends[0][-1]) if len(self.ends[0]) else 0
        mark = [np.zeros(total + 1, bool) for _ in range(2)]
        for m, e in zip(mark, self.ends):
            m[e] = True
        #: Whether a token ends where the other side has an end too; parts end so, hence groups and links never cross them.
        self.closed = [mark[1 - s][e] for s, e in enumerate(self.ends)]
        self.marks = mark
        self.lengths = [side.lengths for side in sides]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens of both sides up to the end of each group."""
        return tuple(np.flatnonzero(c) + 1 for c in self.closed)

    def group_counts(self) -> np.ndarray:
        """Groups of each part."""
        lead = np.concatenate([[0], np.cumsum(self.closed[0])])
        to = np.cumsum(self.count[0])
        return lead[to] - lead[to - self.count[0]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Per A token the first B token that overlaps it, and how many do."""
        upto = np.cumsum(self.marks[1], dtype=np.int32)  # B tokens that end at or before an offset
        end = self.ends[0]
        low = upto[end - self.lengths[0][self.ids[0]]]
        return low, upto[end - 1] + 1 - low

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """A id and B id of each link, and links of each part."""
        low, n = self.links()
        return np.repeat(self.ids[0], n), self.ids[1][K.ranges_concat(low.astype(np.int64), n.astype(np.int64))], np.diff(np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.concatenate([[0], np.cumsum(self.count[0])])])


def _chunks(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Runs of rows of about CHUNK_TOKENS tokens (packed tokens are some 1.3 bytes)."""
    for batch in batches:
        size = np.array([len(x) + len(y) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())], np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_TOKENS)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if i < j:
                run = batch.slice(i, j - i)
                yield run, run.column(a).to_pylist(), run.column(b).to_pylist()


def groups(aligned: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, folder: str = TOKENIZERS) -> DataFrame:
    """``id, rk, part, groups array<struct<a array<int>, b array<int>>>``: the groups of each part, in order."""
    paths = (f"{folder}/{tokenizer_a}", f"{folder}/{tokenizer_b}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tuple(map(tokenizer, paths))
        packer = _Packer(sides)
        for batch, a, b in _chunks(batches, 3, 4):
            p = Parts(sides, packer, a, b)
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], g]).astype(np.int32), pa.array(x.astype(np.int32))) for g, x in zip(p.groups(), p.ids)]
            each = pa.StructArray.from_arrays(lists, names=["a", "b"])
            of_part = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(p.group_counts())]).astype(np.int32), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), of_part], names=["id", "rk", "part", "groups"])

    kind = aligned.schema["id"].dataType.simpleString()
    return aligned.select("id", "rk", "part", "a", "b").mapInArrow(run, f"id {kind}, rk long, part int, groups array<struct<a:array<int>,b:array<int>>>")


def links(aligned: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, folder: str = TOKENIZERS) -> DataFrame:
    """``id, rk, part, links array<struct<a int, b int>>``: the ids of each overlapping pair of tokens, in order."""
    paths = (f"{folder}/{tokenizer_a}", f"{folder}/{tokenizer_b}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tuple(map(tokenizer, paths))
        packer = _Packer(sides)
        for batch, a, b in _chunks(batches, 3, 4):
            x, y, n = Parts(sides, packer, a, b).pairs()
            each = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], names=["a", "b"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), each)], names=["id", "rk", "part", "links"])

    kind = aligned.schema["id"].dataType.simpleString()
    return aligned.select("id", "rk", "part", "a", "b").mapInArrow(run, f"id {kind}, rk long, part int, links array<struct<a:int,b:int>>")


def pair_counts(aligned: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, folder: str = TOKENIZERS) -> DataFrame:
    """``a, b, n``: links of each id pair over all rows."""
    paths = (f"{folder}/{tokenizer_a}", f"{folder}/{tokenizer_b}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tuple(map(tokenizer, paths))
        packer, wide = _Packer(sides), len(sides[1].bytes)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def combined() -> list[tuple[np.ndarray, np.ndarray]]:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return [(key, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

        def out() -> pa.RecordBatch:
            (key, n), = held
            return pa.RecordBatch.from_arrays([pa.array((key // wide).astype(np.int32)), pa.array((key % wide).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch, a, b in _chunks(batches, 1, 2):
            x, y, n = Parts(sides, packer, a, b).pairs()
            key, copies = _keys(x, y, wide, sides), batch.column(0).to_numpy()
            for c in np.unique(copies).tolist():  # nearly always 1 alone
                own = key if (copies == c).all() else key[np.repeat(copies == c, n)]
                u, m = np.unique(own, return_counts=True)
                held.append((u, m * c))
                size += len(u)
            if size > COMBINE_PAIRS:
                held = combined()
                size = len(held[0][0])
                if size > COMBINE_PAIRS // 2:
                    yield out()
                    held, size = [], 0
        if held:
            held = combined()
            yield out()

    return aligned.select("copies", "a", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _keys(x: np.ndarray, y: np.ndarray, wide: int, sides) -> np.ndarray:
    key = x * wide + y
    return key.astype(np.uint32) if len(sides[0].bytes) * wide < 1 << 32 else key


def _hot(pairs: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The most frequent pairs, ``most`` at the most, and whether they are all."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1]) for r in pairs.groupBy(step.alias("k")).count().collect()), reverse=True)  # at most 16 a power of two
    total, least = 0, None
    for k, n in sizes:
        if total + n > most:
            break
        total, least = total + n, k
    everything = total == sum(n for _, n in sizes)
    return pairs.filter(step >= F.lit(least)) if least is not None else pairs.limit(0), everything


def summarise(aligned: DataFrame, pairs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, folder: str = TOKENIZERS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of the input: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` from its parts and the pairs' counts."""
    paths = (f"{folder}/{tokenizer_a}", f"{folder}/{tokenizer_b}")
    hot, everything = _hot(pairs, hot_pairs)
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))  # one row an id of B
    hot_table, top_table = hot.toArrow(), top.toArrow()
    names = ["id", "rk", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest", "cold"]
    cold_kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    wide_b = (int(top_table["b"].to_numpy().max()) + 1) if top_table.num_rows else 1
    best = np.zeros(wide_b, np.int64)
    best[top_table["b"].to_numpy()] = top_table["top"].to_numpy()
    ha, hb, hn = (hot_table[c].to_numpy() for c in ("a", "b", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tuple(map(tokenizer, paths))
        packer, wide = _Packer(sides), len(sides[1].bytes)
        hot_key = _keys(ha.astype(np.int64), hb.astype(np.int64), wide, sides)
        order = np.argsort(hot_key)
        hot_key, hot_n = hot_key[order], hn[order]
        decimal = _Decimals(max(len(s.bytes) for s in sides))
        running = None  # of a document with several parts
        for batch, a, b in _chunks(batches, 5, 6):
            p = Parts(sides, packer, a, b)
            x, y, n = p.pairs()
            key, back = np.unique(_keys(x, y, wide, sides), return_inverse=True)
            if len(hot_key):
                at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                known = np.where(hot_key[at] == key, hot_n[at], 0)
            else:
                known = np.zeros(len(key), np.int64)
            is_top = known == best[(key % wide).astype(np.int64)]
            to = np.concatenate([[0], np.cumsum(n)])
            sums = [_per_part(v[back], to) for v in (known, is_top & (known > 0))]
            cold = [None] * batch.num_rows
            rare = np.flatnonzero((known == 0)[back])
            if len(rare):
                part_of = np.searchsorted(to, rare, "right") - 1
                code, m = np.unique(np.stack([part_of, back[rare]], 1), axis=0, return_counts=True)
                for (i, k), c in zip(code.tolist(), m.tolist()):
                    cold[i] = cold[i] or []
                    cold[i].append({"a": int(key[k]) // wide, "b": int(key[k]) % wide, "n": c})
            digests = []
            for text, part, last in zip(decimal.texts(p), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if part == 0:
                    running = hashlib.sha256()
                running.update(text[:-1] if last else text)
                digests.append((running.hexdigest() if part or text else "") if last else None)
            cols = [pa.array(c) for c in (*p.count, p.group_counts(), n, sums[1], sums[0])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *cols, pa.array(digests, pa.string()), pa.array(cold, pa.list_(cold_kind))], names=names)

    kind = aligned.schema["id"].dataType.simpleString()
    cols = aligned.select("id", "rk", "copies", "part", "last", "a", "b")
    whole = (F.col("part") == 0) & F.col("last")
    in_order = cols.filter(whole).unionByName(cols.filter(~whole).repartition("rk").sortWithinPartitions("rk", "part"))
    fields = ", ".join(f"{c} long" for c in names[3:9])
    parts = in_order.mapInArrow(run, f"id {kind}, rk long, copies int, {fields}, digest string, cold array<struct<a:int,b:int,n:long>>")
    if not everything:
        parts = materialise(parts, "parts")
        rare = pairs.join(hot.select("a", "b"), ["a", "b"], "left_anti") if hot_table.num_rows else pairs
        rare = rare.join(top, "b").select("a", "b", F.col("n").alias("total"), (F.col("n") == F.col("top")).cast("long").alias("is_top"))
        asked = parts.select("id", "rk", "copies", F.explode("cold").alias("c")).select("id", "rk", "copies", "c.*")
        asked = asked.join(rare, ["a", "b"]).groupBy("id", "rk", "copies").agg(F.sum(F.expr("n * is_top")).alias("n_best"), F.sum(F.expr("n * total")).alias("count_sum"))
        zero = [F.lit(0).cast("long").alias(c) for c in names[3:7]]
        parts = parts.drop("cold").unionByName(asked.select("id", "rk", "copies", *zero, "n_best", "count_sum", F.lit(None).cast("string").alias("digest")))
    one = parts.groupBy("id", "rk", "copies").agg(*(F.sum(c).alias(c) for c in names[3:9]), F.max("digest").alias("groups_sha256"))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("id", *names[3:9], "groups_sha256")


def _per_part(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    lead = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(lead[to])


class _Decimals:
    """Groups as text: ``a1,a2|b1;a3|b2,b3;`` with decimal ids."""

    def __init__(self, n: int):
        width = len(str(n - 1))
        digits = np.zeros((n, width + 1), np.uint8)
        for i in range(n):
            s = str(i).encode()
            digits[i, : len(s)] = np.frombuffer(s, np.uint8)
        self.digits, self.size = digits, (digits > 0).sum(1) + 1

    def texts(self, p: Parts) -> list[bytes]:
        """One text a part."""
        upto = p.groups()
        number = [np.cumsum(c) - c for c in p.closed]  # group of each token
        before = np.concatenate([[0], upto[1]])[number[0]] if len(upto[0]) else np.zeros(0, np.int64)
        place = [np.arange(len(p.ids[0])) + before, np.arange(len(p.ids[1])) + upto[0][number[1]] if len(upto[0]) else np.zeros(0, np.int64)]
        total = len(p.ids[0]) + len(p.ids[1])
        table, size = np.zeros((total, self.digits.shape[1]), np.uint8), np.zeros(total + 1, np.int64)
        for s, end in enumerate((b"|", b";")):
            rows = self.digits[p.ids[s]]
            rows[:, -1] = np.where(p.closed[s], end[0], ord(","))
            table[place[s]] = rows
            size[place[s] + 1] = self.size[p.ids[s]]
        flat = table[table > 0].tobytes()
        to = np.cumsum(size)[np.concatenate([[0], np.cumsum(p.count[0] + p.count[1])])].tolist()
        return [flat[x:y] for x, y in zip(to, to[1:])]


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned, and the digest of its groups and links."""
    aligned = align(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = materialise(pair_counts(aligned), "pairs")
    return summarise(aligned, pairs).withColumnRenamed("id", "doc_id")
