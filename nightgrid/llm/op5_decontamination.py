"""Benchmark decontamination: latent semantic retrieval of benchmark items in documents, confirmed on the words.

1. Document frequencies of the benchmark's words over all passages; words in more than ``MAX_DF`` of them carry no meaning.
2. Distributed randomised SVD of the passages' TF-IDF matrix A over the benchmark's words: every task adds its part of
   ``A^T (A Omega)``, a (words x rank) matrix whose size the benchmark fixes; the Nystroem formula gives right singular vectors.
3. Every passage (two neighbouring half windows) is folded in; cosine against all items gives candidates. An item longer than a
   passage is searched for by its pieces of at most a passage's length as well, each with its own share of words to be found.
4. A candidate's region must share a longest common subsequence of ``MIN_LCS`` of the item's words within a bounded stretch, and the
   item's answer (its last words) must be there as well, unless nearly all of the item is.

A benchmark of up to ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` different words is one block: three passes over the documents whatever its
size, with items listed by word, so a passage only meets items that it shares enough words with. A larger one is cut into such blocks, so what
reaches the driver and the tasks is bounded.

Defined results: null or word-less texts match nothing; null or word-less items are ignored; ids may be of any type, null or repeat: each row of
``docs`` is judged for itself, and so is each item; of stretches with equal shares the first counts; a text of any length is read whole, passage by
passage; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .shared import read_table

HALF = 24
RANK = 64
MAX_DF = 0.05
MIN_COSINE = 0.35
#: Share of an item's meaningful words that one passage must hold before its words are aligned.
MIN_SHARED = 0.3
MIN_HITS = 3
MIN_LCS = 0.6
SURE_LCS = 0.8
MIN_ANSWER = 0.5
BLOCK_ITEMS = 1 << 14
BLOCK_WORDS = 1 << 17


def half_windows(buf: np.ndarray, offs: np.ndarray):
    """Words, their hashes, and for each word the number of its half window; the text of each half window and its first word."""
    w = K.Words(buf, offs)
    h = w.hashes(lower=True)
    count = np.diff(w.first)
    halves = -(-count // HALF)
    text = np.repeat(np.arange(len(count)), halves)
    first_half = np.concatenate([[0], np.cumsum(halves)])
    inside = np.arange(len(text)) - first_half[text]
    start = w.first[text] + HALF * inside
    of_word = np.repeat(np.arange(len(text)), np.diff(np.append(start, len(h))))
    return w, h, of_word, text, start


class Vocabulary:
    """The benchmark's words, by sorted hash."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys >> K.U(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h``, word numbers) of known words."""
        maybe = np.flatnonzero(self.filter[(h >> K.U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == h[maybe]
        return maybe[ok], at[ok]



def _parts(m: np.ndarray, n: int = 64) -> list[np.ndarray]:
    return [p for p in np.array_split(m, n)]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, d in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(d.as_buffer(), np.float64)
            total[k] = total[k] + x if k in total else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "data"])


def summed(texts: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of the matrix that ``work(slices)`` makes; added up in 64 parts on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for _, _, buf, offs in K.slices(b.column(0)):
                work(total, buf, offs)
        parts = _parts(total)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "data"])

    rows = texts.mapInArrow(run, "part int, data binary").repartition("part").mapInArrow(_added, "part int, data binary")
    parts = {r["part"]: np.frombuffer(r["data"]) for r in rows.toLocalIterator()}
    if not parts:
        return np.zeros(shape)
    return np.concatenate([parts[k] for k in sorted(parts)]).reshape(shape)


def right_vectors(g: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors (words x rank) from ``g = A^T A omega``, by the Nystroem formula."""
    q, _ = np.linalg.qr(g)
    core = omega.T @ g
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core)
    keep = val > 1e-9 * max(val.max(initial=0), 1e-30)
    if not keep.any():
        return q
    b = g @ (vec[:, keep] / np.sqrt(val[keep]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, s > 1e-9 * s[0]]


class Item:
    """An item's words as bit masks, for bit-parallel longest common subsequences."""

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.masks: dict[int, int] = {}
        for i, x in enumerate(words):
            self.masks[x] = self.masks.get(x, 0) | 1 << i
        self.tail = max(min(3, self.n), self.n // 5)

    def lcs(self, words: list[int], masks: dict[int, int] | None = None, n: int | None = None) -> int:
        masks, n = masks or self.masks, n or self.n
        full = (1 << n) - 1
        s = full
        for x in words:
            m = masks.get(x)
            if m:
                u = s & m
                s = ((s + u) | (s - u)) & full
        return n - s.bit_count()

    def answer(self, words: list[int]) -> float:
        """Share of the last words that ``words`` has, in order."""
        cut = self.n - self.tail
        masks = {x: m >> cut for x, m in self.masks.items() if m >> cut}
        return self.lcs(words, masks, self.tail) / self.tail

    def check(self, region: list[int]) -> tuple[float, float]:
        """Best (share of the item, share of its answer) over stretches of the item's length and a quarter more."""
        if self.lcs(region) < MIN_LCS * self.n:
            return 0.0, 0.0  # no stretch can have more than the whole
        span, best = self.n + self.n // 4 + 2, (0.0, 0.0)
        for at in range(0, max(1, len(region) - span + 1), max(1, span // 8)):
            part = region[at : at + span]
            share = self.lcs(part) / self.n
            if share > best[0]:
                best = (share, self.answer(part))
        last = region[-span:]
        share = self.lcs(last) / self.n
        return max(best, (share, self.answer(last)))


def meaningful(df: np.ndarray, n: float, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """IDF of each word, 0 for words in too many passages, unless an item would be left with too few words."""
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    rare = df <= MAX_DF * n
    for a, b in zip(first[:-1], first[1:]):
        if rare[number[a:b]].sum() < MIN_HITS:
            rare = rare.copy()
            rare[number[a:b]] = True
    return np.where(rare, idf, 0.0)


def pieces(n: int) -> list[tuple[int, int]]:
    """What an item of ``n`` words is searched for by: the whole, and even pieces of a passage's length at most where it is longer."""
    count = -(-n // (2 * HALF))
    cuts = [n * k // count for k in range(count + 1)]
    return [(0, n)] + (list(zip(cuts[:-1], cuts[1:])) if count > 1 else [])


def _scorer(vocab: Vocabulary, weight: np.ndarray, vectors: np.ndarray, queries: np.ndarray, items: list[Item], ids: pa.Array, lists: tuple[np.ndarray, np.ndarray], owner: np.ndarray, names: list[str]):
    """``lists``: for each word the queries that hold it (ends, queries); ``owner``: the item of each query."""
    ends, of = lists
    held = np.bincount(of, minlength=len(queries))
    need = np.maximum(np.minimum(MIN_HITS, held), np.ceil(MIN_SHARED * held)).astype(np.int64)
    width = np.diff(ends)
    n_q = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = (vectors * weight[:, None]).astype(np.float32)
        for b in batches:
            for i, j, buf, offs in K.slices(b.column(1)):
                w, h, of_word, text, start = half_windows(buf, offs)
                at, word = vocab.find(h)
                keep = weight[word] > 0
                at, word = at[keep], word[keep]
                if not len(at):
                    continue
                n = len(text)
                cut = np.searchsorted(of_word[at], np.arange(n + 1))
                follow = np.append(text[1:] == text[:-1], False)
                # words that each passage (a half window and the next one) shares with each query
                half = np.repeat(of_word[at], width[word])
                code, shared = np.unique(half * n_q + of[K.ranges_concat(ends[word], width[word])], return_counts=True)
                both = code >= n_q
                both[both] = follow[code[both] // n_q - 1]
                code, inv = np.unique(np.concatenate([code, code[both] - n_q]), return_inverse=True)
                shared = np.bincount(inv, np.concatenate([shared, shared[both]]))
                code = code[shared >= need[code % n_q]]
                if not len(code):
                    continue
                p, row = np.unique(code // n_q, return_inverse=True)
                q = code % n_q
                size = np.diff(cut)[p] + np.where(follow[p], np.diff(cut, append=cut[-1])[p + 1], 0)
                x = np.add.reduceat(folded[word[K.ranges_concat(cut[p], size)]], np.cumsum(size) - size)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                cosine = np.einsum("ij,ij->i", x[row], queries[q])
                found: dict[tuple[int, int], float] = {}
                windows: dict[tuple[int, int], set[int]] = {}
                for r in np.flatnonzero(cosine >= MIN_COSINE).tolist():
                    key = int(text[p[row[r]]]), int(owner[q[r]])
                    found[key] = max(found.get(key, 0.0), float(cosine[r]))
                    windows.setdefault(key, set()).add(int(start[p[row[r]]]))
                out = []
                for (t, k), starts in windows.items():
                    best = (0.0, 0.0)
                    item = items[k]
                    for s in sorted(starts):
                        lo, hi = max(w.first[t], s - item.n), min(w.first[t + 1], s + 2 * HALF + item.n)
                        best = max(best, item.check(h[lo:hi].tolist()))
                        if best[0] == 1:
                            break
                    if best[0] >= SURE_LCS or best[0] >= MIN_LCS and best[1] >= MIN_ANSWER:
                        out.append((t, k, found[t, k], *best))
                if out:
                    docs = b.column(0).take(pa.array([i + r[0] for r in out]))
                    yield pa.RecordBatch.from_arrays([docs, ids.take(pa.array([r[1] for r in out])), *(pa.array([r[k] for r in out], pa.float64()) for k in (2, 3, 4))], names=names)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.lower(text_col).alias("t")).orderBy("i", "t").toLocalIterator()
    block, words = [], set()
    for row in rows:
        own = set(row["t"].split())
        if block and (len(block) == BLOCK_ITEMS or len(words | own) > BLOCK_WORDS):
            yield block
            block, words = [], set()
        block.append(row)
        words |= own
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer`` of each document and item that it holds."""
    spark = docs.sparkSession
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.lower(text_col).alias("text"))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.lower(text_col).alias("text"))
    names, item_type = [id_col, "item_id", "cosine", "lcs", "answer"], benchmark.schema[item_col].dataType
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, cosine double, lcs double, answer double"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        buf, offs = K.flat(pa.array([r[1] for r in block]))
        w = K.Words(buf, offs)
        h = w.hashes(lower=True)
        full = [k for k in range(len(block)) if w.first[k + 1] > w.first[k]]
        if not full:
            continue
        vocab = Vocabulary(h)
        size = len(vocab.keys)

        def frequencies(total, buf, offs, vocab=vocab, size=size):
            _, hashes, of_word, text, _ = half_windows(buf, offs)
            at, word = vocab.find(hashes)
            code = np.unique(of_word[at] * size + word)
            total[:size, 0] += np.bincount(code % size, minlength=size)
            total[size, 0] += len(text)

        df = summed(texts, frequencies, (size + 1, 1))[:, 0]
        n = max(df[size], 1)
        number = np.searchsorted(vocab.keys, h)
        weight = meaningful(df[:size], n, number, w.first)
        k = min(rank, size)
        omega = np.random.default_rng(5).standard_normal((size, k))
        share = (omega * weight[:, None]).astype(np.float32)

        def products(total, buf, offs, vocab=vocab, weight=weight, share=share):
            _, hashes, of_word, text, _ = half_windows(buf, offs)
            at, word = vocab.find(hashes)
            keep = weight[word] > 0
            at, word = at[keep], word[keep]
            if not len(at):
                return
            passage = of_word[at]
            cut = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            y = np.add.reduceat(share[word], cut)
            local = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(passage))))
            o = np.argsort(word.astype(np.uint16) if len(weight) < 1 << 16 else word, kind="stable")
            sw = word[o]
            cut = np.flatnonzero(np.append(True, sw[1:] != sw[:-1]))
            total[sw[cut]] += np.add.reduceat(y[local[o]], cut) * weight[sw[cut], None]

        vectors = right_vectors(summed(texts, products, (size, k)), omega)
        spans = [(k, w.first[i] + a, w.first[i] + b) for k, i in enumerate(full) for a, b in pieces(int(w.first[i + 1] - w.first[i]))]
        q = np.stack([(vectors[number[a:b]] * weight[number[a:b], None]).sum(0) for _, a, b in spans])
        q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        items = [Item(h[w.first[i] : w.first[i + 1]].tolist()) for i in full]
        span = np.repeat(np.arange(len(spans)), [b - a for _, a, b in spans])
        words = np.concatenate([number[a:b] for _, a, b in spans])
        code = np.unique(words * len(spans) + span)
        code = code[weight[code // len(spans)] > 0]
        lists = np.searchsorted(code // len(spans), np.arange(size + 1)), code % len(spans)
        ids = pa.array([block[i][0] for i in full], to_arrow_type(item_type))
        found = rows.mapInArrow(_scorer(vocab, weight, vectors, q, items, ids, lists, np.array([k for k, _, _ in spans]), names), schema)
        out = out.unionByName(found)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
