"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates: of the word after its last two tokens, after its last one, by itself, and a
uniform share of all known words and one unknown. How they are mixed depends on the context's frequency: a *bucket* is the longest context that was
seen and the power of two of its count. The weights of each bucket are learned by expectation-maximisation on held-out counts: a part of the training documents
(``TUNE_PERCENT``) is deleted from the counts and predicted by the rest. Scores use the counts of all training documents.

1. *Blocks.* Each task turns its documents into blocks of about ``BLOCK_TOKENS`` tokens: 64-bit hashes of the words and their numbers, packed, in a table.
2. *Counts with an answer.* For each order, a block asks for its different n-grams, a row for each shard of the hashes, and says how often it has them in training
   documents. A shard (about ``SHARD_KEYS`` n-grams) adds up what the blocks say and answers each block. A frequent n-gram is one entry a block, so no shard is hot. What is shuffled is
   one order at a time, so disk holds one order's n-grams at most.
3. *Weights.* Held-out positions become rows of counts, equal ones one row with a number; each round of the maximisation is one aggregation over that table
   and gives some 100 buckets with four sums.
4. *Scores.* Blocks meet their answers and add up each document's logarithms.

Nothing is left out at any size: counts, held-out counts and scores cover all documents, and all grow with them.

Defined results: null texts are empty; an empty text has one token, the end; without a training document all counts are zero, the base score is that of
one unknown word and the weights are even; ids may be null (they are training documents) or repeat; a text of any length is scored as a whole; an empty table gives an empty one;
columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import materialise, read_table

ORDER = 3
BLOCK_TOKENS, SHARD_KEYS = 1 << 18, 1 << 20
#: Tokens whose scores are worked out at once.
SCORE_TOKENS = 1 << 16
#: Training documents in a hundred whose counts are held out to learn the weights.
TUNE_PERCENT, TUNE_SEED = 10, 11
EM_ROUNDS = 12
#: Share of a bucket's weight that is spread evenly, so that no probability is zero.
EVEN = 1e-6
#: Powers of two of a context's count.
LEVELS = 32
START, END = np.uint64(0x5BD1E995A7C3F1E7), np.uint64(0x1B873593CC9E2D51)


def pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all their lowest bytes first: the high ones are nearly all zero and compress away."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def grams(word: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n up to ``order``; before a document's first token stands ``START`` alone.

    ``word`` has a ``START`` at each of ``starts``. The context of an n-gram is the (n-1)-gram that ends one token before.
    """
    out = [word]
    for n in range(2, order + 1):
        before = np.empty_like(word)
        before[1:] = out[-1][:-1]
        before[:1] = 0
        g = K.mix64(before * K.U(K.MULT_A) + word * K.U(K.MULT_B) + K.U(n))
        g[starts] = START
        out.append(g)
    return out


def _blocks(block_tokens: int):
    """Texts (id, role, text) -> blocks of documents as numbered tokens."""
    names = ["block", "ids", "role", "n", "vocabulary", "tokens", "size", "train", "tune"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        made, held, size = 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal made
            ids, role, n, word = (pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)))
            vocabulary, tokens = np.unique(word, return_inverse=True)
            sums = [int(n[role == r].sum()) for r in (0, 1)]
            one = pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids)
            cols = [pa.array([base | made]), one, *(pa.array([x], pa.binary()) for x in (pack(role.astype("<i1")), pack(n.astype("<i8")), pack_sorted(vocabulary), pack(tokens.astype("<u4")))), pa.array([len(word)]), pa.array([sum(sums)]), pa.array(sums[1:])]
            made += 1
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            role = b.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            for i, j, buf, offs in K.slices(b.column(2)):
                w = K.Words(buf, offs)
                n = np.diff(w.first) + 1
                word = np.insert(w.hashes(True), w.first[1:], END)
                held.append((b.column(0).slice(i, j - i), role[i:j], n, word))
                size += len(word)
                if size >= block_tokens:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


class Block:
    """A block's documents: roles (0 train, 1 train and held out for the weights, 2 scored only), tokens, and n-grams by order."""

    def __init__(self, role: bytes, n: bytes, vocabulary: bytes, tokens: bytes, order: int):
        self.role, self.n = unpack(role, "<i1"), unpack(n, "<i8")
        first = np.cumsum(self.n) - self.n
        word = np.insert(unpack_sorted(vocabulary)[unpack(tokens, "<u4")], first, START)
        self.starts = first + np.arange(len(first))
        self.grams = grams(word, self.starts, order)
        self.role_at = np.repeat(self.role, self.n + 1)
        self.real = np.ones(len(word), bool)
        self.real[self.starts] = False

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams, sorted, and which of them each position has."""
        return np.unique(self.grams[order - 1], return_inverse=True)


def _shard_cuts(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards (ranges of the hashes' upper half) that hold any of the sorted keys, and the cuts between them."""
    of = ((keys >> K.U(32)) * K.U(shards) >> K.U(32)).astype(np.int32)
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return of[cut], np.append(cut, len(keys))


def _ask(order: int, shards: int):
    names = ["shard", "block", "keys", "n", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *packed in zip(*(c.to_pylist() for c in b.columns)):
                x = Block(*packed, order)
                key, back = x.keys(order)
                n = np.bincount(back[x.role_at < 2], minlength=len(key)).astype("<u4")
                m = np.bincount(back[x.role_at == 1], minlength=len(key)).astype("<u4")
                shard, cut = _shard_cuts(key, shards)
                spans = list(zip(cut.tolist(), cut[1:].tolist()))
                cols = [pa.array(shard), pa.array(np.full(len(shard), block))]
                cols += [pa.array([f(v[s:e]) for s, e in spans], pa.binary()) for v, f in ((key, pack_sorted), (n, pack), (m, pack))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One shard: what the blocks say of each n-gram added up, to each block in its own order."""
    keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(back, weights=np.concatenate([unpack(x, "<u4") for x in table[c].to_pylist()]), minlength=len(key)).astype("<u8") for c in ("n", "m")]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).tolist()
    said = [[pack(v[back[s:e]]) for s, e in zip(cut, cut[1:])] for v in sums]
    known = np.zeros(len(keys), np.int64)
    known[0] = ((sums[0] > 0) & (key != START)).sum()
    return pa.table({"block": table["block"], "shard": table["shard"], "n": pa.array(said[0], pa.binary()), "m": pa.array(said[1], pa.binary()), "known": known})


def _positions(row: list, order: int, held_too: bool) -> tuple[Block, list[np.ndarray], list[np.ndarray]]:
    """A block with its answers: how often each position's n-gram is in training documents, and (``held_too``) in held-out ones, by order."""
    *packed, answers = row
    x = Block(*packed, order)
    n, m = [], []
    for k in range(1, order + 1):
        _, back = x.keys(k)
        own = sorted((a for a in answers if a["k"] == k), key=lambda a: a["shard"])
        for out, c in ((n, "n"), (m, "m"))[: 1 + held_too]:
            out.append(np.concatenate([unpack(a[c], "<u8") for a in own]).astype(np.int64)[back])
    x.grams = []
    return x, n, m


def _before(x: np.ndarray) -> np.ndarray:
    """The value one position earlier."""
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def _held_out_rows(order: int):
    """Blocks with answers -> counts without the held-out documents, at the held-out positions; equal ones are one row."""
    names = [f"{v}{k}" for k in range(1, order + 1) for v in ("x", "d")][2:]
    names = ["x1", *names, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                x, n, m = _positions(list(row), order, True)
                left = [u - v for u, v in zip(n, m)]
                at = np.flatnonzero(x.real & (x.role_at == 1))
                cols = [left[0][at]]
                for k in range(1, order):
                    cols += [left[k][at], _before(left[k - 1])[at]]
                if not len(at):
                    continue
                by = np.lexsort(cols)
                new = reduce(np.logical_or, [np.append(True, c[by][1:] != c[by][:-1]) for c in cols])
                first = np.flatnonzero(new)
                out = [pa.array(c[by][first]) for c in cols] + [pa.array(np.diff(np.append(first, len(by))))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run, ", ".join(f"{c} long" for c in names)


def bucket_of(contexts: list[np.ndarray]) -> np.ndarray:
    """Bucket by the counts of the contexts, shortest first: the longest that was seen and the power of two of its count."""
    out = np.zeros(len(contexts[0]) if contexts else 0, np.int64)
    for k, d in enumerate(contexts, 1):
        level = np.frexp(np.maximum(d, 1).astype(np.float64))[1] - 1
        out = np.where(d > 0, k * LEVELS + np.minimum(level, LEVELS - 1), out)
    return out


def _bucket_column(order: int) -> Column:
    out = F.lit(0)
    for k in range(1, order):
        d = F.col(f"d{k + 1}")
        level = F.least(F.length(F.bin(d)) - 1, F.lit(LEVELS - 1))  # binary digits
        out = F.when(d > 0, k * LEVELS + level).otherwise(out)
    return out.cast("int")


def even_weights(order: int) -> np.ndarray:
    """Per bucket the weights of order 0 to ``order``, even over the orders that its context allows."""
    w = np.zeros((order * LEVELS, order + 1))
    for k in range(order):
        w[k * LEVELS : (k + 1) * LEVELS, : k + 2] = 1 / (k + 2)
    return w


def learn_weights(tuning: DataFrame, order: int, train_tokens: int, known: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Expectation-maximisation on the held-out rows; each round is one aggregation. ``train_tokens`` are those without the held-out ones."""
    spark = tuning.sparkSession
    p = [F.lit(1 / (known + 1)), F.col("x1") / max(train_tokens, 1)] + [F.when(F.col(f"d{k}") > 0, F.col(f"x{k}") / F.col(f"d{k}")).otherwise(0.0) for k in range(2, order + 1)]
    rows = tuning.select(_bucket_column(order).alias("bucket"), "n", *(c.alias(f"p{k}") for k, c in enumerate(p)))
    rows = materialise(rows.groupBy("bucket", *(f"p{k}" for k in range(order + 1))).agg(F.sum("n").alias("n")), "tuning")
    w = even_weights(order)
    weights = ", ".join(f"w{k} double" for k in range(order + 1))
    for _ in range(rounds):
        # order * LEVELS rows, whatever the corpus
        table = spark.createDataFrame([(b, *map(float, w[b])) for b in range(len(w))], f"bucket int, {weights}")
        mix = reduce(lambda x, y: x + y, (F.col(f"w{k}") * F.col(f"p{k}") for k in range(order + 1)))
        share = rows.join(F.broadcast(table), "bucket").withColumn("each", F.col("n") / mix)
        sums = share.groupBy("bucket").agg(*(F.sum(F.col("each") * F.col(f"w{k}") * F.col(f"p{k}")).alias(f"s{k}") for k in range(order + 1))).collect()
        for r in sums:
            s = np.array([r[f"s{k}"] for k in range(order + 1)])
            w[r["bucket"]] = s / s.sum()
            allowed = r["bucket"] // LEVELS + 2
            w[r["bucket"], :allowed] = (1 - EVEN) * w[r["bucket"], :allowed] + EVEN / allowed
    return w


def _scores(order: int, weights: np.ndarray, train_tokens: int, known: int):
    names = ["id", "role", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                x, n, _ = _positions(list(row), order, False)
                ends = np.append(x.starts[1:], len(x.real))
                parts: list[list[np.ndarray]] = []
                d = 0
                while d < len(x.n):  # some documents at a time
                    to = max(d + 1, int(np.searchsorted(ends, x.starts[d] + SCORE_TOKENS, "right")))
                    parts.append(scored(x, n, int(x.starts[d]), int(ends[to - 1]), x.starts[d:to]))
                    d = to
                seen, base, score = (np.concatenate([p[c] for p in parts]) for c in range(3))
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1).flatten(), pa.array(x.role.astype(np.int32)), pa.array(x.n), *map(pa.array, (seen, base, score))], names=names)

    def scored(x: Block, n: list[np.ndarray], low: int, high: int, starts: np.ndarray) -> list[np.ndarray]:
        """Known tokens, base score and score of the documents between two positions."""
        own, real = [v[low:high] for v in n], x.real[low:high]
        contexts = [_before(v) for v in own[: order - 1]]
        w = weights[bucket_of(contexts) if contexts else np.zeros(high - low, np.int64)]
        p = w[:, 0] / (known + 1) + w[:, 1] * own[0] / max(train_tokens, 1)
        for k, d in enumerate(contexts, 2):
            p += w[:, k] * own[k - 1] / np.maximum(d, 1)
        logs = [np.log10((own[0] + 1) / (train_tokens + known + 1)), np.log10(p)]
        at = starts - low
        return [np.add.reduceat(((own[0] > 0) & real).astype(np.int64), at), *(np.add.reduceat(np.where(real, v, 0.0), at) for v in logs)]

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(
    docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, shard_keys: int = SHARD_KEYS, tune_percent: int = TUNE_PERCENT, rounds: int = EM_ROUNDS
) -> DataFrame:
    """Id, ``held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; learned from the rows that are not ``held``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tune = F.pmod(F.xxhash64(F.lit(TUNE_SEED), F.col(id_col), F.col(text_col)), F.lit(100)) < tune_percent
    role = F.when(held, 2).when(tune, 1).otherwise(0)
    src = docs.select(F.col(id_col).alias("id"), role.alias("role"), F.col(text_col).alias("text"))
    blocks = src.mapInArrow(_blocks(block_tokens), f"block long, ids array<{kind}>, role binary, n binary, vocabulary binary, tokens binary, size long, train long, tune long")
    blocks = materialise(blocks, "blocks")
    size = blocks.agg(F.sum("size").alias("all"), F.sum("train").alias("train"), F.sum("tune").alias("tune")).first()
    train_tokens, tune_tokens = size["train"] or 0, size["tune"] or 0
    # one shard a partition at least; a block names an n-gram once, so shards cannot hold more than all tokens
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["all"] or 0) // shard_keys))
    asked = blocks.select("block", "role", "n", "vocabulary", "tokens")
    answers = []
    for k in range(1, order + 1):
        said = asked.mapInArrow(_ask(k, shards), "shard int, block long, keys binary, n binary, m binary").groupBy("shard").applyInArrow(_answer, "block long, shard int, n binary, m binary, known long")
        answers.append(materialise(said, f"answers{k}"))
    known = answers[0].agg(F.sum("known")).first()[0] or 0
    every = reduce(DataFrame.unionByName, (a.select("block", F.struct(F.lit(k).alias("k"), "shard", "n", "m").alias("a")) for k, a in enumerate(answers, 1)))
    counted = blocks.join(every.groupBy("block").agg(F.collect_list("a").alias("a")), "block")
    run, fields = _held_out_rows(order)
    tuning = counted.filter("tune > 0").select("role", "n", "vocabulary", "tokens", "a").mapInArrow(run, fields)
    weights = learn_weights(tuning, order, train_tokens - tune_tokens, known, rounds) if tune_tokens else even_weights(order)
    out = counted.select("ids", "role", "n", "vocabulary", "tokens", "a").mapInArrow(_scores(order, weights, train_tokens, known), f"id {kind}, role int, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), (F.col("role") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; the fold that is not learned from is marked."""
    return score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), held_out())
