"""Language identification by interpolated Kneser-Ney character models.

One four-gram model per language. N-gram counts come from a bounded sample of labelled documents (``MAX_DOCS`` a language, those with the
smallest keyed hash; fewer where the languages are so many that ``MAX_SAMPLE`` is reached); every language is learned; the models are sorted arrays of n-gram keys with log probabilities, so a text is scored by binary search. The language with
the lowest cross-entropy per character wins. Rejection is calibrated: a prediction is marked ``rejected`` if its cross-entropy is above what
all but ``REJECT_SHARE`` of the language's own calibration documents (a fifth of the sample, not trained on) have.

Letters are lower-cased and numbered by frequency (all but the rarest of some 4,000 have a number of their own, so scripts with many
letters keep them); anything that is not a letter is one boundary symbol, however long the run.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled document every text is; ids may
be null or repeat; of languages with equal cross-entropy the first by name wins; a text of any length is scored whole; language, source and id are never inputs of a prediction; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .shared import materialise, read_table

#: Documents of a language that its model may learn from, calibration included.
MAX_DOCS = 1500
#: Documents of all languages together; more languages share it evenly, each has one at least.
MAX_SAMPLE = 64 * MAX_DOCS
#: Languages that are scored at once.
SCORED = 64
REJECT_SHARE = 0.002
#: Characters that count at most towards the score's sharpness.
SHARP_CHARS = 60
#: Bits of a letter's number in an n-gram key, letters with a number of their own, all numbers.
BITS, N_FREQUENT, N_SYMBOLS = 12, 3967, 4096
SEED = 7


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case letter of each code point, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters (0: boundary) of a run of texts, each led by one boundary, and the n+1 starts of the texts."""
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    at = lead[offs]
    low = _folded()[chars]
    low = np.insert(low, at[:-1], 0)
    at = at + np.arange(len(at))
    at[-1] = len(low)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    keep[at[:-1]] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[at]


class Model:
    """Symbols, and per order sorted keys with log2 probabilities (rows) per language."""

    def __init__(self, langs: list[str], frequent: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.frequent = np.sort(frequent)
        tables = [self._train(keys, n) for keys, n in counts]
        self.keys, self.logp = [], []
        for order in range(3, -1, -1):
            keys = np.unique(np.concatenate([t[order][0] for t in tables]))
            p = np.stack([self._prob(t, order, keys) for t in tables], 1)
            self.keys.append(keys)
            self.logp.append(np.log2(p).astype(np.float32))
        self.tables = tables
        self.limit = np.full(len(langs), np.inf)

    @staticmethod
    def _train(keys: np.ndarray, n: np.ndarray):
        """Per order 0-3: n-gram keys, discounted shares, and contexts with their back-off weights."""
        out = []
        for order in range(3, -1, -1):
            context = keys >> BITS
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx, inv = np.unique(context, return_inverse=True)
            total = np.bincount(inv, weights=n)
            kinds = np.bincount(inv)
            out.append((keys, np.maximum(n - d, 0) / total[inv], ctx, d * kinds / total))
            keys, n = np.unique(keys & ((1 << (BITS * order)) - 1), return_counts=True)  # in how many contexts it goes on
        return out[::-1]

    @classmethod
    def _prob(cls, t, order: int, keys: np.ndarray) -> np.ndarray:
        """Interpolated probability of each key's last symbol after its context."""
        low = cls._prob(t, order - 1, keys & ((1 << (BITS * order)) - 1)) if order else np.full(len(keys), 1 / N_SYMBOLS)
        own, share, ctx, back = t[order]

        def find(table, values, x, missing):
            at = np.minimum(np.searchsorted(table, x), len(table) - 1)
            return np.where(table[at] == x, values[at], missing)

        return find(own, share, keys, 0.0) + find(ctx, back, keys >> BITS, 1.0) * low

    def symbols(self, low: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.frequent, low), len(self.frequent) - 1)
        rest = N_FREQUENT + 1 + (low >> 7) % (N_SYMBOLS - N_FREQUENT - 1)
        return np.where(low == 0, 0, np.where(self.frequent[at] == low, at + 1, rest)).astype(np.int64)

    def grams(self, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Four-gram keys that end at each letter; what lies before a text is boundary."""
        s = self.symbols(low)
        key = s.copy()
        inside = np.arange(len(s)) - np.repeat(starts[:-1], np.diff(starts))
        for back in range(1, 4):
            shifted = np.zeros_like(s)
            shifted[back:] = s[:-back] if len(s) > back else 0
            shifted[inside < back] = 0
            key |= shifted << (BITS * back)
        return key

    def score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters scored, bits per character and language) of each text."""
        low, starts = letters(buf, offs)
        key = self.grams(low, starts)
        key[starts[:-1]] = 0
        at = np.minimum(np.searchsorted(self.keys[0], key), len(self.keys[0]) - 1)
        miss = np.flatnonzero(self.keys[0][at] != key)
        unseen, inv = np.unique(key[miss], return_inverse=True)
        n = np.diff(starts) - 1
        has = np.add.reduceat((low != 0).astype(np.int64), starts[:-1])
        bits = []
        for lo in range(0, len(self.langs), SCORED):
            logp = self.logp[0][:, lo : lo + SCORED][at]
            if len(miss):
                logp[miss] = np.log2(np.stack([self._prob(t, 3, unseen) for t in self.tables[lo : lo + SCORED]], 1)).astype(np.float32)[inv]
            logp[starts[:-1]] = 0  # the leading boundary is given
            bits.append(-np.add.reduceat(logp, starts[:-1], axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None])
        return np.where(has > 0, n, 0), np.concatenate(bits, 1)


def _gram_counts(model_symbols, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(0).cast(pa.int32()).to_numpy()
            for i, j, buf, offs in K.slices(b.column(1)):
                low, starts = letters(buf, offs)
                key = model_symbols(frequent, low, starts)
                first = np.zeros(len(key), bool)
                first[starts[:-1]] = True
                code = (np.repeat(lang[i:j], np.diff(starts)).astype(np.int64) << (4 * BITS) | key)[~first]
                u, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((u >> (4 * BITS)).astype(np.int32)), pa.array(u & ((1 << (4 * BITS)) - 1)), pa.array(n)], names=["lang", "key", "n"])

    return run


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, buf, offs in K.slices(b.column(1)):
            u, n = np.unique(letters(buf, offs)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], names=["letter", "n"])


def _keys_of(frequent: np.ndarray, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    shell = Model.__new__(Model)
    shell.frequent = frequent
    return shell.grams(low, starts)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model | None:
    """Models from documents that are not held out and have a language and a text."""
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    held = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())  # one row a language
    if not held:
        return None
    langs = [g for g, _ in held]
    share = max(1, min(max_docs, MAX_SAMPLE // len(langs)))
    # hashes up to a bound by the language's size: twice as many rows as wanted and some, whatever the language holds
    bound = lambda n: (1 << 63) - 1 if n <= 2 * share + 64 else int(-(1 << 63) + (1 << 64) * ((2 * share + 64) / n))
    tops = docs.sparkSession.createDataFrame([(g, k, bound(n)) for k, (g, n) in enumerate(held)], "lang string, number int, top long")
    # one row a language, as the models that every task gets: broadcast, so that only rows under the bound are shuffled with their texts
    near = known.join(F.broadcast(tops), "lang").filter("h <= top").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    # every fifth is for calibration; a language's first one never is
    sample = materialise(near.filter(F.col("r") <= share).select(F.col("number").alias("lang"), "text", (F.col("r") % 5 == 0).alias("calibrate")), "sample")
    fit = sample.filter("NOT calibrate").select("lang", "text")
    counts = fit.mapInArrow(_letter_counts, "letter long, n long").filter("letter > 0").groupBy("letter").agg(F.sum("n").alias("n"))
    frequent = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "letter").limit(N_FREQUENT).collect()] or [1], np.int64)).astype(np.uint32)
    grams = fit.mapInArrow(_gram_counts(_keys_of, frequent), "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, key, n = (grams.column(k).to_numpy() for k in range(3))
    order = np.lexsort((key, lang))
    lang, key, n = lang[order], key[order], n[order].astype(np.float64)
    cut = np.searchsorted(lang, np.arange(len(langs) + 1))
    own = [k for k in range(len(langs)) if cut[k] < cut[k + 1]]
    if not own:
        return None
    model = Model([langs[k] for k in own], frequent, [(key[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]) for k in own])
    place = {k: i for i, k in enumerate(own)}

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who = b.column(0).cast(pa.int32()).to_numpy()
            for i, j, buf, offs in K.slices(b.column(1)):
                chars, bits = model.score(buf, offs)
                ok = np.array([w in place for w in who[i:j]]) & (chars >= 20)
                yield pa.RecordBatch.from_arrays([pa.array(who[i:j][ok]), pa.array(bits[np.flatnonzero(ok), [place[w] for w in who[i:j][ok]]])], names=["lang", "bits"])

    seen = sample.filter("calibrate").select("lang", "text").mapInArrow(entropies, "lang int, bits double").groupBy("lang").agg(F.percentile("bits", F.lit(1 - REJECT_SHARE)).alias("q"))
    for r in seen.collect():
        model.limit[place[r["lang"]]] = r["q"] * 1.05
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred``, ``score``, ``bits`` per character and ``rejected`` of each row."""
    names = ["id", "lang_pred", "score", "bits", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in K.slices(b.column(1)):
                m = j - i
                if model is None:
                    cols = [pa.array(["und"] * m), pa.array(np.zeros(m)), pa.array(np.zeros(m)), pa.array(np.ones(m, bool))]
                else:
                    chars, bits = model.score(buf, offs)
                    best = bits.argmin(1)
                    low = bits[np.arange(m), best]
                    share = np.exp2(-(bits - low[:, None]) * np.minimum(chars, SHARP_CHARS)[:, None])
                    some = chars > 0
                    pred = np.where(some, np.array(model.langs, object)[best], "und")
                    cols = [pa.array(pred.tolist()), pa.array(np.where(some, 1 / share.sum(1), 0.0)), pa.array(np.where(some, low, 0.0)), pa.array(~some | (low > model.limit[best]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), *cols], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
