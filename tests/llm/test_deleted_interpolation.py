"""op11 against a plain model of dictionaries, with its weights learned by a plain expectation-maximisation."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.llm import op11_deleted_interpolation as op11

R = random.Random(11)
WORDS = ["".join(R.choice("abcdé") for _ in range(R.randint(1, 5))) for _ in range(60)]


def prose(n):
    out, k = [], 0
    for _ in range(n):
        k = (k * 7 + R.choice([1, 1, 1, 2, R.randrange(60)])) % 60
        out.append(WORDS[k].upper() if R.random() < 0.1 else WORDS[k])
    return " ".join(out)


ROWS = [(i, prose(R.randint(1, 60))) for i in range(150)]
ROWS += [(200, None), (201, ""), (202, " \t\n"), (203, "ÄÖ unseen\x0bwords é"), (204, prose(3000)), (205, "aa " * 400), (206, ROWS[0][1]), (7, ROWS[7][1]), (7, ROWS[7][1]), (7, "another text"), (None, "no id"), (None, None)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("id", "role", "n", "block", "score", "shard")})


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</end>"]


def roles(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tune = [r[0] for r in df.select(F.pmod(F.xxhash64(F.lit(op11.TUNE_SEED), "doc_id", "text"), F.lit(100)) < percent).collect()]
    return [2 if i is not None and zlib.crc32(str(i).encode()) % 7 == 2 else 1 if t else 0 for (i, _), t in zip(rows, tune)]


def plain(rows, role, order, rounds):
    """Rows of (id, held_out, n, known, N, base, score) from counts in dictionaries."""
    # what an n-gram is: the start stands once before the first token, and longer n-grams end there
    def ending(t, k, n):
        return tuple(t[max(k - n + 1, 0) : k + 1])

    texts = [["<start>", *tokens(t)] for _, t in rows]
    count = {full: [Counter() for _ in range(order)] for full in (True, False)}
    for t, r in zip(texts, role):
        for full in (True, False):
            if r == 0 or (full and r == 1):
                for n in range(1, order + 1):
                    for k in range(len(t)):
                        count[full][n - 1][(n, ending(t, k, n))] += 1
    total = {full: sum(len(t) - 1 for t, r in zip(texts, role) if r == 0 or (full and r == 1)) for full in (True, False)}
    v = len({w for t, r in zip(texts, role) if r < 2 for w in t[1:]})

    def shares(t, k, full):
        c = count[full]
        out, bucket = [1 / (v + 1), c[0][(1, ending(t, k, 1))] / max(total[full], 1)], 0
        for n in range(2, order + 1):
            context = c[n - 2][(n - 1, ending(t, k - 1, n - 1))]
            out.append(c[n - 1][(n, ending(t, k, n))] / context if context else 0.0)
            if context:
                bucket = (n - 1) * op11.LEVELS + int(math.log2(context))
        return bucket, out

    weights = defaultdict(lambda: None)

    def weight(b):
        if weights[b] is None:
            m = b // op11.LEVELS + 2
            weights[b] = [1 / m] * m + [0.0] * (order + 1 - m)
        return weights[b]

    held = Counter()
    for t, r in zip(texts, role):
        if r == 1:
            for k in range(1, len(t)):
                b, p = shares(t, k, False)
                held[(b, tuple(p))] += 1
    for _ in range(rounds):
        sums = defaultdict(lambda: [0.0] * (order + 1))
        for (b, p), n in held.items():
            w = weight(b)
            mix = sum(x * y for x, y in zip(w, p))
            for k in range(order + 1):
                sums[b][k] += n * w[k] * p[k] / mix
        for b, s in sums.items():
            m = b // op11.LEVELS + 2
            weights[b] = [(1 - op11.EVEN) * x / sum(s) + (op11.EVEN / m if k < m else 0) for k, x in enumerate(s)]
    out = []
    for (i, _), t, r in zip(rows, texts, role):
        score = base = known = 0
        for k in range(1, len(t)):
            b, p = shares(t, k, True)
            c = count[True][0][(1, ending(t, k, 1))]
            known += c > 0
            base += math.log10((c + 1) / (total[True] + v + 1))
            score += math.log10(sum(x * y for x, y in zip(weight(b), p)))
        out.append((i, r == 2, len(t) - 1, known, total[True], base, score))
    return out


def order_of(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r[:5]) + tuple(round(x, 4) for x in r[5:]))


@pytest.mark.parametrize("order,block,shard", [(3, op11.BLOCK_TOKENS, op11.SHARD_KEYS), (3, 300, 200), (2, 900, 50), (1, 900, 50), (4, 500, 1 << 21)])
def test_against_plain_model(spark, order, block, shard):
    role = roles(spark, ROWS, 20)
    assert {0, 1, 2} == set(role)
    out = op11.score_documents(frame(spark, ROWS), op11.held_out(), order=order, block_tokens=block, shard_keys=shard, tune_percent=20, rounds=5)
    got, want = order_of(tuple(r) for r in out.collect()), order_of(plain(ROWS, role, order, 5))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_weights_raise_the_held_out_likelihood(spark):
    role = roles(spark, ROWS, 20)
    held = F.col("doc_id").isin([i for (i, _), r in zip(ROWS, role) if r == 2])
    few = op11.score_documents(frame(spark, ROWS), F.coalesce(held, F.lit(False)), tune_percent=20, rounds=8)
    none = op11.score_documents(frame(spark, ROWS), F.coalesce(held, F.lit(False)), tune_percent=0)
    sums = [df.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first() for df in (few, none)]
    assert sums[0][0] > sums[1][0] and sums[0][0] > sums[0][1]


def test_without_training_documents_and_without_rows(spark):
    out = op11.score_documents(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted(tuple(r) for r in out) == [(1, True, 3, 0, 0, 0.0, pytest.approx(3 * math.log10(0.5)),), (2, True, 1, 0, 0, 0.0, pytest.approx(math.log10(0.5)))]
    assert op11.score_documents(frame(spark, []).limit(0), op11.held_out()).collect() == []
