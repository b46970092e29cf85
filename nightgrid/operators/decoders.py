"""Sequence decoders. Learning is counting (aggregates); decoding walks one night at a time in grouped Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-6


def transition_counts(df: DataFrame, label: str, order: str, n_states: int, keys: tuple[str, ...] = ("subject_id",), prior: float = 1.0) -> DataFrame:
    """``state, next_state, n, p`` with ``prior`` added to every pair; rows of ``p`` sum to 1."""
    spark = df.sparkSession
    nxt = F.lead(label).over(Window.partitionBy(*keys).orderBy(order))
    pairs = df.withColumn("next_state", nxt).filter("next_state IS NOT NULL").groupBy(F.col(label).alias("state"), "next_state").agg(F.count("*").alias("n"))
    spine = spark.createDataFrame([(a, b) for a in range(n_states) for b in range(n_states)], "state int, next_state int")
    x = spine.join(pairs, ["state", "next_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("p", (F.col("n") + prior) / F.sum(F.col("n") + prior).over(Window.partitionBy("state")))


def initial_shares(df: DataFrame, label: str, order: str, n_states: int, keys: tuple[str, ...] = ("subject_id",), prior: float = 1.0) -> DataFrame:
    """Shares of first labels, with the prior."""
    spark = df.sparkSession
    first = df.groupBy(*keys).agg(F.min_by(label, order).alias("state")).groupBy("state").agg(F.count("*").alias("n"))
    x = spark.range(n_states).select(F.col("id").cast("int").alias("state")).join(first, "state", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("p", (F.col("n") + prior) / F.sum(F.col("n") + prior).over(Window.partitionBy()))


def emission_counts(df: DataFrame, label: str, obs: str, n_states: int, prior: float = 1.0) -> DataFrame:
    """``state, obs, n, p`` of every pair, seen or not, with ``prior`` added."""
    pairs = df.filter(F.col(label).isNotNull() & F.col(obs).isNotNull()).groupBy(F.col(label).alias("state"), F.col(obs).alias("obs")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(a, b) for a in range(n_states) for b in range(n_states)], "state int, obs int")
    n = F.coalesce("n", F.lit(0)) + F.lit(prior)
    x = spine.join(pairs, ["state", "obs"], "left").withColumn("n", n.cast("long") if float(prior).is_integer() else n)
    return x.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def change_counts(df: DataFrame, label: str, order: str, n_states: int, keys: tuple[str, ...] = ("subject_id",), prior: float = 1.0) -> DataFrame:
    """As ``transition_counts`` over changes only; a state never follows itself."""
    x = transition_counts(df, label, order, n_states, keys, prior).filter("state <> next_state")
    return x.withColumn("p", (F.col("n") + prior) / F.sum(F.col("n") + prior).over(Window.partitionBy("state")))


def matrix(counts: DataFrame, n_states: int, to: str = "next_state") -> np.ndarray:
    """The small transition table on the driver."""
    m = np.zeros((n_states, n_states))
    for r in counts.collect():
        m[r["state"], r[to]] = r["p"]
    return m


def forward_backward(probs: np.ndarray, trans: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """D3: smoothed state probabilities of one night from per-row class probabilities."""
    p = np.asarray(probs, float) + EPS
    n, k = p.shape
    a, b = np.empty((n, k)), np.ones((n, k))
    a[0] = initial * p[0]
    a[0] /= a[0].sum()
    for t in range(1, n):
        a[t] = (a[t - 1] @ trans) * p[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = trans @ (p[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    g = a * b
    return g / g.sum(1, keepdims=True)


def viterbi(obs: list[int], trans: np.ndarray, emission: np.ndarray) -> list[int]:
    """Most likely states, without an initial term; an observation that was never seen counts as the most frequent one."""
    modal = int(emission.sum(0).argmax())
    o = [x if 0 <= x < emission.shape[1] else modal for x in obs]
    lt, le = np.log(trans), np.log(emission)
    cost, back = le[:, o[0]], []
    for x in o[1:]:
        m = cost[:, None] + lt
        back.append(m.argmax(0))
        cost = m.max(0) + le[:, x]
    s = [int(cost.argmax())]
    for frm in reversed(back):
        s.append(int(frm[s[-1]]))
    return s[::-1]


def learn_hsmm(run_df: DataFrame, label: str = "label", length: str = "length") -> DataFrame:
    """Mean run length of each label (at least 1), the Poisson rate of its durations, and the longest run."""
    return run_df.groupBy(label).agg(F.greatest(F.avg(length), F.lit(1.0)).alias("rate"), F.max(length).alias("longest"), F.count("*").alias("runs"))


def hsmm_viterbi(logp: np.ndarray, trans: np.ndarray, rates: np.ndarray, d_max: int) -> list[int]:
    """Segments with explicit Poisson durations (not renormalised) and no return to the same state."""
    n, k = logp.shape
    lt = np.log(np.maximum(trans, 1e-300))
    np.fill_diagonal(lt, -np.inf)
    dur = np.array([[d * math.log(r) - r - math.lgamma(d + 1) for d in range(1, d_max + 1)] for r in rates])
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(logp, 0)])
    best, frm = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k, 2), int)
    for t in range(1, n + 1):
        for d in range(1, min(d_max, t) + 1):
            seg = sums[t] - sums[t - d] + dur[:, d - 1]
            if t == d:
                score, prev = seg, np.full(k, -1)
            else:
                m = best[t - d][:, None] + lt
                prev = m.argmax(0)
                score = m.max(0) + seg
            up = score > best[t]
            best[t][up] = score[up]
            frm[t][up] = np.stack([prev, np.full(k, d)], 1)[up]
    out, t, s = [0] * n, n, int(best[n].argmax())
    while t > 0 and s >= 0:
        prev, d = frm[t][s]
        out[t - d : t] = [s] * d
        t, s = t - d, int(prev)
    return out


def smooth_nights(df: DataFrame, order: str, probs: str, trans: np.ndarray, initial: np.ndarray, key: str = "subject_id") -> DataFrame:
    """D3 over all nights: ``key, order, smoothed array, decoded int``."""
    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, smoothed array<double>, decoded int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        p = forward_backward(np.array(table.column(probs).to_pylist()), trans, initial)
        return pa.table({key: table.column(key), order: table.column(order), "smoothed": pa.array(p.tolist()), "decoded": pa.array(p.argmax(1).astype(np.int32))})

    return df.select(key, order, probs).groupBy(key).applyInArrow(run, kinds)


def decode_nights(df: DataFrame, order: str, obs: str, trans: np.ndarray, emission: np.ndarray, key: str = "subject_id") -> DataFrame:
    """D4 over all nights."""
    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, state int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        s = viterbi(table.column(obs).to_pylist(), trans, emission)
        return pa.table({key: table.column(key), order: table.column(order), "state": pa.array(s, pa.int32())})

    return df.select(key, order, obs).groupBy(key).applyInArrow(run, kinds)
