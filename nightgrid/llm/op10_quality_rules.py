"""Quality rules: document statistics and a learned decision list, as Spark expressions only.

The list is learned by sequential covering: a rule is a conjunction of thresholds that is grown on two thirds of the
labelled rows by information gain and pruned on the rest; a rule counts only if it is precise there. Learning sees a
bounded sample of labelled rows (``MAX_TRAIN``, those with the smallest keyed hash); what is learned is an ordered
CASE expression that runs inside the scan.

Defined results: null and empty texts have 0 words and fail the base rule; a null id stays null; label rows that are null or
contradict one another count as they are, rows without a document are ignored; without labels the list is empty and the
base rule decides alone; equal values on both sides of a threshold go one way, and of rules with equal gain the first in the order of FEATURES
is taken; a very long text is one row of arrays as long as its words; other columns pass through unchanged, but for
input columns whose names start with ``_qr_``, which are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: Labelled rows that learning may see.
MAX_TRAIN = 20_000
MIN_PRECISION = 0.9
MAX_CONDITIONS = 3
MAX_RULES = 12
THRESHOLDS = 32
SEED = 17
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines"]
#: What rules may test: ratios that do not grow with the text, by name.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
    "digit_share": "n_digits / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
}
_WS = r"[\\x20\\x09-\\x0D]+"
#: Names that start so are this operator's own.
_P = "_qr_"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct ``_qr_stats`` of STATS (all long)."""
    cols = [x for x in docs.columns if not x.startswith(_P)]
    c = lambda *more: [F.col(f"`{x}`") for x in cols] + list(more)
    e = F.expr
    df = docs.select(*c(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(_P + "t")))
    df = df.select(*c(e(_P + "t"), e(f"filter(split({_P}t, '{_WS}'), w -> w <> '') AS {_P}w"), e(f"filter(split({_P}t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS {_P}l")))
    gram = ", ".join(f"get({_P}w, i + {k})" for k in range(5))
    df = df.select(*c(e(_P + "t"), e(_P + "w"), e(_P + "l"), e(f"CASE WHEN size({_P}w) >= 5 THEN transform(sequence(0, size({_P}w) - 5), i -> xxhash64({gram})) ELSE cast(array() AS array<bigint>) END AS {_P}g")))
    # windows found twice, as sorted (hash, position): equal neighbours
    df = df.select(*c(e(_P + "t"), e(_P + "w"), e(_P + "l"), e(f"CASE WHEN size(array_distinct({_P}g)) < size({_P}g) THEN sort_array(transform({_P}g, (g, i) -> struct(g AS g, i AS i))) END AS {_P}s")))
    df = df.select(
        *c(e(_P + "t"), e(_P + "w"), e(_P + "l")),
        e(f"sort_array(transform(filter(transform({_P}s, (x, i) -> CASE WHEN x.g = get({_P}s, i - 1).g OR x.g = get({_P}s, i + 1).g THEN x.i END), p -> p IS NOT NULL), p -> p)) AS {_P}p"),
    )
    stats = [
        f"cast(size({_P}w) AS bigint) AS n_words",
        f"cast(length(array_join({_P}w, '')) AS bigint) AS word_chars",
        f"cast(regexp_count({_P}t, '[#*$%&|<>]') AS bigint) AS n_symbols",
        f"cast(size({_P}l) - size(array_distinct({_P}l)) AS bigint) AS n_dup_lines",
        f"coalesce(aggregate(transform({_P}p, (p, i) -> least(5, coalesce(get({_P}p, i + 1), p + 5) - p)), 0L, (a, x) -> a + x), 0L) AS n_repeat_words",
        f"cast(regexp_count({_P}t, '\\\\p{{Lu}}') AS bigint) AS n_upper",
        f"cast(regexp_count({_P}t, '[!?]') AS bigint) AS n_marks",
        f"cast(regexp_count({_P}t, '[0-9]') AS bigint) AS n_digits",
        f"cast(size({_P}l) AS bigint) AS n_lines",
    ]
    # explode() of one struct keeps filters on the statistics from being pushed into, and so repeated in, the expressions above
    return df.select(*c(F.explode(F.array(e(f"struct({', '.join(stats)})"))).alias(_P + "stats")))


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<="
    value: float

    def column(self, features: dict[str, Column]) -> Column:
        x = features[self.feature]
        return x >= self.value if self.op == ">=" else x <= self.value


Rule = tuple[Condition, ...]


def learn_list(rows: list[tuple[list[float], bool, bool]], names: list[str], min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Ordered reject rules from (features, is_bad, for_growing) rows; row sets are bits of Python integers."""
    from math import log2

    if not rows:
        return []
    full = (1 << len(rows)) - 1
    bad = sum(1 << i for i, r in enumerate(rows) if r[1])
    grow = sum(1 << i for i, r in enumerate(rows) if r[2])
    conditions: list[tuple[Condition, int]] = []
    for k, name in enumerate(names):
        order = sorted(range(len(rows)), key=lambda i: rows[i][0][k])
        values = [rows[i][0][k] for i in order]
        mids = set()
        for cls in (True, False):  # quantiles of either class, so that rare bad rows get thresholds of their own
            own = [rows[i][0][k] for i in order if rows[i][1] == cls]
            for q in range(1, THRESHOLDS):
                if own:
                    mids.add(own[min(len(own) - 1, q * len(own) // THRESHOLDS)])
            mids |= set(own[:1] + own[-1:])
        mask, at = 0, 0
        for v in sorted(mids):
            while at < len(order) and values[at] < v:
                mask |= 1 << order[at]
                at += 1
            conditions.append((Condition(name, ">=", v), full & ~mask))
            upto, j = mask, at
            while j < len(order) and values[j] <= v:
                upto |= 1 << order[j]
                j += 1
            conditions.append((Condition(name, "<=", v), upto))

    def count(rows_: int) -> tuple[int, int]:
        return (rows_ & bad).bit_count(), (rows_ & ~bad).bit_count()

    rules: list[Rule] = []
    left = full
    while len(rules) < MAX_RULES:
        cover, rule = left & grow, []
        p0, n0 = count(cover)
        if not p0:
            break
        while n0 and len(rule) < MAX_CONDITIONS:
            best = (0.0, None, 0)
            for cond, mask in conditions:
                p, n = count(cover & mask)
                if p:
                    gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                    if gain > best[0]:
                        best = (gain, cond, mask)
            if best[1] is None:
                break
            rule.append((best[1], best[2]))
            cover &= best[2]
            p0, n0 = count(cover)
        # prune from the end on the rows kept for it
        options = []
        for keep in range(1, len(rule) + 1):
            hit = left & ~grow
            for _, mask in rule[:keep]:
                hit &= mask
            p, n = count(hit)
            options.append(((p - n) / (p + n) if p + n else -1.0, -keep, keep, p, n))
        if not options:
            break
        _, _, keep, p, n = max(options)
        hit = left
        for _, mask in rule[:keep]:
            hit &= mask
        tp, tn = count(hit)
        if not p or p < min_precision * (p + n) or tp < min_precision * (tp + tn):
            break
        rules.append(tuple(c for c, _ in rule[:keep]))
        left &= ~hit
    return rules


def _features(stats: str) -> dict[str, Column]:
    out = {}
    for name, ratio in FEATURES.items():
        a, b = ratio.split(" / ")
        out[name] = F.coalesce(F.try_divide(F.col(f"{stats}.{a}").cast("double"), F.col(f"{stats}.{b}")), F.lit(0.0))
    return out


def base_failed(stats: str) -> Column:
    return (F.col(f"{stats}.n_words") < 10) | (100 * F.col(f"{stats}.n_repeat_words") > 20 * F.col(f"{stats}.n_words"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> list[Rule]:
    """Rules from at most ``max_train`` labelled documents (label 0: bad)."""
    key = F.xxhash64(F.col(id_col), F.lit(SEED))
    picked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 0).alias("bad"), key.alias("key"))
    n = picked.count()
    share, every = 2.0 * max_train, picked  # only keys that can be among the smallest go to the sort: twice as many as wanted at first
    while share < n:
        picked = every.filter(F.col("key") <= int(-(1 << 63) + (1 << 64) * (share / n)))
        if picked.count() >= max_train:
            break
        share, picked = 4 * share, every  # few ids hold most labels
    picked = picked.orderBy("key", "id", "bad").limit(max_train)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # max_train rows at most
    f = _features("_qr_stats")
    seen = with_statistics(own).filter(~base_failed("_qr_stats")).select(F.array(*f.values()).alias("x"), "bad", (F.pmod("key", F.lit(3)) > 0).alias("grow"), "key", F.xxhash64("text").alias("h"))
    rows = seen.orderBy("key", "h", "bad").limit(max_train).collect()  # more only where document ids repeat
    return learn_list([(r[0], r[1], r[2]) for r in rows], list(f))


def list_verdict(rules: list[Rule], stats: str = "_qr_stats") -> Column:
    """The decision list as one CASE: False where a rule rejects."""
    f = _features(stats)
    out = None
    for rule in rules:
        test = F.lit(True)
        for cond in rule:
            test = test & cond.column(f)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``_qr_stats`` and booleans ``_qr_base_failed`` and ``_qr_kept``."""
    df = with_statistics(docs, text_col)
    failed = base_failed("_qr_stats")
    return df.withColumns({"_qr_base_failed": failed, "_qr_kept": ~failed & list_verdict(rules)})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, read_table(spark, sf_dir, "labels"))
    s = lambda n: F.col("_qr_stats." + n)
    return judge(docs, rules).select(
        "doc_id", s("n_words"), s("word_chars"), s("n_symbols"), s("n_dup_lines"), s("n_repeat_words"), F.col("_qr_base_failed").alias("base_failed"), F.col("_qr_kept").alias("kept")
    )
