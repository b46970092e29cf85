"""Mixing sources to target weights by hierarchical budgeting, as Spark expressions only.

A tree of domain, language and source carries weights. A token budget flows down it: a node never gets more than its
subtree can give in ``max_epochs`` passes, and what it cannot take goes to its siblings by weight, so a shortage leaves a
parent only when all of the parent's children are full. Sources weigh as the tokens they hold, so all sources of a language are
full at the same time and share its budget in proportion, rounded down. Each leaf then takes whole seeded epochs and, of the next epoch's
seeded order, the longest prefix within the rest of its tokens.

The prefix is found without sorting a leaf in one task: token sums per leaf and hash bucket give the bucket in which the
prefix ends, and only that bucket is ordered. The token sums of domains and languages are all that reaches the driver; the table of leaves
stays a table, and whether it is broadcast is Spark's decision by its size.

Defined results: null level values are the key "" ; keys without a weight get none and are left out; texts that are null or empty have 0 tokens
and are never selected; null ids are ordered by their text; rows with equal id and text stand side by side in the order, and where the prefix ends
among them as many get a copy more as still fit; so the tokens of all copies never exceed the budget. A document of any length is taken whole
or not at all. Other columns pass through (input columns named ``n_tokens`` or ``copies`` are replaced).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import free_name, materialise, read_table

SEED = 20
MAX_EPOCHS = 4
#: Hex digits of the seeded hash that name a bucket: 4096 buckets a leaf.
BUCKET_DIGITS = 3
LEVELS = ["domain", "lang", "source"]


@dataclass
class Node:
    """A tree node: its weight among its siblings, what it can give, and its children."""

    weight: float
    capacity: int = 0
    children: dict[str, "Node"] = field(default_factory=dict)
    budget: int = 0


#: Weights of the registered query and of the pipeline's last stage. "*" stands for keys that are not named; sources weigh as the tokens they hold.
WEIGHTS: Mapping[str, tuple[float, Mapping[str, float]]] = {
    "web": (0.34, {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.11, "*": 0.02}),
    "reference": (0.36, {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1, "*": 0.02}),
    "community": (0.30, {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1, "*": 0.02}),
}


def domain_of(source: str = "source") -> Column:
    """The domain of a source of the test tables: by its number."""
    n = F.try_to_number(F.regexp_extract(F.col(source), r"(\d{1,9})$", 1), F.lit("999999999")).cast("int")
    return F.when(n == 0, "web").when(n < 10, "reference").otherwise("community")


def share_out(budget: int, nodes: Mapping[str, Node]) -> dict[str, int]:
    """Water filling: shares by weight, none above its capacity; what full nodes cannot take goes to their siblings."""
    got = dict.fromkeys(nodes, 0)
    open_, left = {k: n for k, n in nodes.items() if n.weight > 0 and n.capacity > 0}, min(budget, sum(n.capacity for n in nodes.values() if n.weight > 0))
    while open_ and left > 0:
        total = sum(n.weight for n in open_.values())
        full = {k for k, n in open_.items() if left * n.weight / total >= n.capacity}
        if full:
            for k in sorted(full):
                got[k] = open_[k].capacity
                left -= got[k]
                del open_[k]
            continue
        shares = {k: int(left * n.weight / total) for k, n in open_.items()}
        for k in sorted(open_, key=lambda k: (shares[k] - left * open_[k].weight / total, k))[: left - sum(shares.values())]:
            shares[k] += 1
        got |= shares
        left = 0
    return got


def plan(held: Mapping[tuple[str, str], int], weights: Mapping, budget: int, max_epochs: int = MAX_EPOCHS) -> dict[tuple[str, str], int]:
    """Token budget of each domain and language, from the tokens that they hold."""
    root: dict[str, Node] = {}
    for (d, lang), tokens in sorted(held.items()):
        if d not in weights:
            continue
        w, langs = weights[d]
        top = root.setdefault(d, Node(w))
        top.children[lang] = Node(langs.get(lang, langs.get("*", 0.0)), tokens * max_epochs)
    for top in root.values():
        top.capacity = sum(n.capacity for n in top.children.values() if n.weight > 0)
    return {(d, lang): x for d, b in share_out(budget, root).items() for lang, x in share_out(b, root[d].children).items()}


def _seeded(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_mix_id"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: Mapping, budget_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, str, str] = ("domain", "lang", "source"), max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` that are selected, with ``n_tokens`` and ``copies`` (how many epochs they are in).

    ``budget_tokens`` defaults to all tokens that the documents hold.
    """
    spark = docs.sparkSession
    # columns that have names of this module's own go by others meanwhile
    own_names = [c for c in docs.columns if c.lower().startswith("_mix_")]
    if own_names:
        safe = {c: free_name(f"_own{k}", docs.columns) for k, c in enumerate(own_names)}
        new = lambda c: safe.get(c, c)
        out = mix(docs.withColumnsRenamed(safe), weights, budget_tokens, new(id_col), new(text_col), tuple(map(new, levels)), max_epochs, seed)
        return out.withColumnsRenamed({v: k for k, v in safe.items()})
    names = ["_mix_d", "_mix_l", "_mix_s"]
    tagged = docs.withColumns(
        {n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(names, levels)}
        | {
            "n_tokens": F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
            "_mix_id": F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")),
            "_mix_key": F.xxhash64(*[F.col(c) for c in (id_col, text_col, *levels)]),
        }
    )
    small = materialise(tagged.filter("n_tokens > 0").select(*names, "n_tokens", F.when(F.col(id_col).isNull(), F.md5(F.col("_mix_id").cast("binary"))).otherwise(F.col("_mix_id")).alias("_mix_id"), "_mix_key"), "tokens")
    leaves = materialise(small.groupBy(*names).agg(F.sum("n_tokens").alias("_mix_held")), "leaves")
    held = {(r[0], r[1]): r[2] for r in leaves.groupBy(*names[:2]).agg(F.sum("_mix_held")).collect()}  # domains x languages
    budgets = plan(held, weights, sum(held.values()) if budget_tokens is None else budget_tokens, max_epochs)
    parts = spark.createDataFrame([(*k, b // held[k], b % held[k], held[k]) for k, b in budgets.items() if b > 0], "_mix_d string, _mix_l string, _mix_q long, _mix_r long, _mix_all long")
    # budget of a leaf: held * budget / all = held * q + held * r / all, in numbers that a decimal holds exactly
    more = F.expr("cast(_mix_held AS decimal(19, 0)) * cast(_mix_r AS decimal(19, 0)) div cast(_mix_all AS decimal(19, 0))")
    leaf = leaves.join(parts, names[:2]).withColumn("_mix_more", more)
    leaf = leaf.select(*names, F.expr("_mix_q + _mix_more div _mix_held").alias("_mix_full"), F.expr("_mix_more % _mix_held").alias("_mix_rest")).filter("_mix_full + _mix_rest > 0")
    own = small.join(materialise(leaf, "budgets"), names)
    own = own.withColumn("_mix_h", _seeded(F.col("_mix_full"), seed)).withColumn("_mix_b", F.substring("_mix_h", 1, BUCKET_DIGITS))
    sums = own.filter("_mix_rest > 0").groupBy(*names, "_mix_b").agg(F.sum("n_tokens").alias("t"), F.first("_mix_rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*names).orderBy("_mix_b"))  # 4096 rows a leaf at most
    edge = sums.withColumn("upto", upto).filter("upto > rest").groupBy(*names).agg(F.min("_mix_b").alias("_mix_edge"), F.min_by(F.col("upto") - F.col("t"), "_mix_b").alias("_mix_before"))
    own = own.join(edge, names, "left")
    whole = own.filter("_mix_rest > 0 AND (_mix_edge IS NULL OR _mix_b < _mix_edge)").withColumn("n", F.col("_mix_full") + 1)
    run = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("_mix_h", "_mix_key").rowsBetween(Window.unboundedPreceding, 0))
    at = own.filter("_mix_rest > 0 AND _mix_b = _mix_edge").withColumn("n", F.when(F.col("_mix_before") + run <= F.col("_mix_rest"), F.col("_mix_full") + 1).otherwise(F.col("_mix_full")))
    rest = own.filter("_mix_rest = 0 OR _mix_b > _mix_edge").withColumn("n", F.col("_mix_full"))
    cols = ["_mix_key", "n"]
    copies = whole.select(*cols).unionByName(at.select(*cols)).unionByName(rest.select(*cols)).filter("n > 0")
    copies = copies.groupBy("_mix_key").agg(F.sum("n").alias("_mix_total"))
    counts = small.groupBy("_mix_key").count().filter("count > 1").select("_mix_key", F.col("count").alias("_mix_rows"))
    copies = copies.join(counts, "_mix_key", "left").withColumn("_mix_rows", F.coalesce("_mix_rows", F.lit(1)))
    copies = copies.select("_mix_key", F.expr("_mix_total div _mix_rows").alias("copies"), F.expr("_mix_total % _mix_rows").alias("_mix_extra"))
    joined = tagged.drop("copies").join(copies, "_mix_key")
    split = _first_rows(joined.filter("_mix_extra > 0"), "_mix_key", "_mix_extra", "copies")
    out = joined.filter("_mix_extra = 0").unionByName(split).filter("copies > 0")
    return out.drop(*names, "_mix_id", "_mix_key", "_mix_extra")


def _first_rows(rows: DataFrame, key: str, extra: str, copies: str) -> DataFrame:
    """``rows`` with one copy more for the first ``extra`` rows of each key.

    Rows are numbered within their part of the written table, and parts are counted, so equal rows need not meet in one task.
    """
    parts = materialise(rows, "split").withColumn("_mix_n", F.monotonically_increasing_id()).withColumn("_mix_part", F.shiftright("_mix_n", 33))
    parts = materialise(parts, "numbered")
    sizes = parts.groupBy(key, "_mix_part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(key, "_mix_part").orderBy("_mix_n"))
    placed = parts.join(sizes.select(key, "_mix_part", before.alias("_mix_before")), [key, "_mix_part"]).withColumn("_mix_place", place + F.col("_mix_before"))
    return placed.withColumn(copies, F.col(copies) + (F.col("_mix_place") <= F.col(extra)).cast("long")).drop("_mix_n", "_mix_part", "_mix_before", "_mix_place")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of())
    return mix(docs, WEIGHTS).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")
