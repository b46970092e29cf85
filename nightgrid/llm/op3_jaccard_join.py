"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles; documents link at Jaccard >= ``percent`` / 100. Steps:

1. equal sets collapse into one class; a sketch of fixed size counts shingles over all documents, so that prefixes start
   with rare shingles (any total order is exact; the sketch only sets which);
2. index lists: the prefix shingles of each set, blocked by size, keeping lists that hold different sets;
   Each entry has its reach, the shingles from its position on: a pair meets only where both reaches allow the overlap it needs;
3. every list names a center per size block, and sets are verified against their centers (one pair per set and center, not all pairs).
   Verified sets hang on their nearest center, with the number of shingles that the center lacks;
4. answer-level skipping: the answers of a set are derived from its center's. Pairs within one component are never looked at.
   Between components only centers are compared, and of these only pairs whose parity bitmaps (256 bits a set) allow a link; a member pair is looked at only if
   ``|c1 & c2| + |x - c1| + |y - c2|`` can still reach the threshold;
5. components of the verified links.

Defined results: texts without words have the empty set, link with nothing and are their own component; with fewer words
than a shingle the whole sequence is the one shingle; rows with a null id take part, and a component of null ids only has a null
id; repeated rows are equal sets; ids may be of any type that has an order; a very long text is one set like any other; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .components import connected_components
from .repeats import row_key
from .shared import materialise, read_table

SHINGLE_WORDS = 4
PERCENT = 85
#: Counters of the shingle sketch: its size is fixed, whatever the corpus.
SKETCH_BITS = 20
_BLOCK = 1 << 16
#: Parity bitmap of a set, 256 bits: sets that differ in d shingles differ in at most d bits.
BITS = ["b0", "b1", "b2", "b3"]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, by text and hash."""
    w = K.Words(buf, offs)
    h = w.hashes(lower=True)
    count = np.diff(w.first)
    rolling = K.RollingHash(h, K.MULT_B)
    full = np.flatnonzero(count >= n)
    short = np.flatnonzero((count > 0) & (count < n))
    grams = rolling.windows(n)[K.ranges_concat(w.first[full], count[full] - n + 1)]
    rows = np.concatenate([np.repeat(full, count[full] - n + 1), short])
    grams = np.concatenate([grams, rolling.ranges(w.first[short], w.first[short + 1])])
    return by_row(rows, grams)


def by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted."""
    o = np.argsort(values)
    rows, values = rows[o], values[o]
    narrow = rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows
    o = np.argsort(narrow, kind="stable")
    rows, values = rows[o], values[o]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> K.U(64 - SKETCH_BITS)).astype(np.int64)


def _survey(n: int, id_type: pa.DataType):
    """Set sizes and digests of all documents; at the end of each task its part of the sketch."""
    names = ["rk", "doc_id", "n", "g1", "g2", *BITS, "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for i, j, buf, offs in K.slices(b.column(2)):
                rows, h = shingle_sets(buf, offs, n)
                sketch += np.bincount(_slots(h), minlength=len(sketch))
                size = np.bincount(rows, minlength=j - i)
                sums = []
                for salt in (K.MULT_A, K.MULT_B):
                    run_sum = np.concatenate([[K.U(0)], np.cumsum(K.mix64(h ^ K.U(salt)))])
                    ends = np.cumsum(size)
                    sums.append(K.signed(run_sum[ends] - run_sum[ends - size]))
                odd = np.bincount(rows * 256 + (h & K.U(255)).astype(np.int64), minlength=(j - i) * 256).reshape(j - i, 256) & 1
                words = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                bits = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)]
                none = pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(size), *map(pa.array, sums), *bits, *none], names=names)
        used = [k for k in range(len(sketch) // _BLOCK) if sketch[k * _BLOCK : (k + 1) * _BLOCK].any()]
        nulls = [pa.nulls(len(used), id_type if c == "doc_id" else pa.int64()) for c in names[:9]]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(used, pa.int32()), pa.array([sketch[k * _BLOCK : (k + 1) * _BLOCK].tobytes() for k in used], pa.binary())], names=names)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(c.as_buffer(), np.int64)
            total[k] = total[k] + x if k in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(np.ceil(6 * np.log2(x + 1)), 255).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], names=["block", "ranks"])


def _postings(n: int, percent: int, ranks):
    """The prefix shingles of each set, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in K.slices(b.column(1)):
                rows, h = shingle_sets(buf, offs, n)
                if not len(rows):
                    continue
                rank = ranks.value[_slots(h)].astype(np.uint64)
                rows, key = by_row(rows, (rank << K.U(56)) | (h >> K.U(8)))
                size = np.bincount(rows, minlength=j - i)
                first = np.cumsum(size) - size
                prefix = size - (-(-percent * size // 100)) + 1
                pos = np.arange(len(rows)) - first[rows]
                take = pos < prefix[rows]
                rows, key, pos = rows[take], key[take], pos[take]
                digest = K.signed(np.add.reduceat(K.mix64(h), first[size > 0]))
                wide = np.zeros(j - i, np.int64)
                wide[size > 0] = digest
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(keys[i:j][rows]), pa.array(wide[rows]), pa.array(size[rows].astype(np.int32)), pa.array((size[rows] - pos).astype(np.int32))], names=["tok", "rk", "g", "n", "reach"])

    return run


def _overlap(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in K.slices(b.column(2)):
                rx, hx = shingle_sets(buf, offs, n)
                ry, hy = shingle_sets(*K.flat(b.column(3).slice(i, j - i)), n)
                rows, h = np.concatenate([rx, ry]), np.concatenate([hx, hy])
                o = np.lexsort((h, rows))
                rows, h = rows[o], h[o]
                same = (rows[1:] == rows[:-1]) & (h[1:] == h[:-1])
                m = j - i
                counts = [np.bincount(r, minlength=m).astype(np.int64) for r in (rows[1:][same], rx, ry)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), b.column(1).slice(i, m), *map(pa.array, counts)], names=["x", "y", "both", "nx", "ny"])

    return run


def _linked(percent: int) -> Column:
    return F.expr(f"100 * both >= {percent} * (nx + ny - both)")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``."""
    return row_components(docs, id_col, text_col, shingle_words, percent).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """As ``jaccard_components``, with each row's key ``rk`` and ``comp``, its component whatever the ids (null: no words)."""
    spark, kind, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    src = docs.select(row_key(id_col, text_col).alias("rk"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    info = materialise(src.mapInArrow(_survey(shingle_words, id_type), f"rk long, doc_id {kind}, n long, g1 long, g2 long, b0 long, b1 long, b2 long, b3 long, block int, counts binary"), "info")
    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    blocks = info.filter("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_sum_blocks, "block int, ranks binary")
    for r in blocks.toLocalIterator():
        ranks[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["ranks"], np.uint8)
    ranks = spark.sparkContext.broadcast(ranks)  # 2 ** SKETCH_BITS bytes

    info = info.filter("block IS NULL").drop("block", "counts")
    classes = info.filter("n > 0").groupBy("g1", "g2", "n").agg(F.min("doc_id").alias("low"), F.min("rk").alias("rep"), *[F.max(b).alias(b) for b in BITS])
    classes = materialise(classes, "classes")

    # index lists that hold different sets, with one row for each of these
    text = src.select("rk", "text")
    repeated = materialise(info.groupBy("rk").count().filter("count > 1").select("rk"), "repeated")
    one_text = text  # one row a key: rows with equal id and text have one
    if not repeated.isEmpty():
        one_text = text.join(repeated, "rk", "left_anti").unionByName(text.join(repeated, "rk", "left_semi").dropDuplicates(["rk"]))
    index = text.mapInArrow(_postings(shingle_words, percent, ranks), "tok long, rk long, g long, n int, reach int")
    shared = index.groupBy("tok").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("tok")
    lists = index.join(shared, "tok").select("tok", "rk", "n", "reach").join(classes.select(F.col("rep").alias("rk")), "rk")
    block = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int").alias("block")
    lists = materialise(lists.select("tok", "rk", "n", "reach", block), "lists")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = pairs.join(one_text.select(F.col("rk").alias("x"), F.col("text").alias("tx")), "x")
        both = left.join(one_text.select(F.col("rk").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")
        return materialise(both.mapInArrow(_overlap(shingle_words), "x long, y long, both long, nx long, ny long"), name)

    def edges(*tables: DataFrame) -> DataFrame:
        out = None
        for t in tables:
            e = t.filter(_linked(percent)).select(F.col("x").alias("u"), F.col("y").alias("v"))
            out = e if out is None else out.unionByName(e)
        return out

    bitmaps = lambda p: classes.select(F.col("rep").alias(p), F.col("n").alias(p + "_size"), *[F.col(b).alias(p + b) for b in BITS])
    apart = lambda p, q: " + ".join(f"bit_count({p}{b} ^ {q}{b})" for b in BITS)
    compatible = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    heads = lists.groupBy("tok", "block").agg(F.min_by(F.struct("rk", "n"), "rk").alias("c"), F.max("rk").alias("other")).filter("c.rk <> other")
    near = lists.join(heads.select("tok", "block", "c"), ["tok", "block"]).filter("rk <> c.rk").filter(compatible(F.col("n"), F.col("c.n")))
    near = near.select(F.col("rk").alias("x"), F.col("c.rk").alias("y")).distinct().join(bitmaps("x"), "x").join(bitmaps("y"), "y")
    near = near.filter(f"{100 + percent} * (x_size + y_size - ({apart('x', 'y')})) >= {2 * percent} * (x_size + y_size)")
    stars = verified(near.select("x", "y"), "stars")
    labels = connected_components(edges(stars))

    # each set with its center, what the center lacks of it, and its component
    best = stars.filter(_linked(percent)).groupBy(F.col("x").alias("rk")).agg(F.min(F.struct((F.col("nx") - F.col("both")).alias("lack"), F.col("y").alias("center"))).alias("b"))
    known = lambda labels: labels.select(F.col("node").alias("rk"), "comp")

    def entries(labels: DataFrame) -> DataFrame:
        at = lists.join(best, "rk", "left").join(known(labels), "rk", "left")
        return at.select("tok", "n", "reach", "rk", F.coalesce("b.center", "rk").alias("center"), F.coalesce("b.lack", F.lit(0)).alias("lack"), F.coalesce("comp", "rk").alias("comp"))

    every = entries(labels)
    split = every.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
    open_lists = materialise(every.join(split, "tok"), "open")
    heads = open_lists.groupBy("tok", "center", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("lack").alias("lack"), F.max("reach").alias("reach"), F.max(F.col("rk") != F.col("center")).alias("more"))
    heads = heads.join(bitmaps("center"), "center")
    a, b = heads.alias("a"), heads.alias("b")
    meet = F.expr(f"a.tok = b.tok AND a.center < b.center AND a.comp <> b.comp AND 100 * a.hi >= {percent} * b.lo AND 100 * b.hi >= {percent} * a.lo AND {100 + percent} * least(a.reach, b.reach) >= {percent} * (a.lo + b.lo) "
                  f"AND {100 + percent} * (a.center_size + b.center_size - ({apart('a.center', 'b.center')}) + 2 * (a.lack + b.lack)) >= {2 * percent} * (a.lo + b.lo)")
    meets = a.join(b, meet).select("a.tok", F.col("a.center").alias("x"), F.col("b.center").alias("y"), F.col("a.lack").alias("a_lack"), F.col("b.lack").alias("b_lack"), F.col("a.lo").alias("a_lo"), F.col("b.lo").alias("b_lo"), F.expr("a.more OR b.more").alias("more"))
    meets = materialise(meets, "meets")
    pairs = meets.groupBy("x", "y").agg(F.max(F.col("a_lack") + F.col("b_lack")).alias("lack"), F.min(F.col("a_lo") + F.col("b_lo")).alias("sizes"), F.max("more").alias("more"))
    pairs = materialise(pairs, "centers")
    across = verified(pairs.select("x", "y"), "across")
    labels = connected_components(edges(stars, across))

    # what the centers' overlap does not rule out; members that lack nothing of their centers can link as well, only centers alone are done
    least_both = f"{percent} * sizes <= {100 + percent} * (both + lack)"
    doubt = across.filter(~_linked(percent)).join(pairs, ["x", "y"]).filter("more").filter(least_both).select("x", "y", "both")
    comp = known(labels)
    doubt = doubt.join(comp.select(F.col("rk").alias("x"), F.col("comp").alias("cx")), "x", "left").join(comp.select(F.col("rk").alias("y"), F.col("comp").alias("cy")), "y", "left")
    doubt = materialise(doubt.filter("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y", "both"), "doubt")
    if not doubt.isEmpty():
        # members under the shared shingle only, each held against the other center's best case before pairs are made
        need = lambda n, lack, reach: f"{percent} * ({n}) <= {100 + percent} * least(both + {lack}, {reach})"
        side = lambda p, c: open_lists.select("tok", F.col("center").alias(c), *[F.col(k).alias(p + k) for k in ("rk", "n", "reach", "lack")])
        left = meets.join(doubt, ["x", "y"]).join(side("m_", "x"), ["tok", "x"]).filter(need("m_n + b_lo", "m_lack + b_lack", "m_reach"))
        members = left.join(side("o_", "y"), ["tok", "y"]).filter(need("m_n + o_n", "m_lack + o_lack", "least(m_reach, o_reach)")).filter(compatible(F.col("m_n"), F.col("o_n")))
        members = members.select(F.col("m_rk").alias("a_rk"), F.col("o_rk").alias("b_rk")).distinct().join(bitmaps("a_rk"), "a_rk").join(bitmaps("b_rk"), "b_rk")
        members = members.filter(f"{100 + percent} * (a_rk_size + b_rk_size - ({apart('a_rk', 'b_rk')})) >= {2 * percent} * (a_rk_size + b_rk_size)")
        rest = verified(members.select(F.col("a_rk").alias("x"), F.col("b_rk").alias("y")).distinct(), "members")
        labels = connected_components(edges(stars, across, rest))

    tagged = classes.join(known(labels).withColumnRenamed("rk", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    lows = tagged.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = tagged.join(lows, "comp").select("g1", "g2", "n", "comp", "component_id")
    return info.join(ids, ["g1", "g2", "n"], "left").select("rk", "doc_id", "comp", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
