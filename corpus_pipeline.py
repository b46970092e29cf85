"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on what the stage before it kept. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.llm import op2_line_dedup, op3_jaccard_join, op5_decontamination, op8_source_mixing, op10_quality_rules
from nightgrid.llm.repeats import row_key
from nightgrid.llm.shared import materialise, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates of the stage; the op3 query has its own contract.
SHINGLE_WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    rules = op10_quality_rules.train(docs, read_table(spark, sf_dir, "labels"))
    return op10_quality_rules.judge(docs, rules).filter("_qr_kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; the others lose them. Documents without a line left go."""
    out = op2_line_dedup.apply_bitmaps(docs, op2_line_dedup.line_keep_bitmaps(docs))
    text = F.when(F.col("dedup.n_dropped") > 0, F.col("dedup.kept")).otherwise(F.col("text"))
    out = out.filter("dedup.n_dropped < dedup.n_lines").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("dedup.n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: the one with the smallest id, null ids last. Rows without words stay."""
    rows = op3_jaccard_join.row_components(docs, shingle_words=SHINGLE_WORDS, percent=PERCENT)
    rows = rows.groupBy("rk").agg(F.max("comp").alias("comp"), F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = materialise(rows, "row_components")
    one = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "n")).alias("x"))
    stay = one.select(F.col("x.rk").alias("_rk"), F.col("x.n").alias("_n")).unionByName(rows.filter("comp IS NULL").select(F.col("rk").alias("_rk"), F.lit(1).cast("long").alias("_n")))
    kept = docs.withColumn("_rk", row_key("doc_id", "text")).join(stay, "_rk")
    # rows with equal id and text have one key: one of them stays
    equal = kept.filter("_n > 1").groupBy("_rk").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return kept.filter("_n = 1").select(*COLUMNS).unionByName(equal)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; each is judged for itself, whatever its id."""
    keyed = docs.withColumn("_rk", row_key("doc_id", "text"))
    found = op5_decontamination.contaminated(keyed.select(F.col("_rk").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("_rk")).distinct(), "_rk", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the target weights; ``copies`` tells in how many epochs a document is."""
    return op8_source_mixing.mix(docs.withColumn("domain", op8_source_mixing.domain_of()), op8_source_mixing.WEIGHTS).select(*COLUMNS, "domain", "n_tokens", "copies")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mixing),
]

#: The learned list, the latent search and the mixing budgets have no SQL form: tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
