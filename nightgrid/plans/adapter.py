"""The shared test tables as recordings: users are subjects, one hour stands for one second of a night.

Row grid: 6 "seconds" (6 h); epoch: 30 (5 rows). Event types are the five stages. ``SQL`` has the same views as DuckDB text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.operators.binning import row_spine, time_bin, windowed_mode

UNIT = 3_600_000_000
ROW = 6 * UNIT
EPOCH = 30 * UNIT
STAGES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sig(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, subject_id, t_us, v, k, stage``."""
    stage = F.lit(-1)
    for name, code in reversed(STAGES.items()):
        stage = F.when(F.col("event_type") == name, code).otherwise(stage)
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("subject_id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("t_us"),
        F.col("value").alias("v"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), stage.alias("stage"),
    )


def rows6(spark: SparkSession, sf: str) -> DataFrame:
    """``subject_id, slot, v, k, stage`` on every 6-unit row; -1 where no stage was scored."""
    s = sig(spark, sf)
    at = s.withColumn("row", F.floor(F.col("t_us") / ROW).cast("long"))
    spine = row_spine(s, F.ceil((F.max("t_us") + 1) / ROW))
    mode = windowed_mode(at, "stage", ["subject_id", "row"])
    means = at.groupBy("subject_id", "row").agg(F.avg("v").alias("v"), F.avg("k").alias("k"))
    out = spine.join(means, ["subject_id", "row"], "left").join(mode, ["subject_id", "row"], "left")
    return out.select("subject_id", F.col("row").alias("slot"), "v", "k", F.coalesce("stage", F.lit(-1)).alias("stage"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``subject_id, event_id, truth, pred, v``: a second scorer who differs on every seventh event."""
    return sig(spark, sf).select("subject_id", "event_id", "t_us", F.col("stage").alias("truth"), F.expr("CASE WHEN event_id % 7 = 0 THEN (stage + 1) % 5 ELSE stage END").alias("pred"), "v")


def episodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two sets of closed day intervals per customer: their open orders, and the deliveries of their lines."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"), F.expr("datediff(o_orderdate, date'1995-01-01')").cast("long").alias("day"), F.floor(F.col("o_totalprice") / 10000).cast("long").alias("days"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.expr("datediff(l_shipdate, date'1995-01-01')").cast("long").alias("start"), F.floor(F.col("l_quantity") / 10).cast("long").alias("long"))
    a = o.select("subject_id", F.col("o_orderkey").alias("id"), F.col("day").alias("start"), (F.col("day") + F.col("days")).alias("end"))
    z = lines.join(o.select("o_orderkey", "subject_id"), "o_orderkey").select("subject_id", (F.col("o_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "start", (F.col("start") + F.col("long")).alias("end"))
    return a, z


SIG = f"""sig AS (SELECT event_id, user_id AS subject_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us, value AS v,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
 CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS stage FROM events)"""
ROWS6 = SIG + f""", b AS (SELECT subject_id, t_us // {ROW} AS slot, avg(v) AS v, avg(k) AS k FROM sig GROUP BY 1, 2),
c AS (SELECT subject_id, t_us // {ROW} AS slot, stage, count(*) AS n FROM sig GROUP BY 1, 2, 3),
m AS (SELECT subject_id, slot, min(stage) AS stage FROM (SELECT *, max(n) OVER (PARTITION BY subject_id, slot) AS mx FROM c) WHERE n = mx GROUP BY 1, 2),
sp AS (SELECT subject_id, unnest(range(0, max(t_us) // {ROW} + 1)) AS slot FROM sig GROUP BY subject_id),
rows6 AS (SELECT sp.subject_id, sp.slot, b.v, b.k, coalesce(m.stage, -1) AS stage FROM sp LEFT JOIN b USING (subject_id, slot) LEFT JOIN m USING (subject_id, slot))"""
PAIRS = SIG + """, pairs AS (SELECT subject_id, event_id, t_us, stage AS truth, CASE WHEN event_id % 7 = 0 THEN (stage + 1) % 5 ELSE stage END AS pred, v FROM sig)"""
EPISODES = """a AS (SELECT o_custkey AS subject_id, o_orderkey AS id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + CAST(floor(o_totalprice / 10000) AS BIGINT) AS "end" FROM orders),
z AS (SELECT o_custkey AS subject_id, o_orderkey * 8 + l_linenumber AS id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(floor(l_quantity / 10) AS BIGINT) AS "end" FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
