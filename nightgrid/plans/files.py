"""Queries over recordings that Spark writes from the tables and scans again (survey 2.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.sources import bundles, formats
from nightgrid.sources.scratch import new_folder

from .adapter import SIG, UNIT, sig
from .registry import query

PLACED = f"WITH {SIG}, p AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us, event_id) - 1 AS i, CAST(k AS BIGINT) AS k, stage FROM sig), c AS (SELECT subject_id, i, 'k' AS channel, k AS v FROM p UNION ALL SELECT subject_id, i, 'stage', stage FROM p)"


def placed(spark, sf) -> DataFrame:
    """Events as two whole-numbered channels, one sample an event, in order of time."""
    w = Window.partitionBy("subject_id").orderBy("t_us", "event_id")
    return sig(spark, sf).select("subject_id", (F.row_number().over(w) - 1).alias("i"), F.col("k").cast("int").alias("k"), "stage")


def stored(spark, sf, kind: str, channels: list[str] | None = None) -> DataFrame:
    """The events' recordings as files, scanned: one row a sample."""
    path = new_folder(spark, kind)
    formats.save_whole_numbers(placed(spark, sf), path, ("k", "stage"), kind).write.format("noop").mode("overwrite").save()
    scan = (formats.scan_edf if kind == "edf" else formats.scan_wfdb)(spark, path, channels=channels)
    x = scan.select("subject_id", "channel", "chunk_id", "fs", F.posexplode("samples").alias("j", "v"))
    return x.select(F.col("subject_id").cast("long").alias("subject_id"), "channel", (F.col("chunk_id") * (F.col("fs") * formats.CHUNK_SECONDS).cast("long") + F.col("j")).alias("i"), F.round("v").cast("long").alias("v"))


@query("io1_edf_scan", f"{PLACED} SELECT subject_id, channel, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * i) AS BIGINT) AS moment FROM c GROUP BY 1, 2")
def edf_scan(spark, sf):
    """Every sample comes back at its place."""
    return stored(spark, sf, "edf").groupBy("subject_id", "channel").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("i")).alias("moment"))


@query("io5_wfdb_scan", f"{PLACED} SELECT subject_id, channel, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * i) AS BIGINT) AS moment FROM c GROUP BY 1, 2")
def wfdb_scan(spark, sf):
    return stored(spark, sf, "wfdb").groupBy("subject_id", "channel").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("i")).alias("moment"))


@query("io1_pruned_channel", f"{PLACED} SELECT subject_id, CAST(max(v) AS BIGINT) AS highest, CAST(arg_min(i, v * 100000 + i) AS BIGINT) AS first_lowest FROM c WHERE channel = 'stage' GROUP BY 1")
def pruned_channel(spark, sf):
    """One channel of each recording; the scan is for this one, so others are not decoded."""
    x = stored(spark, sf, "edf", ["stage"])
    return x.groupBy("subject_id").agg(F.max("v").alias("highest"), F.min_by("i", F.struct("v", "i")).alias("first_lowest"))


@query("io22_result_bundle", f"""WITH {SIG} SELECT 'daily' AS "table", subject_id, count(DISTINCT t_us // {24 * UNIT}) AS n, 2 AS version FROM sig GROUP BY 2 UNION ALL SELECT 'stages', subject_id, count(DISTINCT stage), 2 FROM sig GROUP BY 2""")
def result_bundle(spark, sf):
    """Two tables as one bundle, published twice; what is read is the second version."""
    s, path = sig(spark, sf), new_folder(spark, "bundle")
    daily = s.groupBy("subject_id", F.floor(F.col("t_us") / (24 * UNIT)).alias("day")).agg(F.avg("v").alias("v"))
    stages = s.groupBy("subject_id", "stage").agg(F.count("*").alias("n"))
    bundles.save_bundle(spark, path, {"daily": daily.filter("day < 10"), "stages": stages}, {"days": 10})
    bundles.save_bundle(spark, path, {"daily": daily, "stages": stages}, {"days": "all"})
    tables, _ = bundles.load_bundle(spark, path)
    version = bundles.versions(path)[-1]
    each = [t.groupBy("subject_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "subject_id", "n", F.lit(version).alias("version")) for k, t in sorted(tables.items())]
    return each[0].unionByName(each[1])
