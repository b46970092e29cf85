"""Query for the polyphase resampler (survey F17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.functions import resampling

from .adapter import SIG
from .files import placed
from .registry import query, r6

#: Samples of a chunk; a recording has several.
CHUNK = 20
UP, DOWN = 3, 2
TAPS = ", ".join(f"({j}, {float(h)!r})" for j, h in enumerate(resampling.taps(UP, DOWN)))
MID = len(resampling.taps(UP, DOWN)) // 2


@query("f17_polyphase", f"""WITH {SIG}, p AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY t_us, event_id) - 1 AS i, k FROM sig), t(j, h) AS (VALUES {TAPS}), n AS (SELECT subject_id, count(*) AS n FROM p GROUP BY 1),
y AS (SELECT subject_id, (j - {MID} + i * {UP}) // {DOWN} AS m, sum(k * h) AS v FROM p, t WHERE (j - {MID} + i * {UP}) >= 0 AND (j - {MID} + i * {UP}) % {DOWN} = 0 GROUP BY 1, 2) SELECT subject_id, m, round(v, 6) AS v FROM y JOIN n USING (subject_id) WHERE m * {DOWN} < n * {UP}""")
def polyphase(spark, sf):
    """Each user's series at one and a half times its rate, from chunks of twenty samples."""
    x = placed(spark, sf).withColumn("chunk_id", F.floor(F.col("i") / CHUNK).cast("long")).groupBy("subject_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("k").cast("double").alias("k")))).alias("s"))
    chunks = x.select("subject_id", F.lit("k").alias("channel"), "chunk_id", F.lit(1.0).alias("fs"), F.lit("").alias("units"), F.col("s.k").alias("samples"))
    y = resampling.resample(chunks, UP / DOWN, chunk_seconds=CHUNK).select("subject_id", "chunk_id", F.posexplode("samples").alias("j", "v"))
    return y.select("subject_id", (F.col("chunk_id") * (CHUNK * UP // DOWN) + F.col("j")).alias("m"), r6("v"))
