"""Queries over studies that are kept subject by subject (survey 2.11, X40)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from nightgrid.sources.scratch import new_folder

from .adapter import SIG, UNIT, sig
from .registry import query, r6
from .study import Runner, Step, Study, guarded

#: Subjects that were there when the study ran for the first time began in the first six hours; a subject whose lowest value is below this one fails.
EARLY, LEAST = 6 * UNIT, 0.05


def _hours(table: pa.Table) -> pa.Table:
    """Means by hour of one subject; values below the least are an error of the recording."""
    v, t = table.column("v").to_pandas(), table.column("t_us").to_pandas()
    if v.min() < LEAST:
        raise ValueError("value below the least")
    g = v.groupby(t // UNIT).mean()
    return pa.table({"subject_id": table.column("subject_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(g))), "hour": pa.array(g.index, pa.int64()), "v": pa.array(g.to_numpy())})


def hourly_study() -> Study:
    """Hourly means by a kernel, days from these, and a whole-table step over all subjects."""
    hourly = Step("hourly", lambda x: guarded(x["signals"].select("subject_id", "t_us", "v"), _hours, "subject_id long, hour long, v double"), ("signals",))
    daily = Step("daily", lambda x: x["hourly"].groupBy("subject_id", F.floor(F.col("hour") / 24).cast("long").alias("day")).agg(F.avg("v").alias("v"), F.count("*").alias("hours")), ("hourly",), final=True)
    norms = Step("norms", lambda x: x["daily"].agg(F.avg("v").alias("mean"), F.count("*").alias("n")), ("daily",), per_subject=False)
    return Study("hours", [hourly, daily, norms])


def twice(spark, sf) -> tuple[Runner, Study]:
    """The study run for the early subjects, then for all: the second run computes only those that came."""
    study, runner, s = hourly_study(), Runner(spark, new_folder(spark, "study")), sig(spark, sf)
    early = s.groupBy("subject_id").agg(F.min("t_us").alias("t")).filter(F.col("t") < EARLY)
    for who in (early, s):
        runner.run(study, {"signals": s}, subjects=who.select("subject_id"))
    return runner, study


KEPT = f"""WITH {SIG}, w AS (SELECT subject_id, CASE WHEN min(t_us) < {EARLY} THEN 1 ELSE 2 END AS run_no, min(v) < {LEAST} AS bad FROM sig GROUP BY 1)"""


@query("r3_subject_manifest", f"""{KEPT} SELECT 'hourly' AS step, CAST(subject_id AS VARCHAR) AS subject, run_no, 'ok' AS state, '' AS code FROM w WHERE NOT bad
UNION ALL SELECT 'hourly', CAST(subject_id AS VARCHAR), 2, 'fail', 'EXTRACT_FAILED' FROM w WHERE bad UNION ALL SELECT 'daily', CAST(subject_id AS VARCHAR), run_no, 'ok', '' FROM w WHERE NOT bad UNION ALL SELECT 'norms', '*', 2, 'ok', ''""")
def manifest(spark, sf):
    """Each subject is computed once, in the run in which it came; failed ones are tried again in each run and keep no other from its result."""
    runner, _ = twice(spark, sf)
    state = runner.state().drop("study", "message")
    first = state.agg(F.min("run")).first()[0]
    return state.select("step", "subject", F.when(F.col("run") == first, 1).otherwise(2).alias("run_no"), "state", "code")


@query("r3_kept_days", f"""{KEPT}, h AS (SELECT subject_id, t_us // {UNIT} AS hour, avg(v) AS v FROM sig GROUP BY 1, 2) SELECT subject_id, hour // 24 AS day, round(avg(v), 6) AS v, count(*) AS hours FROM h JOIN w USING (subject_id) WHERE NOT bad GROUP BY 1, 2""")
def kept_days(spark, sf):
    """A kept table after two runs: the rows of both, none twice."""
    runner, study = twice(spark, sf)
    return runner.table(study.name, "daily").select("subject_id", "day", r6("v"), "hours")


@query("io21_pruned_study", f"""{KEPT} SELECT 'hourly' AS step, CASE WHEN bad THEN 'fail' ELSE 'pruned' END AS state, count(*) AS subjects FROM w GROUP BY 1, 2 UNION ALL SELECT 'daily', 'ok', count(*) FROM w WHERE NOT bad UNION ALL SELECT 'norms', 'ok', 1""")
def pruned(spark, sf):
    """After pruning, final tables are there and what they were made of is not; a later run computes nothing anew."""
    runner, study = twice(spark, sf)
    runner.prune(study)
    runner.run(study, {"signals": sig(spark, sf)}, subjects=runner.table(study.name, "daily").select("subject_id"))
    return runner.state().groupBy("step", "state").agg(F.count("*").alias("subjects"))
