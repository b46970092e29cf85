"""Label tracks from annotation texts: stage codes, respiratory events, begin/end notes, forward hold, night summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Stage codes of the three sources, collapsed to wake 0, n1 1, n2 2, n3 3, rem 4; others are -1.
UCDDB_STAGES = {0: 0, 1: 4, 2: 1, 3: 2, 4: 3, 5: 3}
ISRUC_STAGES = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4}
NOTE_STAGES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4}
STAGE_NAMES = {0: "wake", 1: "n1", 2: "n2", 3: "n3", 4: "rem"}
# Respiratory severity and obstruction codes by event type.
SEVERITY = {"HYP": 1, "APNEA": 2}
OBSTRUCTION = {"C": 1, "O": 2, "M": 3}


def mapped(c: Column, table: dict, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))


def stage_seconds(lines: DataFrame, text: str = "line", number: str = "line_no", epoch: int = 30, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO9: one code per non-blank line, held for each second of its epoch."""
    x = lines.filter(F.trim(text) != "").withColumn("_c", F.trim(F.col(text)).cast("int"))
    x = x.withColumn("_e", F.row_number().over(Window.partitionBy(*keys).orderBy(number)) - 1)
    x = x.select(*keys, "_e", mapped(F.col("_c"), UCDDB_STAGES, -1).alias("stage"), F.explode(F.sequence(F.lit(0), F.lit(epoch - 1))).alias("_s"))
    return x.select(*keys, (F.col("_e") * epoch + F.col("_s")).cast("long").alias("second"), "stage")


def respiratory_events(lines: DataFrame, text: str = "line", number: str = "line_no", header: int = 3, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO10: ``HH:MM:SS TYPE [extra] DURATION ...`` after the header; lines without a numeric duration go; the end is inclusive."""
    x = lines.filter(F.col(number) >= header).withColumn("_t", F.split(F.trim(text), r"\s+")).filter(F.size("_t") >= 3)
    get = lambda i: F.get("_t", F.lit(i))
    dur = F.coalesce(get(2).try_cast("double"), get(3).try_cast("double"))
    clock = F.split(get(0), ":")
    sec = F.get(clock, F.lit(0)).try_cast("int") * 3600 + F.get(clock, F.lit(1)).try_cast("int") * 60 + F.get(clock, F.lit(2)).try_cast("int")
    x = x.withColumns({"start": sec.cast("long"), "_d": dur}).filter("start IS NOT NULL AND _d IS NOT NULL")
    return x.select(*keys, "start", (F.col("start") + F.greatest(F.rint("_d") - 1, F.lit(0.0)).cast("long")).alias("end"), get(1).alias("label"))


def severity(label: Column) -> Column:
    """J6 codes: HYP 1, APNEA 2, else 0."""
    out = F.lit(0)
    for k, v in SEVERITY.items():
        out = F.when(label.startswith(k), v).otherwise(out)
    return out


def obstruction(label: Column) -> Column:
    return mapped(F.regexp_extract(label, "-([COM])", 1), OBSTRUCTION, 0)


def begin_end_pairs(notes: DataFrame, t: str = "t_sec", note: str = "note", keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO11: ``(name`` opens and ``name)`` closes; the last opening counts, notes without a partner are dropped."""
    x = notes.withColumn("_open", F.col(note).startswith("(")).withColumn("_close", F.col(note).endswith(")"))
    x = x.filter("_open OR _close").withColumn("label", F.regexp_replace(note, r"[()]", ""))
    w = Window.partitionBy(*keys, "label").orderBy(t)
    # an opening counts for the first closing after it only
    x = x.withColumn("_last", F.lag(F.when(F.col("_open"), F.col(t))).over(w))
    return x.filter("_close AND _last IS NOT NULL").select(*keys, "label", F.col("_last").alias("start"), F.col(t).alias("end"))


def held_stages(changes: DataFrame, lengths: DataFrame, epoch: int = 30, t: str = "t_sec", note: str = "note", keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO12: each change holds to the next; epochs wholly inside a hold take its code, the others are -1. ``lengths``: keys, length."""
    x = changes.join(lengths, list(keys)).withColumn("_end", F.coalesce(F.lead(t).over(Window.partitionBy(*keys).orderBy(t)), F.col("length")))
    first, last = F.ceil(F.col(t) / epoch - 1e-9).cast("long"), F.floor(F.col("_end") / epoch + 1e-9).cast("long") - 1
    x = x.withColumns({"_a": first, "_b": last, "stage": mapped(F.col(note), NOTE_STAGES, -1)}).filter("_b >= _a")
    hold = x.select(*keys, "stage", F.explode(F.expr("sequence(_a, _b)")).alias("epoch_index"))
    spine = lengths.filter(F.col("length") >= epoch).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / epoch).cast("long") - 1)).alias("epoch_index"))
    return spine.join(hold, [*keys, "epoch_index"], "left").withColumn("stage", F.coalesce("stage", F.lit(-1)))


def subject_summary(epochs: DataFrame, events: DataFrame, stage: str = "stage", epoch_seconds: int = 30, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """IO15: hours, hours asleep, apneas and hypopneas per hour asleep (NULL without sleep), and the central share of the apneas (0 without any)."""
    e = epochs.groupBy(*keys).agg((F.count("*") * epoch_seconds / 3600.0).alias("hours"), (F.count_if(F.col(stage).between(1, 4)) * epoch_seconds / 3600.0).alias("sleep_hours"), *[F.count_if(F.col(stage) == k).alias("n_" + v) for k, v in STAGE_NAMES.items()])
    r = events.groupBy(*keys).agg(F.count_if(F.col("label").rlike("^(APNEA|HYP)")).alias("n_events"), F.count_if(F.col("label").startswith("APNEA")).alias("n_apneas"), F.count_if(F.col("label") == "APNEA-C").alias("n_central"))
    x = e.join(r, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "n_apneas", "n_central")})
    return x.withColumns({"ahi": F.try_divide(F.col("n_events").cast("double"), F.col("sleep_hours")), "central_fraction": F.coalesce(F.try_divide(F.col("n_central").cast("double"), F.col("n_apneas")), F.lit(0.0))})
