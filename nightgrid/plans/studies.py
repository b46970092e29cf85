"""The registered graphs as studies (survey R9, R10): a step a generator, a feature table at the end, kept subject by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.functions import generators

from .study import Step, Study, guarded

SIGNALS = "signals"
#: Generators that wait for others' results.
AFTER = {"hrv_features": ("pan_tompkins",), "cardiorespiratory_coupling": ("hrv_features",), "apnea_events": ("respiration", "spo2_drop")}
#: What stays of the beats when a study is pruned: the beats themselves.
BEATS = "signal = 'heartbeat_mask' AND v = 1"
#: The graph that each data set runs.
GRAPHS = {"ucddb": "apnea", "cinc2018": "calibrated", "isruc": "calibrated"}


def generator_step(name: str, after: tuple[str, ...] = (), **options) -> Step:
    """A generator as a step. Of the signals it reads the generator's own channels only; a subject on which it raises fails alone."""

    def build(inputs: dict[str, DataFrame]) -> DataFrame:
        rows, schema = generators.channel_rows(inputs[SIGNALS], (name,))
        return guarded(rows, generators.kernel((name,), **{name: options}), schema)

    return Step(name, build, (SIGNALS, *after), events=BEATS if name == "pan_tompkins" else None)


def table_step(names: tuple[str, ...], seconds: int) -> Step:
    """All generators' tracks as one wide table."""

    def build(inputs: dict[str, DataFrame]) -> DataFrame:
        tracks = None
        for n in names:
            tracks = inputs[n] if tracks is None else tracks.unionByName(inputs[n])
        return generators.feature_table(tracks, seconds * 1_000_000)

    return Step(f"feature_table_{seconds}s", build, names, final=True)


def dataset_study(dataset: str, options: dict[str, dict] | None = None) -> Study:
    """The study of a data set, with each step's dependencies named; the apnea graph has a table by the second too."""
    names = generators.PIPELINES[GRAPHS[dataset]]
    steps = [generator_step(n, tuple(d for d in AFTER.get(n, ()) if d in names), **(options or {}).get(n, {})) for n in names]
    widths = (6, 1) if GRAPHS[dataset] == "apnea" else (6,)
    return Study(dataset, steps + [table_step(names, w) for w in widths])


def transform_step(name: str, build, consumes: tuple[str, ...], gives: str | None = None, optional: tuple[str, ...] = ()) -> Step:
    """A step that consumes streams for good. Later steps see what it gives and no longer what it touched."""
    return Step(gives or name, build, consumes, optional, touches=consumes)


def used_channels(study: Study, steps: list[str] | None = None) -> list[str]:
    """Channels that a study's steps (some of them, or all) look at: the only ones that its scans read."""
    names = [s.name for s in study.steps if s.name in generators.GENERATORS and (steps is None or s.name in steps)]
    return sorted({c for n in names for c in generators.GENERATORS[n][2].channels})


def quality_frame(quality: DataFrame, labels: DataFrame, epoch_seconds: int = 30) -> DataFrame:
    """Per-second inputs of a subject (long: subject_id, signal, idx, v) by epoch, with the epoch's label; epochs without a label or a second go."""
    by = quality.withColumn("epoch_index", F.floor(F.col("idx") / epoch_seconds).cast("long")).groupBy("subject_id", "epoch_index", "signal").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    wide = by.groupBy("subject_id", "epoch_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "v")))).alias("inputs"), F.max("n").cast("long").alias("seconds"))
    return wide.join(labels.filter("label IS NOT NULL").select("subject_id", "epoch_index", "label"), ["subject_id", "epoch_index"])
