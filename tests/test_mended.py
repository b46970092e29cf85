"""Hypnograms with several codes on a line, target rows of short blocks, broken samples, enrichment."""

from pyspark.sql import functions as F

from nightgrid.operators import labels, sequences

INF = float("inf")


def test_hypnogram_takes_every_code_of_a_line(spark):
    lines = spark.createDataFrame([(1, 0, "0 1  2"), (1, 1, "\t5 x 4\r"), (1, 2, ""), (1, 3, "-1 3")], "subject_id long, line_no long, line string")
    lengths = spark.createDataFrame([(1, 275.0), (2, 65.0), (3, 10.0)], "subject_id long, length double")
    out = sequences.hypnogram(lines, lengths, labels.mapped(F.col("code"), labels.ISRUC_STAGES, -1)).orderBy("subject_id", "epoch_index").collect()
    assert [(r["subject_id"], r["epoch_index"], r["stage"]) for r in out] == [(1, i, s) for i, s in enumerate([0, 1, 2, 4, 3, -1, 3, -1, -1])] + [(2, 0, -1), (2, 1, -1)]


def test_target_rows_of_short_blocks(spark):
    rows = [(1, i, 0.5 if i != 3 else None, i) for i in range(4)] + [(1, 4, INF, 40), (1, 5, 0.25, 50)]
    df = spark.createDataFrame(rows, "subject_id long, slot long, f double, code int")
    out = {r["block"]: r for r in sequences.target_row(df, "slot", "f", ["code"], 4, 11, seconds_per_row=6).collect()}
    assert (out[0]["event_seconds"], out[0]["event_fraction"], out[0]["code"]) == (9.0, 9.0 / 24, 2)
    assert (out[1]["event_seconds"], out[1]["event_fraction"], out[1]["code"]) == (1.5, 1.5 / 12, 50)  # the anchor lies beyond: the last row


def test_infinite_samples_are_bridged(spark):
    df = spark.createDataFrame([([0.0, INF, 2.0, float("nan"), 4.0, -INF, 6.0, 7.0],)], "x array<double>")
    assert df.select(sequences.resampled_window("x", 1.0, F.lit(0.0), 8.0, 8)).first()[0] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.0]


def test_enrichment_has_classes_and_kinds(spark):
    df = spark.createDataFrame([(1, i, float(i), 0) for i in range(4)], "subject_id long, slot long, v double, c int")
    events = spark.createDataFrame([(1, 3, 8, "apnea"), (1, 8, 9, "arousal"), (1, 0, 1, "other")], "subject_id long, start long, end long, kind string")
    track = spark.createDataFrame([(1, s, c) for s, c in enumerate([2, 2, 3, 3, 3, 2, -1, -1, -1, 1, 1, 3])], "subject_id long, second long, code int")
    out = sequences.enriched(df, "slot", ["c"], events, [1], ["v"], 3, tracks={"stage": (track, {1: "n1", 2: "n2"})}, kinds=["apnea", "arousal"]).orderBy("slot").collect()
    assert [(r["event__apnea"], r["event__arousal"], r["event__any"], r["label__stage"], r["label__stage__class"]) for r in out] == [(0, 0, False, 2, "n2"), (1, 0, True, 3, "unknown"), (1, 1, True, -1, "unknown"), (0, 1, True, 1, "n1")]
