"""Generators called from SQL."""

import numpy as np

from nightgrid.functions import generators, table_functions
from nightgrid.sources import recordings

R = np.random.default_rng(2)


def rows(*subjects):
    return [(s, c, k, 100.0, "uV", R.normal(0, 20, 100 * 60).tolist()) for s in subjects for c in ("eeg", "emg", "snore") for k in range(2)]


def test_sql_equals_the_call(spark):
    df = spark.createDataFrame(rows("a", "b", "c"), recordings.SCHEMA).repartition(5)
    df.createOrReplaceTempView("signals")
    assert table_functions.register(spark, "string", ("slow_wave_features", "emg_tone_features", "spo2_drop")) == ["slow_wave_features", "emg_tone_features", "spo2_drop"]
    for name in ("slow_wave_features", "emg_tone_features"):
        got, want = spark.sql(f"SELECT * FROM {name}(TABLE(signals) PARTITION BY subject_id)"), generators.run_generator(df, name)
        assert got.columns == want.columns and got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0
    # a subject's tracks joined and grouped as any table; no channel, no rows
    top = spark.sql("SELECT subject_id, max(v) AS v FROM emg_tone_features(TABLE(SELECT * FROM signals WHERE subject_id <> 'c') PARTITION BY subject_id) WHERE signal = 'emg_tone' GROUP BY subject_id").collect()
    assert {r["subject_id"] for r in top} == {"a", "b"}
    assert spark.sql("SELECT * FROM spo2_drop(TABLE(signals) PARTITION BY subject_id)").count() == 0
    assert spark.sql("SELECT * FROM emg_tone_features(TABLE(SELECT * FROM signals WHERE false) PARTITION BY subject_id)").count() == 0
