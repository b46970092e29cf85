"""The driver contract: registered queries run and agree with their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from nightgrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["flagship_subject_report", "a1_time_bin_mean", "a8_labelled_epochs_with_gaps", "j1_interval_semi_join", "j18_gap_limited_linear", "w8_windowed_cv", "w24_sliding_windows", "m9_summary", "io12_stage_forward_hold", "f5_f8_band_power", "g14_spo2_clean_drops", "v1_subject_folds", "f17_polyphase", "t1_split_gains", "io1_edf_scan", "w10_truth_and_events", "tvf_bad_oxygen"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if v.__class__.__name__ == "Decimal" else v


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and catalog.FLAGSHIP in entry.queries()


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key) == want
