"""Rows with equal id and text, and columns that have the operators' own names."""

import brute
import pytest
from pyspark.sql import functions as F

from nightgrid.llm import op1_suffix_array, op2_line_dedup, op6_phrase_automata, op8_source_mixing

LINE = "a line that is long enough to count and that many documents hold"


def words(k, n):
    return " ".join(f"w{(i * k) % 211}" for i in range(n))


@pytest.mark.parametrize("max_group", [20_000, 0])
@pytest.mark.parametrize("op,name", [(op1_suffix_array.remove_repeated_bytes, "op1"), (op6_phrase_automata.remove_recurring_passages, "op6")])
def test_many_equal_rows(spark, op, name, max_group):
    """Each gets its stretches once, however many there are: lists do not grow with the rows."""
    rows = [(7, words(3, 260))] * 2000 + [(8, words(5, 90) + " end " + words(3, 60)), (9, "alone"), (None, words(3, 50))]
    out = op(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), max_group=max_group)
    got = out.select("doc_id", "n_units", "spans", "kept").collect()
    want = getattr(brute, name)(rows)
    assert sorted((r["doc_id"] or -1, r["n_units"], brute.sha(bytes(r["kept"]))) for r in got) == sorted((w[0] or -1, w[1], w[-1]) for w in want)
    assert len(got) == len(rows) and max(len(r["spans"]) for r in got) <= 3


def test_op2_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"{LINE}\nown {i}") for i in range(6)], "doc_id long, text string")
    df = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("_keep", "_key", "__KEY", "keep", "rk", "n_lines")})
    out = op2_line_dedup.apply_bitmaps(df, op2_line_dedup.line_keep_bitmaps(df))
    assert out.columns == [*df.columns, "dedup"]
    for r in out.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in df.columns[2:]) and r["dedup"]["n_dropped"] == (r["doc_id"] != 5)


def test_op8_keeps_columns_of_any_name(spark):
    rows = [(i, words(3, 10 + i), "web", "en", f"s{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    plain = op8_source_mixing.mix(df, op8_source_mixing.WEIGHTS, 200)
    odd = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("_mix_extra", "_MIX_d", "_mix_key", "_own0", "count", "n")})
    out = op8_source_mixing.mix(odd, op8_source_mixing.WEIGHTS, 200)
    assert set(odd.columns) <= set(out.columns)
    for r in out.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in odd.columns[5:])
    same = lambda d: sorted((r["doc_id"], r["n_tokens"], r["copies"]) for r in d.collect())
    assert same(out) == same(plain)
