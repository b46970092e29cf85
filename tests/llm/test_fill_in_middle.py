"""op13 against a plain version, and the exact way back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from nightgrid.llm import op13_fill_in_middle as op13

LONG = "wörd x9 " * 40_000
TEXTS = ["one two", "", None, " \n\t", "a", "é", "has <P> inside", "<S", "x<", "<M>", "née 12ab\r\n", "日本語 text ñ", "<<P", LONG, "A" * 9000, "\x0b\x1c end"]


def plain(doc_id, text, seed=1):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("id", "form", "output", "h1", "n")})


def test_against_plain_version_and_back(spark):
    rows = [(37 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, None), (4, "twice"), (4, "twice")]
    out = op13.fill_in_middle(frame(spark, rows))
    back = out.withColumn("back", op13.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in back), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(t or "")
    assert all(r["back"] in want[r["doc_id"]] for r in back)


def test_empty_table_and_other_parameters(spark):
    assert op13.fill_in_middle(frame(spark, []).limit(0)).collect() == []
    df = spark.createDataFrame([(k, f"line {k}\nnext — {k}") for k in range(60)], "key int, body string")
    out = op13.fill_in_middle(df, "key", "body", unit=r"\w+|\W", marks=("[pre]", "[suf]", "[mid]"), cut_percent=100, spm_percent=50, seed=9)
    assert out.schema["key"].dataType.simpleString() == "int"
    rows = out.withColumn("back", op13.restored(F.col("form"), F.col("output"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"}
    assert all(r["back"] == f"line {r['key']}\nnext — {r['key']}" for r in rows)


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P", "P<", "<M>"), ("", "<S>", "<M>")])
def test_marks_that_could_overlap_are_refused(spark, marks):
    with pytest.raises(ValueError):
        op13.fill_in_middle(frame(spark, [(1, "x")]), marks=marks)


def test_matcher_counts_and_cuts():
    unit = re.compile(op13.UNIT)
    assert op13.count_units(unit, "") == 0 and op13.count_units(unit, "ab, c") == 4
    assert op13.cut_places(unit, "ab, c", 0, 0) == (0, 0)
    assert op13.cut_places(unit, "ab, c", 1, 4) == (2, 5)
    assert op13.cut_places(unit, "ab, c", 2, 2) == (3, 3)
