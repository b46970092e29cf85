"""Fill-in-middle transformation: texts become prefix, suffix and middle with marks between them.

A text is a sequence of units (a run of ASCII letters, or any other code point). Both places where it is cut are ranks of units, drawn from a
keyed hash of the document's id. The matcher goes over the text twice and keeps no unit: the first pass counts the matches, the second
advances a lazy match iterator to the lower rank and on to the higher one, where the matches' ends are the places to cut. Nothing is shuffled; beside a text
and its output a task holds a few numbers.

Defined results: null and empty texts have no units and stay plain (an empty output); a null id is hashed as no digits; a text that holds one of the marks stays plain, so
outputs are always readable; repeated rows give repeated rows; a text of any length is cut as a whole; an empty table gives an empty
one; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: Units of a text, left to right.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Documents in a hundred that are cut, and of these in a hundred those whose suffix comes first.
CUT_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
#: Characters of output that leave a task at once.
OUT_CHARS = 1 << 20


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: how many matches a text has."""
    counted = deque(enumerate(unit.finditer(text), 1), maxlen=1)  # keeps the last pair only
    return counted[0][0] if counted else 0


def cut_places(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where ``low`` and ``high`` matches end (low <= high)."""
    matches = unit.finditer(text)

    def after(steps: int, here: int) -> int:
        last = next(islice(matches, steps - 1, None), None) if steps else None
        return here if last is None else last.end()

    first = after(low, 0)
    return first, after(high - low, first)


def _check_marks(marks: tuple[str, str, str]) -> None:
    """A text without marks must not make one together with a mark beside it."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError(f"marks {a!r} and {b!r} can overlap, so an output would not be readable")


def _numbers(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _transform(unit: str, marks: tuple[str, str, str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        p, s, m = marks
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows, began, size = [], 0, 0
            flag, h1, h2 = (b.column(k).to_pylist() for k in (2, 3, 4))
            for i, text in enumerate(b.column(1)):
                t = text.as_py() or ""
                n = count_units(pattern, t)
                if flag[i] == "plain":
                    rows.append((n, "plain", None, None, t))
                else:
                    x, y = sorted((h1[i] % (n + 1), h2[i] % (n + 1)))
                    x, y = cut_places(pattern, t, x, y)
                    out = f"{p}{t[:x]}{s}{t[y:]}{m}{t[x:y]}" if flag[i] == "psm" else f"{s}{t[y:]}{p}{t[:x]}{m}{t[x:y]}"
                    rows.append((n, flag[i], x, y - x, out))
                size += len(t)
                if size >= OUT_CHARS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(began, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
                    rows, began, size = [], i + 1, 0

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, marks: tuple[str, str, str] = MARKS, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED
) -> DataFrame:
    """Id, ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and the ``output`` text of each row.

    ``psm`` is prefix, suffix, middle, each led by its mark; ``spm`` has the suffix first. Units are matches that cover the whole text.
    """
    _check_marks(marks)
    h1, h2, h3, h4 = _numbers(id_col, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for x in marks:
        marked = marked | F.contains(text, F.lit(x))
    form = F.when((F.length(text) == 0) | marked | (h3 % 100 >= cut_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    out = src.mapInArrow(_transform(unit, marks, names), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text that an output was made of, from the output and its form alone."""
    lead, second = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((marks[0], marks[1]), (marks[1], marks[0])))
    at2, at3 = F.position(second, output), F.position(F.lit(marks[2]), output)
    one = F.substring(output, F.length(lead) + 1, at2 - F.length(lead) - 1)
    two = F.substring(output, at2 + F.length(second), at3 - at2 - F.length(second))
    middle = F.substring(output, at3 + len(marks[2]), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut by its id's hash, and the digest of its output and of the text rebuilt from that."""
    out = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
