"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, op10_quality_rules as rules
from .op1_suffix_array import op1_suffix_array
from .op10_quality_rules import op10_quality_rules
from .op11_deleted_interpolation import op11_deleted_interpolation
from .op12_token_alignment import op12_token_alignment
from .op13_fill_in_middle import op13_fill_in_middle
from .op2_line_dedup import op2_line_dedup
from .op3_jaccard_join import op3_jaccard_join
from .op4_surrogates import op4_surrogates
from .op5_decontamination import op5_decontamination
from .op6_phrase_automata import op6_phrase_automata
from .op7_language_id import op7_language_id
from .op8_source_mixing import op8_source_mixing
from .op9_chat_repair import op9_chat_repair
from .shared import read_table


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that its contract fixes, which SQL can express; the verdict of the learned list is not among them."""
    docs = rules.with_statistics(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return docs.select("doc_id", *[F.col(f"_qr_stats.{n}").alias(n) for n in names], rules.base_failed("_qr_stats").alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_surrogates": op4_surrogates,
    "op5_decontamination": op5_decontamination,
    "op6_phrase_automata": op6_phrase_automata,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_chat_repair": op9_chat_repair,
    "op10_quality_rules": op10_quality_rules,
    "op11_deleted_interpolation": op11_deleted_interpolation,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
    "quality_base_columns": quality_base_columns,
}

#: DuckDB SQL over whole tables. Operators without an entry are tested against plain versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array": oracle.OP1,
    "op2_line_dedup": oracle.OP2,
    "op3_jaccard_join": oracle.OP3,
    "op6_phrase_automata": oracle.OP6,
    "op13_fill_in_middle": oracle.OP13,
    "quality_base_columns": oracle.OP10_BASE,
}
