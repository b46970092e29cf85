"""Generators as table functions of SQL (survey 2.12): ``SELECT * FROM slow_wave_features(TABLE(signals) PARTITION BY subject_id)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from . import generators

#: Columns of the table argument, in any order; ``lane`` may be absent.
COLUMNS = ("subject_id", "channel", "lane", "chunk_id", "fs", "units", "samples")


def table_function(name: str, id_type: str = "bigint", **options):
    """A generator as a function of a table of chunks, partitioned by subject: a partition's batches are one recording, whose tracks are the result."""
    kernel, wanted = generators.kernel((name,), **{name: options}), pa.array(sorted(generators.GENERATORS[name][2].channels))

    class Generator:
        def __init__(self):
            self.batches: list[pa.RecordBatch] = []

        def eval(self, chunks: pa.RecordBatch):
            mine = chunks.filter(pc.is_in(chunks.column("channel"), wanted))  # other channels are not kept
            if mine.num_rows:
                self.batches.append(mine)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if not self.batches:
                return
            table = pa.Table.from_batches(self.batches)
            if "lane" not in table.column_names:
                table = table.append_column("lane", pa.array([0] * table.num_rows, pa.int32()))
            yield kernel(table.select(COLUMNS))

    return arrow_udtf(Generator, returnType=f"subject_id {id_type}, {generators.TRACK_SCHEMA}")


def register(spark: SparkSession, id_type: str = "bigint", names: tuple[str, ...] | None = None, **options: dict) -> list[str]:
    """Makes generators (all) known to SQL under their names; subjects are of ``id_type``."""
    done = list(names or generators.GENERATORS)
    for n in done:
        spark.udtf.register(n, table_function(n, id_type, **options.get(n, {})))
    return done
