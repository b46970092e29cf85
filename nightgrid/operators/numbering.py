"""Row numbers of a whole table in a given order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightgrid.sources.scratch import written


def numbered(df: DataFrame, *by: Column | str, name: str = "n") -> DataFrame:
    """``df`` with ``name`` from 0 on, in the order of ``by``; rows that tie come in any order, each with a number of its own.

    Rows are range-partitioned, sorted and stored together with their partition's number and their place in it: a second run of a range
    partitioning could draw other bounds, so the numbers are only ever taken from what is stored. What the partitions before hold is a table of one row a partition.
    """
    clash = {"_part", "_place", "_before", name} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    cols = [F.col(c) if isinstance(c, str) else c for c in by]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    s = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumns({"_part": F.spark_partition_id(), "_place": place})
    s = written(s, "numbered")
    size = s.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = size.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))  # one row a partition
    return s.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
