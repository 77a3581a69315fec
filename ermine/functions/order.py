"""Places of rows in their groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def placed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row in its group, from 0, by ``order``.

    Rows are range-partitioned over (group, order), so a large group is spread over many tasks; a row's place is its
    place in its partition after the rows of its group in the partitions before, of which there is one count each.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    own = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = own.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_g").orderBy("_part")) - F.col("_n")
    runs = cut_lineage(runs.select("_g", "_part", (before - F.col("_first")).alias("_add")))
    j = own.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_part")))
    return j.withColumn(name, F.col("_at") + F.col("_add")).drop("_g", "_part", "_add", "_at")
