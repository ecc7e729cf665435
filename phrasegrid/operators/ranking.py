"""Positions and running sums within groups, without a group in one task.

Rows are range-partitioned by group and order, so a group that holds a third of all rows lies in many partitions. What
the earlier partitions of a group hold comes from one small aggregation; the rest is counted within the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def running(df: DataFrame, keys: list[str], order: list[Column], position: str = "position", total: str | None = None) -> DataFrame:
    """``df`` with the 0-based ``position`` of each row in its group and, of a column ``total``, ``<total>_before``: its sum
    over the earlier rows. ``order`` must tell rows apart for a result that is the same in every run. A null key is a
    group; a null in ``total`` counts 0. The rows are written once, so that both passes see the same partitions.
    """
    ranged = df.repartitionByRange(*(F.col(k) for k in keys), *order)
    stored = materialize(ranged.withColumn("__part", F.spark_partition_id()), "running")
    value = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    cells = stored.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"),
    )
    local = Window.partitionBy(*keys, "__part").orderBy(*order)
    rows = stored.withColumn("__at", F.row_number().over(local) - 1)
    if total:
        rows = rows.withColumn("__sum", F.coalesce(F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(cells, same)
    added = {position: (F.col("__at") + F.col("__n0")).cast("bigint")}
    if total:
        added[f"{total}_before"] = F.col("__sum") + F.col("__s0")
    return out.withColumns(added).select(*df.columns, *added)
