"""Running counts inside a group without putting the group in one task.

A plain window would sort a whole group in one task; here the order axis is cut into
blocks of ``block`` values. A block holds at most ``block`` rows when the order values
are unique within the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def reset_count(df: DataFrame, part: str, order: str, reset: str, flag: str, resets: str, out: str,
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """Append ``resets`` (reset rows of the group at or before the row) and ``out``
    (flagged rows since the last of them). A reset row is not flagged.

    One blocked pass for both: running counts inside a (group, block); per block its
    resets and the flagged rows after the last one; a window over these small rows
    carries both into the next blocks; one join brings them back. A null group is a
    group of its own; rows with a null order value come last in theirs."""
    d = df.withColumn("_blk", F.floor(F.col(order) / block))
    local = Window.partitionBy(part, "_blk").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at_reset = F.when(F.col(reset), F.col("_seen"))
    d = (d.withColumn("_resets", F.sum(F.col(reset).cast("long")).over(local))
         .withColumn("_seen", F.sum(F.col(flag).cast("long")).over(local))
         .withColumn("_base", F.coalesce(F.max(at_reset).over(local), F.lit(0))))
    blocks = d.groupBy(part, "_blk").agg(F.max("_resets").alias("_c"),
                                         (F.max("_seen") - F.max("_base")).alias("_tail"))
    before = Window.partitionBy(part).orderBy(F.col("_blk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carried = (blocks.withColumn("_c_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
               .withColumn("_tails", F.coalesce(F.sum("_tail").over(before), F.lit(0))))
    since = F.last(F.when(F.col("_c") > 0, F.col("_tails")), ignorenulls=True).over(before)
    carried = carried.select(F.col(part).alias("_part"), F.col("_blk").alias("_at"), "_c_before",
                             (F.col("_tails") - F.coalesce(since, F.lit(0))).alias("_carry"))
    carry = F.when(F.col("_resets") == 0, F.col("_carry")).otherwise(F.lit(0))
    return (d.join(carried, F.col(part).eqNullSafe(F.col("_part")) & F.col("_blk").eqNullSafe(F.col("_at")))
            .withColumn(resets, (F.col("_c_before") + F.col("_resets")).cast("long"))
            .withColumn(out, (F.col("_seen") - F.col("_base") + carry).cast("long"))
            .drop("_blk", "_resets", "_seen", "_base", "_c_before", "_carry", "_part", "_at"))
