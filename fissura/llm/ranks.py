"""Places in a global order without a global sort: directories of counts, and ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fissura.llm.shared import stored

FAN = 12  # bits of a key that a level of a directory decides
RANGE = 100_000  # values in a range that one task numbers


def prefix_sums(counts: DataFrame, group: list[str], key: str, value: str, lowest: int, highest: int) -> DataFrame:
    """``counts`` with ``before``: the sum of ``value`` over the smaller keys of the same group.

    ``key`` is a long, unique in its group, from ``lowest`` to ``highest``;
    ``group`` has no nulls. Counts are added up over prefixes of the key, level by
    level, and the sums come down again. A window holds at most ``2**FAN`` rows,
    whatever a group holds. Give a stored table: it is read at every level.
    """
    fan = 1 << FAN
    levels = [counts.withColumn("_at", F.col(key) - lowest)]
    span = highest - lowest
    while span >= fan:
        span >>= FAN
        up = levels[-1].groupBy(*group, F.shiftright("_at", FAN).alias("_at"))
        levels.append(up.agg(F.sum(value).alias(value)))
    above = None
    for level in reversed(levels):
        level = level.withColumn("_above", F.shiftright("_at", FAN))
        earlier = Window.partitionBy(*group, "_above").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("bigint")))
        if above is not None:
            level = level.join(above, [*group, "_above"]).withColumn("before", F.col("before") + F.col("_base"))
        above = level.select(*group, F.col("_at").alias("_above"), F.col("before").alias("_base"))
    return level.select(*counts.columns, "before")


def places(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``place``, from 0, in the order of ``column``, whose values differ.

    Values are dealt into ranges of about ``RANGE``; the driver gets one count a
    range. The ranges are stored, so a task run again numbers the same rows.
    """
    n = max(1, -(-values.count() // RANGE))
    ranged = stored(values.repartitionByRange(n, column).withColumn("_range", F.spark_partition_id()), "ranges")
    before, starts = 0, [F.lit(0), F.lit(0).cast("bigint")]
    for at, count in sorted(tuple(r) for r in ranged.groupBy("_range").count().collect()):
        starts += [F.lit(at), F.lit(before).cast("bigint")]
        before += count
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    start = F.element_at(F.create_map(*starts[2:] or starts), F.col("_range"))
    return ranged.withColumn("place", within + start).drop("_range")
