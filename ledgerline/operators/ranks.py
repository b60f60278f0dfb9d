"""Global row numbers and predecessors in key order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, which is what grows with the data."""
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Distinct keys that are sampled for each range.
SAMPLED = 20


def bounds(keys: DataFrame, slots: int) -> list:
    """At most slots - 1 ascending keys that split the one column of keys into ranges of about as many distinct keys each.

    They are values on the driver, of SAMPLED keys a range that their hashes choose. A plan that reads its ranges twice
    needs them: repartitionByRange samples again each time, and what it calls range 3 need not be the same keys.
    """
    key = F.col(keys.columns[0])
    count = keys.agg(F.approx_count_distinct(key)).first()[0]
    picked = keys.where(key.isNotNull() & (F.pmod(F.xxhash64(key), F.lit(max(1, count // (SAMPLED * slots)))) == 0))
    found = picked.agg(F.sort_array(F.collect_set(key))).first()[0]
    return [found[i] for i in sorted({len(found) * n // slots for n in range(1, slots)})] if found else []


def slot_of(key: Column | str, cuts: list) -> Column:
    """How many of the ascending cuts are at or below key, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    key, table = F.col(key) if isinstance(key, str) else key, F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(table, n + step - 1) <= key, step).otherwise(0))


def numbered(rows: DataFrame, *keys: str, out: str = "rn", before: str | None = None, slots: int | None = None) -> DataFrame:
    """rows with their place (from 1) in the order of keys; with before, also the first key of the row before.

    Rows are split into ranges; places inside a range come from a window, and a table with one row a range says
    how many rows, and which last key, lie below it. Keys must be unique for `before` to be defined.
    """
    slots = slots or ranges(rows)
    both = rows.repartitionByRange(slots, *keys).withColumn("__slot", F.spark_partition_id())
    inner = Window.partitionBy("__slot").orderBy(*keys)
    below = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = both.groupBy("__slot").agg(F.count("*").alias("__n"), F.max(keys[0]).alias("__top"))
    per_slot = per_slot.select("__slot", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__base"), F.max("__top").over(below).alias("__edge"))  # `slots` rows
    found = both.withColumn("__rn", F.row_number().over(inner))
    if before:
        found = found.withColumn("__lag", F.lag(keys[0]).over(inner))
    found = found.join(F.broadcast(per_slot), "__slot").withColumn(out, (F.col("__base") + F.col("__rn")).cast("long"))
    if before:
        found = found.withColumn(before, F.coalesce("__lag", "__edge"))
    return found.drop("__slot", "__rn", "__lag", "__base", "__edge")
