"""Order within groups of any size: neighbours, places, running sums and order statistics.

Rows are range-partitioned by group and order, so a huge group covers many partitions, and each partition sorts what it has.
What crosses between partitions is a row for each group and partition: the border row, for neighbours, or the sum of what is
ahead, for running sums. It joins the partition's rows as a ghost, so that one window over (partition, group) sees it.

`order` should tell the rows of a group apart; rows that it doesn't are taken in any order, and stand in one partition. Null
groups are groups, null values come first. An empty `by` is one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.checkpoints import cut

PART, GHOST, SUM = "__part", "__ghost", "__sum"


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows in ranges of (by, order), checkpointed, with the number of the range."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cut(rows.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()))


def _window(by: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(PART, *by).orderBy(*order)


def beside(rows: DataFrame, by: list[str], order: list[str], uses: list[str], make: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows plus the columns that make(window) gives, which look one row ahead or back at `order` and `uses`."""
    ranges = rows if PART in rows.columns else dealt(rows, by, order)
    held = list(dict.fromkeys([*by, *order, *uses]))
    row, place = F.struct(*held), F.struct(*order)
    ends = ranges.groupBy(PART, *by).agg(F.min_by(row, place).alias("head"), F.max_by(row, place).alias("tail"))
    across = Window.partitionBy(*by).orderBy(PART)
    back = ends.select(F.lag(PART).over(across).alias(PART), "head.*")
    ahead = ends.select(F.lead(PART).over(across).alias(PART), "tail.*")
    ghosts = back.unionByName(ahead).filter(F.col(PART).isNotNull()).withColumn(GHOST, F.lit(True))
    every = ranges.withColumn(GHOST, F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    out = every.withColumns(make(_window(by, order))).filter(~F.col(GHOST)).drop(GHOST)
    return out if rows is ranges else out.drop(PART)


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows plus the sum of value from the group's first row to this one."""
    ranges = (rows if PART in rows.columns else dealt(rows, by, order)).withColumn(SUM, value)
    sums = ranges.groupBy(PART, *by).agg(F.sum(SUM).alias("own"))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ghosts = sums.withColumn(SUM, F.sum("own").over(before)).filter(F.col(SUM).isNotNull()).drop("own").withColumn(GHOST, F.lit(True))
    every = ranges.withColumn(GHOST, F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    upto = _window(by, [F.desc(GHOST), *order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = every.withColumn(name, F.sum(SUM).over(upto)).filter(~F.col(GHOST)).drop(GHOST, SUM)
    return out if PART in rows.columns else out.drop(PART)


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """rows plus their place in the group, from 1."""
    return running(rows, by, order, F.lit(1).cast("long"), name)


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row for each group with values (not null) that stand at the given places, from 0, of its n values in order.

    Distinct values are counted first. Counts of partitions say which one holds a place, and only that one is looked through.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    ranges = dealt(counts, by, [value])
    own = ranges.groupBy(PART, *by).agg(F.sum("times").alias("own"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"n": F.sum("own").over(group), "start": F.sum("own").over(upto) - F.col("own")})
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), place(F.col("n")).cast("long").alias("place")) for k, place in places.items()))
    asked = own.withColumn("ask", F.explode(wanted)).select(F.col(PART).alias("p"), *(F.col(c).alias(f"b{i}") for i, c in enumerate(by)), "start", "own", "ask.*")
    asked = asked.filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("own")))
    same = F.col(PART) == F.col("p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"b{i}"))
    local = Window.partitionBy(PART, *by, "k").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranges.join(asked, same).withColumn("upto", F.col("start") + F.sum("times").over(local))
    found = found.filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("times") <= F.col("place")))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("k") == k, F.col(value))).alias(k) for k in places))


def upper_median(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return at_places(rows, by, value, {name: lambda n: F.floor(n / 2)})


def median(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The mean of the two values in the middle."""
    both = at_places(rows, by, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.floor(n / 2)})
    return both.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias(name))
