"""Sorted pages of a result with the number of all rows, pages by key, and places in a whole order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from paperlake.functions.text import worked_out
from paperlake.storage import shared_folder


def page(rows: DataFrame, order: list[Column], start: int = 0, limit: int = 10) -> DataFrame:
    """Rows ``start`` to ``start + limit`` in order, with num_found and has_more.

    Rows are read once: they are counted by an observation on their way into the top-k of start + limit
    rows, which runs here; what is returned holds the page. has_more goes by the rows asked for. The
    generator before it hides how many rows there are at most: where that is known to be few, the optimizer would
    take the limit away and sort over sampled ranges, which reads, and counts, twice.
    """
    seen = Observation()
    top = worked_out(rows).observe(seen, F.count(F.lit(1)).alias("num_found")).orderBy(*order).offset(start).limit(limit)
    shown = rows.sparkSession.createDataFrame(top.collect(), rows.schema)
    found = F.lit(seen.get["num_found"]).cast("long")
    return shown.withColumns({"num_found": found, "has_more": found > start + limit})


@dataclass(frozen=True)
class Keys:
    """A total order by columns, nulls last: (column, whether descending), the last of them unique and not null."""

    columns: tuple[tuple[str, bool], ...]

    def order(self) -> list[Column]:
        return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in self.columns]

    def after(self, values: dict) -> Column:
        """Whether a row comes after the one with these values."""
        found, equal = F.lit(False), F.lit(True)
        for c, down in self.columns:
            value = values[c]
            if value is None:  # nulls come last, so nothing follows in this column
                equal = equal & F.col(c).isNull()
                continue
            beyond = F.col(c) < F.lit(value) if down else F.col(c) > F.lit(value)
            found = found | equal & (beyond | F.col(c).isNull())
            equal = equal & (F.col(c) == F.lit(value))
        return found


def page_after(rows: DataFrame, keys: Keys, last: dict | None = None, limit: int = 10) -> DataFrame:
    """The ``limit`` rows that follow the row with the key values ``last`` (the first ones without it).

    The condition is a filter that the scan takes, and the top-k holds ``limit`` rows however far the page
    lies from the first.
    """
    return (rows if last is None else rows.where(keys.after(last))).orderBy(*keys.order()).limit(limit)


#: Rows of one range of a whole order, about.
RANGE_ROWS = 500_000


def numbered(rows: DataFrame, group: list[str], order: list[str], place: str = "place", total: str = "total") -> DataFrame:
    """Adds place (from 1, ascending in ``order`` within each group, nulls first) and total (rows of the group).

    The rows are sorted over as many ranges as they need, however many of them one group holds, and by where they were
    read where they agree in all of that; what is numbered is written first, so a task that runs again finds the
    same ranges.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    read_at, part, at, first, before, n = (f"_{c}_of_{place}" for c in ("read_at", "part", "at", "first", "before", "n"))
    given = rows.withColumn(read_at, F.monotonically_increasing_id()).checkpoint()
    by = [*group, *order, read_at]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // RANGE_ROWS))
    ranged = given.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop(read_at)
    fixed = ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}).checkpoint()
    #: One row a group and range that holds it.
    runs = fixed.groupBy(*group, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    within = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum(n).over(within.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({before: earlier, total: F.sum(n).over(within)}).drop(n)
    same = F.lit(True)
    for c in (*group, part):
        same = same & F.col(f"rows.{c}").eqNullSafe(F.col(f"runs.{c}"))
    joined = fixed.alias("rows").join(runs.alias("runs"), same).select("rows.*", f"runs.{first}", f"runs.{before}", f"runs.{total}")
    return joined.withColumn(place, F.col(before) + F.col(at) - F.col(first) + 1).drop(part, at, first, before)
