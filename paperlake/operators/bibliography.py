"""A whole bibliography as files: records in order, with citation keys that no two of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import export
from paperlake.operators import paging
from paperlake.operators.paging import numbered
from paperlake.storage import shared_folder

#: Rounds of suffixes: after the first one only keys that happen to look like another's suffixed form go on.
ROUNDS = 20


def suffix(place: str) -> Column:
    """1 -> a, 26 -> z, 27 -> aa, and so on, of a column."""
    step = "CASE WHEN a.n > 0 THEN named_struct('n', (a.n - 1) div 26, 's', concat(char(97 + (a.n - 1) % 26), a.s)) ELSE a END"
    return F.expr(f"aggregate(sequence(1, 14), named_struct('n', cast({place} AS bigint), 's', ''), (a, i) -> {step}, a -> a.s)")


def two_signs(place: str) -> Column:
    """1 -> a, 26 -> z, 27 -> aa as ``suffix`` has them, but two signs at most: after zz (702) the first one goes on through Unicode, {a, {b, and so on."""
    point = f"decode(unhex(lpad(hex(96 + ({place} - 1) div 26), 8, '0')), 'UTF-32')"
    return F.expr(f"concat(CASE WHEN {place} > 26 THEN {point} ELSE '' END, char(97 + ({place} - 1) % 26))")


def unique_keys(rows: DataFrame, key: str, order: list[str], suffix: Callable[[str], Column] = suffix) -> DataFrame:
    """The same rows with ``key`` made unique: those that share one get a, b, ... in ``order``, over the whole table.

    A key that a suffix makes equal to another's own is given one as well, until none is shared. Rows of a shared key are
    numbered by ranges, however many they are.
    """
    shared_folder(rows.sparkSession)
    for _ in range(ROUNDS):
        placed = numbered(rows, [key], order)
        rows = placed.withColumn(key, F.when(F.col("total") > 1, F.concat(F.col(key), suffix("place"))).otherwise(F.col(key))).drop("place", "total").checkpoint()
        if rows.groupBy(key).count().where("count > 1").isEmpty():
            return rows
    raise RuntimeError("keys did not become unique")


def sorting(sort: str | None) -> list[tuple[str, bool]]:
    """``date desc`` and the like to columns and directions; by identifier without one."""
    names = {"date": "year", "citation_count": "citation_count", "read_count": "read_count", "bibcode": "bibcode", "first_author": "first_author", "title": "first_title"}
    if not sort:
        return [("bibcode", False)]
    found = []
    for part in sort.split(","):
        name, _, direction = part.strip().partition(" ")
        if name not in names or direction not in ("asc", "desc"):
            raise ValueError(f"cannot sort an export by {part.strip()!r}")
        found.append((names[name], direction == "desc"))
    return found


def bibliography(
    records: DataFrame, format: str, sort: str | None = None, max_author: int | None = None, cutoff: int | None = None,
    journal_format: int | None = None, key_format: str | None = None, custom_format: str | None = None,
    suffix: Callable[[str], Column] = suffix,
) -> tuple[DataFrame, list[Column]]:
    """The records' texts (bibcode, cite_key, record) and their order. Keys are unique in formats that have them, by ``suffix`` of their place."""
    keys = sorting(sort)
    rows = records.withColumns(
        {"first_author": F.try_element_at("author", F.lit(1)), "first_title": F.try_element_at("title", F.lit(1)), "cite_key": export.cite_key(key_format)}
    )
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in [*keys, ("bibcode", False)]]
    rows = rows.withColumn("pub", export.journal(F.col("pub"), journal_format))
    if format.startswith("bibtex"):
        rows = unique_keys(rows, "cite_key", ["bibcode"], suffix)
    text = export.record(format, custom_format, max_author, cutoff, cited_as=F.col("cite_key"))
    return rows.withColumn("record", text), order


def write_bibliography(records: DataFrame, folder: str, **options) -> None:
    """Text files that hold the bibliography when they are read one after another, by name: ranges of its order, sorted."""
    rows, order = bibliography(records, **options)
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // paging.RANGE_ROWS))
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged.select(F.regexp_replace("record", "\n$", "").alias("value")).write.text(folder)


def read_bibliography(spark: SparkSession, folder: str) -> DataFrame:
    """Files as rows: name and text."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
