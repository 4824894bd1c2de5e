"""Identifiers of many kinds to records: a table bucketed by canonical form, which lookups join without moving it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.text import column, once, strip_version, trim_all
from paperlake.storage import shared_folder

BUCKETS = 64


def canonical(identifier: str | Column) -> Column:
    """One form for an identifier's spellings; null for null and empty ones.

    Preprint ids lose the site's address, ``arXiv:`` and their version, and the archive's name is in lower case; DOIs lose the
    resolver's address and ``doi:`` and are in lower case, as they do not differ by case; all else only loses white space around it.
    """
    def form(raw: Column) -> Column:
        doi = F.regexp_extract(raw, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{4,9}/\S+|10\.\d+/\S+)$", 1)
        preprint = r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:\s*)?(\d{4}\.\d{4,}(?:v\d+)?|[a-z-]+(?:\.[a-z]{2})?/\d{7}(?:v\d+)?)(?:\.pdf)?$"
        number = once(strip_version(F.regexp_extract(raw, preprint, 1)), lambda n: F.when(n != "", F.concat(F.lit("arxiv:"), F.lower(n))))
        found = once(doi, lambda d: F.when(d != "", F.concat(F.lit("doi:"), F.lower(d))).otherwise(number))
        return F.when(raw != "", F.coalesce(found, raw))

    return once(trim_all(column(identifier)), form)


def build(records: DataFrame, name: str, folder: str, buckets: int = BUCKETS) -> None:
    """Write records(id, identifier array) to ``folder``: key, id; bucketed and sorted by key.

    An identifier that several records claim belongs to the smallest id. ``opened`` makes a table of the files, wherever they
    have been moved to; ``name`` serves for the time of writing only.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a table's name has letters, digits and underscores")
    each = records.select("id", F.explode("identifier").alias("identifier")).select(canonical("identifier").alias("key"), "id").where("key IS NOT NULL")
    one = each.groupBy("key").agg(F.min("id").alias("id"))
    one.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").option("path", folder).saveAsTable(f"{name}_made")
    records.sparkSession.sql(f"DROP TABLE {name}_made")  # the files stay


def opened(spark: SparkSession, name: str, folder: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The table, made known to a session that does not know it yet."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def resolve(asked: DataFrame, known: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Every row of ``asked`` with key and id; unknown identifiers, and null ones, have a null id.

    Rows move to the table's buckets by their key; the table stays where it is. A key that over one in a thousand
    rows ask for, known or not, is looked up once and broadcast (fewer than a thousand of them), and null keys do not move.
    Canonical forms are worked out once, and written, as the rows are read to count keys and for both kinds of lookup.
    """
    shared_folder(asked.sparkSession)
    keyed = asked.withColumn("key", canonical(identifier)).checkpoint()
    times = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("times"))
    often = times.where(F.col("times") * 1000 > F.lit(keyed.count())).join(known, "key", "left")
    marked = keyed.join(F.broadcast(often.select("key", F.col("id").alias("often_id"), F.lit(True).alias("often"))), "key", "left")
    direct = marked.where("key IS NULL OR often").select(*asked.columns, "key", F.col("often_id").alias("id"))
    rest = marked.where("key IS NOT NULL AND often IS NULL").join(known, "key", "left").select(*asked.columns, "key", "id")
    return direct.unionByName(rest)
