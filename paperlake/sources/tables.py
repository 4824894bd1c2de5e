"""Stand-ins for the scholarly tables over the driver's Parquet tables, and schemas of real ones.

Schemas are fixed; nothing is inferred. The stand-ins are declared as such: a part is a
cited paper, an order a citing one, a line item an edge, an event a read or a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_INDEX = "id string, source_file string, source_url string, doc_type string, category string, title string, section string, subsection string, content string, char_count int"
PAPER = "bibcode string, title array<string>, author array<string>, year string, pubdate string, abstract string, citation_count bigint, read_count bigint, doi array<string>, arxiv_id string, pub string, volume string, page array<string>, keyword array<string>, identifier array<string>"
GRAPH_NODE = "paperId string, title string, year int, authors array<struct<name:string>>, externalIds map<string,string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documentation chunks, in its order."""
    return spark.read.schema(DOC_INDEX).json(path, multiLine=True).withColumn("ordinal", F.monotonically_increasing_id())


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as documentation chunks; the index order is doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc-"), "doc_id", F.lit("_page")).alias("source_file"), F.lit("").alias("source_url"), F.lit("doc").alias("doc_type"),
        F.col("lang").alias("category"), F.regexp_extract("text", "^([^\n]*)", 1).alias("title"), F.when(
            F.col("source") != "src0", F.col("source")
        ).alias("section"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("subsection"), F.col("text").alias("content"), F.col("doc_id").alias("ordinal"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citing order, cited part), once for every line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (citing order, cited part) pairs."""
    return pairs(spark, sf_dir).distinct()


def cited_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
    )


def citing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"), F.year("o_orderdate").cast("long").alias("year"),
        F.array("o_orderpriority", "o_orderstatus").alias("categories"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("refereed"),
    )


def collection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks add, errors remove, purchases set a note and sign-ups delete it."""
    action = F.create_map(*(F.lit(x) for x in ("click", "add", "error", "remove", "purchase", "set", "signup", "delete")))
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("library_id"), F.get_json_object("props", "$.k").cast("long").alias("doc_id"), action[F.col("event_type")].alias("action"),
        F.round("value", 6).alias("content"), F.when(F.col("user_id") % 3 == 0, "owner").otherwise("collaborator").alias("permission"), "ts", "event_id",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").alias("author"), F.get_json_object("props", "$.k").cast("long").alias("paper"), "ts", "event_id")
