"""Citation graph over an edge table ``edges(citing, cited)`` of distinct pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators.paging import numbered


def neighbours(edges: DataFrame, papers: DataFrame, paper_id: int, relationship: str, order: list[Column], limit: int) -> DataFrame:
    """Papers that cite ``paper_id`` (citations) or that it cites (references), in order."""
    here, there = {"citations": ("cited", "citing"), "references": ("citing", "cited")}[relationship]
    ids = edges.where(F.col(here) == paper_id).select(F.col(there).alias("id"))
    return papers.join(ids, "id").orderBy(*order).limit(limit)


def references(edges: DataFrame, papers: DataFrame, paper_id: int, limit: int) -> DataFrame:
    """Papers that ``paper_id`` cites, by their citations, then id: only these papers' citations are counted."""
    ids = edges.where(F.col("citing") == paper_id).select(F.col("cited").alias("id"))
    counted = citation_counts(edges.join(ids.withColumnRenamed("id", "cited"), "cited", "left_semi"))
    found = papers.join(ids, "id").join(counted, "id").withColumnRenamed("citation_count", "citations")
    return found.orderBy(F.desc("citations"), F.asc("id")).limit(limit)


def ego_graph(edges: DataFrame, citing: DataFrame, cited: DataFrame, paper_id: int) -> DataFrame:
    """Both directions of one hop; neighbours without a record keep their id and null fields.

    The edges are read once, for both directions.
    """
    end = lambda here, direction, there: F.when(F.col(here) == paper_id, F.struct(F.lit(direction).alias("direction"), F.col(there).alias("id")))
    ends = F.array_compact(F.array(end("cited", "citation", "citing"), end("citing", "reference", "cited")))
    near = edges.where((F.col("cited") == paper_id) | (F.col("citing") == paper_id)).select(F.inline(ends))
    side = lambda direction, records: near.where(F.col("direction") == direction).join(records, "id", "left")
    fields = [c for c in citing.columns if c != "id"]
    return side("citation", citing).unionByName(side("reference", cited)).select("direction", "id", *fields)


def numbered_ego(flat: DataFrame, paper_id: str) -> DataFrame:
    """Every neighbour as a row: paper_id, direction, place (by id, from 1), the record, citation_count and reference_count.

    ``flat`` is worked out once. No task or row holds the whole neighbourhood of a much cited paper; ``nested_ego``
    makes arrays of it, for papers of few neighbours.
    """
    placed = numbered(flat, ["direction"], ["id"])
    count = lambda d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("total"))), F.lit(0)).alias(f"{d}_count")
    #: One row, proven by the global aggregate; all places have been worked out.
    counts = F.broadcast(placed.agg(count("citation"), count("reference")))
    return placed.drop("total").crossJoin(counts).withColumn("paper_id", F.lit(paper_id))


def nested_ego(flat: DataFrame, paper_id: str, most: int | None = None) -> DataFrame:
    """One row: paper_id, counts, and the neighbours of each direction by id as arrays of structs.

    All of them are in the one row, from one pass, unless ``most`` asks for so many only; counts are of all.
    """
    row = F.struct(*(c for c in flat.columns if c != "direction"))
    count = lambda d: F.count_if(F.col("direction") == d).alias(f"{d}_count")
    whole = lambda d: F.sort_array(F.collect_list(F.when(F.col("direction") == d, row)))
    shown = lambda d: (whole(d) if most is None else F.slice(whole(d), 1, most)).alias(f"{d}s")
    return flat.agg(F.lit(paper_id).alias("paper_id"), count("citation"), count("reference"), shown("citation"), shown("reference"))


def node_fields(nodes: DataFrame) -> DataFrame:
    """Graph nodes (``tables.GRAPH_NODE``) to id, title, year, author names and preprint id: nested fields only."""
    return nodes.select(
        F.col("paperId").alias("id"), "title", "year", F.array_join(author_names("authors"), ", ").alias("authors"), F.col("externalIds")["ArXiv"].alias("arxiv_id")
    )


def citation_counts(edges: DataFrame, by: str = "cited") -> DataFrame:
    return edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("citation_count"))


def author_names(authors: str) -> Column:
    """Names of an array of author structs, missing and empty ones left out; a scan reads no other field of them."""
    return F.coalesce(
        F.filter(F.col(authors)["name"], lambda n: n.isNotNull() & (n != "")),
        F.array().cast("array<string>"),
    )
