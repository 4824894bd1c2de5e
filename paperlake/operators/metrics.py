"""Bibliometric indices by author group.

Papers are first counted by (author, citations): an author's histogram is far smaller than
the list of papers, however many papers one author has, and every index follows from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A paper of very many citations is met in so many pieces at least.
PIECES = 4


def histogram(papers: DataFrame, *also: Column) -> DataFrame:
    """papers(author, citations) to (author, c, k, above, sum_above): k papers of c citations each; ``also``: aggregates of these papers."""
    counts = papers.groupBy("author", F.col("citations").alias("c")).agg(F.count("*").alias("k"), *also)
    higher = Window.partitionBy("author").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return counts.withColumns(
        {"above": F.coalesce(F.sum("k").over(higher), zero), "sum_above": F.coalesce(F.sum(F.col("k") * F.col("c")).over(higher), zero)}
    )


def indices(papers: DataFrame) -> DataFrame:
    """author, papers, h (Hirsch 2005), g (Egghe 2006, at most the number of papers), i10."""
    return histogram(papers).groupBy("author").agg(*_indices())


def _indices() -> list[Column]:
    """papers, h, g, i10 as aggregates of a histogram.

    Within a run of equal citations c after R papers with S citations, the g-index is the
    largest g of the run with S + (g - R) c >= g * g, the root of a quadratic.
    """
    h = F.least("c", F.col("above") + F.col("k"))
    c, r, s = F.col("c"), F.col("above"), F.col("sum_above")
    root = F.floor((c + F.sqrt(c * c + 4 * (s - r * c))) / 2)
    g = F.least(root, r + F.col("k"))
    valid = (c * c + 4 * (s - r * c) >= 0) & (g > r)
    return [
        F.sum("k").alias("papers"), F.max(h).cast("long").alias("h"), F.coalesce(F.max(F.when(valid, g)), F.lit(0)).cast("long").alias("g"),
        F.coalesce(F.sum(F.when(c >= 10, F.col("k"))), F.lit(0)).cast("long").alias("i10"),
    ]


def m_index(papers: DataFrame, as_of_year: int) -> DataFrame:
    """author, h, first_year, m: h over the years since the first paper (at least one)."""
    first = papers.groupBy("author").agg(F.min("year").alias("first_year"))
    return indices(papers).join(first, "author").select(
        "author",
        "h",
        "first_year",
        _m(as_of_year).alias("m"),
    )


def _m(as_of_year: int) -> Column:
    return F.col("h") / F.greatest(F.lit(1), F.lit(as_of_year) - F.col("first_year"))


def tori(citations: DataFrame) -> DataFrame:
    """citations(author, self_citation, cited_authors, citing_references) to author, tori (Pepe and Kurtz 2012)."""
    return citations.where("NOT self_citation").groupBy("author").agg(
        F.sum(1 / (F.col("cited_authors") * F.col("citing_references"))).alias("tori")
    )


def by_author(papers: DataFrame) -> DataFrame:
    """papers(id, authors array, ...) to one row a paper and author: an author named twice counts once, null and empty names not."""
    names = F.array_distinct(F.filter("authors", lambda a: a.isNotNull() & (a != "")))
    return papers.withColumn("author", F.explode(names)).drop("authors")


def author_citations(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations of every author from edges(citing, cited) and papers(id, authors): author, citing, cited, cited_authors, citing_references, self_citation.

    The number of authors is that of the cited paper's list. A citation is the author's own where the citing paper has
    the same author; it is found by an equality on paper and author together, so an author of very many
    papers is no key of its own.
    """
    size = papers.select(F.col("id").alias("cited"), F.size(F.array_distinct("authors")).alias("cited_authors"), "authors")
    references = edges.groupBy("citing").agg(F.count("*").alias("citing_references"))
    cited = by_author(edges.join(size, "cited").join(references, "citing"))
    own = by_author(papers).select(F.col("id").alias("citing"), "author", F.lit(True).alias("self_citation"))
    judged = cited.join(own, ["citing", "author"], "left")
    return judged.withColumn("self_citation", F.coalesce("self_citation", F.lit(False)))


def citation_stats(papers: DataFrame) -> DataFrame:
    """papers(author, citations, refereed) to totals, mean and exact median."""
    return papers.groupBy("author").agg(
        F.sum("citations").cast("long").alias("total_citations"), F.sum("refereed").cast("long").alias("refereed_citations"),
        F.avg("citations").alias("mean_citations"), F.median("citations").alias("median_citations"),
    )


def self_citations(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """edges(citing, cited) whose papers(id, authors array) share an author."""
    citing = papers.select(F.col("id").alias("citing"), F.col("authors").alias("by"))
    cited = papers.select(F.col("id").alias("cited"), F.col("authors").alias("of"))
    return edges.join(citing, "citing").join(cited, "cited").where(F.arrays_overlap("by", "of")).select("citing", "cited")


def paper_citations(pairs: DataFrame, citing: DataFrame, papers: DataFrame, cited: DataFrame) -> DataFrame:
    """All that is counted of citations, by cited paper, with pairs(citing, cited) read and moved once by each end.

    ``pairs`` may repeat; ``citing(id, year, refereed)`` are records, ``papers(id, authors array)`` lists, one a paper, ``cited(id)``
    the papers asked for. Returns cited, citations (distinct), total_citations and refereed_citations (by records), year (of the first), tori
    (of citations from papers that share no author) and self_citations.
    """
    records = citing.groupBy(F.col("id").alias("citing")).agg(F.min("year").alias("year"), F.count_if("refereed").alias("refereed"), F.count("*").alias("records"))
    writers = papers.select(F.col("id").alias("citing"), F.col("authors").alias("by"))
    edges = pairs.where("citing IS NOT NULL").repartition("citing").distinct()  # what follows is by citing paper as well
    edges = edges.withColumn("references", F.count("*").over(Window.partitionBy("citing"))).where("cited IS NOT NULL")
    edges = edges.join(records, "citing", "left").join(writers, "citing", "left").withColumn("piece", F.pmod(F.hash("citing"), F.lit(PIECES)))
    of = cited.select("id").distinct().join(papers, "id", "left").select(
        F.col("id").alias("cited"), F.col("authors").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")
    )
    own = F.coalesce(F.arrays_overlap("by", "of"), F.lit(False))
    return edges.join(of, ["cited", "piece"]).groupBy("cited").agg(
        F.count("*").alias("citations"), F.sum(F.coalesce("records", F.lit(1))).alias("total_citations"), F.sum(F.coalesce("refereed", F.lit(0))).alias("refereed_citations"),
        F.min("year").alias("year"), F.sum(F.when(~own, F.try_divide(F.lit(1), F.array_size("of") * F.col("references")))).alias("tori"), F.count_if(own).alias("self_citations"),
    )


def profile(papers: DataFrame, as_of_year: int) -> DataFrame:
    """One wide row an author, with every figure of the view, from one histogram.

    ``papers`` has author and, for every paper, citations, total_citations, refereed_citations, year, tori, self_citations and reads.
    """
    summed = ["total_citations", "refereed_citations", "tori", "self_citations", "reads"]
    sums = [F.sum(c).alias(c) for c in summed]
    wide = histogram(papers, F.min("year").alias("year"), *sums).groupBy("author").agg(
        *_indices(), F.min("year").alias("first_year"), F.percentile("c", 0.5, F.col("k")).alias("median_citations"), *sums
    )
    return wide.select(
        "*", _m(as_of_year).alias("m"), (F.col("total_citations") / F.col("papers")).alias("mean_citations"), (F.col("reads") / F.col("papers")).alias("mean_reads")
    )
