"""Atom feeds to paper rows, by expressions; entities stay undecoded, as the rules ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.text import collapse, strip_version, trim_all, worked_out

SITE = "https://arxiv.org"
FIELDS = ("id", "title", "authors", "abstract", "published", "updated", "categories", "doi", "pdf_url", "html_url", "abs_url")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """One row a feed file, with column ``xml``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml")


# The elements that a paper is read from (any character is a dot: a union of classes is ten times as slow); names, dates and the like do not run over line breaks.
LINE = r"[^\n\r\x{2028}\x{2029}]*?"
ENTRY = r"<entry>((?s:.*?))</entry>"
SUMMARY = r"<summary[^>]*>((?s:.*?))</summary>"
IDENTIFIER = r"<id>https?://arxiv\.org/abs/([^<]+)</id>"
TITLE = r"<title[^>]*>((?s:.*?))</title>"
NAME, CATEGORY = rf"<name>({LINE})</name>", r'<category[^>]+term="([^"]+)"'
PUBLISHED, UPDATED = rf"<published>({LINE})</published>", rf"<updated>({LINE})</updated>"
DOI_LINK = r'<link[^>]+title="doi"[^>]+href="https?://dx\.doi\.org/([^"]+)"'


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per entry that has an identifier, in the columns of ``FIELDS``.

    Every element is sought in the whole entry, so an empty, missing or unclosed one takes nothing
    from the others: it is an empty text, no author or category, or a null DOI.
    """
    entries = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit(ENTRY), F.lit(1))).alias("entry"))
    first = lambda pattern: F.regexp_extract("entry", pattern, 1)
    every = lambda pattern: F.regexp_extract_all("entry", F.lit(pattern), F.lit(1))
    doi = first(DOI_LINK)
    rows = worked_out(entries.select(strip_version(first(IDENTIFIER)).alias("id"), "entry")).where("id <> ''")
    found = rows.select(
        "id",
        collapse(first(TITLE)).alias("title"),
        F.transform(every(NAME), trim_all).alias("authors"),
        collapse(first(SUMMARY)).alias("abstract"),
        trim_all(first(PUBLISHED)).alias("published"),
        trim_all(first(UPDATED)).alias("updated"),
        every(CATEGORY).alias("categories"),
        F.when(doi != "", doi).alias("doi"),
    )
    link = lambda kind: F.concat(F.lit(f"{SITE}/{kind}/"), "id")
    return found.withColumns({"pdf_url": link("pdf"), "html_url": link("html"), "abs_url": link("abs")})


def lookup(papers: DataFrame, paper_id: str) -> DataFrame:
    """The paper of this identifier, with or without a version."""
    return papers.where(F.col("id") == strip_version(F.lit(paper_id))).limit(1)


def render_entry(paper_id: Column, title: Column, authors: Column, summary: Column, date: Column, category: Column, doi: Column) -> Column:
    """An Atom entry of a paper, version 1, with an array of authors and a DOI link where ``doi`` is not null (for fixtures and round trips).

    ``summary`` is the whole element, whatever form it has; it comes first.
    """
    names = F.array_join(F.transform(authors, lambda a: F.concat(F.lit("<author><name> "), a, F.lit(" </name></author>\n"))), "")
    link = F.concat(F.lit('<link title="doi" rel="related" href="http://dx.doi.org/'), doi, F.lit('"/>\n'))
    return F.concat(
        F.lit("<entry>"), summary, F.lit("\n<id>http://arxiv.org/abs/"), paper_id, F.lit("v1</id>\n<title>"), title, F.lit("</title>\n<published>"),
        date, F.lit("</published><updated>"), date, F.lit("</updated>\n"), names, F.coalesce(link, F.lit("")),
        F.lit('<category scheme="s" term="'), category, F.lit('"/></entry>'),
    )
