"""The best available text of each paper: HTML, LaTeX source, PDF, then the abstract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import html_text, is_full_paper


def read_papers(papers: DataFrame, html: DataFrame, tex: DataFrame | None = None, pdf: DataFrame | None = None) -> DataFrame:
    """papers(id, abstract) with html(id, html), tex(id, text, source_name), pdf(id, text).

    Returns id, source (html, tex, pdf or abstract), source_name and content. HTML counts
    only if it looks like a whole paper; a missing or empty source passes on to the next.
    """
    spark = papers.sparkSession
    tex = spark.createDataFrame([], "id string, text string, source_name string") if tex is None else tex
    pdf = spark.createDataFrame([], "id string, text string") if pdf is None else pdf
    from_html = html.select("id", html_text("html").alias("html_text"))
    joined = papers.join(from_html, "id", "left").join(tex.select("id", F.col("text").alias("tex_text"), "source_name"), "id", "left").join(
        pdf.select("id", F.col("text").alias("pdf_text")), "id", "left"
    )
    whole = F.when(is_full_paper("html_text", "abstract"), F.col("html_text"))
    tex_text, pdf_text = F.when(F.col("tex_text") != "", F.col("tex_text")), F.when(F.col("pdf_text") != "", F.col("pdf_text"))
    source = F.when(whole.isNotNull(), "html").when(tex_text.isNotNull(), "tex").when(pdf_text.isNotNull(), "pdf").otherwise("abstract")
    return joined.select(
        "id",
        source.alias("source"),
        F.when(source == "tex", F.col("source_name")).alias("source_name"),
        F.coalesce(whole, tex_text, pdf_text, "abstract").alias("content"),
    )
