"""Ranked lexical search over document chunks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text as T

CHUNK = ("id", "source_file", "source_url", "doc_type", "category", "title", "section", "subsection", "content")


def query_terms(query: str) -> list[str]:
    """Terms of a query, as ``functions.text.tokens`` cuts a column."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in query.lower())
    return kept.split()


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """Titles derived, content cleaned and measured; empty, missing and navigation chunks go.

    ``chunks`` has the columns of ``CHUNK`` and ``ordinal``, its place in the index. Every chunk is
    cleaned once, however often its columns are used afterwards.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = [T.trim_all(name(c)) for c in ("subsection", "section", "title")]
    candidates = F.array(T.first_heading(name("content")), *given, T.slug_title(name("source_file")))
    fit = F.filter(candidates, lambda c: (c != "") & ~T.is_nav(c))
    nav = T.is_nav("source_file") | T.is_nav("source_url") | T.is_nav("id")
    trimmed = {c: T.trim_all(name(c)) for c in ("section", "subsection")}
    derived = trimmed | {"title": F.coalesce(F.get(fit, F.lit(0)), name("id")), "content": T.clean_content(name("content"))}
    cleaned = T.worked_out(chunks.where(~nav).withColumns(derived))
    return cleaned.withColumn("char_count", F.length("content")).where("title <> '' AND title <> '404' AND content <> ''")


#: Lower-case forms that are scored: of three fields alone, and of all together.
LOWERED = ("low_title", "low_section", "low_subsection", "low_all")


def lowered(chunks: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    fields = ("title", "section", "subsection", "doc_type", "category", "content")
    every = F.lower(F.concat_ws(" ", *map(text, fields)))
    return T.worked_out(chunks.withColumns(dict(zip(LOWERED, [*(F.lower(text(c)) for c in fields[:3]), every]))))


def relevance(terms: list[str], phrase: str) -> Column:
    """Title 4, section 3, subsection 2, all fields 1 for each term; 6 for each whole phrase."""
    score = T.occurrences(F.col("low_all"), phrase) * 6
    for t in terms:
        for weight, c in zip((4, 3, 2, 1), LOWERED):
            score = score + T.occurrences(F.col(c), t) * weight
    return score.cast("long")


def search(cleaned: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The best chunks with score and snippet: score, then length, then place in the index.

    Every chunk is scored once; snippets are cut only for the rows that are returned.
    """
    phrase = query.strip().lower()
    if not phrase:
        return cleaned.limit(0).withColumns({"score": F.lit(0).cast("long"), "snippet": F.lit("")})
    terms = query_terms(phrase)
    scored = T.worked_out(lowered(cleaned).withColumn("score", relevance(terms, phrase)).drop(*LOWERED)).where("score > 0")
    top = scored.orderBy(F.desc("score"), F.desc("char_count"), F.asc("ordinal")).limit(max(1, int(limit)))
    return top.withColumn("snippet", T.snippet(F.col("content"), terms))
