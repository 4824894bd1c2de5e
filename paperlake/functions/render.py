"""Markdown views of papers, lists, metrics, libraries and texts as Column expressions.

Detail views take columns of one row and give a string column; list views number the rows
of a page with ``row_number`` and fold them with ``listagg``. A list is one page of a result
(display size, not corpus size), so its window and fold hold a page at most; whole lists, of any length, are
rows of text by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.text import once, text_window, trim_all
from paperlake.operators.paging import numbered

# Places that the views link to.
DOI_SITE = "https://doi.org/"
PREPRINT_SITE = "https://arxiv.org/abs/"
RECORD_SITE = "https://scixplorer.org/abs/"
SHOWN_NEIGHBOURS = 25
# What a view says where nothing was found.
NO_RECORD = "No paper found with identifier: {}"
NO_SIMILAR = "No similar papers found for: {}"
NO_PREPRINTS = "No results found for: {}"
NO_PREPRINT = "No paper found with ID: {}"
NO_DOCS = "No SciX docs found for: {}"


def part(label: str, value: Column | str) -> Column:
    """A bold label and a value, or nothing where the value is null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"**{label}:** "), value.cast("string"), F.lit("\n\n")), F.lit(""))


def shown(value: Column) -> Column:
    """Null where a value is empty or zero."""
    text = value.cast("string")
    return F.when((text != "") & (text != "0"), text)


def author_line(authors: Column) -> Column:
    """The first three authors; ``et al.`` stands for any others."""
    brief = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.lit(" et al."))
    return F.coalesce(shown(F.when(F.size(authors) > 3, brief).otherwise(F.array_join(authors, ", "))), F.lit("N/A"))


def first_of(array: str) -> Column:
    return F.try_element_at(F.col(array), F.lit(1))


def or_else(value: Column | str, default: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("string"), F.lit(default))


def paper_detail() -> Column:
    """A literature record; citations, reads and links of no value are left out."""
    doi, site = F.lit(DOI_SITE), F.lit(RECORD_SITE)
    return F.concat(
        F.lit("# "), or_else(first_of("title"), "Untitled"), F.lit("\n\n"), part(
            "Authors", author_line(F.coalesce("author", F.array().cast("array<string>")))
        ),
        part(
            "Bibcode", F.concat(F.lit("`"), or_else("bibcode", "N/A"), F.lit("`"))
        ), part("Year", or_else("year", "N/A")), part("Publication", or_else("pub", "N/A")),
        part("Citations", shown(F.col("citation_count"))), part("Reads", shown(F.col("read_count"))), part(
            "DOI", F.concat(doi, shown(first_of("doi")))
        ),
        part("arXiv", F.concat(F.lit(PREPRINT_SITE), shown(F.col("arxiv_id")))), part("SciX", F.concat(site, shown(F.col("bibcode")))),
        F.coalesce(F.concat(F.lit("## Abstract\n\n"), shown(F.col("abstract")), F.lit("\n\n")), F.lit("")),
    )


def preprint_links() -> Column:
    return F.concat(
        F.lit("**Links:** [Abstract]("),
        "abs_url",
        F.lit(") | [PDF]("),
        "pdf_url",
        F.lit(") | [HTML]("),
        "html_url",
        F.lit(")\n\n"),
    )


def preprint_head() -> Column:
    return F.concat(
        F.lit("# "),
        "title",
        F.lit("\n\n"),
        part("Authors", author_line(F.col("authors"))),
        part("arXiv ID", F.concat(F.lit("`"), "id", F.lit("`"))),
    )


def preprint_detail() -> Column:
    """A preprint; the update is shown only where it differs from the publication."""
    updated = F.when((F.col("updated") != "") & (F.col("updated") != F.col("published")), F.substring("updated", 1, 10))
    doi = F.concat(F.lit(DOI_SITE), shown(F.col("doi")))
    return F.concat(
        preprint_head(), part("Published", F.substring("published", 1, 10)), part("Updated", updated), part(
            "Categories", F.array_join("categories", ", ")
        ), part("DOI", doi), preprint_links(), F.lit("## Abstract\n\n"), "abstract", F.lit("\n\n")
    )


def window_note(window: Column) -> Column:
    """Where a window of text stands, and how to go on."""
    place = F.concat(
        F.lit("\n\n_Showing characters "),
        window["offset"],
        F.lit("-"),
        window["end"],
        F.lit(" of "),
        window["total_chars"],
        F.lit("._"),
    )
    more = F.concat(F.lit("\n_More text is available. Call this tool again with `offset="), window["end"], F.lit("` to continue._"))
    return F.concat(place, F.when(window["has_more"], more).otherwise(""))


def text_page(content: str, offset: int, max_chars: int, empty: str | None = None) -> Column:
    """One window of a text, which is trimmed and measured once; ``empty`` stands for a text without any, and for null."""

    def page(text: Column) -> Column:
        shown_page = once(text_window(text, offset, max_chars), lambda window: F.concat(trim_all(window["text"]), window_note(window)))
        return shown_page if empty is None else F.when(text != "", shown_page).otherwise(empty)

    return once(trim_all(content), page)


def read_view(offset: int = 0, max_chars: int = 12_000) -> Column:
    """A read paper: source label, file name, links, and one window of its text."""
    label = F.when(
        F.col("source") == "tex", "arXiv source archive"
    ).when(F.col("source") == "html", "arXiv HTML").when(F.col("source") == "pdf", "arXiv PDF").otherwise("Abstract fallback")
    file = F.concat(F.lit("`"), shown(F.col("source_name")), F.lit("`"))
    doi = F.concat(F.lit(DOI_SITE), shown(F.col("doi")))
    return F.concat(
        preprint_head(),
        part("Source", label),
        part("Source file", file),
        preprint_links(),
        part("DOI", doi),
        F.lit("## Extracted text\n\n"),
        text_page("content", offset, max_chars),
        F.lit("\n"),
    )


def full_text_view(offset: int = 0, max_chars: int = 12_000) -> Column:
    """A preprint with its abstract and one window of ``full_text``, or a notice that there is none."""
    text = text_page("full_text", offset, max_chars, "_No text could be extracted from the PDF._")
    return F.concat(
        preprint_head(),
        part("Published", F.substring("published", 1, 10)),
        preprint_links(),
        F.lit("## Abstract\n\n"),
        "abstract",
        F.lit("\n\n## Full text\n\n"),
        text,
        F.lit("\n\n"),
    )


def folded(
    rows: DataFrame,
    order: list[Column],
    head: Column,
    item: Column,
    empty: str,
    show: int | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row with column ``text``: a heading, then the numbered items of a page in order.

    ``head`` and ``empty`` may use ``n``, the number of rows; ``item`` may use ``i``, from 1. With
    ``show``, only so many rows are taken, by a top-k, and all are counted.
    With ``by``, one such row for each of its values, in place of one in all.
    """
    page = rows.orderBy(*order).limit(show) if show else rows
    numbered = page.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    lines = F.array_sort(F.collect_list(F.struct("i", "line")))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("body")
    body = numbered.select(*by, "i", item.alias("line")).groupBy(*by).agg(F.count("*").alias("n"), text)
    if show:  # all rows are counted apart: one row each, proven by the global aggregates
        body = body.drop("n").crossJoin(rows.agg(F.count("*").alias("n")))
    more = F.when(
        F.col("n") > show, F.concat(F.lit(f"_Showing {show} of "), "n", F.lit(" returned papers._\n\n"))
    ).otherwise("") if show else F.lit("")
    return body.select(*by, F.when(F.col("n") == 0, F.lit(empty)).otherwise(F.concat(head, "body", more)).alias("text"))


def listed(rows: DataFrame, order: list[str], head: Column, item: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The view of ``folded`` as rows of text, by ``place``: the heading at 0, then every item, for each value of ``by``.

    Places are worked out over ranges, so no task or row holds a whole list, however long it is. ``order`` names columns, ascending.
    """
    placed = numbered(rows, list(by), order, "i", "n")
    heads = placed.where("i = 1").select(*by, F.lit(0).cast("long").alias("place"), head.alias("text"))
    return heads.unionByName(placed.select(*by, F.col("i").alias("place"), item.alias("text")))


def or_message(view: DataFrame, message: str) -> DataFrame:
    """A view of one row at most, or the message in its place."""
    return view.limit(1).agg(F.coalesce(F.first("text"), F.lit(message)).alias("text"))


def paper_list(page: DataFrame, order: list[Column], total: Column, heading: str = "Search Results") -> DataFrame:
    item = F.concat(
        "i", F.lit(". **"), or_else(first_of("title"), "Untitled"), F.lit("**\n   - "), or_else(first_of("author"), "Unknown"), F.lit(" ("), or_else("year", "N/A"), F.lit(")\n   - Bibcode: `"), or_else("bibcode", ""),
        F.lit("`\n   - Citations: "), or_else("citation_count", "0"), F.lit("\n\n"),
    )
    head = F.concat(F.lit(f"# {heading}\n\nFound **"), total, F.lit("** total, showing **"), "n", F.lit("**\n\n"))
    return folded(page, order, head, item, f"# {heading}\n\nFound **0** total, showing **0**\n\n")


def preprint_list(page: DataFrame, order: list[Column]) -> DataFrame:
    """The number shown is that of the returned rows."""
    item = F.concat(
        "i", F.lit(". **"), "title", F.lit("**\n   - "), or_else(first_of("authors"), "Unknown"), F.lit(" ("), F.substring("published", 1, 10), F.lit(")\n   - ID: `"), "id", F.lit("`\n   - Categories: "),
        F.array_join(F.slice("categories", 1, 3), ", "), F.lit("\n   - [Abstract]("), "abs_url", F.lit(")\n\n"),
    )
    return folded(
        page,
        order,
        F.concat(F.lit("# arXiv Search Results\n\nFound **"), "n", F.lit("** paper(s)\n\n")),
        item,
        "No papers found.",
    )


def docs_list(page: DataFrame, order: list[Column], query: str) -> DataFrame:
    place = F.concat_ws(" / ", shown(F.col("section")), shown(F.col("subsection")))
    line = lambda label, value: F.coalesce(F.concat(F.lit(f"   - {label}: "), value, F.lit("\n")), F.lit(""))
    item = F.concat(
        "i", F.lit(". **"), "title", F.lit("**\n"), line("Section", shown(place)), line("Type", shown(F.col("doc_type"))), line("Category", shown(F.col("category"))), F.lit("   - Source: ["), "source_file", F.lit("]("), "source_url",
        F.lit(")\n   - Score: "), F.col("score").cast("string"), F.lit(".00\n   - Snippet: "), "snippet", F.lit("\n\n"),
    )
    head = F.concat(F.lit("# SciX Docs Search Results\n\nFound **"), "n", F.lit(f"** result(s) for **{query}**\n\n"))
    return folded(page, order, head, item, NO_DOCS.format(query))


def graph_list(neighbours: DataFrame, order: list[Column], heading: str) -> DataFrame:
    """neighbours(id, title, author, year[, arxiv_id]): the first 25 are shown, all are counted."""
    year = F.coalesce(F.concat(F.lit(" ("), shown(F.col("year")), F.lit(")")), F.lit(""))
    preprint = F.coalesce(
        F.concat(F.lit("   - arXiv: `"), shown(F.col("arxiv_id")), F.lit("`\n")), F.lit("")
    ) if "arxiv_id" in neighbours.columns else F.lit("")
    graph_id = F.coalesce(F.concat(F.lit("   - Semantic Scholar: `"), shown(F.col("id")), F.lit("`\n")), F.lit(""))
    item = F.concat(
        "i",
        F.lit(". **"),
        or_else("title", "Untitled"),
        F.lit("**\n   - "),
        or_else("author", "Unknown"),
        year,
        F.lit("\n"),
        preprint,
        graph_id,
        F.lit("\n"),
    )
    head = F.concat(F.lit(f"## {heading} ("), "n", F.lit(")\n\n"))
    return folded(neighbours, order, head, item, f"## {heading} (0)\n\nNo papers returned.\n\n", show=SHOWN_NEIGHBOURS)


def graph_view(paper_id: str, paper: DataFrame, citing: DataFrame, cited: DataFrame, order: list[Column]) -> DataFrame:
    """One paper(title, year) with its two lists of neighbours, one hop away."""
    known = paper.limit(1).agg(F.first("title").alias("title"), F.first("year").alias("year"))
    head = known.select(
        F.lit("head").alias("part"),
        F.concat(part("Title", or_else("title", "Untitled")), part("Year", shown(F.col("year")))).alias("text"),
        F.lit(0).cast("long").alias("n"),
    )
    parts = head
    for name, rows, heading in (("citing", citing, "Citing papers"), ("cited", cited, "Referenced papers")):
        parts = parts.union(graph_list(rows, order, heading).select(F.lit(name), "text", F.lit(0))).union(
            rows.agg(F.lit(name), F.lit(""), F.count("*"))
        )
    of = lambda name, c, how: how(F.when(F.col("part") == name, F.col(c)))
    longest = lambda c: F.max_by(c, F.length(c))
    count = lambda label, name: part(label, of(name, "n", F.max))
    return parts.agg(
        F.concat(
            F.lit(f"# Citation Graph for arXiv:{paper_id}\n\n"),
            of("head", "text", longest),
            count("Citations returned", "citing"),
            count("References returned", "cited"),
            of("citing", "text", longest),
            of("cited", "text", longest),
        ).alias("text")
    )


def metrics_view(count: Column, indices: bool = True, citations: bool = True, basic: bool = True) -> Column:
    """Indices, citation statistics and paper statistics of one wide row; a section that was not computed is left out."""
    line = lambda label, value: F.concat(F.lit(f"- **{label}:** "), value, F.lit("\n"))
    whole = lambda c: or_else(c, "0")
    some = lambda label, c, digits: F.when(F.col(c).isNotNull(), line(label, fixed(F.col(c), digits))).otherwise("")
    parts = [F.lit("# Citation Metrics\n\n*Based on "), count, F.lit(" paper(s)*\n\n")]
    if indices:
        parts += [
            F.lit("## Indices\n\n"),
            line("h-index", whole("h")),
            line("g-index", whole("g")),
            line("i10-index", whole("i10")),
            some("m-index", "m", 2),
            some("tori", "tori", 2),
            F.lit("\n"),
        ]
    if citations:
        parts += [
            F.lit("## Citation Statistics\n\n"),
            line("Total citations", whole("total_citations")),
            line("Refereed citations", whole("refereed_citations")),
            some("Average", "mean_citations", 1),
        ]
        parts += [
            F.coalesce(line("Median", plain_number("median_citations")), F.lit("")),
            line("Self-citations", whole("self_citations")),
            F.lit("\n"),
        ]
    if basic:
        parts += [
            F.lit("## Paper Statistics\n\n"),
            line("Total papers", whole("papers")),
            line("Total reads", whole("reads")),
            some("Average reads", "mean_reads", 1),
            F.lit("\n"),
        ]
    return F.concat(*parts)


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, halves up on its binary value."""
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f", F.floor(value.cast("double") * scale + 0.5) / scale)


def plain_number(c: str) -> Column:
    """A number without a decimal part that is zero: 2.0 as 2, 2.5 as 2.5."""
    return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")


def library_line(*more: tuple[str, Column]) -> Column:
    """One line of labels and values, two blanks and a bar between them."""
    return F.concat(
        F.lit("- "),
        F.array_join(F.array(*(F.concat(F.lit(f"**{label}:** "), value) for label, value in more)), "  |  "),
        F.lit("\n"),
    )


def library_facts() -> list[Column]:
    public = F.when(F.col("public"), "Yes").otherwise("No")
    about = F.coalesce(F.concat(F.lit("- **Description:** "), shown(F.col("description")), F.lit("\n")), F.lit(""))
    return [
        F.lit("- **ID:** `"),
        F.col("id"),
        F.lit("`\n"),
        about,
        library_line(("Papers", F.col("num_documents").cast("string")), ("Permission", F.col("permission")), ("Public", public)),
    ]


def library_item() -> Column:
    """A library in a list: its facts, owner and day of the last change."""
    changed = F.substring(F.col("date_last_modified").cast("string"), 1, 10)
    return F.concat(
        F.lit("## "),
        "name",
        F.lit("\n"),
        *library_facts(),
        library_line(("Owner", F.col("owner")), ("Modified", changed)),
        F.lit("\n"),
    )


LIBRARIES_HEAD = ("# Libraries (", ")\n\n")


def library_list(page: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """A page of libraries (of each user, say) as one text."""
    head = F.concat(F.lit(LIBRARIES_HEAD[0]), "n", F.lit(LIBRARIES_HEAD[1]))
    return folded(page, order, head, library_item(), "No libraries found.", by=by)


def library_lines(libraries: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """All libraries (of each user, say) as rows of text."""
    return listed(libraries, order, F.concat(F.lit(LIBRARIES_HEAD[0]), "n", F.lit(LIBRARIES_HEAD[1])), library_item(), by)


def library_head() -> Column:
    return F.concat(F.lit("# "), "name", F.lit("\n\n"), *library_facts(), library_line(("Owner", F.col("owner"))), F.lit("\n"))


def papers_head(size: Column) -> Column:
    return F.when(size > 0, F.concat(F.lit("## Papers ("), size.cast("string"), F.lit(")\n\n"))).otherwise("")


def paper_line(place: Column, paper: Column) -> Column:
    return F.concat(place.cast("string"), F.lit(". `"), paper, F.lit("`\n"))


def library_detail(papers: str | None = None) -> Column:
    """A library with its facts and, where ``papers`` names an array of ids, its numbered papers."""
    if papers is None:
        return library_head()
    size = F.coalesce(F.array_size(papers), F.lit(0))
    lines = F.transform(papers, lambda p, i: paper_line(i + 1, p))
    return F.concat(library_head(), papers_head(size), F.when(size > 0, F.array_join(lines, "")).otherwise(""))


def library_detail_lines(libraries: DataFrame, members: DataFrame) -> DataFrame:
    """Every library's view as rows of text by ``place``: the head at 0, then its papers.

    libraries(library_id, ...), members(library_id, doc_id). No task or row holds all papers of a library.
    """
    placed = numbered(members.select("library_id", "doc_id"), ["library_id"], ["doc_id"], "i", "n")
    sizes = placed.where("i = 1").select("library_id", "n")
    head = F.concat(library_head(), papers_head(F.coalesce("n", F.lit(0))))
    heads = libraries.join(sizes, "library_id", "left").select("library_id", F.lit(0).cast("long").alias("place"), head.alias("text"))
    return heads.unionByName(placed.select("library_id", F.col("i").alias("place"), paper_line(F.col("i"), F.col("doc_id").cast("string")).alias("text")))


def note_view() -> Column:
    updated = F.coalesce(
        F.concat(F.lit("*Last updated: "), F.substring(F.col("date_last_modified").cast("string"), 1, 10), F.lit("*\n")),
        F.lit(""),
    )
    return F.concat(F.lit("# Note for `"), "doc_id", F.lit("`\n\n"), "content", F.lit("\n\n"), updated)
