"""Bibliography records as Column expressions: BibTeX, BibTeX with abstract, RIS, EndNote, and templates.

The formats' grammars are public; eighteen further formats of the literature service are
undocumented there and are refused rather than guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORTED = ("bibtex", "bibtexabs", "ris", "endnote", "custom")
UNSUPPORTED = (
    "aastex",
    "ads",
    "agu",
    "ams",
    "dcxml",
    "gsa",
    "icarus",
    "ieee",
    "jatsxml",
    "medlars",
    "mnras",
    "procite",
    "refabsxml",
    "refworks",
    "refxml",
    "rss",
    "soph",
    "votable",
)


#: How journals are written in each style: 1 AASTeX macros, 2 Icarus, 3 MNRAS, 4 Solar Physics.
JOURNALS = {
    "The Astronomical Journal": ("\\aj", "Astron. J.", "AJ", "Astron. J."),
    "The Astrophysical Journal": ("\\apj", "Astrophys. J.", "ApJ", "Astrophys. J."),
    "The Astrophysical Journal Supplement Series": ("\\apjs", "Astrophys. J. Suppl. Ser.", "ApJS", "Astrophys. J. Suppl."),
    "Astronomy and Astrophysics": ("\\aap", "Astron. Astrophys.", "A&A", "Astron. Astrophys."),
    "Monthly Notices of the Royal Astronomical Society": ("\\mnras", "Mon. Not. R. Astron. Soc.", "MNRAS", "Mon. Not. Roy. Astron. Soc."),
    "Publications of the Astronomical Society of the Pacific": ("\\pasp", "Publ. Astron. Soc. Pac.", "PASP", "Pub. Astron. Soc. Pacific"),
    "Publications of the Astronomical Society of Japan": ("\\pasj", "Publ. Astron. Soc. Japan", "PASJ", "Pub. Astron. Soc. Japan"),
    "Annual Review of Astronomy and Astrophysics": ("\\araa", "Annu. Rev. Astron. Astrophys.", "ARA&A", "Ann. Rev. Astron. Astrophys."),
    "Nature": ("\\nat", "Nature", "Nat", "Nature"),
    "Icarus": ("\\icarus", "Icarus", "Icarus", "Icarus"),
    "Solar Physics": ("\\solphys", "Sol. Phys.", "Sol. Phys.", "Solar Phys."),
    "Physical Review Letters": ("\\prl", "Phys. Rev. Lett.", "Phys. Rev. Lett.", "Phys. Rev. Lett."),
}


def journal(name: Column, style: int | None = None, journals: dict[str, tuple[str, ...]] = JOURNALS) -> Column:
    """A journal's name in one of the four styles; as it is without a style, and where ``journals`` does not have it."""
    if style is None:
        return name
    if style not in (1, 2, 3, 4):
        raise ValueError("journalformat is 1 (AASTeX), 2 (Icarus), 3 (MNRAS) or 4 (SOPH)")
    known = F.create_map(*(F.lit(x) for n, forms in journals.items() for x in (n, forms[style - 1])))
    return F.coalesce(F.try_element_at(known, name), name)


def authors(max_author: int | None, cutoff: int | None, separator: str, others: str) -> Column:
    """Authors joined; where there are more than the cut-off, the first ``max_author`` and others."""
    a = F.col("author")
    joined = F.array_join(a, separator)
    if not max_author:
        return joined
    return F.when(
        F.size(a) > (cutoff or max_author), F.concat(F.array_join(F.slice(a, 1, max_author), separator), F.lit(others))
    ).otherwise(joined)


def cite_key(template: str | None) -> Column:
    """``%1H`` first author's last name, ``%Y`` year, ``%R`` identifier; the identifier by default."""
    return F.col("bibcode") if not template else fill(template)


def fill(template: str, max_author: int | None = None, cutoff: int | None = None) -> Column:
    """%A authors, %H first author's last name (also %1H), %T title, %Y year, %J publication, %V volume, %D doi, %R identifier, %B abstract, %% a percent sign, \\n a line break."""
    last = F.regexp_extract(F.try_element_at("author", F.lit(1)), "^([^,]*)", 1)
    values = {
        "A": authors(max_author, cutoff, ", ", " et al."), "H": last, "1H": last, "T": F.try_element_at("title", F.lit(1)), "Y": F.col("year"), "J": F.col("pub"), "V": F.col("volume"), "D": F.try_element_at("doi", F.lit(1)),
        "R": F.col("bibcode"), "B": F.col("abstract"), "%": F.lit("%"),
    }
    parts = []
    for text, code in re.findall(r"([^%]+)|%(1H|.)", template.replace("\\n", "\n")):
        if code and code not in values:
            raise ValueError(f"no template code %{code}")
        parts.append(F.lit(text) if text else F.coalesce(values[code].cast("string"), F.lit("")))
    return F.concat(*parts)


def record(
    format: str,
    custom_format: str | None = None,
    max_author: int | None = None,
    cutoff: int | None = None,
    key_format: str | None = None,
    cited_as: Column | None = None,
) -> Column:
    """One record of columns bibcode, title, author, year, pub, volume, doi, abstract; cited by ``cited_as``, or else by ``key_format``."""
    if format == "custom":
        if not custom_format:
            raise ValueError("a custom export needs a template")
        return fill(custom_format, max_author, cutoff)
    if format not in SUPPORTED:
        raise ValueError(f"export format not supported: {format}")
    title, doi = F.try_element_at("title", F.lit(1)), F.try_element_at("doi", F.lit(1))
    optional = lambda before, value, after: F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))
    if format.startswith("bibtex"):
        abstract = optional("    abstract = {", F.col("abstract"), "},\n") if format == "bibtexabs" else F.lit("")
        return F.concat(
            F.lit("@ARTICLE{"), cite_key(key_format) if cited_as is None else cited_as, F.lit(",\n"), optional(
                "    author = {", authors(max_author, cutoff, " and ", " and others"), "},\n"
            ), optional("    title = {", title, "},\n"), optional("    journal = {", F.col("pub"), "},\n"),
            optional("    year = {", F.col("year"), "},\n"), optional(
                "    volume = {", F.col("volume"), "},\n"
            ), abstract, optional("    doi = {", doi, "},\n"), F.lit("}\n"),
        )
    marks = {
        "ris": ("TY  - JOUR\n", "AU  - ", "TI  - ", "JO  - ", "PY  - ", "VL  - ", "DO  - ", "ID  - ", "ER  - \n"),
        "endnote": ("%0 Journal Article\n", "%A ", "%T ", "%J ", "%D ", "%V ", "%R ", "%F ", "\n"),
    }[format]
    head, au, ti, jo, py, vl, do, key, end = marks
    names = F.slice("author", 1, max_author) if max_author else F.col("author")
    each = F.coalesce(F.array_join(F.transform(names, lambda n: F.concat(F.lit(au), n, F.lit("\n"))), ""), F.lit(""))
    return F.concat(
        F.lit(head),
        each,
        optional(ti, title, "\n"),
        optional(jo, F.col("pub"), "\n"),
        optional(py, F.col("year"), "\n"),
        optional(vl, F.col("volume"), "\n"),
        optional(do, doi, "\n"),
        optional(key, F.col("bibcode"), "\n"),
        F.lit(end),
    )
