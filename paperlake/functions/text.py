"""Text functions as Column expressions: cleaning, HTML and LaTeX to text, windows, gates.

All of them stay in the JVM as one projection of regular expressions. Lengths and offsets
count characters as Spark does (code points).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the reference semantics, block tags, named entities, headings.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BLOCK_TAGS = "p|div|li|section|article|header|footer|main|aside|nav|figure|figcaption|blockquote|h[1-6]|tr|td|th|table|ul|ol|pre|dd|dt"
NAMED_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))
HEADINGS = (("section", "#"), ("subsection", "##"), ("subsubsection", "###"), ("paragraph", "####"), ("subparagraph", "#####"))
PAPER_WORDS = ("introduction", "related work", "method", "results", "discussion", "conclusion", "references")
NAV_TEXT = r"(?i)what['\x{2019}]?s?[\s\x{00a0}]*[_\s\x{00a0}-]*new"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def worked_out(df: DataFrame) -> DataFrame:
    """The same rows, their columns computed once: later filters and projections do not repeat the expressions.

    A generator stands between, over which the optimizer neither moves a filter on its columns
    nor merges projections.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: The characters of ``SPACE``.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


#: A run of ``SPACE`` without blanks; what ASCII prints is passed over by one comparison, and single blanks are left alone.
OTHER_SPACE = r"(?=[^ -~])[\t-\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once, however often ``made`` uses it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def trim_all(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks: the ends are looked at, not the whole text."""
    return F.btrim(column(c).cast("string"), F.lit(SPACES))


def collapse(c: str | Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(replace_all(column(c), (OTHER_SPACE, " "), (" {2,}", " ")))


def strip_links(c: str | Column) -> Column:
    """Markdown links become their text."""
    return F.regexp_replace(column(c), r"\[([^\]]+)\]\([^)]+\)", "$1")


def clean_content(c: str | Column) -> Column:
    return collapse(strip_links(c))


def first_heading(c: str | Column) -> Column:
    """Cleaned text of the first Markdown heading, or an empty string."""
    return clean_content(F.regexp_extract(column(c), r"(?m)^#{1,6}\s+(.+)$", 1))


def slug_title(c: str | Column) -> Column:
    """Dashes and underscores to blanks; the first letter of each word in upper case, the rest as is."""
    words = F.split(collapse(F.regexp_replace(column(c), "[-_]+", " ")), "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def is_nav(c: str | Column) -> Column:
    return F.coalesce(column(c).rlike(NAV_TEXT), F.lit(False))


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and numbers, in order, repeats kept."""
    return F.filter(F.split(F.lower(column(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    if not needle:
        return F.lit(0).cast("long")
    rest = F.replace(haystack, F.lit(needle), F.lit(""))
    return ((F.length(haystack) - F.length(rest)) / len(needle)).cast("long")


def snippet(content: Column, terms: list[str], width: int = 260) -> Column:
    """``width`` characters around the earliest hit of any term, or the head, with ellipses where cut."""
    low = F.lower(content)
    hits = F.filter(F.array(*(F.instr(low, t.lower()) for t in terms)), lambda i: i > 0) if terms else F.array().cast("array<int>")
    at = F.array_min(hits) - 1
    start = F.coalesce(F.greatest(F.lit(0), at - width // 2), F.lit(0))
    end = F.least(F.length(content), start + width)
    return F.concat(
        F.when(start > 0, "...").otherwise(""), F.substr(
            content, start + 1, F.greatest(end - start, F.lit(0))
        ), F.when(end < F.length(content), "...").otherwise("")
    )


def normalize_lines(c: Column) -> Column:
    return trim_all(replace_all(c, (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")))


def _character(code: Column) -> Column:
    """Text of one numeric reference; null if it names no character."""
    hexadecimal = code.startswith("x")
    digits = F.when(hexadecimal, F.substr(code, F.lit(2))).otherwise(F.regexp_extract(code, "^[0-9]+", 0))
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when((short != "") & (F.length(short) <= 8), F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("long"))
    valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_entities(c: Column) -> Column:
    """Numeric references first, then six named ones in a single pass; all others stay as they are."""
    pattern = "&#(x?[0-9a-fA-F]+);"
    parts, codes = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(1))

    def after(part: Column, code: Column) -> Column:
        return F.concat(part, F.coalesce(_character(code), F.concat(F.lit("&#"), code, F.lit(";")), F.lit("")))

    c = F.when(F.size(codes) > 0, F.array_join(F.zip_with(parts, codes, after), "")).otherwise(c)
    for name, value in NAMED_ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


def strip_html(c: str | Column) -> Column:
    """Scripts, styles and comments go; breaks and block ends become line breaks; tags become blanks."""
    # The patterns of the reference semantics, in their order.
    return replace_all(
        column(c), (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?s)<!--.*?-->", " "),
        (r"(?i)<\s*br\s*/?\s*>", "\n"), (rf"(?i)</(?:{BLOCK_TAGS})\s*>", "\n\n"), (rf"(?i)<\s*(?:{BLOCK_TAGS})[^>]*>", ""), (r"<[^>]+>", " "),
    )


def html_text(c: str | Column) -> Column:
    return F.regexp_replace(normalize_lines(decode_entities(strip_html(c))), r"\n{3,}", "\n\n")


def latex_text(c: str | Column) -> Column:
    """Sixteen ordered rewrites from LaTeX to plain text with Markdown headings."""
    # The patterns of the reference semantics, in their order.
    c = replace_all(column(c), (r"(?i)\\begin\{document\}", "\n\n"), (r"(?i)\\end\{document\}", "\n\n"))
    for name, mark in HEADINGS:
        c = F.regexp_replace(c, rf"(?i)\\{name}\*?\{{(?=[^{{}}])\s*([^{{}}]*?)\s*\}}", f"\n\n{mark} $1\n\n")
    return normalize_lines(
        replace_all(
            c, (r"(?i)\\(?:textbf|textit|emph|underline)\{([^{}]+)\}", "$1"), (r"(?i)\\(?:title|author|date)\{([^{}]+)\}", "$1\n"),
            (r"(?i)\\(?:cite|citep|citet|autocite|parencite|textcite|ref|label)\{[^{}]*\}", ""), (
                r"(?i)\\includegraphics(?:\[[^\]]*\])?\{[^{}]*\}", ""
            ),
            (r"(?i)\\item(?![A-Za-z0-9_])", "\n- "), (r"\\\\", "\n"),
            # a command keeps one argument; both marks are private characters that become blanks
            (r"\\[a-zA-Z@]+(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", "\ue000$1\ue001"), ("\ue000\ue001", " "), ("[\ue000\ue001]", " "),
            (r"(?m)(?<!\\)%.*$", ""), (r"\$\$\s*((?s:.*?))\s*\$\$", "\n\n\\$\\$$1\\$\\$\n\n"), (r"\$(?!\s)([^$]+?)\s*\$", "\\$$1\\$"),
            ("~", " "), (r"\s+\n", "\n"), (r"\n{3,}", "\n\n"),
        )
    )


def paragraphs(c: str | Column) -> Column:
    return F.size(F.filter(F.split(column(c), r"\n{2,}"), lambda p: p != ""))


def is_full_paper(c: str | Column, abstract: str | Column | None = None) -> Column:
    """Long enough for its abstract, or eight paragraphs, or one of the usual section words."""
    c = column(c)
    brief = F.lit(0) if abstract is None else F.coalesce(F.length(column(abstract)), F.lit(0))
    word = rf"(^|[^a-z0-9_])({'|'.join(PAPER_WORDS)})([^a-z0-9_]|$)"
    return (F.length(c) >= F.greatest(brief * 6, F.lit(3000))) | (paragraphs(c) >= 8) | F.lower(c).rlike(word)


def text_window(c: str | Column, offset: int = 0, max_chars: int = 12_000) -> Column:
    """Struct of text, offset, end, total_chars and has_more for one page of characters."""
    c = column(c)
    offset, total = max(0, offset), F.length(c)
    end = F.least(total, F.lit(offset + max(1, max_chars)))
    return F.struct(
        F.substr(
            c, F.lit(offset + 1), F.greatest(end - offset, F.lit(0))
        ).alias("text"), F.lit(offset).alias("offset"), end.alias("end"), total.alias("total_chars"), (end < total).alias("has_more")
    )


def strip_version(c: str | Column) -> Column:
    """Identifier without blanks around it and without its version."""
    return F.regexp_replace(trim_all(c), r"v\d+$", "")


def padded(c: str | Column, width: int) -> Column:
    """A number with zeros before it up to ``width`` digits; a longer one stays whole."""
    digits = column(c).cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")
