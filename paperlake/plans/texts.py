"""Text extraction from pages, LaTeX archives and feeds, and windows of text."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as T
from paperlake.operators.fulltext import read_papers
from paperlake.plans.params import WindowParams
from paperlake.sources import archive, atom, feed_pages
from paperlake.sources.archive import sink_of
from paperlake.sources.tables import table
from paperlake.storage import kept

WINDOW = WindowParams(500, 1000)


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html("html").cast("binary")).alias("text_md5"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.html_text("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5")
    )


def fulltext_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.html_text("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.paragraphs(text).cast("long").alias("paragraphs"), T.is_full_paper(text).alias("full")
    )


def text_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.text_window("text", WINDOW.offset, WINDOW.max_chars)
    named = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return named.select(
        "doc_id",
        "w.text",
        F.col("w.end").cast("long").alias("end_at"),
        F.col("w.total_chars").cast("long").alias("total_chars"),
        "w.has_more",
    )


def read_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers are documents; pages of the same number are their HTML, their archives' main files the LaTeX texts.

    Every third has a PDF text, and of the rest every second an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    papers = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"))
    html = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    tex = archive.main_tex(archive.entries(archives(spark, sf_dir), ".tex"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("PDF "), "text")).when(F.col("doc_id") % 3 == 1, "")
    found = read_papers(papers, html, tex, docs.select(F.col("doc_id").alias("id"), text.alias("text")))
    return found.select("id", "source", "source_name", F.md5(F.col("content").cast("binary")).alias("content_md5"))


ARCHIVE = "id long, data binary"


def packed_files(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def pack_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as source archives, which the test tables do not have.

    By the remainder of the number by four: a gzipped one whose main file is the whole text, beside a
    head that lies deeper, a plain one with a main file of another name, bytes that are no archive, and none.
    They leave as soon as a chunk of them is packed, so a worker holds no batch of archives.
    """
    for batch in batches:
        ids, rows, held = [], [], 0
        for k in range(len(batch)):
            doc_id, text, source = (batch.column(c)[k].as_py() for c in ("doc_id", "text", "source"))
            head, whole = f"\\section{{{source}}}\nHead".encode(), (text or "").encode()
            kinds = (
                lambda: gzip.compress(packed_files({"sub/other.tex": head, "ms.tex": whole, "fig.png": b"\x89"}), 1, mtime=0),
                lambda: packed_files({"deep/notes.tex": head, "long.TEX": whole, "readme": b"-"}),
                lambda: b"not an archive",
                lambda: None,
            )
            ids.append(doc_id)
            rows.append(kinds[doc_id % 4]())
            held += len(rows[-1] or b"") + 64
            if held >= archive.CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["id", "data"])
                ids, rows, held = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["id", "data"])


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source").mapInArrow(pack_archives, ARCHIVE)


def tar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.entries(archives(spark, sf_dir)).select("id", "ordinal", "name", "size")


def tex_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main file of each document's archive: its name and whole text."""
    return archive.main_tex(archive.entries(archives(spark, sf_dir), ".tex"))


def tex_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX made of every document: its words as sections, styles and comments."""
    head = F.concat(F.lit("\\begin{document}\\section{ "), F.col("source"), F.lit(" }\n"))
    tail = F.concat(F.lit("\n% a comment\n\\emph{"), "lang", F.lit("}~end\\cite{k}\\end{document}"))
    text = T.latex_text(F.concat(head, F.replace("text", F.lit("\n"), F.lit(" \\\\ ")), tail))
    made = T.worked_out(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")))
    return made.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


def atom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of documents, one to three authors each and every third with a DOI link, written and parsed again.

    Of eight documents one each has an empty summary element, none, one that is never closed, and one with an attribute.
    """
    d = table(spark, sf_dir, "documents")
    authors = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda i: F.concat(F.col("source"), F.lit(" "), i))
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), "doc_id"))
    forms = {2: ("<summary/>", None, ""), 3: ("", None, ""), 4: ("<summary>", "text", ""), 5: ('<summary type="text">', "text", "</summary>")}
    element = lambda a, c, z: F.concat(F.lit(a), F.col(c) if c else F.lit(""), F.lit(z))
    summary = element("<summary>", "text", "</summary>")
    for k, form in forms.items():
        summary = F.when(F.col("doc_id") % 8 == k, element(*form)).otherwise(summary)
    entry = atom.render_entry(
        F.concat(F.lit("2001."), T.padded("doc_id", 5)), F.regexp_extract("text", "^([^\n]*)", 1), authors, summary, F.lit("2024-01-15T00:00:00Z"), F.col("lang"), doi
    )
    feeds = d.select(F.concat(F.lit("<feed><id>http://arxiv.org/api/x</id>"), entry, F.lit("</feed>")).alias("xml"))
    joined = {c: F.array_join(c, ";").alias(c) for c in ("authors", "categories")}
    return atom.parse_feeds(feeds).select("id", "title", joined["authors"], "abstract", "published", joined["categories"], "doi", "pdf_url")


#: Entries of a page of the stored feed; the dates and languages that are asked of it.
PAGE_SIZE, FROM, UNTIL, LANGUAGES = 50, "2024-03-01", "2024-04-15", ("en", "fr")


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed entries, dated by their number."""
    date = F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 360).cast("int")).cast("string"), F.lit("T00:00:00Z"))
    entry = atom.render_entry(
        F.concat(F.lit("2001."), T.padded("doc_id", 5)), F.regexp_extract("text", "^([^\n]*)", 1), F.array("source"),
        F.concat(F.lit("<summary>"), "text", F.lit("</summary>")), date, F.col("lang"), F.lit(None).cast("string"),
    )
    return table(spark, sf_dir, "documents").select(entry.alias("xml"))


def feed_folder(spark: SparkSession, sf_dir: str) -> str:
    return kept(spark, "feed_pages", [f"{sf_dir}/documents.parquet"], lambda f: feed_pages.write_pages(dated_entries(spark, sf_dir), f, PAGE_SIZE))


def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of a stretch of time and two languages from a folder of feed pages, of which only those that may hold them are read."""
    asked = (F.col("published") >= FROM) & (F.col("published") < UNTIL) & F.col("category").isin(*LANGUAGES)
    found = feed_pages.read_pages(spark, feed_folder(spark, sf_dir), asked)
    return found.select("id", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "published", F.array_join("categories", ";").alias("categories"))


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers of the stored feed, its files read as they are."""
    found = atom.parse_feeds(atom.read_feeds(spark, f"{feed_folder(spark, sf_dir)}/pages"))
    return found.select("id", "published", F.array_join("authors", ";").alias("authors"), "doi", "abs_url")


def preprint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper of the stored feed by its number and a version."""
    found = atom.lookup(atom.parse_feeds(atom.read_feeds(spark, f"{feed_folder(spark, sf_dir)}/pages")), " 2001.00017v3")
    return found.select("id", "published", "pdf_url", "html_url")


#: Documents of one archive file.
ARCHIVED = 50


def write_archives(docs: DataFrame, folder: str) -> None:
    """docs(doc_id, text) as gzipped archives of ``ARCHIVED`` files each, in order; every other one not gzipped. A task that runs again writes the same file."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        files = {f"d/{i}.tex": (t or "").encode() for i, t in sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()))}
        part, data = key[0].as_py(), packed_files(files)
        with sink_of(f"{folder}/{part}.tar") as out:
            out.write(gzip.compress(data, 1, mtime=0) if part % 2 == 0 else data)
        return pa.table({"part": [part]})

    grouped = docs.select("doc_id", "text", F.expr(f"doc_id div {ARCHIVED}").alias("part")).groupBy("part")
    grouped.applyInArrow(write, "part long").write.format("noop").mode("overwrite").save()


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a folder of archives, read as streams."""
    docs = table(spark, sf_dir, "documents")
    folder = kept(spark, "archive_files", [f"{sf_dir}/documents.parquet"], lambda f: write_archives(docs, f"{f}/files"))
    found = archive.read_archives(spark, f"{folder}/files", ".tex")
    return found.select(F.regexp_extract("id", "([0-9]+)[.]tar$", 1).cast("long").alias("part"), "ordinal", "name", "size", F.md5("data").alias("data_md5"))


QUERIES = {
    "feed_files": feed_files, "preprint_lookup": preprint_lookup, "archive_files": archive_files,
    "feed_scan": feed_scan,
    "html_strip": html_strip, "html_text": html_text, "fulltext_gate": fulltext_gate, "text_window": text_window, "read_cascade": read_cascade, "tar_entries": tar_entries, "tex_choice": tex_choice, "tex_strip": tex_strip, "atom_roundtrip": atom_roundtrip,
}

TAGS = T.BLOCK_TAGS


def chain(text: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


NL = "chr(10)"
STRIPPED = chain(
    "html", (r"(?is)<script.*?</script>", "' '"), (r"(?is)<style.*?</style>", "' '"), (r"(?s)<!--.*?-->", "' '"), (r"(?i)<\s*br\s*/?\s*>", NL), (
        rf"(?i)</(?:{TAGS})\s*>", f"{NL} || {NL}"
    ), (rf"(?i)<\s*(?:{TAGS})[^>]*>", "''"), (r"<[^>]+>", "' '")
)
DECODED = STRIPPED
for _name, _value in T.NAMED_ENTITIES:
    DECODED = f"replace({DECODED}, '&{_name};', '" + _value.replace("'", "''") + "')"
TEXT = chain(DECODED, (r"\r\n?", NL), (r"[ \t]+\n", NL), (r"\n{3,}", f"{NL} || {NL}"), (r"^\s+|\s+$", "''"))
GATE = rf"(length(t) >= 3000 OR len(list_filter(string_split_regex(t, '\n{{2,}}'), lambda p: p <> '')) >= 8 OR regexp_matches(lower(t), '(^|[^a-z0-9_])({'|'.join(T.PAPER_WORDS)})([^a-z0-9_]|$)'))"
PAPER_ID = "'2001.' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0')"
HEAD_SIZE = "length(source) + 15"
LATEX = (
    r"'\begin{document}\section{ ' || source || ' }' || chr(10) || replace(text, chr(10), ' \\ ') || chr(10)"
    r" || '% a comment' || chr(10) || '\emph{' || lang || '}~end\cite{k}\end{document}'"
)
HEADED = [
    (rf"(?i)\\{name}\*?\{{\s*([^{{}}\s](?:[^{{}}]*[^{{}}\s])?)\s*\}}", rf"{NL} || {NL} || '{mark} \1' || {NL} || {NL}") for name, mark in T.HEADINGS
]
#: The rewrites of ``latex_text`` without look-around, which DuckDB's expressions lack.
PLAIN = lambda latex: chain(
    latex,
    (r"(?i)\\begin\{document\}", f"{NL} || {NL}"),
    (r"(?i)\\end\{document\}", f"{NL} || {NL}"),
    *HEADED,
    (r"(?i)\\(?:textbf|textit|emph|underline)\{([^{}]+)\}", r"'\1'"),
    (r"(?i)\\(?:title|author|date)\{([^{}]+)\}", rf"'\1' || {NL}"),
    (r"(?i)\\(?:cite|citep|citet|autocite|parencite|textcite|ref|label)\{[^{}]*\}", "''"),
    (r"(?i)\\includegraphics(?:\[[^\]]*\])?\{[^{}]*\}", "''"),
    (r"(?i)\\item([^A-Za-z0-9_]|$)", rf"{NL} || '- \1'"),
    (r"\\\\", NL),
    (r"\\[a-zA-Z@]+(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", r"chr(57344) || '\1' || chr(57345)"),
    ("\ue000\ue001", "' '"),
    ("[\ue000\ue001]", "' '"),
    (r"(?m)(^|[^\\\n])%[^\n]*", r"'\1'"),
    (r"\$\$\s*((?:[^$]|\$[^$])*?)\s*\$\$", rf"{NL} || {NL} || '$$\1$$' || {NL} || {NL}"),
    (r"\$([^\s$][^$]*?)\s*\$", r"'$\1$'"),
    ("~", "' '"),
    (r"\s+\n", NL),
    (r"\n{3,}", f"{NL} || {NL}"),
    (r"\r\n?", NL),
    (r"[ \t]+\n", NL),
    (r"\n{3,}", f"{NL} || {NL}"),
    (r"^\s+|\s+$", "''"),
)
FILES = f"""WITH files AS (
  SELECT doc_id AS id, text, f.ordinal, f.name, CASE f.name WHEN 'fig.png' THEN 1 WHEN 'readme' THEN 1 WHEN 'sub/other.tex' THEN {HEAD_SIZE} WHEN 'deep/notes.tex' THEN {HEAD_SIZE} ELSE strlen(text) END AS size, f.score
  FROM documents JOIN (VALUES (0, 0, 'sub/other.tex', 0), (0, 1, 'ms.tex', 80), (0, 2, 'fig.png', NULL), (1, 0, 'deep/notes.tex', 0), (1, 1, 'long.TEX', 20), (1, 2, 'readme', NULL)) AS f(kind, ordinal, name, score)
  ON doc_id % 4 = f.kind)"""
SQL = {
    "html_strip": f"SELECT page_id, md5({STRIPPED}) AS text_md5 FROM pages",
    "html_text": f"SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {TEXT} AS t FROM pages)",
    "fulltext_gate": rf"SELECT page_id, CAST(len(list_filter(string_split_regex(t, '\n{{2,}}'), lambda p: p <> '')) AS BIGINT) AS paragraphs, {GATE} AS full FROM (SELECT page_id, {TEXT} AS t FROM pages)".replace(" AS full ", ' AS "full" '),
    "text_window": "SELECT doc_id, substr(text, 501, 1000) AS text, least(length(text), 1500) AS end_at, length(text) AS total_chars, length(text) > 1500 AS has_more FROM documents",
    "read_cascade": f"""WITH whole AS (SELECT page_id, t FROM (SELECT page_id, {TEXT} AS t FROM pages)),
        joined AS (SELECT doc_id AS id, text, CASE WHEN {GATE.replace("length(t) >= 3000", "length(t) >= greatest(6 * length(text), 3000)")} THEN t END AS html,
            CASE WHEN doc_id % 4 < 2 THEN nullif({PLAIN("text")}, '') END AS tex, CASE WHEN doc_id % 3 = 0 THEN 'PDF ' || text END AS pdf FROM documents LEFT JOIN whole ON page_id = doc_id)
        SELECT id, CASE WHEN html IS NOT NULL THEN 'html' WHEN tex IS NOT NULL THEN 'tex' WHEN pdf IS NOT NULL THEN 'pdf' ELSE 'abstract' END AS source,
        CASE WHEN html IS NULL AND tex IS NOT NULL THEN CASE id % 4 WHEN 0 THEN 'ms.tex' ELSE 'long.TEX' END END AS source_name, md5(coalesce(html, tex, pdf, text)) AS content_md5 FROM joined""",
    "atom_roundtrip": rf"""SELECT {PAPER_ID} AS id, trim(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '\s+', ' ', 'g')) AS title,
        array_to_string(list_transform(range(1, CAST(doc_id % 3 + 2 AS BIGINT)), lambda i: source || ' ' || i), ';') AS authors, CASE WHEN doc_id % 8 BETWEEN 2 AND 4 THEN '' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS abstract,
        '2024-01-15T00:00:00Z' AS published, lang AS categories, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, 'https://arxiv.org/pdf/' || {PAPER_ID} AS pdf_url FROM documents""",
    "feed_files": f"""SELECT {PAPER_ID} AS id, strftime(DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS published, source AS authors, CAST(NULL AS VARCHAR) AS doi,
        'https://arxiv.org/abs/' || {PAPER_ID} AS abs_url FROM documents""",
    "preprint_lookup": """SELECT '2001.00017' AS id, strftime(DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS published,
        'https://arxiv.org/pdf/2001.00017' AS pdf_url, 'https://arxiv.org/html/2001.00017' AS html_url FROM documents WHERE doc_id = 17""",
    "archive_files": f"""SELECT doc_id // {ARCHIVED} AS part, CAST(row_number() OVER (PARTITION BY doc_id // {ARCHIVED} ORDER BY doc_id) - 1 AS INTEGER) AS ordinal, 'd/' || doc_id || '.tex' AS name,
        strlen(text) AS size, md5(text) AS data_md5 FROM documents""",
    "feed_scan": rf"""SELECT {PAPER_ID} AS id, trim(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '\s+', ' ', 'g')) AS title, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS abstract_md5,
        strftime(DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS published, lang AS categories FROM documents
        WHERE DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER) >= DATE '{FROM}' AND DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER) < DATE '{UNTIL}' AND lang IN {LANGUAGES}""",
    "tex_strip": f"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {PLAIN(LATEX)} AS t FROM documents)",
    "tar_entries": f"""{FILES} SELECT id, ordinal, name, size FROM files""",
    "tex_choice": f"""{FILES}, best AS (SELECT id, name, text, row_number() OVER (PARTITION BY id ORDER BY score + least(size / 1000, 30.0) DESC, ordinal) AS r FROM files WHERE score IS NOT NULL)
        SELECT id, name AS source_name, {PLAIN("text")} AS text FROM best WHERE r = 1""",
}
