"""Documentation search over documents as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as T
from paperlake.operators import search
from paperlake.operators.search_index import Index, build
from paperlake.plans.params import DocSearchParams
from paperlake.sources.tables import doc_chunks, doc_index, table
from paperlake.storage import kept

SEARCH = DocSearchParams("the nation of", 20)
ONE_WORD = DocSearchParams("License", 10)

CLEAN = r"""
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ordinal, 'doc-' || doc_id || '_page' AS source_file, 'doc' AS doc_type, lang AS category,
         regexp_extract(text, '^([^\n]*)', 1) AS title, CASE WHEN source <> 'src0' THEN source END AS section, CASE WHEN lang <> 'en' THEN lang END AS subsection, text
  FROM documents),
named AS (
  SELECT *, trim(regexp_replace(regexp_extract(text, '(?m)^#{1,6}\s+(.+)$', 1), '\s+', ' ', 'g')) AS heading, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM chunks),
cleaned AS (
  SELECT id, ordinal, doc_type, category, coalesce(section, '') AS section, coalesce(subsection, '') AS subsection, content, length(content) AS char_count,
         coalesce(nullif(heading, ''), subsection, section, nullif(trim(title), ''), 'Doc ' || id || ' Page') AS title
  FROM named WHERE content <> '')"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.clean_chunks(doc_chunks(spark, sf_dir))


def docs_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select(
        "id",
        "section",
        "subsection",
        F.col("char_count").cast("long").alias("char_count"),
        F.md5(F.col("content").cast("binary")).alias("content_md5"),
    )


def docs_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("id", "title")


def docs_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(t, " ").cast("binary")).alias("terms_md5")
    )


def top(params: DocSearchParams):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.search(cleaned(spark, sf_dir), params.query, params.limit)
        return found.select(
            "id",
            "title",
            "section",
            "subsection",
            "score",
            F.col("char_count").cast("long").alias("char_count"),
            "snippet",
        )

    return run


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: by the remainder by five a page of news by its file or its address, a heading that is no title,
    one with a link in it, and none; and a link at the end of each."""
    k = F.col("ordinal") % 5
    head = F.when(k == 2, F.lit("## What\u2019s  New")).when(k == 3, F.concat(F.lit("# [Part "), "id", F.lit("](http://x/a)  of *all*"))).otherwise("####### seven")
    content = F.concat(head, F.lit("\n"), "content", F.lit(" [see  this](http://y/z?q=1)"))
    named = doc_chunks(spark, sf_dir).withColumn("source_file", F.when(k == 0, F.concat(F.lit("whats-new_"), "id")).otherwise(F.col("source_file")))
    return named.withColumns({"source_url": F.when(k == 1, F.lit("https://x/What's_new/")).otherwise(""), "content": content})


def docs_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of Markdown pages, without those of news."""
    found = search.clean_chunks(markdown_chunks(spark, sf_dir))
    return found.select("id", "title", F.col("char_count").cast("long").alias("char_count"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def json_index(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The chunks as files of JSON arrays, as a documentation index has them: fifty chunks each."""
    rows = markdown_chunks(spark, sf_dir).withColumn("part", F.expr("ordinal div 50"))
    text = F.to_json(F.struct(*(c for c in rows.columns if c not in ("part", "ordinal"))))
    files = rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(text)), ",\n"), F.lit("]")).alias("value"))
    files.repartition("part").write.partitionBy("part").text(folder)


def docs_index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages read back from files of JSON."""
    folder = kept(spark, "json_index", [f"{sf_dir}/documents.parquet"], lambda f: json_index(spark, sf_dir, f"{f}/files"))
    found = search.clean_chunks(doc_index(spark, f"{folder}/files"))
    return found.select("id", "title", F.col("char_count").cast("long").alias("char_count"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


#: Indexes of this session, so that their files' schemas are read once.
OPENED: dict[tuple, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of all documents, built where it is not there yet."""
    folder = kept(spark, "doc_index", [f"{sf_dir}/documents.parquet"], lambda f: build(cleaned(spark, sf_dir), f))
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in OPENED:
        OPENED[key] = Index(spark, folder)
    return OPENED[key]


def indexed(params: DocSearchParams):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = index(spark, sf_dir).search(params.query, params.limit)
        return found.select("id", "title", "section", "subsection", "score", F.col("char_count").cast("long").alias("char_count"), "snippet")

    return run


def docs_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search.query_terms(SEARCH.query)
    return cleaned(spark, sf_dir).select("id", T.snippet(F.col("content"), terms).alias("snippet"))


def snippet_sql(terms: list[str]) -> str:
    low = "lower(content)"
    hits = ", ".join(f"nullif(instr({low}, '{t}'), 0)" for t in terms)
    start = f"coalesce(greatest(0, least({hits}) - 1 - 130), 0)"
    return f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || substr(content, {start} + 1, 260) || CASE WHEN {start} + 260 < length(content) THEN '...' ELSE '' END)"


def top_sql(params: DocSearchParams) -> str:
    count = lambda h, n: f"CAST((length({h}) - length(replace({h}, '{n}', ''))) / {len(n)} AS BIGINT)"
    phrase, terms = params.query.lower(), search.query_terms(params.query)
    score = " + ".join(
        [
            f"6 * {count('hay', phrase)}",
            *(
                f"4 * {count('lower(title)', t)} + 3 * {count('lower(section)', t)} + 2 * {count('lower(subsection)', t)} + {count('hay', t)}" for t in terms
            ),
        ]
    )
    return f"""WITH {CLEAN},
scored AS (SELECT *, CAST({score} AS BIGINT) AS score FROM (SELECT *, lower(concat_ws(' ', title, section, subsection, doc_type, coalesce(category, ''), content)) AS hay FROM cleaned)),
best AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, char_count DESC, ordinal LIMIT {params.limit})
SELECT id, title, section, subsection, score, char_count, {snippet_sql(terms)} AS snippet FROM best"""


QUERIES = {
    "docs_search_topk": top(SEARCH), "docs_search_one_word": top(ONE_WORD), "docs_index_search": indexed(SEARCH), "docs_index_one_word": indexed(ONE_WORD), "docs_clean": docs_clean, "docs_title": docs_title, "docs_terms": docs_terms, "docs_snippet": docs_snippet, "docs_markdown": docs_markdown, "docs_index_json": docs_index_json,
}
MARKDOWN = r"""
WITH pages AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN '## What’s  New' WHEN 3 THEN '# [Part ' || doc_id || '](http://x/a)  of *all*' ELSE '####### seven' END || chr(10) || text || ' [see  this](http://y/z?q=1)' AS raw,
         nullif(trim(CASE WHEN lang <> 'en' THEN lang END), '') AS subsection, nullif(trim(CASE WHEN source <> 'src0' THEN source END), '') AS section, nullif(trim(regexp_extract(text, '^([^\n]*)', 1)), '') AS title
  FROM documents WHERE doc_id % 5 > 1 AND text IS NOT NULL),
cleaned AS (
  SELECT doc_id, regexp_extract(raw, '(?m)^#{1,6}\s+(.+)$', 1) AS heading, subsection, section, title,
         trim(regexp_replace(regexp_replace(raw, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g')) AS content FROM pages)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 5 WHEN 3 THEN 'Part ' || doc_id || ' of *all*' ELSE coalesce(CASE WHEN doc_id % 5 <> 2 THEN nullif(trim(heading), '') END, subsection, section, title, 'Doc ' || doc_id || ' Page') END AS title,
       length(content) AS char_count, md5(content) AS content_md5 FROM cleaned"""
SQL = {
    "docs_markdown": MARKDOWN,
    "docs_index_json": MARKDOWN,
    "docs_search_topk": top_sql(SEARCH),
    "docs_search_one_word": top_sql(ONE_WORD),
    "docs_index_search": top_sql(SEARCH),
    "docs_index_one_word": top_sql(ONE_WORD),
    "docs_clean": f"WITH {CLEAN} SELECT id, section, subsection, char_count, md5(content) AS content_md5 FROM cleaned",
    "docs_title": f"WITH {CLEAN} SELECT id, title FROM cleaned",
    "docs_terms": r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5
        FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)""",
    "docs_snippet": f"WITH {CLEAN} SELECT id, {snippet_sql(search.query_terms(SEARCH.query))} AS snippet FROM cleaned",
}
