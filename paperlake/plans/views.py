"""Markdown views of preprints, texts, documentation hits, libraries, notes and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import render
from paperlake.functions import text as T
from paperlake.operators import collections as C
from paperlake.operators import search, similar
from paperlake.plans import papers
from paperlake.plans.collections import MEMBERS
from paperlake.plans.graphs import EGO, SEED_PART, ego
from paperlake.plans.papers import records
from paperlake.plans.params import WindowParams
from paperlake.plans.searches import SEARCH, cleaned, top_sql
from paperlake.sources.tables import cited_papers, collection_events, table

WINDOW = WindowParams(500, 1000)


def preprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as preprints with one to five authors; every third has a DOI, every other one an update."""
    key = F.col("o_orderkey")
    link = lambda kind: F.concat(F.lit(f"https://arxiv.org/{kind}/o"), key)
    published = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), key).alias("id"), F.concat(F.lit("Order "), key).alias("title"), F.transform(
            F.sequence(F.lit(1), (key % 5 + 1).cast("int")),
            lambda i: F.concat(F.lit("C"), F.col("o_custkey"), F.lit("-"), i),
        ).alias("authors"),
        published.alias("published"), F.when(key % 2 == 0, published).otherwise("2002-01-01T00:00:00Z").alias("updated"), F.array("o_orderpriority", "o_orderstatus").alias("categories"),
        F.when(
            key % 3 == 0, F.concat(F.lit("10.1/"), key)
        ).alias("doi"), F.col("o_orderpriority").alias("abstract"), link("abs").alias("abs_url"), link("pdf").alias("pdf_url"), link("html").alias("html_url"), key.alias("key"),
    )


def render_preprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprints(spark, sf_dir).select("id", F.md5(render.preprint_detail().cast("binary")).alias("text_md5"))


def render_preprint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("published"), F.asc("key")]
    return render.preprint_list(preprints(spark, sf_dir).orderBy(*order).limit(10), order)


def render_read_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read papers: the source goes by the remainder of the number."""
    sources = F.array(*map(F.lit, ("tex", "html", "pdf", "abstract")))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("key"), F.col("text").alias("content"))
    papers = preprints(spark, sf_dir).join(docs, "key").withColumns(
        {"source": F.get(sources, (F.col("key") % 4).cast("int")), "source_name": F.when(F.col("key") % 4 == 0, "main.tex")}
    )
    return papers.select("id", F.md5(render.read_view(WINDOW.offset, WINDOW.max_chars).cast("binary")).alias("text_md5"))


def render_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth paper has no text."""
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("key"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("full_text")
    )
    return preprints(spark, sf_dir).join(docs, "key").select(
        "id", F.md5(render.full_text_view(WINDOW.offset, WINDOW.max_chars).cast("binary")).alias("text_md5")
    )


def render_docs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(cleaned(spark, sf_dir), SEARCH.query, SEARCH.limit)
    return render.docs_list(found, [F.desc("score"), F.desc("char_count"), F.asc("ordinal")], SEARCH.query)


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries of the event log under stand-in names; every second is public, every fifth described."""
    k = F.col("library_id")
    return C.libraries(collection_events(spark, sf_dir)).withColumns(
        {
            "id": F.concat(F.lit("L"), k),
            "name": F.concat(F.lit("Library "), k),
            "description": F.when(k % 5 == 0, F.concat(F.lit("About "), k)),
            "public": k % 2 == 0,
            "owner": F.concat(F.lit("user"), k % 7),
        }
    )


def render_library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of each user who owns libraries, as rows of text."""
    return render.library_lines(libraries(spark, sf_dir).where("permission = 'owner'"), ["library_id"], by=("owner",))


def render_library_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each library with its papers in order, as rows of text."""
    return render.library_detail_lines(libraries(spark, sf_dir), C.members(collection_events(spark, sf_dir)))


def render_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = C.notes(collection_events(spark, sf_dir))
    body = F.concat(F.lit("note "), (F.col("content") * 1000).cast("long"))
    return notes.withColumn("content", body).select("library_id", "doc_id", render.note_view().alias("text"))


def render_graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ego(spark, sf_dir).select(
        "direction",
        F.col("id").cast("string").alias("id"),
        F.col("id").alias("key"),
        F.lit(None).cast("string").alias("title"),
        "author",
        "year",
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), "id")).alias("arxiv_id"),
    )
    paper = cited_papers(spark, sf_dir).where(F.col("id") == SEED_PART).select("title", F.lit(None).cast("int").alias("year"))
    return render.graph_view(
        str(SEED_PART),
        paper,
        near.where("direction = 'citation'"),
        near.where("direction = 'reference'"),
        [F.asc("key")],
    )


def empty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of what is not there, and of one paper that is."""
    detail = lambda key: records(spark, sf_dir).where(F.col("bibcode") == key).select(render.paper_detail().alias("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = similar.by_vector(vectors, -1).select(F.col("id").cast("string").alias("text"))
    every = preprints(spark, sf_dir)
    found = every.where(F.contains("title", F.lit("unheard of"))).select(F.col("title").alias("text"))
    one = every.where("id = 'ox'").select(render.preprint_detail().alias("text"))
    docs = search.search(cleaned(spark, sf_dir), "unheardof", 5)
    listed = render.docs_list(docs, [F.desc("score"), F.desc("char_count"), F.asc("ordinal")], "unheardof")
    views = {
        "record": render.or_message(detail("PX"), render.NO_RECORD.format("PX")),
        "known record": render.or_message(detail("P1"), render.NO_RECORD.format("P1")),
        "similar": render.or_message(near, render.NO_SIMILAR.format("v")),
        "preprints": render.or_message(found, render.NO_PREPRINTS.format("unheard of")),
        "preprint": render.or_message(one, render.NO_PREPRINT.format("ox")),
        "docs": listed,
    }
    return reduce(DataFrame.union, (v.select(F.lit(name).alias("view"), "text") for name, v in views.items()))


def entities_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents behind a fixed head, line breaks as numeric references."""
    escaped = F.concat(F.lit("&#72;&#x69;&#8212;&#x1F600; &copy; &amp;lt; "), F.replace("text", F.lit("\n"), F.lit("&#10;")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.decode_entities(escaped).cast("binary")).alias("text_md5"))


QUERIES = {
    "render_preprint": render_preprint, "render_preprint_list": render_preprint_list, "render_read_paper": render_read_paper, "render_full_text": render_full_text, "render_docs_list": render_docs_list,
    "render_library_list": render_library_list, "render_library_detail": render_library_detail, "render_note": render_note, "render_graph_view": render_graph_view, "entities_decode": entities_decode, "empty_messages": empty_messages,
}

NL = "chr(10)"
PARA = "chr(10) || chr(10)"
PREPRINTS = """preprints AS (
  SELECT o_orderkey AS key, 'o' || o_orderkey AS id, 'Order ' || o_orderkey AS title, list_transform(range(1, CAST(o_orderkey % 5 + 2 AS BIGINT)), lambda i: 'C' || o_custkey || '-' || i) AS authors, strftime(o_orderdate, '%Y-%m-%d') AS published,
         CASE WHEN o_orderkey % 2 = 1 AND o_orderdate <> TIMESTAMP '2002-01-01' THEN '2002-01-01' END AS updated, [o_orderpriority, o_orderstatus] AS categories, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey END AS doi, o_orderpriority AS abstract,
         'https://arxiv.org/abs/o' || o_orderkey AS abs_url FROM orders)"""
AUTHORS = "CASE WHEN len(authors) > 3 THEN array_to_string(authors[1:3], ', ') || ' et al.' ELSE array_to_string(authors, ', ') END"
HEAD = f"'# ' || title || {PARA} || '**Authors:** ' || {AUTHORS} || {PARA} || '**arXiv ID:** `' || id || '`' || {PARA}"
LINKS = f"'**Links:** [Abstract](' || abs_url || ') | [PDF](' || replace(abs_url, '/abs/', '/pdf/') || ') | [HTML](' || replace(abs_url, '/abs/', '/html/') || ')' || {PARA}"
DOI = f"coalesce('**DOI:** https://doi.org/' || doi || {PARA}, '')"
ABSTRACT = f"'## Abstract' || {PARA} || abstract || {PARA}"
TRIM = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"


def window_sql(content: str) -> str:
    low, high = WINDOW.offset, WINDOW.offset + WINDOW.max_chars
    end = f"least(length({content}), {high})"
    more = f"CASE WHEN length({content}) > {high} THEN {NL} || '_More text is available. Call this tool again with `offset=' || {end} || '` to continue._' ELSE '' END"
    return f"{TRIM % f'substr({content}, {low + 1}, {WINDOW.max_chars})'} || {PARA} || '_Showing characters {low}-' || {end} || ' of ' || length({content}) || '._' || {more}"


FACTS = f"""'- **ID:** `L' || library_id || '`' || {NL} || CASE WHEN library_id % 5 = 0 THEN '- **Description:** About ' || library_id || {NL} ELSE '' END
  || '- **Papers:** ' || num_documents || '  |  **Permission:** ' || permission || '  |  **Public:** ' || CASE WHEN library_id % 2 = 0 THEN 'Yes' ELSE 'No' END || {NL} || '- **Owner:** user' || library_id % 7"""
LIBRARIES = f"""{MEMBERS}, n AS (SELECT library_id, count(*) AS n FROM members GROUP BY 1),
  libraries AS (SELECT library_id, max(ts) AS date_last_modified, any_value(permission) AS permission, coalesce(any_value(n.n), 0) AS num_documents FROM e LEFT JOIN n USING (library_id) GROUP BY library_id)"""


def neighbours_sql(direction: str, heading: str) -> str:
    item = f"i || '. **Untitled**' || {NL} || '   - ' || coalesce(author, 'Unknown') || coalesce(' (' || year || ')', '') || {NL} || CASE WHEN id % 3 = 0 THEN '   - arXiv: `a' || id || '`' || {NL} ELSE '' END || '   - Semantic Scholar: `' || id || '`' || {PARA}"
    none = f"'## {heading} (0)' || {PARA} || 'No papers returned.' || {PARA}"
    return f"""(SELECT CASE WHEN count(*) = 0 THEN {none} ELSE '## {heading} (' || count(*) || ')' || {PARA} || string_agg({item}, '' ORDER BY i) FILTER (i <= 25)
      || CASE WHEN count(*) > 25 THEN '_Showing 25 of ' || count(*) || ' returned papers._' || {PARA} ELSE '' END END FROM numbered WHERE direction = '{direction}')"""


DOC_ITEM = f"""i || '. **' || title || '**' || {NL} || CASE WHEN concat(section, subsection) <> '' THEN '   - Section: ' || concat_ws(' / ', nullif(section, ''), nullif(subsection, '')) || {NL} ELSE '' END || '   - Type: doc' || {NL}
  || coalesce('   - Category: ' || lang || {NL}, '') || '   - Source: [doc-' || id || '_page]()' || {NL} || '   - Score: ' || score || '.00' || {NL} || '   - Snippet: ' || snippet || {PARA}"""
SQL = {
    "empty_messages": f"""SELECT 'record' AS "view", 'No paper found with identifier: PX' AS text UNION ALL SELECT 'known record', text FROM ({papers.SQL["render_detail"]}) WHERE bibcode = 'P1'
        UNION ALL SELECT 'similar', 'No similar papers found for: v' UNION ALL SELECT 'preprints', 'No results found for: unheard of'
        UNION ALL SELECT 'preprint', 'No paper found with ID: ox' UNION ALL SELECT 'docs', 'No SciX docs found for: unheardof'""",
    "render_preprint": f"""WITH {PREPRINTS} SELECT id, md5({HEAD} || '**Published:** ' || published || {PARA} || coalesce('**Updated:** ' || updated || {PARA}, '') || '**Categories:** ' || array_to_string(categories, ', ') || {PARA} || {DOI} || {LINKS} || {ABSTRACT}) AS text_md5 FROM preprints""",
    "render_preprint_list": f"""WITH {PREPRINTS}, best AS (SELECT *, row_number() OVER (ORDER BY published DESC, key) AS i FROM preprints ORDER BY i LIMIT 10)
        SELECT '# arXiv Search Results' || {PARA} || 'Found **' || count(*) || '** paper(s)' || {PARA} || string_agg(i || '. **' || title || '**' || {NL} || '   - ' || authors[1] || ' (' || published || ')' || {NL} || '   - ID: `' || id || '`' || {NL}
        || '   - Categories: ' || array_to_string(categories, ', ') || {NL} || '   - [Abstract](' || abs_url || ')' || {PARA}, '' ORDER BY i) AS text FROM best""",
    "render_read_paper": f"""WITH {PREPRINTS}, d AS (SELECT doc_id + 1 AS key, {TRIM % 'text'} AS t FROM documents)
        SELECT id, md5({HEAD} || '**Source:** ' || ['arXiv source archive', 'arXiv HTML', 'arXiv PDF', 'Abstract fallback'][CAST(key % 4 + 1 AS INTEGER)] || {PARA} || CASE WHEN key % 4 = 0 THEN '**Source file:** `main.tex`' || {PARA} ELSE '' END
        || {LINKS} || {DOI} || '## Extracted text' || {PARA} || {window_sql('t')} || {NL}) AS text_md5 FROM preprints JOIN d USING (key)""",
    "render_full_text": f"""WITH {PREPRINTS}, d AS (SELECT doc_id + 1 AS key, CASE WHEN doc_id % 5 <> 0 THEN {TRIM % 'text'} END AS t FROM documents)
        SELECT id, md5({HEAD} || '**Published:** ' || published || {PARA} || {LINKS} || {ABSTRACT} || '## Full text' || {PARA} || CASE WHEN t <> '' THEN {window_sql('t')} ELSE '_No text could be extracted from the PDF._' END || {PARA}) AS text_md5 FROM preprints JOIN d USING (key)""",
    "render_docs_list": f"""WITH best AS ({top_sql(SEARCH)}), numbered AS (SELECT best.*, lang, row_number() OVER (ORDER BY score DESC, char_count DESC, doc_id) AS i FROM best JOIN documents ON doc_id = CAST(id AS BIGINT))
        SELECT '# SciX Docs Search Results' || {PARA} || 'Found **' || count(*) || '** result(s) for **{SEARCH.query}**' || {PARA} || string_agg({DOC_ITEM}, '' ORDER BY i) AS text FROM numbered""",
    "render_library_list": f"""WITH {LIBRARIES}, page AS (SELECT *, 'user' || library_id % 7 AS owner FROM libraries WHERE permission = 'owner')
        SELECT owner, 0 AS place, '# Libraries (' || count(*) || ')' || {PARA} AS text FROM page GROUP BY 1 UNION ALL
        SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY library_id), '## Library ' || library_id || {NL} || {FACTS} || '  |  **Modified:** ' || strftime(date_last_modified, '%Y-%m-%d') || {PARA} FROM page""",
    "render_library_detail": f"""WITH {LIBRARIES} SELECT library_id, 0 AS place, '# Library ' || library_id || {PARA} || {FACTS} || {PARA}
        || CASE WHEN num_documents > 0 THEN '## Papers (' || num_documents || ')' || {PARA} ELSE '' END AS text FROM libraries UNION ALL
        SELECT library_id, i, i || '. `' || doc_id || '`' || {NL} FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY doc_id) AS i FROM members)""",
    "render_note": f"""WITH notes AS (SELECT library_id, doc_id, content, ts FROM (SELECT *, row_number() OVER (PARTITION BY library_id, doc_id ORDER BY ts DESC, event_id DESC) AS r
        FROM (SELECT user_id AS library_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, event_type, round(value, 6) AS content, ts, event_id FROM events) WHERE (event_type = 'purchase' AND content IS NOT NULL) OR event_type = 'signup') WHERE r = 1 AND event_type = 'purchase')
        SELECT library_id, doc_id, '# Note for `' || doc_id || '`' || {PARA} || 'note ' || CAST(trunc(content * 1000) AS BIGINT) || {PARA} || '*Last updated: ' || strftime(ts, '%Y-%m-%d') || '*' || {NL} AS text FROM notes""",
    "render_graph_view": f"""WITH {EGO}, numbered AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY id) AS i FROM ego)
        SELECT '# Citation Graph for arXiv:{SEED_PART}' || {PARA} || '**Title:** ' || coalesce((SELECT p_name FROM part WHERE p_partkey = {SEED_PART}), 'Untitled') || {PARA} || '**Citations returned:** ' || (SELECT count(*) FROM ego WHERE direction = 'citation') || {PARA}
        || '**References returned:** ' || (SELECT count(*) FROM ego WHERE direction = 'reference') || {PARA} || {neighbours_sql('citation', 'Citing papers')} || {neighbours_sql('reference', 'Referenced papers')} AS text""",
    "entities_decode": "SELECT doc_id, md5('Hi' || chr(8212) || chr(128512) || ' &copy; &lt; ' || text) AS text_md5 FROM documents",
}
