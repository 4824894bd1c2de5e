"""Citation graph, bibliometric indices and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import render
from paperlake.operators import graph, metrics, neighbours, similar
from paperlake.sources.tables import cited_papers, citing_papers, edges, pairs, reads, table
from paperlake.storage import kept

AS_OF = 2002
SEED_PART, SEED_ORDER = 7, 7


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its number of citations."""
    n = graph.citation_counts(edges(spark, sf_dir))
    return cited_papers(spark, sf_dir).join(n, "id", "left").select(
        "id", "author", F.coalesce("citation_count", F.lit(0)).cast("long").alias("citations")
    )


def citations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    papers = citing_papers(spark, sf_dir).select("id", "author", "score")
    return graph.neighbours(e, papers, SEED_PART, "citations", [F.desc("score"), F.asc("id")], 20)


def references_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.references(edges(spark, sf_dir), cited_papers(spark, sf_dir).select("id", "author"), SEED_ORDER, 20)


def ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and part of the seed number share it; the whole record tables are joined."""
    citing = citing_papers(spark, sf_dir).select("id", F.col("author").cast("string").alias("author"), "year")
    cited = cited_papers(spark, sf_dir).select("id", "author", F.lit(None).cast("long").alias("year"))
    return graph.ego_graph(edges(spark, sf_dir), citing, cited, SEED_PART)


def nested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested graph nodes; every customer gives the order's number of lines as authors, some of them without a name."""
    key = F.col("id")
    name = lambda i: F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, F.concat(F.lit("C"), F.col("author"), F.lit("-"), i)).otherwise("")
    author = lambda i: F.struct(F.concat(F.lit("id"), i).alias("authorId"), name(i).alias("name"), F.lit("https://x").alias("url"))
    authors = F.transform(F.sequence(F.lit(1), (key % 7 + 1).cast("int")), author)
    some = lambda c, x: F.when(c, x)
    ids = F.struct(
        some(key % 4 == 0, F.concat(F.lit("o"), key)).alias("ArXiv"), some(key % 4 != 0, F.lit("10.1/x")).alias("DOI"), F.concat(F.lit("c"), key).alias("CorpusId")
    )
    text = F.concat(F.lit("Order "), key)
    return citing_papers(spark, sf_dir).select(
        key.cast("string").alias("paperId"), text.alias("title"), F.col("year").cast("int").alias("year"), authors.alias("authors"), ids.alias("externalIds"),
        F.struct(F.repeat(text, 20).alias("text"), F.lit("x").alias("model")).alias("tldr"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested nodes, from a stored table of whole ones: only the leaves asked for are read."""
    folder = kept(spark, "graph_nodes", [f"{sf_dir}/orders.parquet"], lambda f: nested_nodes(spark, sf_dir).write.parquet(f))
    return graph.node_fields(spark.read.parquet(folder))


def citation_graph_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours of both directions as numbered rows with both counts."""
    return graph.numbered_ego(ego(spark, sf_dir), str(SEED_PART))


def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.citation_counts(edges(spark, sf_dir))


def metrics_h_g_i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.indices(counts(spark, sf_dir))


def first_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of a part is that of its first citing order."""
    orders = citing_papers(spark, sf_dir).select(F.col("id").alias("citing"), "year")
    years = edges(spark, sf_dir).join(orders, "citing").groupBy(F.col("cited").alias("id")).agg(F.min("year").alias("year"))
    return counts(spark, sf_dir).join(years, "id", "left")


def metrics_m_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.m_index(first_years(spark, sf_dir), AS_OF).withColumn("m", F.round("m", 6))


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in authors of every paper, one to five by its number; one of them has a third of all papers."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).union(table(spark, sf_dir, "part").select("p_partkey"))
    own = F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("a"), (F.col("id") * i + i * i) % 89))
    hot = F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(F.array().cast("array<string>"))
    return ids.distinct().select("id", F.array_distinct(F.concat(hot, own)).alias("authors"))


def metrics_tori(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By author: every citation of a paper counts for each of its authors, but for those who wrote the citing paper as well."""
    judged = metrics.author_citations(edges(spark, sf_dir), authorships(spark, sf_dir))
    return metrics.tori(judged).withColumn("tori", F.round("tori", 6))


def metrics_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indices of every author from lists of authors."""
    n = graph.citation_counts(edges(spark, sf_dir)).withColumnRenamed("citation_count", "citations")
    papers = authorships(spark, sf_dir).join(n, "id", "left").withColumn("citations", F.coalesce("citations", F.lit(0)).cast("long"))
    return metrics.indices(metrics.by_author(papers))


def metrics_citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = citing_papers(spark, sf_dir).select(F.col("id").alias("citing"), F.col("refereed").cast("long").alias("refereed"))
    n = edges(spark, sf_dir).join(by, "citing", "left").groupBy(F.col("cited").alias("id")).agg(
        F.count("*").alias("citations"), F.coalesce(F.sum("refereed"), F.lit(0)).alias("refereed")
    )
    papers = cited_papers(spark, sf_dir).join(n, "id", "left").select(
        "author",
        F.coalesce("citations", F.lit(0)).alias("citations"),
        F.coalesce("refereed", F.lit(0)).alias("refereed"),
    )
    return metrics.citation_stats(papers).withColumn("mean_citations", F.round("mean_citations", 6))


def metrics_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_paper = reads(spark, sf_dir).where("paper IS NOT NULL").groupBy("author", "paper").agg(F.count("*").alias("n"))
    return by_paper.groupBy("author").agg(
        F.count("*").alias("papers"),
        F.sum("n").alias("reads"),
        F.round(F.sum("n") / F.count("*"), 6).alias("mean_reads"),
    )


def metrics_self_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.self_citations(edges(spark, sf_dir), authorships(spark, sf_dir))
    return found.groupBy("cited").agg(F.count("*").alias("self_citations"))


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similar.by_vector(vectors, 0, 10)


def similar_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, by the kept index of all of them."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    folder = kept(spark, "neighbours", [f"{sf_dir}/embeddings.parquet"], lambda f: neighbours.build(vectors, f))
    return neighbours.search(spark, folder, 10)


def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similar.by_terms(docs, 3, 10)


def render_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ego(spark, sf_dir).where("direction = 'citation'").select("id", F.lit(None).cast("string").alias("title"), "author", "year")
    return render.graph_list(near, [F.asc("id")], "Citing papers")


def render_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of the view for every group of papers; a paper's citations and reads are counted once for all of them."""
    parts = cited_papers(spark, sf_dir).select("id", "author")
    cited = metrics.paper_citations(pairs(spark, sf_dir), citing_papers(spark, sf_dir), authorships(spark, sf_dir), parts)
    read = reads(spark, sf_dir).groupBy(F.col("paper").alias("id")).agg(F.count("*").alias("reads"))
    counted = parts.where("author IS NOT NULL").join(cited.withColumnRenamed("cited", "id"), "id", "left").join(read, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("citations", "total_citations", "refereed_citations")}
    wide = metrics.profile(counted.withColumns(zero), AS_OF)
    wide = wide.withColumns({c: F.round(c, 6) for c in ("m", "tori", "mean_citations")})
    return wide.select("author", render.metrics_view(F.col("papers")).alias("text"))


QUERIES = {
    "citations_of": citations_of, "references_of": references_of, "citation_graph_ego": ego, "citation_graph_nested": citation_graph_nested, "graph_nodes": graph_nodes, "citation_counts": citation_counts, "metrics_h_g_i10": metrics_h_g_i10,
    "metrics_m_index": metrics_m_index, "metrics_tori": metrics_tori, "metrics_by_author": metrics_by_author, "metrics_citation_stats": metrics_citation_stats, "metrics_basic": metrics_basic, "metrics_self_citations": metrics_self_citations,
    "similar_vectors": similar_vectors, "similar_many": similar_many, "similar_terms": similar_terms, "render_graph": render_graph, "render_metrics": render_metrics,
}

EDGES = "edges AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem)"
COUNTS = f"{EDGES}, counts AS (SELECT p_partkey AS id, p_brand AS author, count(citing) AS citations FROM part LEFT JOIN edges ON cited = p_partkey GROUP BY ALL)"
RANKED = f"{COUNTS}, ranked AS (SELECT *, row_number() OVER w AS r, sum(citations) OVER (PARTITION BY author ORDER BY citations DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM counts WINDOW w AS (PARTITION BY author ORDER BY citations DESC, id))"
STATS = f"""{EDGES}, n AS (SELECT p_partkey, p_brand AS author, count(citing) AS citations, count(*) FILTER (o_orderstatus = 'F') AS refereed FROM part LEFT JOIN edges ON cited = p_partkey LEFT JOIN orders ON o_orderkey = citing GROUP BY ALL),
  stats AS (SELECT author, CAST(sum(citations) AS BIGINT) AS total_citations, CAST(sum(refereed) AS BIGINT) AS refereed_citations, round(avg(citations), 6) AS mean_citations, CAST(median(citations) AS DOUBLE) AS median_citations FROM n GROUP BY author)"""
EGO = f"""{EDGES}, ego AS (
  SELECT 'citation' AS direction, citing AS id, CAST(o_custkey AS VARCHAR) AS author, year(o_orderdate) AS year FROM edges LEFT JOIN orders ON o_orderkey = citing WHERE cited = {SEED_PART}
  UNION ALL SELECT 'reference', cited, p_brand, NULL FROM edges LEFT JOIN part ON p_partkey = cited WHERE citing = {SEED_PART})"""
#: One row a paper, with its list of authors.
AUTHORS = """papers AS (SELECT id, list_distinct(list_concat(CASE WHEN id % 3 = 0 THEN ['hot'] ELSE [] END,
    list_transform(range(1, CAST(id % 4 + 2 AS BIGINT)), lambda i: 'a' || ((id * i + i * i) % 89)))) AS authors FROM (SELECT o_orderkey AS id FROM orders UNION SELECT p_partkey FROM part))"""
OWN = f"""{EDGES}, {AUTHORS}, refs AS (SELECT citing, count(*) AS n FROM edges GROUP BY 1),
    judged AS (SELECT e.citing, e.cited, c.authors, refs.n, coalesce(list_has_any(b.authors, c.authors), false) AS own, b.authors AS writers
    FROM edges e JOIN papers c ON c.id = e.cited JOIN refs ON refs.citing = e.citing LEFT JOIN papers b ON b.id = e.citing)"""
OWN_PARTS = OWN.removeprefix(f"{EDGES}, ")
INDICES = f"""{RANKED}, indices AS (SELECT author, count(*) AS papers, count(*) FILTER (citations >= r) AS h, coalesce(max(r) FILTER (s >= r * r), 0) AS g, count(*) FILTER (citations >= 10) AS i10 FROM ranked GROUP BY author)"""
SQL = {
    "graph_nodes": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS title, year(o_orderdate) AS year, 'o' || CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS arxiv_id,
        array_to_string(list_transform(list_filter(range(1, CAST(o_orderkey % 7 + 2 AS BIGINT)), lambda i: i % 3 = 1), lambda i: 'C' || o_custkey || '-' || i), ', ') AS authors FROM orders""",
    "citations_of": f"WITH {EDGES} SELECT o_orderkey AS id, o_custkey AS author, o_totalprice AS score FROM edges JOIN orders ON o_orderkey = citing WHERE cited = {SEED_PART} ORDER BY score DESC, id LIMIT 20",
    "references_of": f"WITH {COUNTS} SELECT id, author, citations FROM edges JOIN counts ON id = cited WHERE citing = {SEED_ORDER} ORDER BY citations DESC, id LIMIT 20",
    "citation_graph_ego": f"WITH {EGO} SELECT * FROM ego",
    "citation_graph_nested": f"""WITH {EGO} SELECT '{SEED_PART}' AS paper_id, direction, row_number() OVER (PARTITION BY direction ORDER BY id) AS place, id, author, year,
        count(*) FILTER (direction = 'citation') OVER () AS citation_count, count(*) FILTER (direction = 'reference') OVER () AS reference_count FROM ego""",
    "citation_counts": "SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS citation_count FROM lineitem GROUP BY 1",
    "metrics_h_g_i10": f"WITH {INDICES} SELECT * FROM indices",
    "metrics_m_index": f"""WITH {INDICES}, firsts AS (SELECT p_brand AS author, min(year(o_orderdate)) AS first_year FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
        SELECT author, h, first_year, round(h / greatest(1, {AS_OF} - first_year), 6) AS m FROM indices JOIN firsts USING (author)""",
    "metrics_tori": f"""WITH {OWN} SELECT author, round(sum(1 / (k * n)), 6) AS tori
        FROM (SELECT unnest(authors) AS author, len(authors) AS k, n, writers FROM judged) WHERE NOT coalesce(list_contains(writers, author), false) GROUP BY 1""",
    "metrics_by_author": f"""WITH {EDGES}, {AUTHORS}, n AS (SELECT cited, count(*) AS n FROM edges GROUP BY 1),
        of AS (SELECT id, unnest(authors) AS author, coalesce(n, 0) AS c FROM papers LEFT JOIN n ON cited = id),
        ranked AS (SELECT *, row_number() OVER w AS r, sum(c) OVER (PARTITION BY author ORDER BY c DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM of WINDOW w AS (PARTITION BY author ORDER BY c DESC, id))
        SELECT author, count(*) AS papers, count(*) FILTER (c >= r) AS h, coalesce(max(r) FILTER (s >= r * r), 0) AS g, count(*) FILTER (c >= 10) AS i10 FROM ranked GROUP BY author""",
    "metrics_citation_stats": f"WITH {STATS} SELECT * FROM stats",
    "metrics_basic": "SELECT user_id AS author, count(DISTINCT json_extract_string(props, '$.k')) AS papers, count(*) AS reads, round(count(*) / count(DISTINCT json_extract_string(props, '$.k')), 6) AS mean_reads FROM events WHERE event_type = 'view' GROUP BY 1",
    "metrics_self_citations": f"""WITH {OWN} SELECT cited, count(*) AS self_citations FROM judged WHERE own GROUP BY 1""",
    "similar_vectors": """SELECT e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) s
        WHERE e.vec_id <> 0 ORDER BY score DESC, id LIMIT 10""",
    "similar_terms": r"""WITH terms AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM documents) GROUP BY 1, 2),
        shared AS (SELECT * FROM terms WHERE t IN (SELECT t FROM terms WHERE doc_id = 3)), weights AS (SELECT t, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM shared GROUP BY 1)
        SELECT doc_id AS id, round(sum((1 + ln(tf)) * idf * idf), 6) AS score FROM shared JOIN weights USING (t) WHERE doc_id <> 3 GROUP BY 1 ORDER BY score DESC, id LIMIT 10""",
    "render_graph": f"""WITH {EGO}, near AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM ego WHERE direction = 'citation')
        SELECT CASE WHEN count(*) = 0 THEN '## Citing papers (0)' || chr(10) || chr(10) || 'No papers returned.' || chr(10) || chr(10) ELSE '## Citing papers (' || count(*) || ')' || chr(10) || chr(10)
        || string_agg(i || '. **Untitled**' || chr(10) || '   - ' || coalesce(author, 'Unknown') || coalesce(' (' || year || ')', '') || chr(10) || '   - Semantic Scholar: `' || id || '`' || chr(10) || chr(10), '' ORDER BY i) FILTER (i <= 25)
        || CASE WHEN count(*) > 25 THEN '_Showing 25 of ' || count(*) || ' returned papers._' || chr(10) || chr(10) ELSE '' END END AS text FROM near""",
    "render_metrics": f"""WITH {INDICES}, stats AS (
        SELECT p_brand AS author, count(citing) AS total, count(*) FILTER (o_orderstatus = 'F') AS refereed, count(citing) / count(DISTINCT p_partkey) AS mean FROM part LEFT JOIN edges ON cited = p_partkey LEFT JOIN orders ON o_orderkey = citing GROUP BY 1),
        medians AS (SELECT author, median(citations) AS middle FROM counts GROUP BY 1),
        firsts AS (SELECT p_brand AS author, min(year(o_orderdate)) AS first_year FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
        {OWN_PARTS},
        toris AS (SELECT p_brand AS author, round(sum(1 / (len(authors) * n)), 6) AS tori FROM judged JOIN part ON p_partkey = cited WHERE NOT own GROUP BY 1),
        own AS (SELECT p_brand AS author, count(*) AS self_citations FROM judged JOIN part ON p_partkey = cited WHERE own GROUP BY 1),
        read AS (SELECT p_brand AS author, count(*) AS reads FROM events JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT) WHERE event_type = 'view' GROUP BY 1)
        SELECT author, '# Citation Metrics' || chr(10) || chr(10) || '*Based on ' || papers || ' paper(s)*' || chr(10) || chr(10) || '## Indices' || chr(10) || chr(10) || '- **h-index:** ' || h || chr(10) || '- **g-index:** ' || g || chr(10) || '- **i10-index:** ' || i10 || chr(10)
        || coalesce('- **m-index:** ' || format('{{:.2f}}', floor(round(h / greatest(1, {AS_OF} - first_year), 6) * 100 + 0.5) / 100) || chr(10), '') || coalesce('- **tori:** ' || format('{{:.2f}}', floor(tori * 100 + 0.5) / 100) || chr(10), '') || chr(10)
        || '## Citation Statistics' || chr(10) || chr(10) || '- **Total citations:** ' || total || chr(10) || '- **Refereed citations:** ' || refereed || chr(10) || '- **Average:** ' || format('{{:.1f}}', floor(round(mean, 6) * 10 + 0.5) / 10) || chr(10)
        || '- **Median:** ' || replace(CAST(CAST(middle AS DOUBLE) AS VARCHAR) || '|', '.0|', '|')[:-2] || chr(10) || '- **Self-citations:** ' || coalesce(self_citations, 0) || chr(10) || chr(10)
        || '## Paper Statistics' || chr(10) || chr(10) || '- **Total papers:** ' || papers || chr(10) || '- **Total reads:** ' || coalesce(reads, 0) || chr(10)
        || coalesce('- **Average reads:** ' || format('{{:.1f}}', floor(reads / papers * 10 + 0.5) / 10) || chr(10), '') || chr(10) AS text
        FROM indices JOIN stats USING (author) JOIN medians USING (author) LEFT JOIN firsts USING (author) LEFT JOIN toris USING (author) LEFT JOIN own USING (author) LEFT JOIN read USING (author)""",
}
