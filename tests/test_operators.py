import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperlake.functions import export, render
from paperlake.operators import collections as C
from paperlake.operators import graph, metrics, search, similar
from paperlake.operators.boolean import Field, Fields, any_category, month_range
from paperlake.operators.paging import page
from paperlake.plans import params as P
from paperlake.sources.tables import GRAPH_NODE

CHUNK = "id string, source_file string, source_url string, doc_type string, category string, title string, section string, subsection string, content string, ordinal long"


def chunks(spark, rows):
    return search.clean_chunks(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CHUNK))


def test_titles_and_filters(spark):
    rows = [
        ("a", "a-file_name", "", "", "", "T", "S", "Sub", "# Head [x](y)\nbody"), ("b", "b", "", "", "", "T", "S", " ", "body"), ("c", "c", "", "", "", "T", None, None, "body"), (
            "d",
            "my-slug",
            "",
            "",
            "",
            "",
            "What's new",
            "",
            "body",
        ),
        ("e", "whats-new", "", "", "", "T", "", "", "body"), ("f", "f", "", "", "", "404", "", "", "body"), ("g", "g", "", "", "", "T", "", "", " \n"), (
            "h",
            None,
            None,
            None,
            None,
            None,
            None,
            None,
            "x",
        ),
    ]
    got = {r.id: (r.title, r.char_count) for r in chunks(spark, rows).collect()}
    assert got == {"a": ("Head x", 13), "b": ("S", 4), "c": ("T", 4), "d": ("My Slug", 4), "h": ("h", 1)}


def test_ranking(spark):
    def row(i, title, content, section="", subsection=""):
        return (i, "f" + i, "", "", "", title, section, subsection, content)

    rows = [
        row("1", "alpha", "beta"),
        row("2", "x", "alpha alpha"),
        row("3", "x", "alpha alphas"),
        row("4", "y", "none"),
        row("5", "z", "beta gamma"),
    ]
    c = chunks(spark, rows)
    got = [(r.id, r.score) for r in search.search(c, "Alpha", 5).collect()]
    assert got == [("3", 14), ("2", 14), ("1", 11)]
    assert [r.score for r in search.search(c, "alpha alpha", 1).collect()] == [2 + 2 + 6]
    assert [r.id for r in search.search(c, '"beta" (gamma)', 5).collect()] == ["5", "1"]
    assert search.search(c, "  ", 5).count() == 0 and search.search(c, "beta", 0).count() == 1


def test_phrase_across_fields_and_snippets(spark):
    long = "w " * 300 + "needle " + "v " * 300
    c = chunks(
        spark,
        [
            ("1", "f", "", "", "", "one two", "three", "", long),
            ("2", "g", "", "", "", "t", "", "", "needle at the start"),
            ("3", "h", "", "", "", "q", "", "", "w " * 200 + "needle"),
        ],
    )
    assert [r.id for r in search.search(c, "three", 5).collect()] == ["1"]
    got = {r.id: r.snippet for r in search.search(c, "needle", 5).collect()}
    assert got["1"].startswith("...") and got["1"].endswith("...") and len(got["1"]) == 266 and "needle" in got["1"]
    assert got["2"] == "needle at the start" and got["3"].startswith("...") and got["3"].endswith("needle")


FIELDS = Fields(
    {"ti": Field("title"), "au": Field("author", "exact"), "year": Field("year", "number"), "cat": Field("cats", "array")},
    ("ti",),
)
ANY, HAS, STARTS, YEAR = FIELDS.anywhere, FIELDS.has, FIELDS.starts, lambda a, b=None: FIELDS.between("year", a, b)


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        (1, "Dark matter halos", "Smith", 2020, ["cs.LG"]),
        (2, "Dark energy", "Smithson", 2021, ["cs.CL", "x"]),
        (3, "Matter, dark.", "Jones", 1999, []),
        (4, None, None, None, None),
        (5, "darkness", "smith", 2024, ["cs.lg"]),
    ]
    return spark.createDataFrame(rows, "id long, title string, author string, year int, cats array<string>").cache()


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (lambda: ANY("dark"), {1, 2, 3}),
        (lambda: ANY("dark", beginning=True), {1, 2, 3, 5}),
        (lambda: ANY("dark") & ANY("matter"), {1, 3}),
        (lambda: ANY("dark matter"), {1}),
        (lambda: HAS("ti", "dark") & HAS("au", "smith"), {1}),
        (lambda: STARTS("au", "smith"), {1, 2, 5}),
        (lambda: ANY("dark") & ~ANY("matter"), {2}),
        (lambda: ANY("dark") & ~(ANY("matter") | ANY("energy")), set()),
        (lambda: YEAR(2020, 2021), {1, 2}),
        (lambda: YEAR(1999), {3}),
        (lambda: ANY("energy") | ANY("matter") & HAS("au", "jones"), {2, 3}),
        (lambda: (ANY("energy") | ANY("matter")) & HAS("au", "jones"), {3}),
        (lambda: HAS("cat", "cs.lg"), {1, 5}),
        (lambda: STARTS("cat", "cs") & ~HAS("cat", "x"), {1, 5}),
        (lambda: ~ANY("dark"), {4, 5}),
        (lambda: HAS("ti", "energy"), {2}),
    ],
)
def test_boolean(papers, condition, ids):
    assert {r.id for r in papers.where(condition()).collect()} == ids


@pytest.mark.parametrize(
    "condition",
    [
        lambda: ANY(""),
        lambda: HAS("no", "field"),
        lambda: HAS("year", "abc"),
        lambda: ANY("da*rk"),
        lambda: FIELDS.between("ti", 1),
        lambda: STARTS("ti", " "),
    ],
)
def test_boolean_refuses(spark, condition):
    with pytest.raises(ValueError):
        condition()


def test_preprint_filters(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 31), ["a"]), (2, dt.datetime(2024, 2, 1), ["b"]), (3, dt.datetime(2025, 1, 1), [])],
        "id int, d timestamp, c array<string>",
    )
    ids = lambda f: [r.id for r in df.where(f).orderBy("id").collect()]
    assert ids(
        month_range("d", "2024-01-31", "2024-01-01")
    ) == [1] and ids(month_range("d", "2024-02")) == [2, 3] and ids(month_range("d", None, "2024-02")) == [1, 2] and ids(month_range("d")) == [1, 2, 3]
    assert ids(any_category("c", ["b", "z"])) == [2] and ids(any_category("c", [])) == [1, 2, 3]


def test_page(spark):
    got = page(spark.range(25), [F.desc("id")], 20, 10).collect()
    assert [r.id for r in got] == [4, 3, 2, 1, 0] and {(r.num_found, r.has_more) for r in got} == {(25, False)}
    assert page(spark.range(25), [F.asc("id")], 0, 10).first().has_more is True
    assert page(spark.range(25), [F.asc("id")], 30, 10).count() == 0


def plain_indices(c):
    c = sorted(c, reverse=True)
    h = sum(x >= i + 1 for i, x in enumerate(c))
    g = max([0] + [i + 1 for i in range(len(c)) if sum(c[: i + 1]) >= (i + 1) ** 2])
    return len(c), h, g, sum(x >= 10 for x in c)


def test_indices_equal_plain_ones(spark):
    rng = random.Random(1)
    groups = {f"a{k}": [rng.choice([0, 0, 1, 2, 3, 5, 10, 30, 200]) for _ in range(rng.randint(1, 40))] for k in range(40)} | {
        "zero": [0, 0], "one": [9], "big": [100, 1, 1]
    }
    df = spark.createDataFrame([(a, x) for a, c in groups.items() for x in c], "author string, citations long")
    got = {r.author: (r.papers, r.h, r.g, r.i10) for r in metrics.indices(df).collect()}
    assert got == {a: plain_indices(c) for a, c in groups.items()}
    assert metrics.indices(df.limit(0)).count() == 0


def test_citation_stats_and_self_citations(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 4, 0), ("b", 3, 3)], "author string, citations long, refereed long")
    got = {
        r.author: (
            r.total_citations, r.refereed_citations, r.mean_citations, r.median_citations
        ) for r in metrics.citation_stats(df).collect()
    }
    assert got == {"a": (5, 1, 2.5, 2.5), "b": (3, 3, 3.0, 3.0)}
    papers = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"]), (3, ["z"])], "id int, authors array<string>")
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "citing int, cited int")
    assert [tuple(r) for r in metrics.self_citations(edges, papers).collect()] == [(1, 2)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 9), (2, 9), (9, 3)], "citing int, cited int")
    papers = spark.createDataFrame([(1, "one"), (3, "three")], "id int, title string")
    flat = graph.ego_graph(edges, papers, papers, 9)
    assert {tuple(r) for r in flat.collect()} == {("citation", 1, "one"), ("citation", 2, None), ("reference", 3, "three")}
    row = graph.nested_ego(flat, "9").first()
    assert (row.citation_count, row.reference_count, [x.id for x in row.citations]) == (2, 1, [1, 2])
    assert graph.nested_ego(flat.limit(0), "9").first().citation_count == 0
    names = spark.createDataFrame([([("A",), (None,), ("",)],), (None,)], "authors array<struct<name:string>>").select(
        graph.author_names("authors").alias("n")
    ).collect()
    assert [r.n for r in names] == [["A"], []]


def test_similar_without_seed(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "id long, vector array<float>")
    assert [r.id for r in similar.by_vector(v, 1, 5).collect()] == [3, 2] and similar.by_vector(v, 9, 5).count() == 0


def test_collections(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, n)
    cols = "library_id long, doc_id long, action string, content string, permission string, ts timestamp, event_id long"
    rows = [
        (1, 5, "add", None, "owner", at(1), 1),
        (1, 5, "remove", None, "owner", at(2), 2),
        (1, 6, "add", None, "owner", at(1), 3),
        (1, 6, "remove", None, "owner", at(1), 2),
        (2, 5, "set", "n1", "collaborator", at(1), 4),
        (2, 5, "set", "n2", "collaborator", at(3), 5),
        (2, 6, "set", "x", "collaborator", at(1), 6),
        (2, 6, "delete", None, "collaborator", at(2), 7),
    ]
    C.append_events(spark.createDataFrame(rows[:3], cols), str(tmp_path / "log"))
    C.append_events(spark.createDataFrame(rows[3:], cols), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [tuple(r) for r in C.members(log).collect()] == [(1, 6)]
    assert [(r.library_id, r.doc_id, r.content) for r in C.notes(log).collect()] == [(2, 5, "n2")]
    assert [(r.library_id, r.num_documents) for r in C.libraries(log, "owner").collect()] == [(1, 1)] and C.libraries(log).count() == 2


def test_export_and_views(spark):
    from paperlake.sources.tables import PAPER

    rows = [
        ("B1", ["T"], ["A, X", "B", "C", "D"], "2020", None, "abs", 0, 7, ["10.1/x"], None, "J", "3", None, None, None),
        ("B2", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, PAPER)
    one, two = df.select(render.paper_detail().alias("t")).collect()
    assert "A, X, B, C et al." in one.t and "**Citations:**" not in one.t and "**Reads:** 7" in one.t and "# Untitled" in two.t and "**Authors:** N/A" in two.t and "Abstract" not in two.t
    text = render.paper_list(df, [F.asc("bibcode")], F.lit("9")).first().text
    assert "Found **9** total, showing **2**" in text and "1. **T**" in text and "Citations: 0" in text and "Unknown (N/A)" in text
    bib = df.select(export.record("bibtex", max_author=2, cutoff=3).alias("r")).first().r
    assert bib.startswith("@ARTICLE{B1,") and "author = {A, X and B and others}" in bib
    assert df.select(export.record("custom", "%H-%Y%%").alias("r")).first().r == "A-2020%"
    for bad in ("mnras", "nonsense", "custom"):
        with pytest.raises(ValueError):
            export.record(bad)


def test_read_views(spark):
    row = [("id1", "T", ["A"], "abs", "2024-01-15T0", "2024-02-01", ["c1", "c2"], None, "p", "h", "a", "html", None, " body " + "x" * 2000)]
    df = spark.createDataFrame(
        row,
        "id string, title string, authors array<string>, abstract string, published string, updated string, categories array<string>, doi string, pdf_url string, html_url string, abs_url string, source string, source_name string, content string",
    )
    text = df.select(render.read_view(0, 1000).alias("t")).first().t
    assert "**Source:** arXiv HTML" in text and "offset=1000" in text and "_Showing characters 0-1000 of 2005._" in text
    detail = df.select(render.preprint_detail().alias("t")).first().t
    assert "**Updated:** 2024-02-01" in detail and "**Published:** 2024-01-15" in detail and "DOI" not in detail
    assert "1. **T**" in render.preprint_list(df, [F.asc("id")]).first().text
    empty = df.withColumn("full_text", F.lit(" ")).select(render.full_text_view().alias("t")).first().t
    assert "No text could be extracted" in empty


def test_params():
    for bad in (
        lambda: P.SearchParams(""),
        lambda: P.SearchParams("q", rows=51),
        lambda: P.SearchParams("q", sort="x"),
        lambda: P.DocSearchParams("q", 21),
        lambda: P.PreprintSearchParams("q", date_from="2024"),
        lambda: P.WindowParams(max_chars=10),
        lambda: P.LibraryParams(""),
        lambda: P.check_papers("ids", [], 100),
        lambda: P.CitationParams("x", relationship="both"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert P.CitationParams("10.1088/0004-637X/1234/5678").rows == 20


def test_graph_and_library_views(spark):
    near = spark.createDataFrame(
        [("p1", "One", "A", 2020, "2001.1"), ("p2", None, None, None, None)],
        "id string, title string, author string, year int, arxiv_id string",
    )
    paper = spark.createDataFrame([("T", 2019)], "title string, year int")
    text = render.graph_view("x", paper, near, near.limit(0), [F.asc("id")]).first().text
    assert text.startswith(
        "# Citation Graph for arXiv:x\n\n**Title:** T\n\n**Year:** 2019\n\n**Citations returned:** 2\n\n**References returned:** 0\n\n## Citing papers (2)\n\n1. **One**\n   - A (2020)\n   - arXiv: `2001.1`\n"
    )
    assert "2. **Untitled**\n   - Unknown\n   - Semantic Scholar: `p2`\n\n" in text and text.endswith(
        "## Referenced papers (0)\n\nNo papers returned.\n\n"
    )
    assert "**Title:** Untitled" in render.graph_view("x", paper.limit(0), near, near, [F.asc("id")]).first().text
    many = spark.range(30).select(
        F.lpad(F.col("id").cast("string"), 2, "0").alias("id"),
        F.lit("t").alias("title"),
        F.lit("a").alias("author"),
        F.lit(1).alias("year"),
    )
    text = render.graph_list(many, [F.asc("id")], "Citing papers").first().text
    assert "25. **t**" in text and "26. **t**" not in text and "_Showing 25 of 30 returned papers._" in text

    columns = "id string, name string, description string, num_documents int, permission string, public boolean, owner string, date_last_modified string, papers array<string>"
    libraries = spark.createDataFrame(
        [
            ("L1", "Mine", "about", 2, "owner", True, "me", "2024-05-06T07:08", ["b1", "b2"]),
            ("L2", "Other", None, 0, "read", False, "you", "2024-01-02", None),
        ],
        columns,
    )
    one, two = (r.t for r in libraries.orderBy("id").select(render.library_detail("papers").alias("t")).collect())
    assert one == "# Mine\n\n- **ID:** `L1`\n- **Description:** about\n- **Papers:** 2  |  **Permission:** owner  |  **Public:** Yes\n- **Owner:** me\n\n## Papers (2)\n\n1. `b1`\n2. `b2`\n"
    assert "Description" not in two and two.endswith("- **Owner:** you\n\n")
    text = render.library_list(libraries, [F.asc("id")]).first().text
    assert text.startswith("# Libraries (2)\n\n## Mine\n") and "- **Owner:** me  |  **Modified:** 2024-05-06\n\n" in text
    assert render.library_list(libraries.limit(0), [F.asc("id")]).first().text == "No libraries found."


def test_metrics_view_sections(spark):
    row = spark.createDataFrame(
        [(5, 6, 2, 1.5, None, 30, 20, 2.25, 3.0, None, 4, None, None)],
        "h int, g int, i10 int, m double, tori double, total_citations int, refereed_citations int, mean_citations double, median_citations double, self_citations int, papers int, reads int, mean_reads double",
    )
    text = row.select(render.metrics_view(F.lit("4")).alias("t")).first().t
    assert "- **m-index:** 1.50\n\n## Citation Statistics" in text and "tori" not in text and "- **Median:** 3\n- **Self-citations:** 0\n" in text and text.endswith("- **Total reads:** 0\n\n")
    assert row.select(
        render.metrics_view(F.lit("4"), citations=False, basic=False).alias("t")
    ).first().t.endswith("- **m-index:** 1.50\n\n")


def test_documentation_index(spark, tmp_path):
    import json

    from paperlake.sources.tables import doc_index

    rows = [
        {"id": "a", "title": "Alpha", "content": "beta gamma", "source_file": "a.md", "char_count": 3, "unknown": 1},
        {"id": "b", "title": "404", "content": "x"},
        {"id": "whats-new", "title": "N", "content": "x"},
    ]
    (tmp_path / "docs.json").write_text(json.dumps(rows))
    found = search.search(search.clean_chunks(doc_index(spark, str(tmp_path / "docs.json"))), "gamma", 5).collect()
    assert [(r.id, r.score, r.char_count) for r in found] == [("a", 7, 10)]


def test_sort_names_become_orders(spark):
    rows = [(1, 2.0, 5, "2024-01-01", None), (2, 1.0, 7, "2025-01-01", 3), (3, 2.0, None, None, 4)]
    df = spark.createDataFrame(rows, "id int, score double, citation_count int, date string, read_count int")
    ids = lambda order: [r.id for r in df.orderBy(*order).collect()]
    got = {s: ids(P.SearchParams("q", sort=s).order()) for s in P.SORTS}
    assert got == {
        "score desc": [1, 3, 2],
        "citation_count desc": [2, 1, 3],
        "date desc": [2, 1, 3],
        "date asc": [1, 2, 3],
        "read_count desc": [3, 2, 1],
    }
    assert ids(P.PreprintSearchParams("q", sort_by="submittedDate", sort_order="ascending").order()) == [1, 2, 3]
    with pytest.raises(ValueError):
        P.SearchParams("q", sort="title desc")


def test_library_create_and_edit_counts(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, 5, "add", None, "owner", t, 1), (1, 6, "add", None, "owner", t, 2), (1, 6, "remove", None, "owner", t, 3)],
        C.EVENT,
    )
    asked = spark.createDataFrame(
        [(1, t, 9, [7]), (2, t, 10, [7, 7, None, 8]), (3, t, 11, [])],
        "library_id long, ts timestamp_ntz, event_id long, papers array<long>",
    )
    made = C.created(log, asked)
    whole = {r.library_id: (r.num_documents, r.permission) for r in C.libraries(log.unionByName(made)).collect()}
    assert whole == {1: (1, "owner"), 2: (2, "owner"), 3: (0, "owner")}
    edits = spark.createDataFrame(
        [(1, 5, "add"), (1, 6, "add"), (1, 6, "add"), (1, 5, "remove"), (1, 9, "remove"), (1, None, "add")],
        "library_id long, doc_id long, action string",
    )
    got = {r.action: (r.number_added, r.number_removed, r.n_asked, r.n_changed) for r in C.edit_counts(log, edits).collect()}
    assert got == {"add": (1, None, 2, 1), "remove": (None, 1, 2, 1)}


def test_nested_nodes(spark):
    nodes = spark.createDataFrame(
        [("p", "T", 2020, [("A",), (None,), ("",), ("B",)], {"ArXiv": "1"}), ("q", None, None, None, {})], GRAPH_NODE
    )
    assert [tuple(r) for r in graph.node_fields(nodes).collect()] == [("p", "T", 2020, "A, B", "1"), ("q", None, None, "", None)]


def test_shown_lists_count_all(spark):
    many = spark.range(60).selectExpr("cast(id as string) AS id", "id AS key", "'t' AS title", "'a' AS author", "2000 AS year")
    text = render.graph_list(many, [F.asc("key")], "Citing papers").first().text
    assert text.startswith("## Citing papers (60)") and "_Showing 25 of 60 returned papers._" in text and "25. **t**" in text and "26. " not in text


def test_library_lines_are_the_views(spark, monkeypatch):
    """Rows of text, put together by place, are the text of the view; a library without papers, one of very many."""
    from paperlake.operators import paging

    monkeypatch.setattr(paging, "RANGE_ROWS", 20)
    columns = "library_id long, id string, name string, description string, num_documents long, permission string, public boolean, owner string, date_last_modified string"
    rows = [(i, f"L{i}", f"N{i}", None, 0, "owner", True, f"u{i % 2}", "2024-05-06T07") for i in range(7)]
    libraries = spark.createDataFrame(rows, columns)
    members = spark.createDataFrame([(0, k) for k in range(300)] + [(1, 5), (1, 3)], "library_id long, doc_id long")
    whole = lambda df, key: {k: "".join(r.text for r in sorted(v, key=lambda r: r.place)) for k, v in grouped(df, key).items()}

    def grouped(df, key):
        found = {}
        for r in df.collect():
            found.setdefault(r[key], []).append(r)
        return found

    lists = render.library_list(libraries, [F.asc("library_id")], by=("owner",)).collect()
    assert whole(render.library_lines(libraries, ["library_id"], ("owner",)), "owner") == {r.owner: r.text for r in lists}
    papers = members.groupBy("library_id").agg(F.sort_array(F.collect_list("doc_id")).cast("array<string>").alias("papers"))
    want = libraries.join(papers, "library_id", "left").select("library_id", render.library_detail("papers").alias("text")).collect()
    assert whole(render.library_detail_lines(libraries, members), "library_id") == {r.library_id: r.text for r in want}
