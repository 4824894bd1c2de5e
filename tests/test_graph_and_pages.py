import random
import re

import pytest
from pyspark.sql import functions as F

from paperlake.operators import graph, metrics, paging
from paperlake.operators.paging import Keys, numbered, page, page_after


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_pages_are_worked_out_in_one_pass(spark, tmp_path):
    """A counter in the source's own expression sees every row once; the plan of a page holds no second scan."""
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.read.parquet(str(tmp_path / "t")).mapInArrow(seen, "id long")
    got = page(rows, [F.desc("id")], 10, 5).collect()
    assert [r.id for r in got] == [989, 988, 987, 986, 985] and {(r.num_found, r.has_more) for r in got} == {(1000, True)}
    assert read.value == 1000


def test_counts_of_few_rows(spark):
    """Sources that say how many rows they have at most, joins, aggregates."""
    for rows in (spark.range(25), spark.range(25).limit(20), spark.range(50).groupBy((F.col("id") % 9).alias("id")).count(), spark.range(9).join(spark.range(4), "id")):
        n = rows.count()
        for start, limit in ((0, 3), (2, 50), (n - 1, 5)):
            got = page(rows, [F.asc("id")], start, limit).collect()
            assert {(r.num_found, r.has_more) for r in got} == {(n, n > start + limit)} and len(got) == min(limit, n - start)


def test_a_page_keeps_types_and_nulls(spark):
    df = spark.createDataFrame([(1, None, [None, "a"]), (2, "x", None)], "id long, name string, tags array<string>")
    got = page(df, [F.asc("id")], 0, 10)
    assert got.schema.names == ["id", "name", "tags", "num_found", "has_more"] and got.drop("num_found", "has_more").schema == df.schema
    assert [tuple(r) for r in got.collect()] == [(1, None, [None, "a"], 2, False), (2, "x", None, 2, False)]
    assert page(df.limit(0), [F.asc("id")]).collect() == []


@pytest.mark.parametrize("down", [True, False])
def test_pages_by_key_go_through_all_rows(spark, down):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.5, 1.0, 2.0]), rng.choice([None, "a", "b"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, score double, name string")
    keys = Keys((("score", down), ("name", not down), ("id", down)))
    want = [r.id for r in df.orderBy(*keys.order()).collect()]
    got, last = [], None
    while found := page_after(df, keys, last, 11).collect():
        got += [r.id for r in found]
        last = found[-1].asDict()
    assert got == want


def test_a_page_by_key_is_a_filter_of_the_scan(spark, tmp_path, capsys):
    spark.range(1000).selectExpr("id", "id % 7 AS score").write.parquet(str(tmp_path / "t"))
    keys = Keys((("score", True), ("id", False)))
    out = plan(page_after(spark.read.parquet(str(tmp_path / "t")), keys, {"score": 3, "id": 500}, 10), capsys)
    assert "LessThan(score,3)" in out and "TakeOrderedAndProject" in out and "Arguments: 10, [score" in out


def test_places_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(paging, "RANGE_ROWS", 40)
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(60)])) for _ in range(500)] + [("hot", 1)] * 300
    got = numbered(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"]).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}
        values = [(r.v is not None, r.v or 0) for r in own]
        assert values == sorted(values)


def test_places_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)] * 3, "part long, at long, first long, before long, n long, read_at long")
    got = numbered(df, ["part"], ["at"], "i", "all").collect()
    assert sorted(r.i for r in got) == [1, 2, 3] and {(r.part, r.at, r.first, r.before, r.n, r.read_at, r.all) for r in got} == {(1, 2, 3, 4, 5, 6, 3)}


@pytest.fixture(scope="module")
def star(spark):
    """Paper 0 has 3,000 citations and cites two papers."""
    edges = spark.range(1, 3001).selectExpr("id AS citing", "0L AS cited").union(spark.createDataFrame([(0, 5), (0, 9999)], "citing long, cited long"))
    papers = spark.range(0, 2000).selectExpr("id", "concat('t', id) AS title")
    return edges, papers


def test_neighbourhoods_have_no_cap(star):
    edges, papers = star
    flat = graph.ego_graph(edges, papers, papers, 0)
    rows = graph.numbered_ego(flat, "0").collect()
    assert len(rows) == 3002 and {(r.paper_id, r.citation_count, r.reference_count) for r in rows} == {("0", 3000, 2)}
    assert {(r.place, r.id, r.title) for r in rows if r.direction == "citation"} == {(i, i, f"t{i}" if i < 2000 else None) for i in range(1, 3001)}
    assert {(r.place, r.id, r.title) for r in rows if r.direction == "reference"} == {(1, 5, "t5"), (2, 9999, None)}
    one = graph.nested_ego(flat, "0").first()
    assert len(one.citations) == 3000 and len(one.references) == 2 and one.citation_count == 3000
    few = graph.nested_ego(flat, "0", 10).first()
    assert [x.id for x in few.citations] == list(range(1, 11)) and few.citation_count == 3000


def test_edges_are_read_once(spark, tmp_path, star, capsys):
    edges, papers = star
    edges.write.parquet(str(tmp_path / "e"))
    flat = graph.ego_graph(spark.read.parquet(str(tmp_path / "e")).distinct(), papers, papers, 0)
    flat.collect()
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan(flat, capsys), re.M)) <= 2  # the second is the reused exchange in the plan before it runs
    assert plan(graph.nested_ego(graph.ego_graph(spark.read.parquet(str(tmp_path / "e")), papers, papers, 0), "0"), capsys).count("CartesianProduct") == 0


def test_nested_leaves_are_pruned(spark, tmp_path, capsys):
    """Of a stored table of nested nodes, the scan reads the asked leaves only."""
    from paperlake.plans.catalog import queries

    out = plan(queries()["graph_nodes"](spark, "/root/testdata/sf0.001"), capsys)
    schema = re.search(r"ReadSchema: (.*)", out)[1]
    assert "authors:array<struct<name:string>>" in schema and "externalIds:struct<ArXiv:string>" in schema
    assert "tldr" not in schema and "CorpusId" not in schema and "url" not in schema


def test_authors_from_lists(spark):
    """Repeated, null and empty names; one author of a third of all papers; against plain code."""
    rng = random.Random(7)
    people = [f"p{i}" for i in range(12)] + [None, ""]
    papers = {i: ["hot"] * (i % 3 == 0) + rng.choices(people, k=rng.randint(0, 6)) for i in range(150)}
    edges = list({(rng.randrange(150), rng.randrange(150)) for _ in range(900)})
    of = {i: {a for a in names if a} for i, names in papers.items()}
    references = {c: sum(1 for a, _ in edges if a == c) for c, _ in edges}
    want = {}
    for citing, cited in edges:
        for a in of[cited] - of[citing]:
            want[a] = want.get(a, 0) + 1 / (len(set(papers[cited])) * references[citing])
    table = spark.createDataFrame(list(papers.items()), "id long, authors array<string>")
    judged = metrics.author_citations(spark.createDataFrame(edges, "citing long, cited long"), table)
    got = {r.author: r.tori for r in metrics.tori(judged).collect()}
    assert got.keys() == want.keys() and all(abs(got[a] - want[a]) < 1e-9 for a in want)
    assert {(r.id, r.author) for r in metrics.by_author(table).collect()} == {(i, a) for i, names in of.items() for a in names}


def test_no_join_on_the_author_alone(spark, capsys):
    table = spark.createDataFrame([(1, ["a"])], "id long, authors array<string>")
    out = plan(metrics.author_citations(spark.createDataFrame([(1, 1)], "citing long, cited long"), table).where(F.lit(True)), capsys)
    assert not re.search(r"hashpartitioning\(author#\d+, \d+\)", out)


def test_citations_are_counted_in_one_pass(spark):
    """Repeated pairs and records, ends that are null or unknown, a paper of most citations; against plain code."""
    rng = random.Random(11)
    papers = {i: rng.sample("abcdefgh", rng.randint(1, 3)) for i in range(200) if i % 13}
    edges = {(rng.randrange(220), rng.choice([3, 3, 3, *range(40)])) for _ in range(900)}
    pairs = [*edges, *list(edges)[:200], (None, 3), (5, None), (5, None), (None, None)]
    records = [(i, rng.choice([2000, 2001, None]), rng.choice([True, False, None])) for i in range(180)]
    records += records[:9]
    references = {c: sum(a == c for a, _ in edges) + (c == 5) for c, _ in edges}
    want = {}
    for cited in {b for _, b in edges} & set(range(30)):
        by = [a for a, b in edges if b == cited]
        of = [r for a in by for r in records if r[0] == a]
        own = [a for a in by if set(papers.get(a, [])) & set(papers.get(cited, []))]
        tori = [1 / (len(papers[cited]) * references[a]) for a in by if a not in own and cited in papers]
        total = sum(max(1, sum(r[0] == a for r in records)) for a in by)
        years = [r[1] for r in of if r[1]]
        want[cited] = (len(by), total, sum(bool(r[2]) for r in of), min(years, default=None), round(sum(tori), 9) if tori else None, len(own))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = metrics.paper_citations(
        frame(pairs, "citing long, cited long"), frame(records, "id long, year long, refereed boolean"), frame(list(papers.items()), "id long, authors array<string>"),
        frame([(i,) for i in [*range(30), 7]], "id long"),
    )
    assert {r[0]: (*r[1:5], r[5] if r[5] is None else round(r[5], 9), r[6]) for r in out.collect()} == want


def test_metrics_view_reads_citations_once(spark, capsys):
    from paperlake.plans.catalog import queries

    out = plan(queries()["render_metrics"](spark, "/root/testdata/sf0.001"), capsys)
    assert len(re.findall(r"^Location: .*lineitem\.parquet", out, re.M)) == 1
    assert len(re.findall(r"^Location: .*events\.parquet", out, re.M)) == 1


def test_profile_equals_the_single_figures(spark):
    """One wide row an author as from the operators of each section; an author without citations or reads."""
    rng = random.Random(5)
    rows = [(f"a{i % 7}", n := rng.choice([0, 1, 2, 2, 9, 40]), n, n // 2, rng.choice([1998, 2000, None]), rng.choice([0.5, None]), n // 3, rng.choice([1, None])) for i in range(120)]
    rows.append(("none", 0, 0, 0, None, None, None, None))
    df = spark.createDataFrame(rows, "author string, citations long, total_citations long, refereed_citations long, year long, tori double, self_citations long, reads long")
    got = {r.author: r for r in metrics.profile(df, 2002).collect()}
    stats = metrics.citation_stats(df.withColumn("refereed", F.col("refereed_citations")))
    for r in metrics.indices(df).join(stats, "author").join(metrics.m_index(df, 2002).drop("h"), "author").collect():
        assert {c: got[r.author][c] for c in r.asDict()} == r.asDict()
    for a, row in got.items():
        mine = [r for r in rows if r[0] == a]
        sums = [sum(v) if (v := [r[i] for r in mine if r[i] is not None]) else None for i in (5, 6, 7)]
        assert [row.tori, row.self_citations, row.reads] == sums and row.mean_reads == (None if sums[2] is None else sums[2] / len(mine))
