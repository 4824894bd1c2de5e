"""Every operator and stage on tables that hold nulls, long texts, ties, repeated rows, clashing columns, or nothing."""

import pytest

import corpus_pipeline
from paperlake.llm import queries

#: Names that the operators use inside themselves.
CLASHING = "fp long, block int, shard int, size int, atom int, ids int, score double, key long, lang_pred string, component_id string, training boolean, start int, run int, n int, spans string, `a.b` string"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Over five times the bytes that a slice or stretch holds.
LONG = "word next other " * 330_000
NAMES = [n for n in queries.queries() if not n.startswith(("op5_", "op13_"))]


def rows():
    texts = [None, "", " \n\t", "x", "a b c", "a b c", "é 日本 🙂 ſ", LONG, "-" * 5000, "\x00 nul", "password=abcdefgh12"]
    found = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return [
        *found,
        found[4],
        found[4],
        (None, "a b c", None, None, None),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (-(2**63), "least", "fr", "s", 5),
    ]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Folders with hard tables, with clashing columns beside them, and with empty ones."""
    found = {}
    bench = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        (2, None),
        (None, "x y"),
        (3, ""),
    ]
    for name in ("hard", "clashing", "empty"):
        folder = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(rows() if name != "empty" else [], DOCUMENT)
        if name == "clashing":
            extra = spark.createDataFrame([], CLASHING).schema
            docs = docs.selectExpr("*", *(f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in extra))
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(bench if name != "empty" else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found[name] = folder
    return found


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, folders, name):
    query = queries.queries()[name]
    hard = query(spark, folders["hard"]).collect()
    if not name.startswith("op3_"):
        assert len(hard) == len(rows())
        key = lambda r: tuple(str(r[c]) for c in sorted(r.asDict()) if c not in ("slot", "start"))
        assert sorted(map(key, hard)) == sorted(map(key, query(spark, folders["clashing"]).collect()))
    assert query(spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, folders, k):
    stage = corpus_pipeline.STAGES[k][1]
    for name, folder in folders.items():
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        got = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert len(got) <= docs.count() and (name == "empty") == (not got)


def test_whole_pipeline_on_an_empty_table(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_urls(spark, tmp_path):
    pages = [
        (1, None, None),
        (None, "http://a.b.c.d/x", ""),
        (2, "", "x"),
        (2, "", "x"),
        (3, "http://" + "a." * 300 + "com/" + "p/" * 300, ""),
        (4, "//", ""),
        (5, "http://a.b.c.d/x", ""),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.queries()["op5_url_filters"](spark, str(tmp_path)).count() == len(pages)
