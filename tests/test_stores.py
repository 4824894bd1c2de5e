"""Feed pages, snapshots of the event log, identifier tables, bibliographies as files."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from paperlake.functions import export
from paperlake.operators import bibliography, collections, identifiers, paging, snapshots
from paperlake.sources import feed_pages
from paperlake.sources.atom import parse_feeds
from paperlake.sources.tables import PAPER


def entry(i, day, category):
    date = f"<published>{day}</published>" if day else ""
    return f'<entry><id>http://arxiv.org/abs/9.{i}v1</id><title>T {i} é\n</title>{date}<category term="{category}"/><category term="x"/></entry>'


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("feed"))
    days = [None if i % 41 == 0 else f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}T00:00:00Z" for i in range(500)]
    rows = [(entry(i, d, "abc"[i % 3]),) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "xml string")
    feed_pages.write_pages(df, folder, 20)
    return folder, parse_feeds(df)


def reader_of(folder, *filters):
    reader = feed_pages.FeedPagesReader(folder, 1)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return reader


CONDITIONS = [
    (lambda: F.col("published") >= "2024-06-01", lambda r: r.published >= "2024-06-01"),
    (lambda: (F.col("published") > "2024-02") & (F.col("published") <= "2024-03-05T00:00:00Z"), lambda r: "2024-02" < r.published <= "2024-03-05T00:00:00Z"),
    (lambda: F.col("category") == "b", lambda r: r.categories[0] == "b"),
    (lambda: F.col("category").isin("a", "zz") & (F.col("published") < "2024-02"), lambda r: r.categories[0] == "a" and r.published < "2024-02"),
    (lambda: F.col("published") == "", lambda r: r.published == ""),
    (lambda: F.col("published") > "2030", lambda r: False),
    (lambda: (F.col("category") == "c") | (F.col("published") > "2024-11"), lambda r: r.categories[0] == "c" or r.published > "2024-11"),
    (lambda: None, lambda r: True),
]


@pytest.mark.parametrize("condition,plain", CONDITIONS)
def test_feed_pages_give_the_rows_of_a_plain_scan(spark, feed, condition, plain):
    folder, whole = feed
    got = feed_pages.read_pages(spark, folder, condition()).collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in whole.collect() if plain(r))


def test_fewer_pages_are_read(spark, feed, capsys):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    folder, _ = feed
    every = reader_of(folder).partitions()
    assert len(every) == 25
    some = reader_of(folder, GreaterThanOrEqual(("published",), "2024-06-01"), LessThan(("published",), "2024-07-01")).partitions()
    assert 1 <= len(some) <= 4 and {f for p in some for f in p.files} < {f for p in every for f in p.files}
    assert [p.files for p in reader_of(folder, EqualTo(("category",), "zz")).partitions()] == [()]
    read = feed_pages.read_pages(spark, folder, F.col("published") >= "2024-12-20", per_task=1)
    assert read.rdd.getNumPartitions() < 5
    read.explain("formatted")
    assert "feed_pages" in capsys.readouterr().out


def test_texts_of_entries_stay_on_the_executors(spark, tmp_path):
    """Forty long entries: neither the order of the pages nor the list of their files brings texts to the driver, and every page is a plain file of one folder."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def most() -> int:
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    long = spark.range(40).select(F.concat(F.lit("<entry><published>2024</published>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.xxhash64("id", i).cast("string")), ""), F.lit("</entry>")).alias("xml"))
    before = most()
    feed_pages.write_pages(long, str(tmp_path / "f"), 7)
    assert most() - before < 2_000_000
    assert sorted(f.name for f in (tmp_path / "f" / "pages").iterdir() if f.suffix == ".txt") == [f"page-{k:09d}.txt" for k in range(6)]
    spark.dataSource.register(feed_pages.FeedPages)
    assert spark.read.format("feed_pages").load(str(tmp_path / "f")).distinct().count() == 40


def random_events(rng, n, start=0):
    """Events over ten days; some keys and values are missing."""
    actions = ["add", "add", "remove", "set", "delete", "create", "other"]
    day = lambda: dt.datetime(2024, 1, rng.randint(1, 10), rng.randint(0, 23), rng.randint(0, 59))
    return [
        (rng.randint(0, 12), rng.choice([None, *range(6)]), rng.choice(actions), rng.choice([None, 1.5, 2.5]), "owner", day(), start + i)
        for i in range(n)
    ]


def test_state_at_any_time_equals_a_replay(spark, tmp_path, monkeypatch):
    """Three batches, the last of which holds events before the snapshots, as well as at their very instants."""
    monkeypatch.setattr(snapshots, "BUCKETS", 5)
    rng = random.Random(2)
    root = str(tmp_path / "log")
    first, second, third = (random_events(rng, 150, s) for s in (0, 1000, 2000))
    third += [(3, 2, "add", None, "owner", dt.datetime(2024, 1, 4), 5000), (3, 2, "remove", None, "owner", dt.datetime(2024, 1, 7), 5001)]
    make = lambda rows: spark.createDataFrame(rows, collections.EVENT)
    known = []

    def same():
        log = make(known)
        for at in ("2024-01-02 12:30:00", "2024-01-07 00:00:00", "2025-01-01 00:00:00"):
            replay = log.where(F.col("ts") <= F.lit(at).cast("timestamp_ntz"))
            for name in ("members", "notes"):
                want = sorted(map(tuple, getattr(collections, name)(replay).collect()), key=repr)
                assert sorted(map(tuple, getattr(snapshots, name)(spark, root, at).collect()), key=repr) == want, (name, at)

    assert snapshots.members(spark, root, "2024-01-05 00:00:00").collect() == []
    for rows, until in ((first, "2024-01-04 00:00:00"), (second, "2024-01-07 00:00:00"), (third, "2024-01-08 12:00:00")):
        snapshots.append(make(rows), root)
        known += rows
        snapshots.compact(spark, root, until)
        same()
    with pytest.raises(ValueError):
        snapshots.compact(spark, root, "2024-01-01 00:00:00")


def test_only_the_delta_and_touched_buckets_are_read(spark, tmp_path):
    root = str(tmp_path / "log")
    row = lambda library, day, i: (library, i, "add", None, "owner", dt.datetime(2024, 1, day), i)
    make = lambda rows: spark.createDataFrame(rows, collections.EVENT)
    snapshots.append(make([row(k % 200, 1 + k % 5, k) for k in range(1000)]), root)
    before = snapshots.compact(spark, root, "2024-01-06 00:00:00")
    assert len(before["buckets"]) > 50 and set(before["buckets"].values()) == {0}
    snapshots.append(make([row(7, 8, 5000), row(7, 9, 5001)]), root)
    after = snapshots.compact(spark, root, "2024-01-10 00:00:00")
    assert sorted(after["buckets"].values())[-2:] == [0, 1] and list(after["buckets"].values()).count(1) == 1
    delta = snapshots._since(spark, root, before, "2024-01-10 00:00:00")
    delta.collect()
    plan = delta._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    days = {re.search(r"day=([\d-]+)", f)[1] for f in delta.inputFiles()}
    assert snapshots.members(spark, root, "2024-01-12 00:00:00").count() == 1002 and {"2024-01-08", "2024-01-09"} <= days
    rerun = snapshots.compact(spark, root, "2024-01-10 00:00:00")
    assert rerun["version"] == 2 and rerun["buckets"] == after["buckets"]


SPELLINGS = {
    " arXiv:2103.01231v12\n": "arxiv:2103.01231",
    "2103.01231": "arxiv:2103.01231",
    "https://arxiv.org/abs/2103.01231v2": "arxiv:2103.01231",
    "http://arxiv.org/pdf/2103.01231.pdf": "arxiv:2103.01231",
    "cs.LG/0612056v1": "arxiv:cs.lg/0612056",
    "astro-ph/9901001": "arxiv:astro-ph/9901001",
    "doi: 10.1088/0004-637X/1/2": "doi:10.1088/0004-637x/1/2",
    "https://doi.org/10.1088/0004-637X/1/2": "doi:10.1088/0004-637x/1/2",
    "HTTP://DX.DOI.ORG/10.1088/0004-637x/1/2": "doi:10.1088/0004-637x/1/2",
    "2020ApJ...900....1A ": "2020ApJ...900....1A",
    "10.1": "10.1",
    "": None,
    " \t": None,
}


def test_canonical_forms(spark):
    df = spark.createDataFrame([(s,) for s in [*SPELLINGS, None]], "s string")
    got = {r.s: r.k for r in df.select("s", identifiers.canonical("s").alias("k")).collect()}
    assert got == {**SPELLINGS, None: None}


def test_resolving_moves_no_table(spark, tmp_path, capsys):
    """Many spellings, unknown and null ones kept, a hot one; the table's side has no exchange."""
    records = spark.createDataFrame([(i, [f"2001.{i:05d}", f"10.1/P.{i}", "shared"]) for i in range(500)] + [(900, None), (901, [])], "id long, identifier array<string>")
    identifiers.build(records, "ids_test", str(tmp_path / "ids"), 8)
    known = identifiers.opened(spark, "ids_test_open", str(tmp_path / "ids"), "key string, id long", 8)
    rng = random.Random(1)
    asked = [(n, rng.choice([None, "", "nothing", f"arXiv:2001.{rng.randrange(600):05d}v3", f"doi:10.1/p.{rng.randrange(600)}", "SHARED", "shared"])) for n in range(3000)]
    got = identifiers.resolve(spark.createDataFrame(asked, "n long, identifier string"), known)
    table = {f"arxiv:2001.{i:05d}": i for i in range(500)} | {f"doi:10.1/p.{i}": i for i in range(500)} | {"shared": 0}
    rows = got.collect()
    assert {(r.n, r.identifier) for r in rows} == set(asked) and len(rows) == 3000
    assert all(r.id == table.get(r.key) for r in rows) and sum(r.id is None for r in rows) > 300
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.createDataFrame([("shared",)], "identifier string").select(identifiers.canonical("identifier").alias("key")).distinct()
        wanted.join(known, "key").explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = capsys.readouterr().out
    scan = out[: out.index("FileScan parquet spark_catalog")]
    assert "Exchange" not in scan.split("SortMergeJoin")[1].split("\n+-")[0].split("FileScan")[0].split("HashAggregate")[-1] and "Bucketed: true" in out
    spark.sql("DROP TABLE ids_test_open")


def test_forms_are_worked_out_once(spark):
    """Neither kind of lookup, nor the count of keys, repeats the patterns."""
    known = spark.createDataFrame([("arxiv:2001.00001", 1)], "key string, id long")
    got = identifiers.resolve(spark.createDataFrame([(1, "2001.00001v2"), (2, None)], "n long, identifier string"), known)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "2001.00001v2", "arxiv:2001.00001", 1), (2, None, None, None)]


def papers(spark, n, same=3):
    rows = [(f"B{i:05d}", [f"T{i}"], [f"Last{i % same}, A", "B, C"], "2020", None, None, i % 5, 0, [f"10.1/{i}"], None, "The Astrophysical Journal" if i % 2 else "Other", "3", None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, PAPER)


def test_keys_are_unique_over_the_whole_export(spark, monkeypatch):
    monkeypatch.setattr(paging, "RANGE_ROWS", 50)
    rows, _ = bibliography.bibliography(papers(spark, 900), "bibtex", key_format="%1H%Y")
    keys = [r.cite_key for r in rows.orderBy("bibcode").collect()]
    assert len(set(keys)) == 900 and keys[:4] == ["Last02020a", "Last12020a", "Last22020a", "Last02020b"] and keys[3 * 26] == "Last02020aa"
    assert all(r.record.startswith(f"@ARTICLE{{{r.cite_key},") for r in rows.collect())


def test_more_keys_alike_than_two_letters_tell_apart(spark, saved):
    """Places after 702, those of the SQL's two signs, and beyond one byte (6,000 of one brand and size)."""
    import duckdb

    from paperlake.plans import papers as plans

    rows = spark.range(6000).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'t' AS p_type", "5 AS p_size")
    folder = saved(part=rows)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    got = sorted(map(tuple, plans.export_whole(spark, folder).collect()))
    assert got == sorted(db.sql(plans.SQL["export_whole"]).fetchall()) and len({k for _, k, _ in got}) == 6000


def test_suffixed_keys_that_meet_other_keys(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(["X", "X", "Xa", "Xaa", "Xab", "X", "", "Y"])], "k string, i long")
    got = bibliography.unique_keys(df, "k", ["i"]).collect()
    assert len({r.k for r in got}) == len(got) and {r.i: r.k for r in got}[7] == "Y"


@pytest.mark.parametrize("sort", [None, "date desc", "citation_count desc, bibcode asc", "title asc"])
def test_files_one_after_another_are_the_whole(spark, tmp_path, sort):
    df = papers(spark, 300)
    bibliography.write_bibliography(df, str(tmp_path / "out"), format="bibtex", sort=sort, journal_format=1)
    texts = [r.text for r in bibliography.read_bibliography(spark, str(tmp_path / "out")).orderBy("name").collect()]
    rows, order = bibliography.bibliography(df, "bibtex", sort=sort, journal_format=1)
    assert "".join(texts) == "".join(r.record for r in rows.orderBy(*order).collect()) and len(texts) > 1
    assert "journal = {\\apj}" in texts[0] and "journal = {Other}" in texts[0]


def test_refused_options(spark):
    for bad in (lambda: export.journal(F.col("pub"), 5), lambda: bibliography.sorting("date"), lambda: bibliography.sorting("nothing desc"), lambda: identifiers.build(papers(spark, 1), "a-b", "x")):
        with pytest.raises(ValueError):
            bad()
    styles = spark.createDataFrame([("Nature",), (None,), ("X",)], "pub string").select(*(export.journal(F.col("pub"), k).alias(f"s{k}") for k in (1, 2, 3, 4)))
    assert [tuple(r) for r in styles.collect()] == [("\\nat", "Nature", "Nat", "Nature"), (None,) * 4, ("X",) * 4]
