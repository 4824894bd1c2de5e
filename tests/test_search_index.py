import random

import pytest

from paperlake.operators import search, search_index
from paperlake.operators.search_index import Index, build

CHUNK = "id string, source_file string, source_url string, doc_type string, category string, title string, section string, subsection string, content string, ordinal long"
WORDS = ["the", "nation", "of", "license", "office", "offset", "réseau", "Über", "don't", "a-b", "x1", "ΟΔΟΣ", "alpha", "alphas", "alphaalpha", "(of)", "the nation of"]
QUERIES = ["the nation of", "License", "of", "alpha", "alpha alpha", "nation, of", "don't", "über", "zzz", "f", "???", "of the nation of the", "οδος"]


@pytest.fixture(scope="module", params=[9, 2])
def pair(request, spark, tmp_path_factory):
    """Cleaned chunks and their index, in blocks of 512 and of 4."""
    patch = pytest.MonkeyPatch()
    patch.setattr(search_index, "BLOCK_BITS", request.param)
    rng = random.Random(request.param)
    text = lambda most: " ".join(rng.choices(WORDS, k=rng.randint(0, most)))
    rows = [(str(i), f"f{i % 50}", "", rng.choice(["doc", "of"]), rng.choice(["en", "alpha"]), text(3), rng.choice([None, text(2)]), text(1), rng.choice([text(40), text(5), "the nation of"])) for i in range(900)]
    rows += [("nav", "whats-new", "", "", "", "the", "", "", "the nation of")] * 2 + [("dup", "f", "", "", "", "the", None, None, "alpha of")] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CHUNK)
    cleaned = search.clean_chunks(df)
    folder = str(tmp_path_factory.mktemp("index"))
    build(cleaned, folder)
    patch.undo()
    return cleaned, Index(spark, folder)


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_the_scan(pair, query):
    cleaned, index = pair
    for limit in (7,):
        want = [tuple(r) for r in search.search(cleaned, query, limit).collect()]
        got = index.search(query, limit).select(*search.search(cleaned, query, limit).columns)
        assert [tuple(r) for r in got.collect()] == want, query


@pytest.mark.parametrize("query", ["the nation of", "alpha", "alpha alpha"])
def test_small_lists_change_nothing(pair, monkeypatch, query):
    """Blocks left out by their bounds, lists that overflow into joins, words by condition."""
    cleaned, index = pair
    want = [(r.id, r.score) for r in search.search(cleaned, query, 7).collect()]
    for first, listed, words, chained in ((1, 1000, 200, 200), (1, 5, 0, 2), (2, 60, 3, 0), (1, 0, 200, 200)):
        for name, value in (("FIRST_BLOCKS", first), ("LISTED", listed), ("LISTED_WORDS", words), ("CHAINED", chained)):
            monkeypatch.setattr(search_index, name, value)
        assert [(r.id, r.score) for r in index.search(query, 7).collect()] == want


def test_blocks_are_left_out(spark, tmp_path, monkeypatch):
    """A word of all chunks that one block holds very often: the other blocks' postings are not read."""
    monkeypatch.setattr(search_index, "BLOCK_BITS", 4)
    monkeypatch.setattr(search_index, "FIRST_BLOCKS", 1)
    rows = [(str(i), "f", "", "", "", f"t{i}", "", "", "common " * (50 if 160 <= i < 176 else 1) + f"own{i}", i) for i in range(800)]
    build(search.clean_chunks(spark.createDataFrame(rows, CHUNK)).coalesce(1), str(tmp_path / "i"))
    index = Index(spark, str(tmp_path / "i"))
    assert {int(r.id) for r in index.search("common", 5).collect()} <= set(range(160, 176))
    listed = index._candidates(index._matched(search_index.Counter(["common"])), search_index.Counter(["common"]), 5, True)
    assert len({r.block for r in listed}) < 4 < index.postings.select("block").distinct().count()


def test_no_text_is_read_before_the_top(pair, capsys):
    """Words, maxima and postings have no content, and the last plan reads the listed chunks only."""
    _, index = pair
    assert all("content" not in t.columns for t in (index.words, index.maxima, index.postings))
    index.search("alpha", 5).explain()
    out = capsys.readouterr().out
    assert "PushedFilters" in out and "doc" in out.split("PushedFilters")[1]


def shuffled_records(spark):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_do_not_move(spark, tmp_path, monkeypatch):
    """60,000 words in chunks: texts, distinct words and maxima are shuffled, no word of a chunk is; postings that leave in parts add up."""
    monkeypatch.setattr(search_index, "HELD_WORDS", 500)
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(str(i), "f", "", "", "", f"t{i}", "", "", words, i) for i in range(300)]
    cleaned = search.clean_chunks(spark.createDataFrame(rows, CHUNK))
    before = shuffled_records(spark)
    build(cleaned, str(tmp_path / "i"))
    assert shuffled_records(spark) - before < 10_000
    got = Index(spark, str(tmp_path / "i")).search("w19 w7", 5).select("id", "score").collect()
    assert got == search.search(cleaned, "w19 w7", 5).select("id", "score").collect()


def test_kept_folders_follow_their_inputs(spark, tmp_path):
    from paperlake.storage import kept

    made = []

    def make(folder):
        made.append(folder)
        spark.range(3).write.parquet(f"{folder}/t")

    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    one = kept(spark, "x", [source], make)
    assert kept(spark, "x", [source], make) == one and len(made) == 1 and spark.read.parquet(f"{one}/t").count() == 3
    spark.range(6).write.mode("append").parquet(source)
    assert kept(spark, "x", [source], make) != one and len(made) == 2
