import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperlake.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
VALUES = st.one_of(st.just(0), st.integers(0, 300), st.integers(0, 49407), st.integers(0, 2**64 - 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(VALUES, min_size=1, max_size=150), min_size=1, max_size=6))
def test_words_round_trip(docs):
    lengths = np.array([len(d) for d in docs])
    words, offsets = tf.encode_words(np.array([x for d in docs for x in d], np.uint64), lengths)
    assert tf.decode_words(words, lengths, offsets).tolist() == [x for d in docs for x in d]
    for k, d in enumerate(docs):
        end = offsets[k + 1] if k + 1 < len(docs) else len(words)
        assert tf.decode_words(words[offsets[k] : end], lengths[k : k + 1], np.array([0])).tolist() == d


def test_zero_runs_pack():
    words, _ = tf.encode_words(np.zeros(1200, np.uint64), np.array([1200]))
    assert len(words) == 10


def test_files_match_the_library(spark, docs, saved):
    rng = random.Random(1)
    pieces = [
        "Hello",
        "world's",
        "it's,",
        "É",
        "é",
        " ",
        " ",
        "<|endoftext|>",
        "日本語",
        "🙂",
        "x" * 50,
        "don't'll",
        "\x1c",
        "12ab3",
        "Σ",
        "ΑΣ ",
        "<|start",
        "oftext|>",
        "…",
    ]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "\t "]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rng.shuffle(rows)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "word " * 30000), (7, rows[3][1]), (7, rows[3][1])]
    got = sorted(map(tuple, tf.query(spark, saved(documents=docs(rows))).collect()))
    library = Tokenizer.from_file(PATH)
    coded = sorted((i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    in_order = sorted(got, key=lambda r: r[1])
    at = 0
    for doc_id, start, n, _ in in_order:
        assert start == at
        at += n
    assert [r[0] for r in in_order] == sorted(r[0] for r in in_order)


def test_ids_come_back_and_empty_table(spark, docs, tmp_path):
    tf.write_token_files(docs([(2, "b a"), (1, "a b")]), f"{tmp_path}/t", PATH)
    rows = tf.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    assert [list(r.ids) for r in rows] == [library.encode("a b").ids + [2], library.encode("b a").ids + [2]]
    tf.write_token_files(docs([]), f"{tmp_path}/e", PATH)
    assert tf.token_digests(spark, f"{tmp_path}/e").count() == 0


def test_another_tokenizer_is_used_whole(spark, docs, tmp_path):
    """A file that keeps white space and case: no word is cut or numbered on its own."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tf.word_by_word(PATH) and not tf.word_by_word(path)
    rows = [(1, "Hello  World's\n\n a"), (2, None), (3, ""), (4, " É x" * 500), (5, "word " * 1_000_000)]
    tf.write_token_files(docs(rows), f"{tmp_path}/t", path, 50256)
    library = Tokenizer.from_file(path)
    got = {r.doc_id: list(r.ids) for r in tf.read_token_files(spark, f"{tmp_path}/t").collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 50256] for i, t in rows}


def test_ranges_follow_the_bytes_and_repeated_rows_are_dealt(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "RANGE_BYTES", 2000)
    rows = [(None, "the same text") for _ in range(2000)] + [(i, f"own {i}") for i in range(300)]
    tf.write_token_files(docs(rows).repartition(4), f"{tmp_path}/t", PATH)
    blocks = spark.read.parquet(f"{tmp_path}/t").selectExpr("shard", "size(doc_ids) AS n").collect()
    assert len({r.shard for r in blocks}) > 8 and max(r.n for r in blocks) < 600
    got = tf.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 2000 + list(range(300))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
