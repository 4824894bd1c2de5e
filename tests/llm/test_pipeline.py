import random
import re

import numpy as np

import corpus_pipeline
from paperlake.llm import decontamination, language, sentencepiece_dropout, simhash

LETTERS = {"aa": "abcdefgh", "bb": "ijklmnop"}


def word(rng, lang):
    return "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(4, 8)))


def test_run_equals_plain_stages(spark, docs, saved):
    rng = random.Random(3)
    item = [word(rng, "aa") for _ in range(30)]
    rows = [(i, " ".join(word(rng, lang) for _ in range(80)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, rows[4][1], "aa"), (101, "123 456 !!", "aa"), (102, None, "bb"), (103, "", "aa")]
    rows += [(104, rows[8][1].split(" ", 1)[0] + " " + " ".join(item) + " " + rows[10][1], "aa")]
    rows += [(105, rows[12][1][::-1] + " password=abcdefgh12", "aa")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    sf = saved(documents=docs(rows), benchmark=bench)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}

    kept = {i: t for i, t, _ in rows if t and re.search("[a-z]", t)}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in kept.items()}
    root = {i: i for i in kept}
    for _ in kept:
        for i in kept:
            for j in kept:
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[i] == root[j] for i in kept for j in kept if (fps[i] ^ fps[j]).bit_count() <= 3):
            break
    kept = {i: t for i, t in kept.items() if root[i] == i}
    words = [w.encode() for w in item]
    kept = {i: t for i, t in kept.items() if decontamination.longest_common(words, t.encode().split()) < 15}
    kept = {i: re.sub(r"password=\S{8,}", "[SECRET]", t) for i, t in kept.items()}
    assert set(got) == set(kept) and 104 not in got and 100 not in got
    for i, t in kept.items():
        assert got[i].lossless
        assert sentencepiece_dropout.decode(np.array(got[i].ids, np.uint32), sentencepiece_dropout.model_path()).decode() == t


def test_every_stage_but_the_last_keeps_the_columns(spark, docs, saved):
    sf = saved(
        documents=docs([(1, "abc def", "aa"), (2, None, None), (6, "abc", "aa")]),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, sf).columns == table.columns
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_rows_are_judged_by_their_text_whatever_their_doc_id(spark, docs):
    rng = random.Random(5)
    text = [" ".join(word(rng, "aa") for _ in range(60)) for _ in range(6)]
    item = " ".join(word(rng, "aa") for _ in range(30))
    rows = [(i, " ".join(word(rng, "aa") for _ in range(40)), "aa") for i in range(10, 40)]
    kept = language.keep_known_language(docs([*rows, (None, "999 111"), (1, text[0], "aa"), (1, "12345 678"), (None, text[1])]))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(i, t) for i, t, _ in rows} | {(1, text[0]), (None, text[1])}

    same_id = [
        (1, text[0]),
        (1, text[1]),
        (1, text[1]),
        (2, text[1]),
        (None, text[2]),
        (None, text[2]),
        (None, text[3]),
        (3, text[3]),
        (None, None),
        (None, ""),
    ]
    left = simhash.drop_near_duplicates(docs(same_id)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted(
        [("1", text[0]), ("1", text[1]), ("None", text[2]), ("3", text[3]), ("None", next(str(r.text) for r in left if not r.text))]
    )

    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leaks = [(None, f"{text[4]} {item} {text[5]}"), (7, item), (7, text[5]), (None, text[4]), (None, None)]
    clean = decontamination.drop_contaminated(docs(leaks), bench)
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(
        map(str, [(7, text[5]), (None, text[4]), (None, None)])
    )


def test_long_texts_in_stretches_give_the_same(monkeypatch):
    text = " ".join(word(random.Random(i), "aa") for i in range(500)) + "\n a  b"
    whole, vector = simhash.fingerprint(text.encode()), language.text_vectors([text, "abc"])
    for size in (1, 30, 1000):
        monkeypatch.setattr(simhash, "STRETCH", size)
        monkeypatch.setattr(language, "STRETCH", size)
        assert simhash.fingerprint(text.encode()) == whole
        assert (language.text_vectors([text, "abc"]) == vector).all()
        assert (language.total_vector([text, "abc"]) == vector.sum(axis=0)).all()
