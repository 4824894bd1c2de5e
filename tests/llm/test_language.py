import random
import zlib

import numpy as np

from paperlake.llm import language as lang

LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèüopqrs"}


def text_of(rng, name, words=12):
    return " ".join("".join(rng.choice(LETTERS[name]) for _ in range(rng.randint(2, 7))) for _ in range(words))


def test_vectors_equal_plain_sums():
    text = "Ab, éa\n𐐀b"
    stream = [0]
    for c in f"{text} ":
        s = 0 if not c.isalpha() else ord(c.lower()[0]) if ord(c) < 1 << 16 else 0xE000 + ord(c.lower()[0]) % 6400
        if s or stream[-1]:
            stream.append(s)
    want = sum(np.roll(lang.letter_vector(a), 2).astype(int) * np.roll(lang.letter_vector(b), 1) * lang.letter_vector(c) for a, b, c in zip(stream, stream[1:], stream[2:]))
    got = lang.text_vectors(["xyz", text, ""])
    assert got[1].tolist() == want.tolist() and not got[2].any()


def test_small_cells_give_the_same(monkeypatch):
    rng = random.Random(0)
    texts = [text_of(rng, n) for n in LETTERS for _ in range(5)]
    whole = lang.text_vectors(texts)
    monkeypatch.setattr(lang, "CELLS", 10)
    assert (lang.text_vectors(texts) == whole).all()
    assert (np.concatenate([lang.text_vectors([t]) for t in texts]) == whole).all()


def test_held_out_accuracy(docs):
    rng = random.Random(1)
    rows = [(i, text_of(rng, n), n) for i, n in enumerate(list(LETTERS) * 60)]
    truth = {i: n for i, _, n in rows}
    rows += [
        (900, None, "aa"),
        (901, "123 !", "bb"),
        (902, "", "cc"),
        (903, text_of(rng, "aa"), None),
        (None, text_of(rng, "bb"), None),
        (5, rows[5][1], "cc"),
    ]
    got = lang.identify(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[900] == by[901] == by[902] == "und" and by[903] == "aa" and by[None] == "bb"


def test_empty_unlabelled_and_clashing(spark, docs):
    assert lang.identify(docs([])).count() == 0
    assert [(r.lang_pred, r.score) for r in lang.identify(docs([(1, "abc")])).collect()] == [("und", 0.0)]
    df = spark.createDataFrame(
        [(1, "abc abc", "aa", 3), (2, "!!", "aa", 4), (3, "abc", "aa", 5), (4, "abca", "aa", 5)],
        "doc_id long, text string, lang string, score int",
    )
    kept = lang.keep_known_language(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_answers_equal_plain_prototypes_and_cosines(docs):
    """lang_pred and score of every document, from vectors summed n-gram by n-gram."""
    rng = random.Random(12)
    rows = [(i, text_of(rng, n, rng.randint(1, 9)), n) for i, n in enumerate(list(LETTERS) * 15)]
    rows += [
        (900, None, "aa"),
        (901, "7 !", "bb"),
        (902, text_of(rng, "aa", 3) + " ?", None),
        (None, text_of(rng, "bb", 4), "bb"),
        (3, "ab AB", "cc"),
    ]

    def vector(text):
        stream = [0]
        for c in f"{text} ":
            s = ord(c.lower()[0]) if c.isalpha() else 0
            if s or stream[-1]:
                stream.append(s)
        out = np.zeros(lang.DIMENSIONS)
        for a, b, c in zip(stream, stream[1:], stream[2:]):
            out += np.roll(lang.letter_vector(a), 2).astype(int) * np.roll(lang.letter_vector(b), 1) * lang.letter_vector(c)
        return out

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    sums = {n: sum(vector(t) for i, t, g in rows if g == n and t is not None and not held(i)) for n in LETTERS}
    expected = []
    for i, t, _ in rows:
        v = vector(t or "")
        if any(c.isalpha() for c in t or ""):
            cosine = {n: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for n, s in sums.items()}
            best = max(sorted(cosine), key=cosine.get)
            expected.append((i, held(i), best, round(max(0.0, cosine[best]), 9)))
        else:
            expected.append((i, held(i), "und", 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in lang.identify(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
