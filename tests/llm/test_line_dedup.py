import hashlib
import random
from collections import Counter

import pytest

from paperlake.llm import line_dedup

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(texts, least, shortest=1):
    """(n_lines, n_dropped, kept) of each text by plain code."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(UPPER)
    cut = [(t or "").split("\n") for t in texts]
    held = Counter(k for lines in cut for k in {key(line) for line in lines} if len(k) >= shortest)
    kept = [[line for line in lines if held[key(line)] < least] for lines in cut]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(cut, kept)]


def random_texts(seed, count):
    rng = random.Random(seed)
    lines = ["", " ", "a", "A ", "\tB\v", "é", "É", "x ", " ", "Same line", "same LINE\r", "ſ", "🙂", *map(str, range(30))]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 12))) for _ in range(count)]
    return [*texts, None, "", "\n", "\n\n\n", "Same line\n" * 50, texts[0], texts[0]]


@pytest.mark.parametrize("least,shortest", [(10, 1), (2, 1), (1, 1), (3, 2), (1000, 1)])
def test_against_plain_code(docs, least, shortest):
    texts = random_texts(least, 60)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = line_dedup.dedup_lines(docs(rows), least, shortest).collect()
    want = [(i, *x) for (i, _), x in zip(rows, plain(texts, least, shortest))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_query_digest(spark, docs, saved):
    texts = random_texts(5, 80)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in line_dedup.query(spark, saved(documents=docs(rows))).collect()}
    for (i, _), (n, gone, kept) in zip(rows, plain(texts, 10)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_lines_of_very_many_and_of_few_documents_go_alike(docs):
    """One line of half the rows goes the way of hot keys; repeated lines in one document count once."""
    rows = [(i, f"Everywhere\nown {i}\nshared {i % 300}\nthrice\nthrice" if i % 2 else f"own {i}\nshared {i % 300}") for i in range(6000)]
    got = line_dedup.dedup_lines(docs([*rows, (9999, "solo\n" * 40)])).collect()
    assert {r.doc_id: r.kept for r in got} == {**{i: f"own {i}" for i, _ in rows}, 9999: "solo\n" * 40}


def test_one_long_text_with_many_marks(docs):
    """Two hundred thousand lines of which every other goes: linear, no list of lines is copied or searched for each."""
    text = "\n".join("gone" if k % 2 else f"line {k}" for k in range(200_000))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs([(1, text), *((k, "GONE") for k in range(2, 12))])).collect()}
    assert got[1].n_dropped == 100_000 and got[1].kept == "\n".join(f"line {k}" for k in range(0, 200_000, 2))
    assert got[2].kept == "" and got[2].n_dropped == 1


def test_empty_keys_are_no_keys(docs):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs([]), 10, 0)
    assert line_dedup.dedup_lines(docs([])).collect() == []
