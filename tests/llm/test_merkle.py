import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperlake.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return digest(*(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """All levels, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        t = levels[-1]
        levels.append([digest(*t[i : i + 3]) for i in range(0, len(t), 3)])
    return levels


def way(levels, p):
    """(left, right) of node p, level by level."""
    found = []
    for t in levels[:-1]:
        run = p // 3 * 3
        found.append(("".join(t[run:p]), "".join(t[p + 1 : run + 3])))
        p //= 3
    return found


def plain(rows):
    """The query's answer by plain code, from rows (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in order])
    found = []
    for k, s in enumerate(order):
        for p, r in enumerate(by_source[s]):
            path = way(trees[s], p) + way(top, k)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "")) if altered else leaf(r, r[1])
            for left, right in path:
                node = digest(left, node, right)
            siblings = digest("".join(a + b for a, b in path))
            found.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], siblings, node, node == top[-1][0]))
    return found


def answer(spark, folder):
    return [tuple(r) for r in merkle.query(spark, folder).collect()]


def rows_of(rng, sizes):
    texts = [None, "", "a", "a\nb", "\n", "é\n🙂", "no break"]
    return [(rng.randint(-5, 10**6), rng.choice(texts), rng.choice([None, "", "en"]), s, rng.choice([None, 0, 7])) for s, n in sizes for _ in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_plain_code(spark, docs, saved, monkeypatch, levels):
    """Blocks of 3, 9 and 729: several rounds, partial blocks, lone leaves, sources by bytes."""
    for name, value in vars(merkle).copy().items():
        if isinstance(value, str) and name in ("SIBLINGS",):
            monkeypatch.setattr(merkle, name, value.replace("sequence(0, 6)", f"sequence(0, {levels})"))
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(levels)
    sizes = [(None, 5), ("", 1), ("Z", 27), ("a", 28), ("é", 82), ("\U0001f642", 1), ("b", 3), ("-", 10), *((f"s{k}", 1) for k in range(8))]
    rows = rows_of(rng, sizes)
    rows += [rows[0], rows[0], (None, "x\ny", None, "a", None), (None, "x\ny", None, "a", None), (-(2**63), "t", "fr", "a", 1)]
    rng.shuffle(rows)
    assert sorted(map(repr, answer(spark, saved(documents=docs(rows))))) == sorted(map(repr, plain(rows)))


def test_ranges_of_one_large_source(spark, docs, saved, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = [(i * 7 % 2000, f"t{i}\n", "en", "one" if i % 3 else "two", i) for i in range(2000)] + [(5, "same", None, "one", 1)] * 300
    assert sorted(map(repr, answer(spark, saved(documents=docs(rows))))) == sorted(map(repr, plain(rows)))


def test_one_row_and_none(spark, docs, saved):
    row = (3, "a\nb", "en", "s", 3)
    (got,) = answer(spark, saved(documents=docs([row])))
    assert got == plain([row])[0] and got[1] == got[2] == got[3]
    assert answer(spark, saved(documents=docs([]))) == []


def test_a_changed_row_is_found_by_its_proof(docs):
    """Any column of any row: the manifest's proof of the old row no longer leads to the root."""
    rows = [(i, f"text {i}", "en", f"s{i % 4}", i) for i in range(200)]
    made = merkle.manifest(docs(rows)).collect()
    root = made[0].root
    for r in made[::17]:
        old = rows[r.doc_id]
        for k, value in ((1, "other"), (2, None), (4, -1)):
            node = leaf([*old[:k], value, *old[k + 1 :]], value if k == 1 else old[1])
            for s in r.path:
                node = digest(s.left, node, s.right)
            assert node != root


def test_no_python_in_the_plan(spark, docs, saved, capsys):
    merkle.leaves(docs([(1, "a", "en", "s", 1)]).where(F.lit(True))).explain()
    merkle.query(spark, saved(documents=docs([(1, "a", "en", "s", 1)]))).explain()
    assert "Python" not in capsys.readouterr().out
