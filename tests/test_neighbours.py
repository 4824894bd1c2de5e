import numpy as np
import pytest

from paperlake.operators import neighbours


def brute(x, ids, seeds, k):
    """The k nearest other vectors of each seed by plain code."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for s in seeds:
        score = np.round(u @ u[ids.index(s)], 6)
        order = sorted((i for i in range(len(ids)) if ids[i] != s), key=lambda i: (-score[i], ids[i]))
        found[s] = [(ids[i], score[i]) for i in order[:k]]
    return found


def indexed(spark, tmp_path, x, ids=None, **more):
    ids = list(range(len(x))) if ids is None else ids
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x)], "id long, vector array<float>")
    neighbours.build(df, str(tmp_path / "i"), **more)
    return lambda *a, **b: neighbours.search(spark, str(tmp_path / "i"), *a, **b)


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.seed_id, set()).add(r.id)
    return np.mean([len(found.get(s, set()) & {i for i, _ in w}) / len(w) for s, w in want.items()])


def test_all_cells_are_exact(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(600, 8)).astype(np.float32)
    run = indexed(spark, tmp_path, x.tolist())
    got = run(10, probes=10**6).collect()
    want = brute(x.astype(float), list(range(600)), range(0, 600, 50), 10)
    by_seed = {s: [r.id for r in sorted((r for r in got if r.seed_id == s), key=lambda r: r.rank)] for s in want}
    assert by_seed == {s: [i for i, _ in w] for s, w in want.items()} and all(r.copies == 1 for r in got)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_recall_with_the_fitted_number_of_cells(spark, tmp_path, spread):
    """Vectors without any clusters ask for many cells, clustered ones for few; both reach the recall asked for."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 32)) + spread * rng.normal(size=(40, 32))[rng.integers(40, size=4000)]).astype(np.float32)
    run = indexed(spark, tmp_path, x.tolist())
    want = brute(x.astype(float), list(range(4000)), range(0, 4000, 50), 10)
    assert recall(run(10).collect(), want) >= 0.9
    if spread:
        assert spark.read.parquet(str(tmp_path / "i" / "model")).first().probes < 20


def test_recall_on_the_embeddings(spark, tmp_path):
    from paperlake.plans.catalog import queries

    folder = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in t], np.array([r.embedding for r in t], float)
    want = brute(x, ids, [i for i in ids if i % 50 == 0], 10)
    got = queries()["similar_many"](spark, folder).collect()
    assert len(got) == 10 * len(want) and recall(got, want) >= 0.9
    scores = {s: dict(w) for s, w in want.items()}
    assert all(abs(scores[r.seed_id][r.id] - r.score) < 2e-6 for r in got if r.id in scores[r.seed_id])


def test_copies_are_one_class_and_tiles_change_nothing(spark, tmp_path, monkeypatch):
    """A third of all rows is one vector; tiny tiles split every cell among rows and seeds."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 4)).astype(np.float32)
    x = np.concatenate([base, np.repeat(base[:1], 100, axis=0)])
    run = indexed(spark, tmp_path, x.tolist())
    want = {(r.seed_id, r.rank): tuple(r) for r in run(5, probes=10**6).collect()}
    assert all(r[1] == (3 if r[0] == 0 else 1) for r in want.values())  # 0, 200 and 250 share a vector
    assert {r[3] for r in want.values()} <= set(range(200)) and {r[4] for r in want.values() if r[3] == 0} <= {101}
    monkeypatch.setattr(neighbours, "TILE", 3)
    assert {(r.seed_id, r.rank): tuple(r) for r in run(5, probes=10**6).collect()} == want


def test_unusable_vectors_and_empty_tables(spark, tmp_path):
    rows = [[1.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [1.0], [1.0, None], [float("nan"), 1.0], [1.0, 1.0]]
    run = indexed(spark, tmp_path, rows)
    assert {(r.seed_id, r.id) for r in run(5, probes=9).collect()} == {(0, 1), (0, 7)}
    for name, given in (("none", []), ("null", [None])):
        (tmp_path / name).mkdir()
        assert indexed(spark, tmp_path / name, given)(5).collect() == []


def test_no_plan_of_all_pairs(spark, tmp_path, capsys):
    x = np.random.default_rng(1).normal(size=(100, 4)).astype(np.float32)
    indexed(spark, tmp_path, x.tolist())(3).explain()
    out = capsys.readouterr().out
    assert "Cartesian" not in out and "NestedLoop" not in out
