import math
import random
from fractions import Fraction

import numpy as np
import pytest

from paperlake.llm import whitening

TABLE = "vec_id long, embedding array<double>, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, None) for i, v in enumerate(vectors)], TABLE)


def whole(vectors):
    ok = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    ends = lambda c: max(-(2**63), min(2**63 - 1, c))
    return {i: [ends(math.floor(Fraction(c) * 256)) for c in v] for i, v in enumerate(vectors) if ok(v)}


def test_scatter_is_exact_at_any_size(spark):
    """Small entries, entries of the whole range of longs, and ones beside a huge shift."""
    rng = random.Random(1)
    for span in (3, 2**18, 2**21, 2**45, 2**62, 2**63 - 1):
        x = [[rng.randint(-span, span) for _ in range(3)] for _ in range(200)] + [[span] * 3, [-span - 1 if span == 2**63 - 1 else -span] * 3]
        x = list(map(list, {tuple(v) for v in x}))
        n, sums, scaled = whitening.fitted(spark.createDataFrame([(v,) for v in x], "x array<long>"))
        assert n == len(x) and list(sums) == [sum(v[k] for v in x) for k in range(3)]
        for i in range(3):
            for j in range(3):
                assert scaled[i, j] == n * sum(v[i] * v[j] for v in x) - sums[i] * sums[j]


def test_digits_and_limbs():
    x = np.array([[-(2**63), 2**63 - 1, 0, -1, 2**20, -(2**20)]])
    for k in range(x.shape[1]):
        assert sum(int(p[0, k]) << whitening.DIGIT * i for i, p in enumerate(whitening.digits(x))) == int(x[0, k])
    for v in (0, -1, 2**130, -(2**170) + 5):
        assert sum(p << 32 * i for i, p in enumerate(whitening.limbs(v))) == v


@pytest.mark.parametrize("far", [0.0, 4.0e9])
def test_whole_answer(spark, far):
    """Repeated vectors count once in the fit but have rows; a far-off dimension takes no precision away."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ np.diag([9, 5, 3, 2, 1, 0.5]) + [0, 1, -2, 0, far, 0]
    vectors = [*base.tolist(), *base[:1].tolist() * 200, None, [1.0] * 5 + [None], [float("nan")] + [0.0] * 5, [float("inf")] * 6, [1.0] * 5, []]
    x = whole(vectors)
    x = {i: v for i, v in x.items() if len(v) == 6}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scaled = np.array([[Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n) for j in range(6)] for i in range(6)])
    values, vecs = np.linalg.eigh(scaled.astype(float))
    got = whitening.whiten(table(spark, vectors)).collect()
    assert {(r.vec_id, r.component) for r in got} == {(i, k) for i in x for k in (1, 2, 3, 4)} and len(got) == 4 * len(x)
    sign = {}
    for r in got:
        k = -r.component
        off = [n * c - s for c, s in zip(x[r.vec_id], sums)]
        want = float(sum((o / n) * v for o, v in zip(off, vecs[:, k]))) / math.sqrt(values[k])
        assert r.n == n and r.deviation == (d if (d := sum(o * o for o in off)) < 2**63 else None)
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 and r.identity_error < 1e-9
        assert math.isclose(r.explained, values[k] / np.trace(scaled.astype(float)), rel_tol=1e-9)
        if abs(want) > 1e-6:
            assert sign.setdefault(k, r.whitened * want > 0) == (r.whitened * want > 0)


def test_covariance_of_the_fit_is_the_identity(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 8)) @ rng.normal(size=(8, 8))
    got = whitening.whiten(table(spark, base.tolist())).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    centred = got - got.mean(axis=0)
    assert np.abs(centred.T @ centred / len(got) - np.eye(4)).max() < 1e-9


def test_no_spread_few_dimensions_and_huge_entries(spark):
    one = whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(one) == 10 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    line = whitening.whiten(table(spark, [[float(k), float(k)] for k in range(10)])).collect()
    assert len(line) == 20 and all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
    huge = whitening.whiten(table(spark, [[1e300, -1e300], [0.0, 1.0], [-1e300, 1e18]])).collect()
    assert len(huge) == 6 and any(r.deviation is None for r in huge)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[float("nan")]]])
def test_nothing_usable(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_query_over_floats_and_extra_columns(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5), 1.5 * (i % 3)], i, 1, "x") for i in range(50)] + [(None, [0.0, 1.0, 2.0], 0, 2, None)] * 2
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x long, deviation long, `a.b` string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path)).collect()
    assert len(got) == 52 * 3 and sum(r.vec_id is None for r in got) == 6
