"""Whitening of embeddings from an exact integer scatter.

Entries become whole numbers; the distinct vectors are fitted. A shift is subtracted, and sums
and cross-products of what is left are accumulated exactly, whatever their size: tasks
multiply digits of 20 bits whose products a double holds without rounding, pass on
numbers of 192 bits as six longs, and Spark adds those up column by column. From them
n X'X - SS' is formed in whole numbers, and only then rounded, once an entry, and decomposed by ``eigh``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_folder, shared_folder

SCALE = 256
COMPONENTS = 4
#: Rows multiplied at once: 2 ** 12 products of two digits of 20 bits add up below 2 ** 53.
ROWS, DIGIT = 1 << 12, 20
#: A number of 192 bits as longs of 32 bits, the last one signed: sums over 2 ** 31 tasks stay exact.
LIMBS, LIMB = 6, 32
LIMB_NAMES = [f"limb_{k}" for k in range(LIMBS)]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of longs) of rows whose vector is not null, has no null or non-finite entry, and the usual length.

    The usual length is that of most rows (the greater one of two); vectors of other lengths are left out, as
    they have no covariance with the rest. Entries beyond the range of longs take its nearest end.
    """
    entries = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("entries")).where("entries IS NOT NULL")
    rows = rows.where(F.forall("entries", finite))
    length = rows.groupBy(F.size("entries").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = rows.where(F.size("entries") == (length.d if length else 0)).where(F.size("entries") > 0)
    return kept.select("vec_id", F.transform("entries", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Rows of longs as digits of ``DIGIT`` bits in doubles, lowest first; the last one has the sign."""
    found = []
    while True:
        if -(1 << DIGIT) < x.min() and x.max() < 1 << DIGIT:
            return [*found, x.astype(np.float64)]
        found.append((x & ((1 << DIGIT) - 1)).astype(np.float64))
        x = x >> DIGIT


def exact_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows of ``x`` (longs) as Python integers."""
    parts = [digits(block) for block in np.array_split(x, -(-len(x) // ROWS))]
    sums, products = np.zeros(x.shape[1], object), np.zeros((x.shape[1],) * 2, object)
    small: dict[int, np.ndarray] = {}  # whole numbers in longs: fewer than 2 ** 10 blocks are passed in at once
    whole = lambda a: a.astype(np.int64)
    for part in parts:
        for i, a in enumerate(part):
            sums += whole(a.sum(axis=0)).astype(object) << DIGIT * i
            for j, b in enumerate(part):
                small[i + j, i] = small.get((i + j, i), 0) + whole(a.T @ b)
    for (power, _), found in small.items():
        products += found.astype(object) << DIGIT * power
    return sums, products


def limbs(value: int) -> list[int]:
    """A whole number as longs, the lowest first."""
    mask = (1 << LIMB) - 1
    return [*((value >> LIMB * k) & mask for k in range(LIMBS - 1)), value >> LIMB * (LIMBS - 1)]


def scatter(fit: DataFrame, shift: list[int]) -> DataFrame:
    """i, j (-1: the sum of entry i, both -1: the number of rows), limbs: exact sums over all rows of fit(x), less ``shift``."""
    d = len(shift)
    upper = np.triu_indices(d)
    low, high = min(shift), max(shift)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            for start in range(0, len(batch), ROWS << 6):
                x = matrix(batch.column(0).slice(start, ROWS << 6))
                n += len(x)
                if max(int(x.max()), 0) - min(low, 0) < 2**62 and max(high, 0) - min(int(x.min()), 0) < 2**62:
                    s, p = exact_sums(x - np.array(shift, np.int64))
                else:  # differences need not fit into longs: shift the sums in place of the entries
                    s, p = exact_sums(x)
                    by = np.array(shift, object)
                    p = p - np.outer(s, by) - np.outer(by, s) + len(x) * np.outer(by, by)
                    s = s - len(x) * by
                sums += s
                products += p[upper]
        if n:
            values = [n, *sums, *products]
            rows = np.array([limbs(int(v)) for v in values], np.int64)
            i = np.concatenate([[-1], np.arange(d), upper[0]]).astype(np.int32)
            j = np.concatenate([[-1], np.full(d, -1), upper[1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, rows.T)], ["i", "j", *LIMB_NAMES])

    parts = fit.select("x").mapInArrow(accumulate, "i int, j int, " + ", ".join(f"{c} long" for c in LIMB_NAMES))
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in LIMB_NAMES))


def fitted(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """n, S (Python integers) and n X'X - SS' over fit(x), exact; None without rows.

    Collects one exact number a pair of dimensions, whatever the number of rows.
    """
    some = fit.first()
    if some is None:
        return None
    shift = [int(v) for v in some.x]
    d = len(shift)
    sums, products, n = np.zeros(d, object), np.zeros((d, d), object), 0
    for i, j, *parts in scatter(fit, shift).toLocalIterator():
        value = sum(v << LIMB * k for k, v in enumerate(parts))
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            products[i, j] = products[j, i] = value
    #: A shift changes no covariance.
    return n, sums + n * np.array(shift, object), n * products - np.outer(sums, sums)


def components(n: int, scaled: np.ndarray, most: int) -> tuple[np.ndarray, list[float], list[float]]:
    """Directions (rows), eigenvalues and shares of the trace of the covariance ``scaled / n ** 2``, largest first.

    Every entry is rounded once, as a quotient of whole numbers. A component whose eigenvalue is not above the
    rounding of the largest one has no spread to divide by: its direction is null (nan).
    """
    size = n * n
    v = np.array([[a / size for a in row] for row in scaled], np.float64)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:most]
    trace = sum(int(scaled[k, k]) for k in range(len(v))) / size
    e = [float(values[k]) for k in order]
    floor = max(float(values[-1]), 0.0) * len(v) * np.finfo(np.float64).eps
    directions = np.array([vectors[:, k] / np.sqrt(values[k]) if values[k] > floor else np.full(len(v), np.nan) for k in order])
    return directions, e, [x / trace if trace > 0 else float("nan") for x in e]


def projected(rows: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray) -> DataFrame:
    """rows(..., x) with deviation (long; null beyond its range) and whitened (array of doubles) in place of x."""
    d = len(sums)
    kept = [f for f in rows.schema.fields if f.name != "x"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "deviation long", "whitened array<double>"])
    top = max(map(abs, sums))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                piece = batch.slice(start, ROWS)
                x = matrix(piece.column("x"))
                most = n * max(abs(int(x.max())), abs(int(x.min()))) + int(top)
                exact = most < 2**62 and d * most * most < 2**63  # else in Python integers, as exact
                kind = np.int64 if exact else object
                off = n * x.astype(kind) - sums.astype(kind)
                deviation = [int(v) for v in (off * off).sum(axis=1)]
                white = (off.astype(np.float64) / n) @ directions.T
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(f.name) for f in kept),
                        pa.array([v if v < 2**63 else None for v in deviation], pa.int64()),
                        pa.array([[None if np.isnan(w) else w for w in r] for r in white.tolist()], pa.list_(pa.float64())),
                    ],
                    [*(f.name for f in kept), "deviation", "whitened"],
                )

    return rows.mapInArrow(project, schema)


def identity_error(white: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of whitened(array of k) less the identity; of components that have a direction."""
    at = [F.get("whitened", F.lit(i)) for i in range(k)]
    means = white.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(at))).first()
    known = [i for i in range(k) if means[i] is not None]
    if not known:
        return None
    pairs = [(i, j) for i in known for j in known if i <= j]
    products = white.agg(*(F.avg((at[i] - means[i]) * (at[j] - means[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(products, pairs))


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row per usable row (see ``usable``) and component up to ``most``, or to the dimensions if fewer.

    vec_id, component (from 1), n (distinct vectors), deviation (sum of (n x - S) ** 2, null where a long cannot hold
    it), whitened, explained, identity_error. Components without spread (one distinct vector, or a rank below ``most``)
    have a null whitened; without any spread explained and identity_error are null too. No usable row: no rows.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    folder = f"{shared_folder(spark)}/whitening_{uuid.uuid4().hex}"
    #: Equal vectors meet after each task has dropped its own repeats. Written once, read by three passes, then removed.
    rows.select("x").distinct().write.parquet(folder)
    fit = spark.read.parquet(folder)
    found = fitted(fit)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        remove_folder(spark, folder)
        return spark.createDataFrame([], schema)
    n, sums, scaled = found
    directions, _, explained = components(n, scaled, most)
    error = identity_error(projected(fit, n, sums, directions), len(explained))
    remove_folder(spark, folder)
    shares = F.array(*(F.lit(None if np.isnan(x) else x).cast("double") for x in explained))
    one = projected(rows, n, sums, directions).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"), shares.alias("shares"))
    return one.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get("shares", F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_embedding_whitening": query}
