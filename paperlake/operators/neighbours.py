"""Approximate nearest neighbours by cosine for many seeds: coarse cells and residual codes.

Equal vectors are one class, known by its smallest id and its number of copies, so copies of one vector cost
no more than one. Cells are fitted on a bounded sample (``SAMPLE`` classes of smallest hash); every class is
indexed, as its cell and one byte a dimension for what its cell's centre leaves. A seed is joined with the rows
of its nearest cells, tile by tile, and the best by code are scored by their exact vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Classes that centres, code scales and the number of cells to probe are fitted on, and cells at most.
SAMPLE, MOST_CELLS = 20_000, 1_000
ROUNDS = 10
#: Rows, and seeds, of one cell that one task compares.
TILE = 20_000
#: Candidates by code for each of the neighbours asked for.
RERANKED = 4


def unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def classes(vectors: DataFrame, seeds: str) -> DataFrame:
    """vectors(id, vector) to one row a distinct vector: id (the smallest), copies, seed_id (smallest seed or null), seeds, vector.

    ``seeds`` is a condition on id. Left out: vectors that are null, have null or non-finite entries or no length
    to divide by, and those without the usual number of dimensions (that of most rows).
    """
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = vectors.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector")).where(good)
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    seed = F.when(F.expr(seeds), F.col("id"))
    return rows.where(F.size("vector") == (usual.d if usual else 0)).groupBy("vector").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.min(seed).alias("seed_id"), F.count(seed).alias("seeds")
    )


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means over unit rows; empty cells start anew at a row."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), x[rng.integers(len(x), size=cells)]).astype(np.float32)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
    """Cells to probe so that, within the sample, ``recall`` of the k nearest of its rows lie in them."""
    some = x[:: max(1, len(x) // 500)]
    near = some @ x.T
    k = min(k + 1, len(x))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    of = (x @ centres.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    found = np.sort(np.take_along_axis(rank, of[top], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def build(vectors: DataFrame, folder: str, seeds: str = "id % 50 = 0", recall: float = 0.97, k: int = 10) -> None:
    """Write the index of vectors(id, vector): classes, codes (cell, id, code) and model (one row)."""
    spark = vectors.sparkSession
    classes(vectors, seeds).write.parquet(f"{folder}/classes")
    found = spark.read.parquet(f"{folder}/classes")
    sample = found.orderBy(F.xxhash64("id"), "id").select("vector").limit(SAMPLE).toArrow().column(0)
    if not len(sample):
        spark.createDataFrame([], "cell int, id long, code binary").write.parquet(f"{folder}/codes")
        spark.createDataFrame([], "centres array<float>, scale array<float>, probes int").write.parquet(f"{folder}/model")
        return
    x = unit(matrix(sample))
    centres = centres_of(x, max(1, min(MOST_CELLS, int(found.count() ** 0.5), len(x))))
    left = np.abs(x - centres[(x @ centres.T).argmax(axis=1)])
    scale = np.maximum(left.max(axis=0) / 127, 1e-9).astype(np.float32)
    probes = probes_for(x, centres, recall, k)
    model = [(centres.ravel().tolist(), scale.tolist(), probes)]
    spark.createDataFrame(model, "centres array<float>, scale array<float>, probes int").coalesce(1).write.parquet(f"{folder}/model")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = unit(matrix(batch.column("vector")))
            cell = (rows @ centres.T).argmax(axis=1)
            codes = np.clip(np.rint((rows - centres[cell]) / scale), -127, 127).astype(np.int8)
            raw = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), raw], ["cell", "id", "code"])

    coded = found.select("id", "vector").mapInArrow(code, "cell int, id long, code binary")
    coded.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(f"{folder}/codes")


def search(spark: SparkSession, folder: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """For every class that has a seed: seed_id, seeds, rank (from 1), id, copies and score of its k nearest other classes.

    ``probes`` cells are searched, by default as many as the sample asked for; with all cells and enough
    candidates the answer is exact. Scores are cosines rounded to six digits; ties go to the smaller id.
    """
    schema = "seed_id long, seeds long, rank int, id long, copies long, score double"
    (model,) = spark.read.parquet(f"{folder}/model").collect() or (None,)
    if model is None:
        return spark.createDataFrame([], schema)
    scale = np.array(model.scale, np.float32)
    centres = np.array(model.centres, np.float32).reshape(-1, len(scale))
    probes, most = min(probes or model.probes, len(centres)), k * RERANKED
    found, codes = spark.read.parquet(f"{folder}/classes"), spark.read.parquet(f"{folder}/codes")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = unit(matrix(batch.column("vector")))
            cells = np.argpartition(-(rows @ centres.T), probes - 1, axis=1)[:, :probes].astype(np.int32)
            at = np.repeat(np.arange(len(rows)), probes)
            for start in range(0, len(at), TILE):
                part = pa.array(at[start : start + TILE])
                taken = [pa.array(cells.ravel()[start : start + TILE]), *(batch.column(c).take(part) for c in ("id", "vector"))]
                yield pa.RecordBatch.from_arrays(taken, ["cell", "id", "vector"])

    asked = found.where("seeds > 0").select("id", "vector").mapInArrow(probe, "cell int, id long, vector array<float>")
    #: One row a cell, of which there are at most MOST_CELLS.
    count = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    layout = F.broadcast(count(codes, "parts").join(count(asked, "seed_parts"), "cell"))
    tile = lambda rows, own, other: rows.join(layout, "cell").withColumns(
        {own[:-1]: F.pmod(F.xxhash64("id"), own).cast("int"), other[:-1]: F.explode(F.expr(f"sequence(0, {other} - 1)"))}
    )
    keys = ["cell", "part", "seed_part"]
    left = tile(asked, "seed_parts", "parts").select(*keys, "id", "vector").groupBy(*keys)
    right = tile(codes, "parts", "seed_parts").select(*keys, "id", "code").groupBy(*keys)

    def compare(key: tuple, seeds: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(seeds) or not len(rows):
            return pa.table({"seed": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
        raw = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(rows), -1)
        base = centres[key[0].as_py()] + raw * scale
        ids, of = rows.column("id").to_numpy(), seeds.column("id").to_numpy()
        wanted, out = unit(matrix(seeds.column("vector"))), []
        for start in range(0, len(of), 1000):
            near = wanted[start : start + 1000] @ base.T
            top = np.argpartition(-near, min(most, len(ids) - 1), axis=1)[:, : most + 1] if len(ids) > most else np.tile(np.arange(len(ids)), (len(near), 1))
            seed = np.repeat(of[start : start + 1000], top.shape[1])
            out.append((seed, ids[top.ravel()], np.take_along_axis(near, top, axis=1).ravel()))
        seed, other, near = (np.concatenate(c) for c in zip(*out))
        kept = seed != other
        return pa.table({"seed": seed[kept], "id": other[kept], "near": near[kept]})

    close = left.cogroup(right).applyInArrow(compare, "seed long, id long, near float")
    #: At most ``most`` + 1 rows a seed and tile.
    by_code = Window.partitionBy("seed").orderBy(F.desc("near"), "id")
    listed = close.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= most).select("seed", "id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    with_rows = listed.join(found.select("id", "copies", "vector"), "id")
    own = found.where("seeds > 0").select(F.col("id").alias("seed"), "seed_id", "seeds", F.col("vector").alias("own"))
    cosine = dot("vector", "own") / (F.sqrt(dot("vector", "vector")) * F.sqrt(dot("own", "own")))
    scored = with_rows.join(own, "seed").withColumn("score", F.round(cosine, 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("seed_id", "seeds", "rank", "id", "copies", "score")
