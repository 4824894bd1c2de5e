"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. Each count can
differ by no more than the bits that differ in its segment, so the Manhattan distance of
two embeddings is a lower bound of the Hamming distance of the fingerprints. The counts
are stored in unary (0: 00, 1: 01, 2: 11), which makes that Manhattan distance the bit
count of an exclusive or.

The range join runs on a grid whose six axes are groups of segments: two embeddings at
Manhattan distance 3 or less differ on three axes at most, so they share a cell in at
least one of the twenty projections onto three axes. Every cell is compared under the
Manhattan bound and then verified by the exact Hamming distance. Cells of more than
``tile`` fingerprints are cut into tiles, and each pair of tiles is a group of its own.
Within a group only a spanning forest of the links is emitted, which keeps every
component and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (
    checkpointed,
    columns_of,
    connected_components,
    documents,
    free_names,
    joined_by_hot_key,
    keyed_text,
    raw_texts,
    row_key,
    slices,
    stretches,
)

MAX_BITS = 3
LANES = 0x5555555555555555
#: Segments on each of the six grid axes.
AXES = (6, 6, 5, 5, 5, 5)
TILE = 4096
SHINGLES_AT_ONCE = 1 << 16
#: Bytes of one text that are read at once.
STRETCH = 1 << 20


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of whole text: bit set where over half the shingle hashes have it.

    A very long text is read in stretches, each of which begins with the last words before it.
    """
    votes, count, words = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in stretches(text or b"", STRETCH):
        words = words[-(width - 1) :] + part.lower().split()
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :])], np.uint64)
        count += len(hashes)
        for i in range(0, len(hashes), SHINGLES_AT_ONCE):
            bits = hashes[i : i + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not count:
        return digest(b" ".join(words), 42) if words else 0
    return int(np.packbits(votes * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns of whole numbers named in ``more``, and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t) for t in raw_texts(part)], np.uint64).view(np.int64)
            kept = ["doc_id", *more]
            yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(found)], [*kept, "fp"])

    columns = "".join(f"{c} long, " for c in ("doc_id", *more))
    return keyed_text(docs, *more).mapInArrow(run, f"{columns}fp long")


def axis_masks() -> list[int]:
    masks, at = [], 0
    for n in AXES:
        masks.append(sum(3 << (2 * lane) for lane in range(at, at + n)))
        at += n
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(x: np.ndarray, y: np.ndarray, ex: np.ndarray, ey: np.ndarray, most: int) -> np.ndarray:
    """Manhattan bound on the embeddings first, then the exact distance."""
    hit = np.bitwise_count(ex ^ ey) <= most
    hit[hit] = np.bitwise_count(x[hit] ^ y[hit]) <= most
    return hit


def embed(fp: np.ndarray) -> np.ndarray:
    lanes = np.uint64(LANES)
    high = fp >> np.uint64(1)
    return (((fp & high) & lanes) << np.uint64(1)) | ((fp | high) & lanes)


def forest(fp: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span each component of one group: breadth first over what is not yet reached."""
    rest, left, right = np.unique(fp), [], []
    rest_e = embed(rest)
    while len(rest):
        queue, rest, rest_e = [rest[0]], rest[1:], rest_e[1:]
        while queue and len(rest):
            x = np.full(len(rest), queue.pop(), np.uint64)
            hit = near(rest, x, rest_e, embed(x), most)
            if hit.any():
                left.append(x[hit])
                right.append(rest[hit])
                queue.extend(rest[hit])
                rest, rest_e = rest[~hit], rest_e[~hit]
    return left, right


def compare_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (axes, cell), which arrive sorted; a run may span batches."""

    def links(axes: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (axes[1:] != axes[:-1]) | (cell[1:] != cell[:-1])]
        run = np.cumsum(new)
        size = np.bincount(run)[run]
        left, right = [], []
        small = size <= 32
        x, r = fp[small], run[small]
        e = embed(x)
        for s in range(1, min(32, len(x))):
            same = r[s:] == r[:-s]
            if not same.any():
                break
            i = np.flatnonzero(same)
            hit = i[near(x[i], x[i + s], e[i], e[i + s], most)]
            left.append(x[hit])
            right.append(x[hit + s])
        for k in np.unique(run[~small]):
            a, b = forest(fp[run == k], most)
            left += a
            right += b
        pick = lambda parts: pa.array(np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64))
        return pa.RecordBatch.from_arrays([pick(left), pick(right)], ["a", "b"])

    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("axes", "cell", "fp"))
        new = (*new[:2], new[2].view(np.uint64))
        held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
        if not len(held[0]):
            continue
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield links(*(p[:cut] for p in held))
            held = tuple(p[cut:] for p in held)
    if held is not None and len(held[0]):
        yield links(*held)


def fingerprint_links(fps: DataFrame, most: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span every component of distinct fingerprints ``fps(fp)``."""
    masks = axis_masks()
    one = F.shiftrightunsigned("fp", 1)
    lanes = F.lit(LANES)
    counts = F.shiftleft(F.col("fp").bitwiseAND(one).bitwiseAND(lanes), 1).bitwiseOR(F.col("fp").bitwiseOR(one).bitwiseAND(lanes))
    keep = len(masks) - most
    projections = [
        F.struct(F.lit(i).alias("axes"), F.col("e").bitwiseAND(F.lit(signed(sum(c)))).alias("cell"))
        for i, c in enumerate(combinations(masks, keep))
    ]
    cells = fps.select("fp", counts.alias("e")).select("fp", F.explode(F.array(*projections)).alias("p")).select("p.axes", "p.cell", "fp")
    sized = cells.withColumn("n", F.count("*").over(Window.partitionBy("axes", "cell"))).where("n > 1")
    small = sized.where(F.col("n") <= tile).sortWithinPartitions("axes", "cell")
    found = small.select("axes", "cell", "fp").mapInArrow(lambda batches: compare_cells(batches, most), "a long, b long")

    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    hot = sized.where(F.col("n") > tile).withColumn("t", mine).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    hot = hot.select("axes", "cell", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "fp")

    def compare_tiles(group: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(group["fp"].to_numpy().view(np.uint64), most)
        if not a:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return found.union(hot.groupBy("axes", "cell", "i", "j").applyInPandas(compare_tiles, "a long, b long"))


def components_of(fps: DataFrame, most: int) -> DataFrame:
    """fp, n (rows that have it), first (the least of them by id, then key), root: one row a distinct fingerprint of ``fps``."""
    place = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", *(c for c in fps.columns if c not in ("doc_id", "fp"))))
    distinct = checkpointed(fps.groupBy("fp").agg(F.count("*").alias("n"), place.alias("first")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), most))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return placed.withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts
    of fewer than three words hash their whole word sequence. component_id is the smallest
    non-null doc_id reachable over links of at most ``most`` differing bits (null only if
    a component has no doc_id at all). Repeated rows, and different texts under one doc_id,
    are rows of their own, each with its own fingerprint.
    """
    fp = checkpointed(fingerprints(docs))
    placed = components_of(fp, most)
    low = placed.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    groups = placed.join(low, "root").select("fp", "n", "component_id")
    found = joined_by_hot_key(fp, groups, "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """All columns of ``docs``, keeping one document of each component: of smallest doc_id, nulls last.

    Rows are told apart by text and doc_id together, so a null doc_id is judged like any
    other, and different texts under one doc_id stay unless they are near-duplicates. Where the
    smallest doc_id of a component has several texts, one of them stays. Rows that repeat
    both text and doc_id collapse to one.
    """
    first, second = free_names(docs, 2)
    one, two = row_key(docs)
    keyed = docs.withColumns({first: one, second: two})
    fp = checkpointed(fingerprints(keyed, first, second))
    keep = components_of(fp, most).groupBy("root").agg(F.min("first").alias("kept")).select(f"kept.{first}", f"kept.{second}")
    kept = keyed.join(keep, [first, second], "left_semi").dropDuplicates([first, second])
    return columns_of(kept, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


QUERIES = {"op8_simhash_near_dedup": query}
