"""What the operators share: bounded slices of Arrow batches, shared storage, components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a helper handles at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id as long, text as string and the columns named; all others are pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order; names may hold dots or back quotes."""
    return df.select(*("`" + c.replace("`", "``") + "`" for c in like.columns))


def crc_mod(column: str, modulus: int):
    """crc32 of the column's text form, modulo; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text in each piece stays near ``size`` bytes."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def listed(words: pa.Array) -> list[str]:
    """Words without spaces as a list, by one join and one split."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


WHITE = re.compile(rb"[\t-\r ]")


def stretches(raw: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes of one long text, each but the last cut before white space."""
    start = 0
    while len(raw) - start > size:
        found = WHITE.search(raw, start + size)
        if not found:
            break
        yield raw[start : found.start()]
        start = found.start()
    yield raw[start:]


def shared_folder(spark: SparkSession) -> str:
    """Where tables go that every executor must read: spark.checkpoint.dir.

    A folder of our own is set only where the session names none and runs in one process, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def row_key(docs: DataFrame) -> list[Column]:
    """128 bits from a row's text and doc_id, either of which may be null: rows agree where both do."""
    parts = F.struct(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return [F.xxhash64(F.lit(salt), parts, F.isnull("doc_id"), F.isnull("text")) for salt in (1, 2)]


def free_names(docs: DataFrame, count: int) -> list[str]:
    """Names that no column of ``docs`` has, in either case."""
    taken = {c.lower() for c in docs.columns}
    return [n for n in (f"key_{i}" for i in range(count + len(taken))) if n not in taken][:count]


def in_slices(texts: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts of an array, a slice at a time."""
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        yield raw_texts(part)


#: A key with more than one in so many rows is hot: there are fewer than so many hot keys, whatever the table.
HOT_PART = 1000


def joined_by_hot_key(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """rows joined with groups(key, count, ...), one row a key, where ``count`` is how many rows have that key.

    Rows of hot keys meet their group by a broadcast of fewer than ``HOT_PART`` groups, so no
    task gets all rows of one key; the rest are joined by key.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_PART > F.lit(total)
    few, rest = (F.broadcast(groups.where(hot).drop(count)), groups.where(~hot).drop(count))
    keys = [key] if isinstance(key, str) else key
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(rest, keys))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that nothing reads any more, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node it can reach.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) as joins and partial
    minimums; each round is checkpointed. Hub nodes are only ever summed up by a minimum
    and joined, never gathered.
    """
    pairs = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(small.union(down).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
