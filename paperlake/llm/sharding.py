"""Minimax contiguous shards over ordered atoms, in DataFrame expressions throughout.

Documents of equal text hash alike, and the leading ``ATOM_BITS`` bits of that hash name
their atom: atoms are whole groups of equal texts in hash order, never cut. Their sizes
are one short array (2 ** ATOM_BITS longs at most, whatever the corpus), over which the
smallest feasible shard capacity is found by binary search with a greedy check. The cuts
then stay within that capacity, and where it leaves a choice (one huge atom sets the
capacity) they aim at equal shares of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, keyed_text

ATOM_BITS = 16
OVERHEAD = 16
#: Rows that one sorted run for slot numbers holds, about; larger atoms are dealt over more runs, by
#: doc_id and by the partition a row was read from, so that rows without an id are dealt as well.
RUN_ROWS = 10_000


def atom_cuts(sizes: str, shards: int) -> str:
    """SQL for the first atom of each shard after shard 0, given an array<bigint> column ``sizes``."""
    feasible = f"aggregate({sizes}, named_struct('n', 1, 'fill', 0L), (a, x) -> if(a.fill + x <= div_mid, named_struct('n', a.n, 'fill', a.fill + x), named_struct('n', a.n + 1, 'fill', x)), a -> a.n <= {shards})"
    middle = "(b.lo + (b.hi - b.lo) div 2L)"
    search = f"""aggregate(sequence(1, 63),
        named_struct('lo', greatest(array_max({sizes}), total div {shards}L), 'hi', array_max({sizes}) + total div {shards}L + 1L),
        (b, i) -> if(b.lo >= b.hi, b, if({feasible.replace("div_mid", middle)},
            named_struct('lo', b.lo, 'hi', {middle}), named_struct('lo', {middle} + 1L, 'hi', b.hi))),
        b -> b.lo)"""
    return search


def with_cuts(one: DataFrame, shards: int) -> DataFrame:
    """Adds ``capacity`` and ``cuts`` to one row with ``sizes`` (array<bigint>, atoms in order).

    Each step is checkpointed (one short row): the optimizer would else put its expression
    into the next step's function and work it out anew for every atom.
    """
    one = checkpointed(one.withColumn("total", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")))
    one = checkpointed(one.withColumn("capacity", F.expr(atom_cuts("sizes", shards))))
    #: From the right: latest[k] is the first atom of the longest tail that fits into k + 1 shards.
    tail = """aggregate(sequence(size(sizes) - 1, 0, -1), named_struct('fill', 0L, 'first', array()),
        (a, i) -> if(a.fill > 0L and a.fill + sizes[i] > capacity,
            named_struct('fill', sizes[i], 'first', array_append(a.first, i + 1)),
            named_struct('fill', a.fill + sizes[i], 'first', a.first)),
        a -> array_append(a.first, 0))"""
    one = checkpointed(one.withColumn("latest", F.expr(tail.replace("array()", "cast(array() as array<int>)"))))
    last = shards - 1
    cuts = f"""aggregate(sequence(0, size(sizes) - 1), named_struct('k', 0, 'fill', 0L, 'rest', total, 'cuts', cast(array() as array<int>)),
        (a, i) -> if(a.fill > 0L and a.k < {last} and (a.fill + sizes[i] > capacity
                or (i >= coalesce(get(latest, {last - 1} - a.k), 0)
                    and (a.fill + sizes[i] div 2L) * ({shards} - a.k) > a.rest)),
            named_struct('k', a.k + 1, 'fill', sizes[i], 'rest', a.rest - a.fill, 'cuts', array_append(a.cuts, i)),
            named_struct('k', a.k, 'fill', a.fill + sizes[i], 'rest', a.rest, 'cuts', a.cuts)),
        a -> a.cuts)"""
    return checkpointed(one.withColumn("cuts", F.expr(cuts)))


def keyed_documents(docs: DataFrame) -> DataFrame:
    return keyed_text(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("key"),
        F.spark_partition_id().alias("part"),
    ).withColumn("atom", F.shiftrightunsigned("key", 64 - ATOM_BITS).cast("int"))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, atom.

    law is ``bytes``: shard sizes are as near equal as whole atoms allow. Null texts have
    16 bytes and checksum 0. Slots count from 0 in each shard without gaps, in the order
    of atom, run, text hash, doc_id (nulls first); repeated rows get slots of their own.
    With fewer atoms than shards the last shards stay empty.
    """
    #: Read once: what follows meets a few numbers a row in place of its text.
    keyed = checkpointed(keyed_documents(docs))
    atoms = keyed.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    listed = F.sort_array(F.collect_list(F.struct("atom", "bytes", "rows")))
    #: Bounded by 2 ** ATOM_BITS entries, as is every table below it up to ``layout``.
    one = checkpointed(atoms.agg(listed.alias("atoms")).where("size(atoms) > 0").withColumn("sizes", F.col("atoms.bytes")))
    placed = with_cuts(one, shards).select(
        F.explode(
            F.expr("transform(atoms, (x, i) -> named_struct('atom', x.atom, 'rows', x.rows, 'shard', size(filter(cuts, c -> c <= i))))")
        ).alias("p")
    ).select("p.*")
    earlier = F.sum("rows").over(Window.partitionBy("shard").orderBy("atom").rowsBetween(Window.unboundedPreceding, -1))
    runs = F.greatest(F.lit(1), F.ceil(F.col("rows") / RUN_ROWS)).cast("int")
    layout = placed.select("atom", "shard", F.coalesce(earlier, F.lit(0)).alias("before"), runs.alias("runs"))

    #: Proven bound: at most 2 ** ATOM_BITS short rows.
    rows = keyed.join(F.broadcast(layout), "atom").withColumn("run", F.pmod(F.xxhash64("doc_id", "part"), "runs").cast("int"))
    counts = rows.where("runs > 1").groupBy("atom", "run").agg(F.count("*").alias("n"))
    in_atom = Window.partitionBy("atom").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("atom", "run", F.coalesce(F.sum("n").over(in_atom), F.lit(0)).alias("skip"))
    place = F.row_number().over(Window.partitionBy("atom", "run").orderBy("key", "doc_id")) - 1
    numbered = rows.withColumn("place", place).join(offsets, ["atom", "run"], "left")
    slot: Column = F.col("before") + F.coalesce("skip", F.lit(0)) + F.col("place")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "atom",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 40)


QUERIES = {"op1_sharding": query}
