"""A Merkle manifest of the dataset: one root, a subroot a source, and a proof for every row.

Leaves are numbered by a range sort, with offsets from counts of runs. Fixed-size blocks of
``BLOCK`` ordered leaves are arrays; ``sequence``, ``transform``, ``slice`` and ``aggregate``
collapse the ``LEVELS`` levels of a block, and the roots of blocks are the leaves of the next
round, until a group has one block. So no task or array sees more than a block, and
a group of any size takes log(size) / log(BLOCK) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, joined_by_hot_key

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS
#: Leaves that one range of the sort holds, about.
RANGE_ROWS = 500_000
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """group (the source as a field), source, doc_id, digest, tampered: the digest without line breaks, where it differs."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    digest = lambda t: F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, t))), 256)
    altered = (F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    return docs.select(
        field(source).alias("group"),
        source.cast("string").alias("source"),
        doc_id.cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.when(altered, digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0, in ``order`` within each group) and total (rows of the group).

    Rows are sorted by group and ``order`` over as many ranges as they need, and by where they were read
    where they agree in all of that, so that repeated rows need not lie in one range. What is numbered
    is written first: a task that is run again finds the same ranges.
    """
    given = checkpointed(rows.withColumn("read_at", F.monotonically_increasing_id()))
    by = ["group", *order, "read_at"]
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(session, -(-given.count() // RANGE_ROWS))
    ranged = given.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("read_at")
    fixed = checkpointed(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    #: One row a group and range that holds it.
    runs = fixed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    within = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"before": before, "total": F.sum("n").over(within)}).drop("n")
    placed = fixed.join(runs, ["group", "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first"))
    return placed.drop("part", "at", "first", "before")


#: The next level of a level ``t``: every ``ARITY`` nodes in turn are one.
NEXT = f"transform(sequence(0, (size(t) - 1) div {ARITY}), i -> sha2(array_join(slice(t, {ARITY} * i + 1, {ARITY}), ''), 256))"


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes(group, place, total, digest, about) to group, block, total, nodes (in order), tree (levels, leaves first).

    A block of a group that has more of them collapses ``LEVELS`` times, the last and shorter one
    too; the only block of a group until one node is left.
    """
    found = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("group", "block").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", "digest", "about"))).alias("nodes")
    )
    last = "element_at(tree, -1)"
    tree = f"""aggregate(sequence(1, {LEVELS}), array(nodes.digest),
        (tree, k) -> if(total <= {BLOCK} and size({last}) = 1, tree, concat(tree, array({NEXT.replace("(t,", f"({last},").replace("(t)", f"({last})")}))))"""
    return checkpointed(found.withColumn("tree", F.expr(tree)))


#: Siblings left and right of node ``p`` of the block, level by level.
SIBLINGS = f"""transform(slice(sequence(0, {LEVELS}), 1, size(tree) - 1), k -> named_struct(
    'left', array_join(slice(tree[k], at(k) div {ARITY} * {ARITY} + 1, at(k) % {ARITY}), ''),
    'right', array_join(slice(tree[k], at(k) + 2, {ARITY - 1} - at(k) % {ARITY}), '')))""".replace(
    "at(k)", f"cast(p div cast(pow({ARITY}, k) as int) as int)"
)


def unfolded(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """group, place, about, digest, path (all siblings on the way up) and the columns of ``upper`` for every node of the blocks.

    ``upper`` has group, block and path, the way of a block's root.
    """
    rest = [c for c in upper.columns if c not in ("group", "block", "path")]
    joined = blocks.join(upper.withColumnRenamed("path", "upper"), ["group", "block"])
    row = f"transform(nodes, (x, p) -> named_struct('place', x.place, 'about', x.about, 'digest', x.digest, 'path', concat({SIBLINGS}, upper)))"
    return joined.selectExpr("group", *rest, f"inline({row})")


def ways(below: DataFrame) -> DataFrame:
    """group, block, path, top for every block: its root's siblings on the way up, and the group's top."""
    top = F.element_at(F.element_at("tree", -1), 1)
    ends = below.where(f"total <= {BLOCK}").select("group", "block", F.array().cast(PATH).alias("path"), top.alias("top"))
    more = below.where(f"total > {BLOCK}").select(
        "group", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
        top.alias("digest"), F.lit(None).cast("string").alias("about"),
    )
    if more.isEmpty():
        return ends
    higher = blocks(more)
    found = unfolded(higher, ways(higher)).select("group", F.col("place").alias("block"), "path", "top")
    return checkpointed(ends.unionByName(found))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, tampered (null where nothing was altered), subroot, root, path.

    Leaves of a source ascend by doc_id (null first), then digest; rows that agree in all
    columns take neighbouring places. Null columns count as ``-``, empty texts as ``0:``. A table without
    rows has no root.
    """
    below = blocks(
        numbered(leaves(docs), ["doc_id", "digest"]).select("group", "place", "total", "digest", F.struct("source", "doc_id", "tampered").alias("about"))
    )
    up = ways(below)
    #: One subroot a source, in a tree of their own.
    heads = below.where("block = 0").select("group", F.col("nodes")[0]["about"]["source"].alias("source")).join(up.where("block = 0"), "group")
    heads = heads.select(F.lit("").alias("group"), F.col("group").alias("about"), "source", F.col("top").alias("digest"))
    crown = blocks(numbered(heads, ["source"]).select("group", "place", "total", "digest", "about"))
    crowned = unfolded(crown, ways(crown)).select(F.col("about").alias("group"), F.col("path").alias("crown"), F.col("top").alias("root"))
    counted = crowned.join(up.groupBy("group").agg(F.count("*").alias("n")), "group")
    whole = joined_by_hot_key(up, counted, "group", "n").withColumn("path", F.concat("path", "crown")).drop("crown")
    found = unfolded(below, whole.withColumnRenamed("top", "subroot"))
    return found.select("about.doc_id", "about.source", F.col("digest").alias("leaf"), "about.tampered", "subroot", "root", "path")


def proof(path: str) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(path: str, leaf: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(documents(spark, sf_dir)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof("path"), 256).alias("proof_sha256"),
        folded("path", F.coalesce("tampered", "leaf")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    f = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    level = lambda t: f"""SELECT level + 1, g, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3
    FROM {t} WHERE n > 1 GROUP BY level, g, p // 3"""  # noqa: E731
    beside = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, level, p // 3 ORDER BY p ROWS BETWEEN {rows}), '')"
    sides = f"{beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after"
    climb = lambda w, s: f"""SELECT w.r, w.g, w.level + 1, w.p // 3, sha256(before || node || after), proof || before || after
    FROM {w} w JOIN {s} s ON w.g = s.g AND w.level = s.level AND w.p = s.p"""  # noqa: E731
    return f"""WITH RECURSIVE
codes AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    FOR i IN range(256)] AS code),
given AS (SELECT row_number() OVER () AS r, doc_id, source, text, {f("source")} AS g,
    {f("doc_id")} || {f("source")} || {f("lang")} || {f("n_chars")} AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, codes),
leaves AS (SELECT r, doc_id, source, g, sha256(head || {f("text")}) AS leaf,
    sha256(head || CASE WHEN crc % 2 = 0 THEN {f("replace(text, chr(10), '')")} ELSE {f("text")} END) AS start FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS p FROM leaves),
low AS (SELECT 0 AS level, g, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed UNION ALL {level("low")}),
heads AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p
    FROM low JOIN (SELECT DISTINCT g, source FROM leaves) USING (g) WHERE n = 1),
high AS (SELECT 0 AS level, 'all' AS g, p, subroot AS h, (SELECT count(*) FROM heads) AS n FROM heads UNION ALL {level("high")}),
low_sides AS (SELECT *, {sides} FROM low WHERE n > 1),
high_sides AS (SELECT *, {sides} FROM high WHERE n > 1),
walk AS (SELECT r, g, 0 AS level, p, start AS node, '' AS proof FROM placed UNION ALL {climb("walk", "low_sides")}),
arrived AS (SELECT w.r, heads.subroot, 'all' AS g, heads.p, node, proof
    FROM walk w JOIN low ON w.g = low.g AND w.level = low.level AND w.p = low.p AND low.n = 1 JOIN heads ON heads.g = w.g),
last_walk AS (SELECT r, g, 0 AS level, p, node, proof FROM arrived UNION ALL {climb("last_walk", "high_sides")})
SELECT l.doc_id, l.leaf, a.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.h AS verified
FROM last_walk w JOIN high t ON t.n = 1 AND w.level = t.level JOIN arrived a ON a.r = w.r JOIN leaves l ON l.r = w.r
"""


QUERIES = {"op12_merkle_manifest": query}
ORACLE_SQL = {"op12_merkle_manifest": _sql()}
