"""Lines that many documents share, dropped from all of them.

The lines of every text are normalised and exploded, hashed to 128 bits, and counted by the
documents that hold them: once for each, so the count is of distinct documents and sums up
before it is shuffled. Lines whose hash reaches the threshold are marked by document and
position, and texts that lose lines are put together again by position. Only hashes and
positions are grouped; texts meet their marks in one join.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from .common import checkpointed, documents, joined_by_hot_key, keyed_text, row_key

#: Documents that must hold a line for it to go.
LEAST_DOCUMENTS = 10
ROW, KEY = ["row_1", "row_2"], ["key_1", "key_2"]


@arrow_udf(ArrayType(StringType()))
def line_keys(texts: pa.Array) -> pa.Array:
    """The key of each line, in order: ASCII white space stripped at both ends, A-Z in lower case."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return pa.ListArray.from_arrays(lines.offsets, pc.ascii_lower(pc.ascii_trim_whitespace(lines.values)))


#: Taken as not deterministic, the keys are worked out once: filters that the optimizer infers of them do not repeat the function.
line_keys = line_keys.asNondeterministic()


def hashes(key: str) -> dict[str, Column]:
    """128 bits of a key."""
    return {name: F.xxhash64(F.lit(salt), key) for salt, name in enumerate(KEY)}


def frequent_lines(docs: DataFrame, least: int, shortest: int) -> DataFrame:
    """key_1, key_2, n: hashes of the keys of at least ``shortest`` code points that ``n >= least`` documents hold."""
    keyed = docs.select(line_keys("text").alias("lines"))
    each = keyed.select(F.explode(F.array_distinct("lines")).alias("line")).where(F.length("line") >= shortest)
    return each.withColumns(hashes("line")).groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def marked_rows(docs: DataFrame, frequent: DataFrame, shortest: int) -> DataFrame:
    """row_1, row_2, marks: positions of a row's lines that go, ascending; rows that keep all their lines are left out."""
    #: Row keys are worked out before the lines are exploded: texts are not carried along with each line.
    keyed = docs.select(*(c.alias(n) for n, c in zip(ROW, row_key(docs))), line_keys("text").alias("lines"))
    lines = keyed.select(*ROW, F.posexplode("lines").alias("at", "line"))
    lines = lines.where(F.length("line") >= shortest).withColumns(hashes("line")).drop("line")
    found = joined_by_hot_key(lines, frequent, KEY, "n")
    #: Bounded by the lines of one text; rows that agree in doc_id and text agree in their marks.
    return found.groupBy(*ROW).agg(F.sort_array(F.collect_set("at")).alias("marks"))


def dedup_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, shortest: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped (longs), kept (the text without its frequent lines).

    A line's key is the line without ASCII white space at either end, A-Z in lower case. Lines
    whose key has ``shortest`` code points and lies in at least ``least`` documents go; every row
    is one document, repeated rows and rows without a doc_id too. Null and empty texts have
    one empty line, which stays; a text that loses all lines becomes empty.
    """
    if shortest < 1:
        raise ValueError("keys without a code point are never dropped")
    rows = keyed_text(docs)
    marks = marked_rows(rows, checkpointed(frequent_lines(rows, least, shortest)), shortest)
    keyed = rows.withColumns(dict(zip(ROW, row_key(rows)))).withColumn("text", F.coalesce("text", F.lit("")))
    joined = keyed.join(marks, ROW, "left")
    #: Whether each line goes, from the stretches before, between and after the marks; every step is linear in the lines.
    start, end = "if(i = 0, 0, marks[i - 1] + 1)", "if(i = size(marks), size(lines), marks[i])"
    stretch = f"concat(array_repeat(false, {end} - ({start})), if(i = size(marks), cast(array() as array<boolean>), array(true)))"
    gone = f"flatten(transform(sequence(0, size(marks)), i -> {stretch}))"
    kept = f"array_join(zip_with(lines, {gone}, (line, g) -> if(g, cast(null as string), line)), '\n')"
    return joined.withColumn("lines", F.split("text", "\n", -1)).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("marks"), F.lit(0)).cast("long").alias("n_dropped"),
        F.expr(f"if(marks is null, text, {kept})").alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM texts),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, any_value(n_lines) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

QUERIES = {"op11_line_dedup": query}
ORACLE_SQL = {"op11_line_dedup": SQL}
