"""Libraries and notes from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import collections as C
from paperlake.operators import snapshots
from paperlake.sources.tables import cited_papers, collection_events, table
from paperlake.storage import kept


def library_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.members(collection_events(spark, sf_dir))


def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.libraries(collection_events(spark, sf_dir), "owner")


def library_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.notes(collection_events(spark, sf_dir))


def library_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = cited_papers(spark, sf_dir).select("id", "title")
    return C.library_papers(collection_events(spark, sf_dir), papers).select("library_id", "doc_id", "title")


def library_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a library of its customer's number, with the parts that it has: those not yet in the log are made."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("library_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id")
    )
    first = orders.groupBy("library_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))
    lines = table(spark, sf_dir, "lineitem").join(first.select(F.col("event_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    parts = lines.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_list("l_partkey").alias("papers"))
    asked = first.join(parts, "event_id", "left").withColumn("papers", F.coalesce("papers", F.array().cast("array<bigint>")))
    log = collection_events(spark, sf_dir)
    made = C.created(log, asked)
    return C.libraries(log.select(*made.columns).unionByName(made)).select("library_id", "num_documents", "permission", "date_created")


def library_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's own adds and removes, asked for once more."""
    log = collection_events(spark, sf_dir)
    return C.edit_counts(log, log.select("library_id", "doc_id", "action"))


def library_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a union with, and a removal of, another library's members would leave of each first library."""
    m = C.members(collection_events(spark, sf_dir)).withColumn("pair", F.floor(F.col("library_id") / 2))
    left, right = (m.where(F.col("library_id") % 2 == k).select("pair", "doc_id") for k in (0, 1))
    joined = left.union(right).distinct().groupBy("pair").agg(F.count("*").alias("n_union"))
    kept = left.join(right, ["pair", "doc_id"], "left_anti").groupBy("pair").agg(F.count("*").alias("n_kept"))
    return joined.join(kept, "pair", "left").select("pair", "n_union", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


#: Times of the two snapshots, and one after them.
SNAPSHOTS, AS_OF = ("2024-01-05 00:00:00", "2024-01-12 00:00:00"), "2024-01-20 12:00:00"


def keep_log(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The log in three batches, the second of them with every tenth event of the first one's time, and two snapshots."""
    log = collection_events(spark, sf_dir)
    late, early = F.col("event_id") % 10 == 0, F.col("ts") <= F.lit(SNAPSHOTS[0]).cast("timestamp_ntz")
    middle = F.col("ts") <= F.lit(SNAPSHOTS[1]).cast("timestamp_ntz")
    for batch, until in ((early & ~late, SNAPSHOTS[0]), (middle & (~early | late), SNAPSHOTS[1]), (~middle, None)):
        snapshots.append(log.where(batch), root)
        if until:
            snapshots.compact(spark, root, until)


def log_store(spark: SparkSession, sf_dir: str) -> str:
    return kept(spark, "library_log", [f"{sf_dir}/events.parquet"], lambda f: keep_log(spark, sf_dir, f))


def library_members_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members as they stood at a time, from the last snapshot before it and the events since."""
    return snapshots.members(spark, log_store(spark, sf_dir), AS_OF)


def library_notes_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.notes(spark, log_store(spark, sf_dir), AS_OF)


QUERIES = {
    "library_members_at": library_members_at,
    "library_notes_at": library_notes_at,
    "library_members": library_members,
    "library_list": library_list,
    "library_notes": library_notes,
    "library_papers": library_papers,
    "library_set_operations": library_set_operations,
    "library_create": library_create,
    "library_edit_counts": library_edit_counts,
}

EVENTS = """e AS (SELECT user_id AS library_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id, event_type, round(value, 6) AS content, ts, event_id, CASE WHEN user_id % 3 = 0 THEN 'owner' ELSE 'collaborator' END AS permission FROM events)"""
MEMBERS = f"""{EVENTS}, members AS (SELECT library_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY library_id, doc_id ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type IN ('click', 'error') AND doc_id IS NOT NULL) WHERE r = 1 AND event_type = 'click')"""
UNTIL = f"ts <= TIMESTAMP '{AS_OF}'"
SQL = {
    "library_members_at": f"""WITH {MEMBERS} SELECT * FROM members""".replace("AND doc_id IS NOT NULL)", f"AND doc_id IS NOT NULL AND {UNTIL})"),
    "library_notes_at": f"""WITH {EVENTS} SELECT library_id, doc_id, content, ts AS date_last_modified FROM (SELECT *, row_number() OVER (PARTITION BY library_id, doc_id ORDER BY ts DESC, event_id DESC) AS r FROM e
        WHERE ((event_type = 'purchase' AND content IS NOT NULL) OR event_type = 'signup') AND {UNTIL}) WHERE r = 1 AND event_type = 'purchase'""",
    "library_members": f"WITH {MEMBERS} SELECT * FROM members",
    "library_list": f"""WITH {MEMBERS}, n AS (SELECT library_id, count(*) AS n FROM members GROUP BY 1) SELECT library_id, min(ts) AS date_created, max(ts) AS date_last_modified, any_value(permission) AS permission, coalesce(any_value(n.n), 0) AS num_documents
        FROM e LEFT JOIN n USING (library_id) WHERE permission = 'owner' GROUP BY library_id""",
    "library_notes": f"""WITH {EVENTS} SELECT library_id, doc_id, content, ts AS date_last_modified FROM (SELECT *, row_number() OVER (PARTITION BY library_id, doc_id ORDER BY ts DESC, event_id DESC) AS r FROM e
        WHERE (event_type = 'purchase' AND content IS NOT NULL) OR event_type = 'signup') WHERE r = 1 AND event_type = 'purchase'""",
    "library_papers": f"WITH {MEMBERS} SELECT library_id, doc_id, p_name AS title FROM members LEFT JOIN part ON p_partkey = doc_id",
    "library_create": f"""WITH {MEMBERS}, n AS (SELECT library_id, count(*) AS n FROM members GROUP BY 1),
        old AS (SELECT library_id, coalesce(any_value(n.n), 0) AS num_documents, any_value(permission) AS permission, min(ts) AS date_created FROM e LEFT JOIN n USING (library_id) GROUP BY library_id),
        first AS (SELECT o_custkey AS library_id, o_orderkey, o_orderdate AS ts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1 AND o_custkey NOT IN (SELECT user_id FROM events))
        SELECT * FROM old UNION ALL SELECT library_id, count(DISTINCT l_partkey) AS num_documents, 'owner' AS permission, any_value(ts) AS date_created FROM first LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY library_id""",
    "library_edit_counts": f"""WITH {MEMBERS}, asked AS (SELECT DISTINCT library_id, doc_id, CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS action FROM e WHERE event_type IN ('click', 'error') AND doc_id IS NOT NULL),
        judged AS (SELECT a.*, m.doc_id IS NOT NULL AS held FROM asked a LEFT JOIN members m ON m.library_id = a.library_id AND m.doc_id = a.doc_id)
        SELECT library_id, action, CASE WHEN action = 'add' THEN count(*) FILTER (NOT held) END AS number_added, CASE WHEN action = 'remove' THEN count(*) FILTER (held) END AS number_removed, count(*) AS n_asked,
        CASE WHEN action = 'add' THEN count(*) FILTER (NOT held) ELSE count(*) FILTER (held) END AS n_changed FROM judged GROUP BY library_id, action""",
    "library_set_operations": f"""WITH {MEMBERS}, m AS (SELECT *, CAST(floor(library_id / 2) AS BIGINT) AS pair FROM members),
        kept AS (SELECT pair, count(*) AS n_kept FROM (SELECT pair, doc_id FROM m WHERE library_id % 2 = 0 EXCEPT SELECT pair, doc_id FROM m WHERE library_id % 2 = 1) GROUP BY 1)
        SELECT pair, count(DISTINCT doc_id) AS n_union, coalesce(any_value(n_kept), 0) AS n_kept FROM m LEFT JOIN kept USING (pair) GROUP BY pair""",
}
