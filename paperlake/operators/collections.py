"""Personal collections (libraries) and notes as an append-only event log.

State is what the latest event of a key says, found by one aggregate whose partial results
are single rows, so that a library with very many events costs no more than its log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_events(events: DataFrame, path: str) -> None:
    """Creates, adds, removes, sets and deletes are rows appended to the log."""
    events.write.mode("append").parquet(path)


EVENT = "library_id long, doc_id long, action string, content double, permission string, ts timestamp_ntz, event_id long"


def created(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(library_id, ts, event_id, papers array) to the events that create each library with its first papers.

    A library that the log already has is not created again; papers are taken once each, nulls left out.
    """
    new = asked.join(events.select("library_id").distinct(), "library_id", "left_anti")
    papers = F.array_compact(F.array_distinct("papers"))
    event = lambda action, paper: F.struct(F.lit(action).alias("action"), paper.cast("long").alias("doc_id"))
    both = F.concat(F.array(event("create", F.lit(None))), F.transform(papers, lambda p: event("add", p)))
    rows = new.select("library_id", F.explode(both).alias("e"), "ts", "event_id")
    return rows.select(
        "library_id",
        "e.doc_id",
        "e.action",
        F.lit(None).cast("double").alias("content"),
        F.lit("owner").alias("permission"),
        "ts",
        "event_id",
    )


def edit_counts(events: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(library_id, doc_id, action add|remove) against the members that stand: library_id, action, number_added, number_removed, n_asked, n_changed.

    Adding a member and removing a stranger change nothing; a paper named twice counts once.
    """
    asked = edits.where("action IN ('add', 'remove') AND doc_id IS NOT NULL").select("library_id", "doc_id", "action").distinct()
    held = members(events).withColumn("held", F.lit(True))
    judged = asked.join(held, ["library_id", "doc_id"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    added = F.count_if((F.col("action") == "add") & ~F.col("held"))
    removed = F.count_if((F.col("action") == "remove") & F.col("held"))
    counts = judged.groupBy("library_id", "action").agg(
        F.when(F.col("action") == "add", added).alias("number_added"),
        F.when(F.col("action") == "remove", removed).alias("number_removed"),
        F.count("*").alias("n_asked"),
    )
    return counts.withColumn("n_changed", change_count(F.col("number_added"), F.col("number_removed"), F.col("n_asked")))


def latest(events: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The values of the last event (ts, then event_id) of each key."""
    last = F.max_by(F.struct(*values), F.struct("ts", "event_id")).alias("last")
    return events.groupBy(*keys).agg(last).select(*keys, *(f"last.{v}" for v in values))


def members(events: DataFrame) -> DataFrame:
    """events(library_id, doc_id, action add|remove, ts, event_id) to library_id, doc_id."""
    changes = events.where("action IN ('add', 'remove') AND doc_id IS NOT NULL")
    return latest(changes, ["library_id", "doc_id"], "action").where("action = 'add'").select("library_id", "doc_id")


def libraries(events: DataFrame, access: str = "all") -> DataFrame:
    """library_id, num_documents, date_created, date_last_modified, permission; filtered by access type."""
    sizes = members(events).groupBy("library_id").agg(F.count("*").alias("num_documents"))
    dates = events.groupBy("library_id").agg(
        F.min("ts").alias("date_created"),
        F.max("ts").alias("date_last_modified"),
        F.max_by("permission", F.struct("ts", "event_id")).alias("permission"),
    )
    found = dates.join(sizes, "library_id", "left").withColumn("num_documents", F.coalesce("num_documents", F.lit(0)).cast("long"))
    return found if access == "all" else found.where(F.col("permission") == access)


def notes(events: DataFrame) -> DataFrame:
    """events(library_id, doc_id, action set|delete, content, ts, event_id) to the notes that stand."""
    changes = events.where("(action = 'set' AND content IS NOT NULL) OR action = 'delete'")
    return latest(changes, ["library_id", "doc_id"], "action", "content", "ts").where("action = 'set'").select(
        "library_id", "doc_id", "content", F.col("ts").alias("date_last_modified")
    )


def library_papers(events: DataFrame, papers: DataFrame) -> DataFrame:
    """Members with their records; unknown papers keep their id."""
    return members(events).join(papers.withColumnRenamed("id", "doc_id"), "doc_id", "left")


def change_count(added, removed, asked):
    """Number reported for an edit: added, else removed, else as many as were asked for."""
    return F.coalesce(added, removed, asked)
