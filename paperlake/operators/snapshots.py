"""A collection's event log with snapshots: its state at any time from one snapshot and the events since.

The log is appended to in batches (``log/batch=N/day=D``). A snapshot holds the last event of every key up to a time,
in buckets of libraries; a new one writes only the buckets that events have touched since the one before, each
under the snapshot's own version, and a manifest says which version of a bucket is the latest. Nothing is overwritten
but a half-written version of the same number, so a run that is repeated leaves the same state.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.collections import EVENT
from paperlake.storage import _path, exists

#: Buckets of a new log; a log keeps the number that its first snapshot had.
BUCKETS = 64
KEYS = ["library_id", "doc_id"]
KINDS = {"members": ("add", "remove"), "notes": ("set", "delete")}
STATE = "kind string, library_id long, doc_id long, action string, content double, ts timestamp_ntz, event_id long"


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers in the names of sub-folders ``prefix``N."""
    found, store = _path(spark, path)
    if not store.exists(found):
        return []
    names = [s.getPath().getName() for s in store.listStatus(found)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def append(events: DataFrame, root: str) -> int:
    """Add a batch of events (the columns of ``EVENT``); its number is returned."""
    n = (_children(events.sparkSession, f"{root}/log", "batch=") or [-1])[-1] + 1
    day = F.to_date("ts")
    events.selectExpr(*(c.split()[0] for c in EVENT.split(", "))).withColumn("day", day).write.partitionBy("day").parquet(f"{root}/log/batch={n}")
    return n


def bucket(of: int) -> Column:
    return F.pmod(F.xxhash64("library_id"), F.lit(of)).cast("int")


def last_events(rows: DataFrame) -> DataFrame:
    """The last event of each kind and key; partial results are single rows, and the last of lasts is the last."""
    last = F.max_by(F.struct("action", "content", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    return rows.groupBy("kind", *KEYS).agg(last).select("kind", *KEYS, "last.*")


def _changes(log: DataFrame) -> DataFrame:
    """Events that say something about a member or a note."""
    add = F.col("action").isin(*KINDS["members"]) & F.col("doc_id").isNotNull()
    note = ((F.col("action") == "set") & F.col("content").isNotNull()) | (F.col("action") == "delete")
    kind = F.when(add, "members").when(note, "notes")
    return log.withColumn("kind", kind).where("kind IS NOT NULL").select(*(c.split()[0] for c in STATE.split(", ")))


def _log(spark: SparkSession, root: str) -> DataFrame:
    if not _children(spark, f"{root}/log", "batch="):
        return spark.createDataFrame([], f"{EVENT}, batch int, day date")
    return spark.read.schema(f"{EVENT}, batch int, day date").option("basePath", f"{root}/log").parquet(f"{root}/log")


def manifest(spark: SparkSession, root: str, until: str | None = None) -> dict | None:
    """The latest snapshot (up to the time ``until``): version, until, of (buckets in all), batch (the last one it knows), buckets (bucket -> version)."""
    for v in reversed(_children(spark, f"{root}/manifest", "version=")):
        if exists(spark, f"{root}/manifest/version={v}/_SUCCESS"):
            found = json.loads(spark.read.text(f"{root}/manifest/version={v}").first().value)
            if until is None or found["until"] <= until:
                return found
    return None


def _since(spark: SparkSession, root: str, base: dict | None, until: str) -> DataFrame:
    """Changes up to ``until`` that the snapshot does not know: later ones, and those that came in afterwards.

    Days and batches are folders, so what the snapshot covers is not read.
    """
    log, end = _log(spark, root), F.lit(until).cast("timestamp_ntz")
    rows = log.where((F.col("ts") <= end) & (F.col("day") <= F.to_date(end)))
    if base:
        start = F.lit(base["until"]).cast("timestamp_ntz")
        later = (F.col("day") >= F.to_date(start)) & (F.col("ts") > start)
        rows = rows.where((F.col("batch") > base["batch"]) | later)
    return _changes(rows)


def _kept(spark: SparkSession, root: str, base: dict | None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a snapshot, of these buckets only where they are given."""
    paths = [f"{root}/state/bucket={b}/version={v}" for b, v in (base or {"buckets": {}})["buckets"].items() if buckets is None or int(b) in buckets]
    if not paths:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*paths)


def compact(spark: SparkSession, root: str, until: str) -> dict:
    """Write the snapshot of the state at ``until`` (a time as text, ``YYYY-MM-DD HH:MM:SS``), which must not be before the last one's.

    Buckets without new events keep their files; of the others the old state and the new events are read.
    """
    base = manifest(spark, root)
    if base and until < base["until"]:
        raise ValueError("a snapshot lies after the last one")
    version, of = (base["version"] + 1, base["of"]) if base else (0, BUCKETS)
    batch = (_children(spark, f"{root}/log", "batch=") or [-1])[-1]
    delta = _since(spark, root, base, until)
    touched = sorted(r.b for r in delta.select(bucket(of).alias("b")).distinct().collect())  # as many numbers as buckets at most
    merged = last_events(_kept(spark, root, base, touched).unionByName(delta))
    if touched:
        out = merged.withColumns({"bucket": bucket(of), "version": F.lit(version)})
        #: Files of a bucket lie together, and a large bucket is cut by its size, not left to one task.
        out.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{root}/state")
    found = {"version": version, "until": until, "of": of, "batch": batch, "buckets": (base or {"buckets": {}})["buckets"] | {str(b): version for b in touched}}
    text = spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{root}/manifest/version={version}")
    return found


def state(spark: SparkSession, root: str, at: str) -> DataFrame:
    """The last event of every key at a time, from the nearest snapshot before it and the events since."""
    base = manifest(spark, root, at)
    return last_events(_kept(spark, root, base).unionByName(_since(spark, root, base, at)))


def members(spark: SparkSession, root: str, at: str) -> DataFrame:
    return state(spark, root, at).where("kind = 'members' AND action = 'add'").select(*KEYS)


def notes(spark: SparkSession, root: str, at: str) -> DataFrame:
    found = state(spark, root, at).where("kind = 'notes' AND action = 'set'")
    return found.select(*KEYS, "content", F.col("ts").alias("date_last_modified"))
