"""Tables that outlive a query: where they go, and how they are made once."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


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


def _path(spark: SparkSession, path: str):
    """A path and the store that it lies in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, store = _path(spark, path)
    return store.exists(found)


def remove_folder(spark: SparkSession, path: str) -> None:
    found, store = _path(spark, path)
    store.delete(found, True)


def stamp(spark: SparkSession, path: str) -> str:
    """What changes when the files under a path do: time, bytes, number of files."""
    found, store = _path(spark, path)
    held = store.getContentSummary(found)
    return f"{path}|{store.getFileStatus(found).getModificationTime()}|{held.getLength()}|{held.getFileCount()}"


def kept(spark: SparkSession, name: str, inputs: list[str], make: Callable[[str], None]) -> str:
    """The folder of ``name`` made of these input paths; ``make(folder)`` writes it only where it is not there yet.

    It is written beside its place and then renamed, so a run that breaks off leaves no half of it.
    """
    key = hashlib.md5("\n".join(stamp(spark, p) for p in inputs).encode()).hexdigest()
    folder = f"{shared_folder(spark)}/kept_{name}_{key}"
    if not exists(spark, f"{folder}/_done"):
        made = f"{folder}_{uuid.uuid4().hex}"
        make(made)
        done, store = _path(spark, f"{made}/_done")
        store.create(done).close()
        if not store.rename(_path(spark, made)[0], _path(spark, folder)[0]) or exists(spark, f"{folder}/{made.rsplit('/', 1)[1]}"):
            remove_folder(spark, made)  # another run was first
            remove_folder(spark, f"{folder}/{made.rsplit('/', 1)[1]}")
    return folder
