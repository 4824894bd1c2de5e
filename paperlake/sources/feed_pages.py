"""A folder of feed pages as a Spark data source that leaves out pages by date and category.

``write_pages`` puts papers' entries, in order of their date, into pages of bounded size (one file each) and
lists the pages with their dates and categories. ``FeedPages`` reads them: filters on published and categories are
taken by the reader, which skips pages that cannot hold such an entry; Spark filters the entries themselves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from paperlake.operators.paging import numbered
from paperlake.sources.archive import sink_of, store_of, stream_of
from paperlake.sources.atom import CATEGORY, ENTRY, PUBLISHED, parse_feeds

SCHEMA = "published string, category string, xml string"


def write_pages(entries: DataFrame, folder: str, size: int = 100) -> None:
    """entries(xml): an ``<entry>`` element each, to pages of ``size`` entries by date, and the list of pages.

    An entry without a date comes first; the first category of an entry is its primary one.
    """
    dated = entries.select("xml", F.regexp_extract("xml", PUBLISHED, 1).alias("published"), F.regexp_extract("xml", CATEGORY, 1).alias("category"))
    #: Entries of one date go by their texts' hashes: what a sort samples and compares stays small.
    placed = numbered(dated.withColumn("mark", F.xxhash64("xml")), [], ["published", "mark"]).withColumn("page", F.expr(f"(place - 1) div {int(size)}"))
    #: A page has at most ``size`` entries.
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "xml"))), lambda e: e["xml"]), "\n")
    pages = placed.groupBy("page").agg(
        F.concat(F.lit("<feed>\n"), whole, F.lit("\n</feed>\n")).alias("xml"), F.min("published").alias("first"), F.max("published").alias("last"),
        F.sort_array(F.collect_set("category")).alias("categories"), F.count("*").alias("entries"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files, whose names follow from the pages, so none is sought afterwards; a task that runs again writes the same ones."""
        for batch in batches:
            files = [f"pages/page-{page:09d}.txt" for page in batch.column("page").to_pylist()]
            for file, xml in zip(files, batch.column("xml")):
                with sink_of(f"{folder}/{file}") as out:
                    out.write(xml.as_buffer())
            kept = [batch.column(c) for c in ("page", "first", "last", "categories", "entries")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(files, pa.string())], ["page", "first", "last", "categories", "entries", "file"])

    listed = pages.mapInArrow(write, "page long, first string, last string, categories array<string>, entries long, file string")
    listed.repartition(1).write.json(f"{folder}/list")


@dataclass
class Pages(InputPartition):
    """The files that one task reads."""

    files: tuple[str, ...]

    def __init__(self, files):
        self.files = tuple(files)
        super().__init__(len(self.files))


class FeedPagesReader(DataSourceReader):
    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task, self.filters = folder, per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on one column that tell whether a page may hold such an entry; all are applied to the entries afterwards."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute in (("published",), ("category",)):
                self.filters.append(f)
            yield f

    def may_hold(self, page: dict) -> bool:
        first, last = page["first"], page["last"]
        for f in self.filters:
            values = f.value if isinstance(f, In) else (f.value,)
            if f.attribute == ("category",):
                if isinstance(f, (EqualTo, In)) and not set(values) & set(page["categories"]):
                    return False
            elif isinstance(f, GreaterThan) and not last > f.value or isinstance(f, GreaterThanOrEqual) and not last >= f.value:
                return False
            elif isinstance(f, LessThan) and not first < f.value or isinstance(f, LessThanOrEqual) and not first <= f.value:
                return False
            elif isinstance(f, (EqualTo, In)) and not any(first <= v <= last for v in values if v is not None):
                return False
        return True

    def pages(self) -> list[dict]:
        """The list of pages: a row a page, whatever the size of the pages."""
        from pyarrow import fs

        store, inner = store_of(self.folder)
        found = [f.path for f in store.get_file_info(fs.FileSelector(f"{inner}/list")) if f.base_name.startswith("part-") and f.size]
        return [json.loads(line) for path in found for line in store.open_input_stream(path).read().decode("utf-8").splitlines()]

    def partitions(self) -> list[Pages]:
        files = [f"{self.folder}/{p['file']}" for p in sorted(self.pages(), key=lambda p: p["page"]) if self.may_hold(p)]
        return [Pages(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Pages(())]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            with stream_of(file) as stream:
                entries = re.findall(ENTRY, stream.read().decode("utf-8"))
            first = lambda pattern, e: (re.search(pattern, e) or [None, ""])[1]
            line = PUBLISHED.replace(r"\x{2028}", r"\u2028").replace(r"\x{2029}", r"\u2029")
            columns = [first(line, e) for e in entries], [first(CATEGORY, e) for e in entries], [f"<entry>{e}</entry>" for e in entries]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["published", "category", "xml"])


class FeedPages(DataSource):
    """Entries of feed pages: ``spark.read.format("feed_pages").load(folder)``; option ``per_task`` pages a task."""

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedPagesReader:
        return FeedPagesReader(self.options["path"], int(self.options.get("per_task", 16)))


def read_pages(spark: SparkSession, folder: str, where: Column | None = None, per_task: int = 16) -> DataFrame:
    """Papers of a folder of feed pages, those that meet ``where`` on published (text) and category (the primary one)."""
    spark.dataSource.register(FeedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    entries = spark.read.format("feed_pages").option("per_task", per_task).load(folder)
    return parse_feeds(entries if where is None else entries.where(where))


