"""Source archives: gzip and tar bytes to entries, and the choice of the main LaTeX file.

Archives are read as streams, entry by entry: a task holds a block of the archive and one
entry of bounded size, however large the archive is and whatever it inflates to.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.text import latex_text

BLOCK = 512
#: Bytes read and inflated at once.
CHUNK = 1 << 20
#: Contents over so many bytes are not read; such entries have their size and null data.
LARGEST = 1 << 28
#: Bytes that one archive may inflate to; it ends there as one cut short does.
MOST_INFLATED = 1 << 37
#: File names that most likely hold the paper, best first.
PREFERRED = ("main.tex", "paper.tex", "manuscript.tex", "article.tex", "ms.tex")
ENTRY = "ordinal int, name string, size long, data binary"


def inflated(stream: io.BufferedIOBase, most: int = MOST_INFLATED) -> Iterator[bytes]:
    """The bytes of a gzip of one or more members, in chunks of bounded size; raises zlib.error or EOFError if it is none."""
    left, data, members = most, stream.read(CHUNK), 0
    while data and (members == 0 or data[:1] != b"\0"):
        inner = zlib.decompressobj(31)
        while not inner.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise EOFError("a gzip member has no end")
            out = inner.decompress(data, CHUNK)
            data = inner.unconsumed_tail
            if out:
                yield out[:left]
                left -= len(out)
                if left <= 0:
                    return
        data = inner.unused_data or stream.read(CHUNK)
        members += 1


class Chunks(io.RawIOBase):
    """A readable stream of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.held:
            try:
                self.held = memoryview(next(self.chunks))
            except StopIteration:
                return 0
        n = min(len(target), len(self.held))
        target[:n], self.held = self.held[:n], self.held[n:]
        return n


def is_gzip(opened: Callable[[], io.BufferedIOBase], most: int) -> bool:
    """Whether all of it inflates; its chunks are dropped as they come."""
    try:
        with opened() as stream:
            if stream.read(2) != b"\x1f\x8b":
                return False
        with opened() as stream:
            for _ in inflated(stream, most):
                pass
    except (zlib.error, EOFError):
        return False
    return True


def skipped(stream: io.BufferedIOBase, n: int) -> bool:
    """Whether ``n`` more bytes were there to be passed over."""
    while n:
        got = len(stream.read(min(n, CHUNK)))
        if not got:
            return False
        n -= got
    return True


def octal(field: str) -> int:
    """The octal number that a field begins with, or 0."""
    found = re.match(r"[0-7]+", field)
    return int(found[0], 8) if found else 0


def tar_files(stream: io.BufferedIOBase, wanted: str = "", largest: int = LARGEST) -> Iterator[tuple[str, int, bytes | None]]:
    """Name, size and content of regular files; ends at a zero block or an entry cut short.

    Contents over ``largest`` bytes, or of names without the ending ``wanted`` (in either case), are passed
    over as None. Checksums are not verified and extension headers not interpreted.
    """

    def text(field: bytes) -> str:
        return field.split(b"\0", 1)[0].decode("utf-8", "replace").strip()

    while len(head := stream.read(BLOCK)) == BLOCK and head.strip(b"\0"):
        size, prefix, content = octal(text(head[124:136])), text(head[345:500]), None
        name = (f"{prefix}/" if prefix else "") + text(head[:100])
        regular = head[156:157] in (b"\0", b"0")
        if regular and size <= largest and name.lower().endswith(wanted):
            content = stream.read(size)
            if len(content) < size:
                return
        elif not skipped(stream, size):
            return
        if regular:
            yield name, size, content
        skipped(stream, -size % BLOCK)


def archive_files(opened: Callable[[], io.BufferedIOBase], wanted: str = "", largest: int = LARGEST, most: int = MOST_INFLATED) -> Iterator[tuple[str, int, bytes | None]]:
    """Files of a tar, gzipped or not. ``opened`` gives its stream anew; a broken gzip counts as plain bytes."""
    zipped = is_gzip(opened, most)
    with opened() as stream:
        yield from tar_files(io.BufferedReader(Chunks(inflated(stream, most)), CHUNK) if zipped else stream, wanted, largest)


def store_of(path: str) -> tuple:
    """The store of a URI or local path, any that Arrow knows, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)


def stream_of(path: str) -> io.BufferedIOBase:
    """A file to read."""
    store, inner = store_of(path)
    return io.BufferedReader(store.open_input_stream(inner, compression=None), CHUNK)


def sink_of(path: str):
    """A file to write, in a folder that is made where it is not there yet."""
    store, inner = store_of(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def _unpacked(archives: DataFrame, opener: Callable, wanted: str, limits: tuple[int, int]) -> DataFrame:
    """archives(id, what is opened) to one row a file; rows leave as soon as ``CHUNK`` bytes of them have been read."""
    of = archives.schema["id"]
    names = ["id", "ordinal", "name", "size", "data"]

    def table_of(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        k, *columns = zip(*rows)
        types = (pa.int32(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), *map(pa.array, columns, types)], names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k in range(len(batch)):
                if not batch.column(1)[k].is_valid:
                    continue
                for i, (name, size, data) in enumerate(archive_files(lambda k=k: opener(batch.column(1)[k]), wanted, *limits)):
                    rows.append((k, i, name, size, data))
                    held += len(data or b"") + len(name) + 64
                    if held >= CHUNK:
                        yield table_of(batch, rows)
                        rows, held = [], 0
            if rows:
                yield table_of(batch, rows)

    return archives.mapInArrow(unpack, f"id {of.dataType.simpleString()}, {ENTRY}")


def entries(archives: DataFrame, wanted: str = "", largest: int = LARGEST, most: int = MOST_INFLATED) -> DataFrame:
    """archives(id, data) to one row per file: id, ordinal, name, size, data (only of names that end in ``wanted``)."""
    return _unpacked(archives.select("id", "data"), lambda v: io.BufferedReader(io.BytesIO(v.as_buffer())), wanted, (largest, most))


def read_archives(spark: SparkSession, path: str, wanted: str = "", largest: int = LARGEST, most: int = MOST_INFLATED) -> DataFrame:
    """The files of all archives of a folder, as ``entries`` has them; the id is the archive's path.

    Only paths are listed by the scan; tasks open them as streams, so an archive may be larger than a row or a worker can hold.
    """
    #: One path a task: archives are large.
    paths = spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), F.col("path"))
    return _unpacked(paths, lambda v: stream_of(v.as_py()), wanted, (largest, most))


def tex_score() -> Column:
    """Preference of the name, 20 at the root, up to 30 for size (one point per 1,000 bytes)."""
    base = F.lower(F.element_at(F.split("name", "/"), -1))
    place = F.array_position(F.array(*map(F.lit, PREFERRED)), base)
    return F.when(place > 0, 110 - 10 * place).otherwise(0) + F.when(F.contains("name", F.lit("/")), 0).otherwise(20) + F.least(F.col("size") / 1000, F.lit(30.0))


def main_tex(files: DataFrame) -> DataFrame:
    """id, source_name and text of each archive's best LaTeX file; ties go to the earlier one."""
    tex = files.where(F.lower("name").endswith(".tex"))
    best = tex.groupBy("id").agg(F.max_by(F.struct("name", "data"), F.struct(tex_score(), -F.col("ordinal"))).alias("best"))
    return best.select("id", F.col("best.name").alias("source_name"), latex_text(F.decode("best.data", "UTF-8")).alias("text"))
