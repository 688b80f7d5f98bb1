"""Files of pages as a registered source and sink: ``spark.read.format("page_files")``.

Reading gives ``(path, start, text)``: a page per row with the byte it starts at. Pages of
plain text are set apart by form feeds, and a large file is read in byte ranges, each by its
own task: a page belongs to the range it starts in. With an ``extractor`` a file is one range,
and ``start`` is the page's number. As a stream, files are taken in the order of their times.

Paths are those pyarrow's file systems open (local, hdfs, s3, gs). For stores that only Spark
can read there is :func:`sparrowline.sources.documents.scan_documents`.
"""

from __future__ import annotations

import base64
import fnmatch
import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "page_files"
RANGE_BYTES = 32 << 20
_READ_BYTES = 1 << 20
_OPEN_BYTES = 64 << 10
_BREAK = b"\f"
_PAGES = "path string, start bigint, text string"

Extractor = Callable[[bytes], Sequence[str | None]]


@dataclass
class Range:
    """Bytes of a file from ``low`` up to ``high``; ``size`` is the whole file's."""

    path: str
    low: int
    high: int
    size: int


@dataclass
class Share(InputPartition):
    """What one task reads: a range of a large file, or many small files."""

    ranges: list[Range]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str, glob: str = "*") -> list[tuple[int, str, int]]:
    """``(time, path, size)`` of the files at or below ``path``, hidden ones left out, in that order."""
    store, place = _open(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = [f for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File]
    shown = lambda name: not any(part.startswith(("_", ".")) for part in name[len(place) :].split("/"))
    kept = [f for f in found if fnmatch.fnmatch(f.base_name, glob) and (f is info or shown(f.path))]
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in kept)


def ranges_of(path: str, size: int, most: int) -> Iterator[Range]:
    """A file's byte ranges; an empty file has one, as it holds one empty page."""
    for low in range(0, max(size, 1), most):
        yield Range(path, low, min(low + most, size), size)


def shares_of(ranges: Iterator[Range], most: int) -> list[Share]:
    """Neighbouring ranges together up to ``most`` bytes, opening a file counting as some."""
    shares: list[Share] = []
    room = 0
    for part in ranges:
        cost = part.high - part.low + _OPEN_BYTES
        if not shares or cost > room:
            shares.append(Share([]))
            room = most + _OPEN_BYTES
        shares[-1].ranges.append(part)
        room -= cost
    return shares


def read_range(store: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """``(start, bytes)`` of the pages that start in a range: at 0, or after a form feed."""
    with store.open_input_file(part.path) as file:
        # A page starts behind a break, so the byte before the range is looked at too.
        at = max(part.low - 1, 0)
        file.seek(at)
        start, held = (0, []) if part.low == 0 else (None, [])
        while data := file.read(_READ_BYTES):
            pieces = data.split(_BREAK)
            for i, piece in enumerate(pieces):
                if start is not None:
                    held.append(piece)
                at += len(piece)
                if i + 1 < len(pieces):
                    if start is not None:
                        yield start, b"".join(held)
                    at += 1
                    start, held = at, []
                    if start >= part.high and not (start == part.size == part.high):
                        return
        if start is not None:
            yield start, b"".join(held)


class _Reading:
    """What a batch and a stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.most = int(options.get("rangebytes", RANGE_BYTES))
        self.extractor = options.get("extractor")

    def _shares(self, files: list[tuple[int, str, int]]) -> list[Share]:
        whole = self.extractor is not None
        ranges = (r for _, path, size in files for r in ranges_of(path, size, max(size, 1) if whole else self.most))
        # A folder without files has no ranges, but a scan wants a share.
        return shares_of(ranges, self.most) or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple[str, int, str | None]]:
        store, _ = _open(self.path)
        extract = self.extractor and cloudpickle.loads(base64.b64decode(self.extractor))
        for part in partition.ranges:
            if extract is None:
                for start, page in read_range(store, part):
                    yield part.path, start, page.decode("utf-8", "replace")
            else:
                with store.open_input_file(part.path) as file:
                    pages = extract(file.read())
                for number, text in enumerate(pages):
                    yield part.path, number, text


class _BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Share]:
        return self._shares(list_files(self.path, self.glob))


class _StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the time and path of the last file taken; files are expected whole, under their last name."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path, self.glob)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        low, high = ((offset["time"], offset["path"]) for offset in (start, end))
        return self._shares([f for f in list_files(self.path, self.glob) if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    """A file per row ``(name, content)``, written aside and moved, so a retried task leaves whole files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        store, place = _open(self.path)
        store.create_dir(place, recursive=True)
        for row in iterator:
            target = posixpath.join(place, row["name"])
            draft = posixpath.join(place, f"_draft-{row['name']}")
            with store.open_output_stream(draft) as out:
                out.write(bytes(row["content"]))
            store.move(draft, target)
        return WriterCommitMessage()


class PageFiles(DataSource):
    """Options: ``path``; ``glob`` of file names; ``rangeBytes``; ``extractor`` (see :func:`read_pages`)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _PAGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def _options(glob: str, range_bytes: int, extractor: Extractor | None) -> dict[str, str]:
    found = {"glob": glob, "rangeBytes": str(range_bytes)}
    return found if extractor is None else found | {"extractor": base64.b64encode(cloudpickle.dumps(extractor)).decode()}


def read_pages(
    spark: SparkSession, path: str, glob: str = "*", extractor: Extractor | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``(path, page, text)`` of all files at ``path``, pages numbered from 0.

    Without an ``extractor`` files are UTF-8 text with form feeds between pages, read in
    ranges of ``range_bytes``; a page's number is its place among the file's starts.
    """
    spark.dataSource.register(PageFiles)
    pages = spark.read.format(FORMAT).options(**_options(glob, range_bytes, extractor)).load(path)
    if extractor is not None:
        return pages.withColumnRenamed("start", "page")
    return number_pages(pages, range_bytes)


def number_pages(pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Page numbers from starts. Ranges are counted first, so a file of very many pages is
    numbered range by range, and only counts of ranges meet."""
    ranged = pages.withColumn("_range", F.floor(F.col("start") / range_bytes))
    counts = ranged.groupBy("path", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("path", "_range").orderBy("start")) - 1
    numbered = ranged.withColumn("_place", place).join(counts, ["path", "_range"])
    return numbered.select("path", (F.col("_before") + F.col("_place")).cast("bigint").alias("page"), "text")


def stream_pages(spark: SparkSession, path: str, glob: str = "*", extractor: Extractor | None = None) -> DataFrame:
    """``(path, start, text)`` of the pages of files as they come."""
    spark.dataSource.register(PageFiles)
    return spark.readStream.format(FORMAT).options(**_options(glob, RANGE_BYTES, extractor)).load(path)


def write_files(files: DataFrame, path: str) -> None:
    """Write a file for each row ``(name, content)`` below ``path``; rows without content have none."""
    files.sparkSession.dataSource.register(PageFiles)
    rows = files.filter(F.col("content").isNotNull()).select("name", "content")
    rows.write.format(FORMAT).mode("append").save(path)
