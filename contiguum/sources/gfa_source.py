"""GFA text as a Spark data source: ``spark.read.format("gfa")`` after ``register(spark)``.

A file is split by byte ranges, and a line belongs to the range in which it starts.  Rows are (file, at, record, value): where the line starts, its
first field, and the line without blanks around it; empty lines and comments are no rows.  Conditions on ``record`` are pushed down: other lines
are skipped as bytes, before they are decoded or cross into the JVM.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from ..operators.graph import AssemblyGraph
from ..operators.lineage import cut, numbered
from ..shipping import ship
from .gfa import graph_from_lines, parsed

CHUNK = 4 << 20
SCHEMA = "file string, at long, record string, value string"


def opened(path: str):
    """(file system, name) of a path or URI."""
    if path.startswith("file:") or "://" not in path:
        return pa.fs.LocalFileSystem(), path.removeprefix("file:").removeprefix("//")
    return pa.fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines_between(f, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in a range of a random-access file."""
    pos = base = max(start - 1, 0)
    skip, held = start > 0, b""  # a line that starts before the range is another range's
    while base < end or skip:
        more = f.read_at(chunk, pos)
        pos += len(more)
        if not more:
            if held and not skip and base < end:
                yield base, held
            return
        held += more
        if skip:
            i = held.find(b"\n")
            if i < 0:
                base, held = base + len(held), b""
                continue
            base, held, skip = base + i + 1, held[i + 1 :], False
        *full, held = held.split(b"\n")
        for line in full:
            if base >= end:
                return
            yield base, line
            base += len(line) + 1


class GfaReader(DataSourceReader):
    def __init__(self, path: str, split: int, suffix: str = ".gfa"):
        self.path, self.split, self.suffix = path, split, suffix
        self.records: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("record",):
                continue  # it never is
            values = {f.value} if isinstance(f, (EqualTo, EqualNullSafe)) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("record",):
                yield f
            else:
                self.records = values if self.records is None else self.records & values

    def partitions(self) -> list[InputPartition]:
        fs, name = opened(self.path)
        info = fs.get_file_info(name)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pa.fs.FileType.Directory:
            found = [x for x in fs.get_file_info(pa.fs.FileSelector(name)) if x.is_file and x.path.endswith(self.suffix)]
            files = [(f"{self.path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.path)]
        else:
            files = [(self.path, info.size)]
        return [Range(p, a, min(a + self.split, size)) for p, size in files for a in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, name = opened(partition.path)
        wanted = None if self.records is None else {r.encode() for r in self.records if r is not None}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            at, record, value = map(list, cols)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(record, pa.string()), pa.array(value, pa.string())], names=["file", "at", "record", "value"])

        size = 0
        with fs.open_input_file(name) as f:
            for at, raw in lines_between(f, partition.start, partition.end):
                # a record that nobody asked for is left out by its first bytes; blanks ahead are rare and are looked at as text
                if wanted is not None and raw[:1].isalnum() and raw.split(b"\t", 1)[0].rstrip() not in wanted:
                    continue
                value = raw.decode("utf-8", "replace").strip()
                record = value.split("\t", 1)[0]
                if value and not value.startswith("#") and (self.records is None or record in self.records):
                    rows.append((at, record, value))
                    size += len(value)
                    if size > CHUNK:
                        yield batch()
                        rows.clear()
                        size = 0
        yield batch()


class GfaSource(DataSource):
    """Options: ``path`` (a file, or a folder), ``suffix`` (of the folder's files that count, ``.gfa``) and ``split`` (bytes of a range, 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "gfa"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GfaReader:
        return GfaReader(self.options["path"], int(self.options.get("split", 64 << 20)), self.options.get("suffix", ".gfa"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and turn its push-down on."""
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark plans sources in a process that may not know this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GfaSource)


def lines(spark: SparkSession, path: str, split: int = 64 << 20, suffix: str = ".gfa") -> DataFrame:
    register(spark)
    return spark.read.format("gfa").option("split", split).option("suffix", suffix).load(path)


def read_gfa(spark: SparkSession, path: str, mode: str = "FAILFAST", split: int = 64 << 20) -> AssemblyGraph:
    """The graph of a file, or of a folder's files one after another.  All records but S and L are skipped as bytes.

    Faults are told by the number of the line among S and L lines.
    """
    found = lines(spark, path, split).filter(F.col("record").isin("S", "L"))
    at = numbered(found, [F.col("file"), F.col("at")], "line_no")
    return graph_from_lines(at.select((F.col("line_no") + 1).alias("line_no"), "value"), mode)


def read_segments(spark: SparkSession, path: str, split: int = 64 << 20, suffix: str = ".gfa") -> DataFrame:
    """(ord, id, length_bp, coverage, tags) of well-formed S lines; links are not even decoded."""
    rows = numbered(lines(spark, path, split, suffix).filter("record = 'S'"), [F.col("file"), F.col("at")])
    return cut(parsed(rows.select("ord", "record", "value")).filter("fault IS NULL").select("ord", "id", "length_bp", "coverage", "tags"))

