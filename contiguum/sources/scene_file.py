"""Scene files: the GSC1 binary format, JSON scenes, and synthetic ribbons.

GSC1: the magic, the length of the header as a little-endian 32-bit number, a compact JSON header, then the columns one after another.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut, numbered, shared_folder
from ..operators.scene import Scene
from ..shipping import ship

MAGIC = b"GSC1"
#: Columns in file order: name, type, numbers for each row, DataFrame columns (fixed values of the format).
LAYOUT = (
    ("contigPositions", "f32", 4, ("in_x", "in_y", "out_x", "out_y")),
    ("contigWidth", "f32", 1, ("width",)),
    ("linkPositions", "f32", 4, ("x0", "y0", "x1", "y1")),
    ("linkEndpoints", "u32", 4, ("contig_a", "side_a", "contig_b", "side_b")),
    ("contigColor", "u8", 4, ("r", "g", "b", "a")),
)
DTYPES = {"f32": "<f4", "u32": "<u4", "u8": "u1"}


def encode(source: str, ids: list[str], bbox: tuple, tables: dict[str, np.ndarray]) -> bytes:
    """Bytes of a scene from arrays of shape (rows, numbers)."""
    parts, columns, at = [], {}, 0
    for name, kind, size, _ in LAYOUT:
        data = np.ascontiguousarray(tables[name], DTYPES[kind]).tobytes()
        columns[name] = {"dtype": kind, "size": size, "offset": at, "length": len(data) // np.dtype(DTYPES[kind]).itemsize}
        parts.append(data)
        at += len(data)
    head = {"version": 1, "source": source, "contigCount": len(ids), "linkCount": len(tables["linkPositions"]), "columns": columns, "idTable": ids, "bbox": list(bbox)}
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *parts])


def decode(blob: bytes) -> dict:
    """Header fields and arrays of a scene file; files without link endpoints have an empty array."""
    if blob[:4] != MAGIC:
        raise ValueError(f"bad magic: {blob[:4]!r}")
    body = 8 + struct.unpack_from("<I", blob, 4)[0]
    head = json.loads(blob[8:body])
    out = {k: head[k] for k in ("source", "idTable", "bbox")}
    for name, _, size, _ in LAYOUT:
        c = head["columns"].get(name)
        out[name] = np.frombuffer(blob, DTYPES[c["dtype"]], c["length"], body + c["offset"]).reshape(-1, size).copy() if c else np.zeros((0, size), "<u4")
    return out


def header(source: str, contigs: int, links: int, bbox: tuple) -> tuple[bytes, bytes, dict[str, int]]:
    """The header's text ahead of the ids and behind them, and where each column starts behind the header."""
    columns, starts, at = {}, {}, 0
    for name, kind, size, _ in LAYOUT:
        n = size * (links if name.startswith("link") else contigs)
        columns[name], starts[name] = {"dtype": kind, "size": size, "offset": at, "length": n}, at
        at += n * np.dtype(DTYPES[kind]).itemsize
    text = json.dumps({"version": 1, "source": source, "contigCount": contigs, "linkCount": links, "columns": columns, "idTable": [], "bbox": list(bbox)}, separators=(",", ":")).encode()
    cut_at = text.rindex(IDS) + len(IDS)
    return text[:cut_at], text[cut_at:], starts


IDS = b'"idTable":['
#: Rows of a part, and bytes of a range of ids, that a task holds at once.
ROWS, RANGE = 1 << 16, 4 << 20


def _parts(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(section, row, rows, data): bytes of consecutive rows of each column, and of the ids if there are some."""
    with_ids = "id" in rows.columns
    layout = [c for c in LAYOUT if c[0] in names]

    def run(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            at = cols["row"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1, len(at)] if len(at) else np.zeros(1, int)
            out: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = {n: c.slice(a, b - a) for n, c in cols.items()}
                if with_ids:
                    out.append(("ids", int(at[a]), b - a, ",".join(map(json.dumps, part["id"].to_pylist())).encode()))
                for name, kind, _, own in layout:
                    data = np.stack([part[c].to_numpy(zero_copy_only=False) for c in own], 1)
                    out.append((name, int(at[a]), b - a, np.ascontiguousarray(data, DTYPES[kind]).tobytes()))
            kinds = pa.string(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["section", "row", "rows", "data"])

    return rows.mapInArrow(run, "section string, row long, rows long, data binary")


def write_gsc1(scene: Scene, path: str) -> dict[str, int]:
    """Write a scene file; returns its size in bytes and its numbers of contigs and links.

    First pass: rows are numbered by a range sort and become byte parts, written as a table.  The parts' sizes give where each belongs.  Second pass:
    with a path in a folder that driver and executors share (``file:``), each task writes its parts at their places, which a repeated task does again with the
    same bytes; the file gets its name at the end.  Other stores only append, so there the parts follow one another through the driver, one at a time.
    """
    spark = scene.contigs.sparkSession
    ship(spark)
    contigs = numbered(scene.contigs, [F.col("ord")], "row")
    links = numbered(scene.links, [F.col("ord")], "row")
    parts = cut(_parts(contigs, ("contigPositions", "contigWidth", "contigColor")).union(_parts(links, ("linkPositions", "linkEndpoints"))))
    # counts of rows and bytes: one row for each section
    total = {r["section"]: r for r in parts.groupBy("section").agg(F.sum("rows").alias("rows"), F.sum(F.octet_length("data")).alias("bytes"), F.count(F.lit(1)).alias("parts")).collect()}
    n, m = (total[c]["rows"] if c in total else 0 for c in ("ids", "linkPositions"))
    before, after, starts = header(scene.source, n, m, tuple(scene.bbox.first()))
    ids = total["ids"]["bytes"] + total["ids"]["parts"] - 1 if n else 0
    body = 8 + len(before) + ids + len(after)
    size = body + sum(np.dtype(DTYPES[kind]).itemsize * width * (m if name.startswith("link") else n) for name, kind, width, _ in LAYOUT)
    # a comma after each part of ids but the last; the window sees sizes of parts only
    text = parts.filter("section = 'ids'").select("row", F.octet_length("data").alias("size"))
    ahead = F.coalesce(F.sum(F.col("size") + 1).over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = text.select("row", (ahead + 8 + len(before)).alias("at"))
    last = F.col("row") + F.col("rows") == n
    placed = parts.filter("section = 'ids'").join(text, "row").select("at", F.when(last, F.col("data")).otherwise(F.concat("data", F.lit(b","))).alias("data"))
    for name, kind, width, _ in LAYOUT:
        at = F.col("row") * (width * np.dtype(DTYPES[kind]).itemsize) + body + starts[name]
        placed = placed.union(parts.filter(F.col("section") == name).select(at.alias("at"), "data"))
    head = MAGIC + struct.pack("<I", len(before) + ids + len(after)) + before
    if path.startswith("file:"):
        _write_in_place(placed, local_name(path), head, (8 + len(before) + ids, after), size)
    else:
        small = spark.createDataFrame([(0, head), (8 + len(before) + ids, after)], "at long, data binary")
        _append(placed.union(small), path)
    return {"bytes": size, "contigs": n, "links": m}


def scene_bytes(scene: Scene) -> bytes:
    """A scene as the bytes of one file, to be sent to a client: a file is written as ever, and read whole."""
    spark = scene.contigs.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.gsc"
    write_gsc1(scene, path)
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _write_in_place(parts: DataFrame, path: str, head: bytes, after: tuple[int, bytes], size: int) -> None:
    name = f"{path}.{uuid.uuid4().hex}"

    def run(batches):
        f = os.open(name, os.O_WRONLY)
        done = 0
        try:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    while data:
                        k = os.pwrite(f, data, at)
                        at, data, done = at + k, data[k:], done + k
        finally:
            os.close(f)
        yield pa.RecordBatch.from_pydict({"done": pa.array([done], pa.int64())})

    os.makedirs(os.path.dirname(name), exist_ok=True)
    with open(name, "wb") as f:
        f.truncate(size)
        f.write(head)
        f.seek(after[0])
        f.write(after[1])
    done = parts.mapInArrow(run, "done long").agg(F.sum("done")).first()[0] or 0
    if done != size - len(head) - len(after[1]):
        os.remove(name)
        raise OSError(f"{done} bytes of parts were written to {path}, not {size - len(head) - len(after[1])}")
    os.replace(name, path)


def _append(parts: DataFrame, path: str) -> None:
    spark = parts.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for r in parts.orderBy("at").toLocalIterator():
            out.write(bytearray(r["data"]))
    finally:
        out.close()


CONTIGS = "path string, ord long, id string, in_x float, in_y float, out_x float, out_y float, width float, r short, g short, b short, a short"
LINKS = "path string, ord long, x0 float, y0 float, x1 float, y1 float, contig_a long, side_a long, contig_b long, side_b long"
HEADS = "path string, body long, ids_from long, ids_to long, contigs long, links long, columns string, source string, bbox array<double>"


def local_name(path: str) -> str:
    return path.removeprefix("file:").removeprefix("//")


class Ranges:
    """Bytes of a file by place."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            fs, name = pa.fs.LocalFileSystem(), local_name(path)
        else:
            fs, name = pa.fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
        self.file = fs.open_input_file(name)
        self.size = self.file.size()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, start: int, end: int) -> bytes:
        start, end = max(0, start), min(end, self.size)
        return self.file.read_at(end - start, start) if end > start else b""

    def growing(self, start: int, end: int, good, back: bool = False) -> bytes:
        """Bytes from start to end, lengthened (at the end, or ``back`` at the start) until ``good``, or to the file's bound."""
        more = 1 << 12
        while True:
            blob = self.read(start, end)
            if good(blob) or (start <= 0 if back else end >= self.size):
                return blob
            start, end, more = (start - more, end, more * 2) if back else (start, end + more, more * 2)


def quotes(blob: bytes, skip: int = 0) -> np.ndarray:
    """Places of quotes that no backslash takes away, from ``skip`` on; the bytes before tell whether the first are escaped."""
    b = np.frombuffer(blob, np.uint8)
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != 92, at, -1)) if len(b) else at  # the last byte so far that is no backslash
    found = np.flatnonzero(b == 34)
    found = found[found >= skip]
    slashes = np.where(found > 0, found - 1 - plain[found - 1], 0)
    return found[slashes % 2 == 0]


def _head(path: str) -> tuple:
    """A file's header but for its ids."""
    with Ranges(path) as f:
        start = f.growing(0, 1 << 12, lambda b: IDS in b)
        if start[:4] != MAGIC:
            raise ValueError(f"bad magic: {start[:4]!r}")
        body = 8 + struct.unpack_from("<I", start, 4)[0]
        at = start.index(IDS) + len(IDS)
        end = f.growing(body - (1 << 10), body, lambda b: b'],"bbox":[' in b, back=True)
        to = body - len(end) + end.rindex(b'],"bbox":[')
        head = json.loads(start[8:at] + end[end.rindex(b'],"bbox":[') :])
    return path, body, at, to, head["contigCount"], head["linkCount"], json.dumps(head["columns"]), head["source"], head["bbox"]


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``HEADS`` of each scene file: where its parts are, its counts, columns (JSON), source and extent.  Ids are not read."""
    ship(spark)
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.float64())]

    def run(batches):
        for batch in batches:
            rows = [_head(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in HEADS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, HEADS)


def _id_ranges(heads: DataFrame) -> DataFrame:
    """(path, body, contigs, columns, p, q, first): byte ranges of the ids, with the number of quotes ahead of each.

    An id has two quotes, so quotes ahead tell a range's first id and whether it starts inside one, whatever the ids' letters are.
    """

    def run(batches):
        for batch in batches:
            n = []
            for path, p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with Ranges(path) as f:
                    blob = f.growing(p - 64, q, lambda b, p=p, q=q: len(b[: p - q].rstrip(b"\\")) > 0, back=True)
                    n.append(len(quotes(blob, len(blob) - (q - p))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["path", "p", "q", "n"])

    ends = heads.filter("ids_to > ids_from").select("path", "ids_to", F.explode(F.sequence("ids_from", F.col("ids_to") - 1, F.lit(RANGE))).alias("p"))
    ranges = cut(ends.select("path", "p", F.least(F.col("p") + RANGE, "ids_to").alias("q")).repartition("path", "p").mapInArrow(run, "path string, p long, q long, n long"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.select("path", "p", "q", ahead.alias("first")).join(heads.select("path", "body", "columns"), "path")


def _columns(f: Ranges, body: int, columns: str, names: tuple[str, ...], first: int, n: int) -> dict[str, np.ndarray]:
    """Rows first .. first + n of columns; a column that the file has not is zeros."""
    out: dict[str, np.ndarray] = {}
    for name, _, size, own in LAYOUT:
        if name in names:
            c = json.loads(columns).get(name)
            if c:
                kind = np.dtype(DTYPES[c["dtype"]])
                at = body + c["offset"] + first * size * kind.itemsize
                data = np.frombuffer(f.read(at, at + n * size * kind.itemsize), kind).reshape(-1, size)
            else:
                data = np.zeros((n, size))
            out |= {c: data[:, k] for k, c in enumerate(own)}
    return out


def _batch(schema: T.StructType, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array(cols[f.name], _arrow(f.dataType)) for f in schema})


def _arrow(t: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "float": pa.float32(), "smallint": pa.int16()}[t.simpleString()]


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Ribbons of GSC1 files: a task reads a range of ids and the same rows' bytes of each column."""
    heads = cut(read_headers(spark, path))
    shape = T.StructType.fromDDL(CONTIGS)

    def run(batches):
        for batch in batches:
            for p, start, end, ahead, body, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Ranges(p) as f:
                    blob = f.growing(start - 64, end, lambda b, n=end - start: len(b[:-n].rstrip(b"\\")) > 0, back=True)
                    skip = len(blob) - (end - start)
                    at = quotes(blob, skip)
                    opening = at[ahead % 2 :: 2]
                    if not len(opening):
                        continue
                    if (ahead + len(at)) % 2:  # the last id ends behind the range
                        blob = f.growing(end - len(blob), end + 4096, lambda b, k=int(at[-1]): len(quotes(b, k + 1)) > 0)
                        last = int(quotes(blob, int(at[-1]) + 1)[0])
                    else:
                        last = int(at[-1])
                    ids = json.loads(b"[" + blob[int(opening[0]) : last + 1] + b"]")
                    first = (ahead + 1) // 2
                    for k in range(0, len(ids), ROWS):
                        n = min(ROWS, len(ids) - k)
                        cols = _columns(f, body, columns, ("contigPositions", "contigWidth", "contigColor"), first + k, n)
                        yield _batch(shape, cols | {"path": [p] * n, "ord": np.arange(first + k, first + k + n), "id": ids[k : k + n]})

    return _id_ranges(heads).select("path", "p", "q", "first", "body", "columns").mapInArrow(run, CONTIGS)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of GSC1 files, a range of rows at a time."""
    heads = read_headers(spark, path).filter("links > 0")
    shape, step = T.StructType.fromDDL(LINKS), ROWS

    def run(batches):
        for batch in batches:
            for p, body, columns, first, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = min(step, links - first)
                with Ranges(p) as f:
                    cols = _columns(f, body, columns, ("linkPositions", "linkEndpoints"), first, n)
                yield _batch(shape, cols | {"path": [p] * n, "ord": np.arange(first, first + n)})

    rows = heads.select("path", "body", "columns", F.explode(F.sequence(F.lit(0).cast("long"), F.col("links") - 1, F.lit(step))).alias("first"), "links")
    return rows.repartition("path", "first").mapInArrow(run, LINKS)


def synthetic_ribbons(spark: SparkSession, n: int = 200_000) -> DataFrame:
    """Ribbons on a square grid, turned and sized by the fractional part of a large sine."""
    i = F.col("id")
    cols = math.ceil(math.sqrt(n))
    noise = lambda k, m: F.sin(i * k) * m - F.floor(F.sin(i * k) * m)
    turn, size = noise(12.9898, 43758.5453) * (2 * math.pi), 6 + noise(78.233, 12345.678) * 12
    x, y = (i % cols) * 20.0, F.floor(i / cols) * 20.0
    rows = spark.range(n).select(i.alias("ord"), x.alias("in_x"), y.alias("in_y"), (x + F.cos(turn) * size).alias("out_x"), (y + F.sin(turn) * size).alias("out_y"), (1 + i % 8).alias("width"), *((60 + (i * k) % 195).alias(c) for c, k in (("r", 53), ("g", 97), ("b", 29))), F.lit(255).alias("a"))
    return rows.select("ord", *(F.col(c).cast("float").alias(c) for c in ("in_x", "in_y", "out_x", "out_y", "width")), *(F.col(c).cast("short").alias(c) for c in "rgba"))


def read_json_scene(spark: SparkSession, path: str) -> DataFrame:
    """Ribbons of a JSON scene with flat arrays contigPositions, contigWidth, contigColor."""
    at = lambda c, k, size: F.get(F.col(c), (F.col("ord") * size + k).cast("int"))
    raw = spark.read.schema("contigPositions array<double>, contigWidth array<double>, contigColor array<int>").option("multiLine", True).json(path)
    rows = raw.select("*", F.posexplode("contigWidth").alias("ord", "w"))
    return rows.select(F.col("ord").cast("long").alias("ord"), *(at("contigPositions", k, 4).cast("float").alias(c) for k, c in enumerate(("in_x", "in_y", "out_x", "out_y"))), F.col("w").cast("float").alias("width"), *(at("contigColor", k, 4).cast("short").alias(c) for k, c in enumerate("rgba")))


def write_json_scene(contigs: DataFrame, path: str) -> None:
    """Ribbons as one JSON object of flat arrays, as ``read_json_scene`` takes them.  One object is one row, so this is for scenes a client can open."""
    each = F.array_sort(F.collect_list(F.struct("ord", *(F.col(c).cast("double").alias(c) for c in ("in_x", "in_y", "out_x", "out_y", "width")), *(F.col(c).cast("int").alias(c) for c in "rgba"))))
    flat = lambda *names: F.flatten(F.transform("t", lambda t: F.array(*(t[n] for n in names))))
    rows = contigs.agg(each.alias("t"))
    rows = rows.select(flat("in_x", "in_y", "out_x", "out_y").alias("contigPositions"), flat("width").alias("contigWidth"), flat(*"rgba").alias("contigColor"))
    rows.coalesce(1).write.json(path)


def first_ids(contigs: DataFrame, k: int = 3) -> list[str]:
    """The first k ids in order: what a quick look at a scene shows."""
    return [r["id"] for r in contigs.orderBy("ord").limit(k).select("id").collect()]
