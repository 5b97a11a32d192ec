"""Shared plumbing of the corpus operators: scratch tables, task-sized batches and distributed row numbers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import contracted, stars
from ..shipping import ship

_LIVE: dict[str, weakref.ref] = {}
_TABLES: dict[str, list[str]] = {}
_LOCAL_BASE: list[str] = []
_HELD: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by directory and name; only Spark's readers touch the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="contiguum-"))
    return f"file://{_LOCAL_BASE[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; they go when the session ends or on ``drop``.

    A written table survives the loss of any executor and is read back column by column, which
    ``DataFrame.checkpoint`` does not offer.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n = spark, f"{shared_base(spark)}/contiguum-{tag}-{uuid.uuid4().hex}", 0
        _LIVE[self.path] = weakref.ref(spark)

    def save(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._contiguum_path = path
        return out

    def bucket(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """A table bucketed by a column: joins on it leave this side's rows where they are."""
        self.n += 1
        name = f"contiguum_{self.path.rsplit('-', 1)[-1]}_{self.n}"
        df.write.option("path", f"{self.path}/{name}").option("compression", "none").bucketBy(buckets, column).saveAsTable(name)
        _TABLES.setdefault(self.path, []).append(name)
        return self.spark.table(name)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._contiguum_path)


@atexit.register
def _clean() -> None:
    for path, ref in _LIVE.items():
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                for name in _TABLES.pop(path, ()):
                    spark.sql(f"DROP TABLE IF EXISTS {name}")
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the gateway may be gone while the interpreter ends
            return


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, counted by Spark over the whole table."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def small_batches(batches, column: str, limit: int = 4 << 20):
    """Re-slice Arrow batches so that one holds at most ``limit`` bytes of ``column`` (or a single row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        start = held = 0
        for i, size in enumerate(lengths.to_pylist()):
            size = size or 0
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and the C heap where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hold(name: str, clear) -> None:
    """Tell that this worker holds a cache, which ``clear`` empties."""
    _HELD[name] = clear


def settle(keep: str | None) -> None:
    """Empty the caches of other operators, whose tasks this worker ran before."""
    others = [n for n in _HELD if n != keep]
    for n in others:
        _HELD.pop(n)()
    if others:
        gc.unfreeze()
        give_back()


def lean(run, keep: str | None = None):
    """A task's function after which its Python worker, which goes on to other operators, holds no freed memory, and before
    which it lets go of caches but the one named.  With a cache of its own, freed memory is kept for the next task, too."""

    def task(batches):
        settle(keep)
        try:
            yield from run(batches)
        finally:
            if keep is None:
                give_back()

    return task


def narrow_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let the session send batches of at most ``limit`` bytes to Python workers: both sides hold several copies of one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864b").rstrip("b")) > limit:
        spark.conf.set(name, f"{limit}b")


def partitions_for(spark: SparkSession, units: int, per_task: int) -> int:
    """Enough tasks for ``units`` at ``per_task`` each, and never fewer than the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // per_task))


def numbered(scratch: Scratch, df: DataFrame, order: list, parts: int, group: str) -> tuple[DataFrame, dict[int, int]]:
    """Give each row its 0-based rank ``idx`` within ``group`` (an int column of few values), in the given order.

    Rows are range-sorted, written once, and each partition's rows are shifted by the counts of the
    partitions before it: the driver sees one count for each partition and group value, never a row.
    Returns the rows and the size of each group.
    """
    keys = [F.col(group), *order]
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = scratch.save(laid.withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    pid = F.shiftright("_mid", 33)
    cells = laid.groupBy(pid.alias("_pid"), F.col(group)).agg(F.min("_mid").alias("lo"), F.count(F.lit(1)).alias("c")).collect()
    totals: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(cells, key=lambda r: (r[group], r["_pid"])):
        base[r["_pid"], r[group]] = totals.get(r[group], 0) - r["lo"]
        totals[r[group]] = totals.get(r[group], 0) + r["c"]
    shift = scratch.spark.createDataFrame([(p, g, b) for (p, g), b in base.items()], f"_pid long, {group} int, _base long")
    out = laid.withColumn("_pid", pid).join(F.broadcast(shift), ["_pid", group])
    return out.withColumn("idx", F.col("_mid") + F.col("_base")).drop("_mid", "_pid", "_base"), totals


def min_label_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between long ids: rows ``(id, component)``, smallest id of each.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every edge points at a root; before the first round and
    after each, a partition's edges are contracted where they are.  A node never gathers its neighbours in one task: each step is a
    partial minimum by key and a join, so a hub of any degree is pre-aggregated before the shuffle.  Each round is
    written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct()
    cur = scratch.save(contracted(e), "cc")
    while not stars(cur):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large-star: neighbours above a node go to the node's minimum
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: neighbours below a node, and the node, go to the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        nxt = scratch.save(contracted(small), "cc")
        scratch.drop(cur)
        cur = nxt
    nodes = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


__all__ = ["Scratch", "Window", "give_back", "hold", "lean", "min_label_components", "narrow_batches", "numbered", "partitions_for", "shared_base", "small_batches", "table", "text_bytes"]
