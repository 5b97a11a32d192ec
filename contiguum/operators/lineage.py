"""Cutting lineage in iterative operators, and row numbers that do not gather rows in one task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, tuple[str, weakref.ref]] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; only a session in one process gets a temporary folder without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='contiguum-')}"
        _FOLDERS[app] = (f"{base.rstrip('/')}/contiguum-cut-{uuid.uuid4().hex}", weakref.ref(spark))
    return _FOLDERS[app][0]


@atexit.register
def _clean() -> None:
    for folder, ref in _FOLDERS.values():
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the gateway may be gone while the interpreter ends
            return


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: they survive lost executors, the plan starts anew, and their size is known to joins."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "ord", parts: int | None = None, group: str | None = None) -> DataFrame:
    """0-based rank in a total order (within each value of ``group``, of which there are few): a range sort, then one count for
    each partition moves its rows up."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order] if group else order
    laid = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    of = F.col(group) if group else F.lit(0)
    pid = F.shiftright("_mid", 33)
    counts = laid.groupBy(pid.alias("p"), of.alias("g")).agg(F.count(F.lit(1)).alias("c"), F.min("_mid").alias("lo")).collect()  # one row for each partition and group
    done: dict = {}
    rows = []
    for p, g, c, lo in sorted(counts, key=lambda r: r["p"]):
        rows.append((p, g, done.get(g, 0) - lo))
        done[g] = done.get(g, 0) + c
    shift = spark.createDataFrame(rows, f"_p long, _g {dict(df.dtypes)[group] if group else 'int'}, _base long")
    out = laid.withColumn("_p", pid).withColumn("_g", of).join(F.broadcast(shift), ["_p", "_g"])
    return out.withColumn(name, F.col("_mid") + F.col("_base")).drop("_mid", "_p", "_g", "_base")
