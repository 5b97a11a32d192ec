"""The events table read as an assembly graph: one segment for each event, links along each user's sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import AssemblyGraph
from ..shipping import ship
from .gfa import graph_from_lines

LINK_BASE = 1_000_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bridge_segments(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"),
        (10 + (F.col("event_id") * 37) % 991).alias("length_bp"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("coverage"),
    )


def bridge_links(ev: DataFrame) -> DataFrame:
    """Consecutive events of a session, and for a click also the event three back; errors are traversed backwards."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    session = F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(by_user.rowsBetween(Window.unboundedPreceding, 0))
    in_session = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    back = lambda k: F.struct(F.lag("event_id", k).over(in_session).alias("ev"), F.lag("event_type", k).over(in_session).alias("type"))
    rows = ev.select("event_id", "user_id", "ts", "event_type").withColumn("session", session)
    rows = rows.select("event_id", "event_type", back(1).alias("p1"), back(3).alias("p3"))
    steps = F.filter(
        F.array(F.struct(F.col("event_id").alias("e"), F.lit(0).alias("k"), F.col("p1").alias("p")), F.when(F.col("event_type") == "click", F.struct(F.col("event_id").alias("e"), F.lit(1).alias("k"), F.col("p3").alias("p")))),
        lambda s: s.isNotNull() & s["p"]["ev"].isNotNull(),
    )
    orient = lambda t: F.when(t == "error", "-").otherwise("+")
    name = lambda e: F.concat(F.lit("s"), e.cast("string"))
    out = rows.select("event_type", F.explode(steps).alias("s"))
    number = F.col("s.e") * 2 + F.col("s.k")
    return out.select(number.alias("link_ord"), name(F.col("s.p.ev")).alias("from_seg"), orient(F.col("s.p.type")).alias("from_orient"), name(F.col("s.e")).alias("to_seg"), orient(F.col("event_type")).alias("to_orient"), F.concat((number % 11).cast("string"), F.lit("M")).alias("overlap"))


def bridge_lines(ev: DataFrame) -> DataFrame:
    """GFA text: all S lines, then all L lines; ``k`` is the line order."""
    cov = F.when(F.col("coverage").isNull(), "").otherwise(F.concat(F.lit("\tdp:f:"), F.col("coverage").cast("string")))
    s = bridge_segments(ev).select(F.concat(F.lit("S\t"), F.col("id"), F.lit("\t*\tLN:i:"), F.col("length_bp").cast("string"), cov).alias("line"), F.col("ord").alias("k"))
    link = bridge_links(ev).select(F.concat_ws("\t", F.lit("L"), "from_seg", "from_orient", "to_seg", "to_orient", "overlap").alias("line"), (LINK_BASE + F.col("link_ord")).alias("k"))
    return s.union(link)


def bridge_graph(spark: SparkSession, sf_dir: str) -> AssemblyGraph:
    """The bridge text, parsed like any GFA text."""
    lines = bridge_lines(events(spark, sf_dir)).select(F.col("k").alias("line_no"), F.col("line").alias("value"))
    return graph_from_lines(lines)
