"""GFA v1 text as DataFrames: numbered lines, segments, links, violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EdgeExists, GFAParseError, InvalidEdgeEndpoint, NodeExists
from ..functions import gfa as fn
from ..operators.graph import AssemblyGraph
from ..operators.lineage import cut, numbered
from ..shipping import ship

#: The characters that Python's str.strip() removes.
STRIP = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def gfa_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) without blanks around them, without empty lines and comments; numbers stay those of the file."""
    value = F.btrim(F.col("value"), F.lit(STRIP))
    return lines.select("line_no", value.alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text with 1-based line numbers in file order."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = text.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    return numbered(at, [F.col("f"), F.col("b"), F.col("m")], "line_no").select((F.col("line_no") + 1).alias("line_no"), "value")


def records(lines: DataFrame) -> DataFrame:
    """S and L lines as text: (line_no, value, record)."""
    return gfa_lines(lines).withColumn("record", F.substring_index("value", "\t", 1)).filter(F.col("record").isin("S", "L"))


def parsed(rows: DataFrame) -> DataFrame:
    """Records, split once and typed: what is wrong with the line's own form (or null), and the columns of its record."""
    f, n = F.col("f"), F.size("f")
    own = [c for c in rows.columns if c != "value"]
    rows = rows.withColumn("f", F.split("value", "\t"))
    is_s = F.col("record") == "S"
    turns = F.coalesce(F.get(f, 2).isin("+", "-") & F.get(f, 4).isin("+", "-"), F.lit(False))
    fault = F.when(is_s & (n < 3), "invalid S record").when(~is_s & (n < 6), "invalid L record").when(~is_s & ~turns, "invalid orientation in L record")
    skip = F.when(is_s, 3).otherwise(6)
    rows = rows.withColumn("fault", fault).withColumn("tags", fn.parse_tags(F.slice(f, skip + 1, F.greatest(n - skip, F.lit(0)))))
    start, end = fn.link_endpoints(F.get(f, 1), F.get(f, 2), F.get(f, 3), F.get(f, 4))
    of = lambda cond, c: F.when(F.col("fault").isNull() & cond, c)
    return rows.select(
        *own, "fault",
        of(is_s, F.get(f, 1)).alias("id"), of(is_s, fn.segment_length(F.col("tags"), F.get(f, 2))).alias("length_bp"), of(is_s, fn.coverage(F.col("tags"))).alias("coverage"),
        of(~is_s, start).alias("start"), of(~is_s, end).alias("end"), of(~is_s, F.get(f, 5)).alias("overlap"), "tags",
    )


def record_counts(lines: DataFrame) -> DataFrame:
    return gfa_lines(lines).groupBy(F.element_at(F.split("value", "\t"), 1).alias("record")).agg(F.count(F.lit(1)).alias("n"))


def violations(lines: DataFrame) -> DataFrame:
    """Every line that strict parsing stops at: (line_no, kind, detail)."""
    return violations_of(cut(parsed(records(lines))))


def violations_of(rows: DataFrame) -> DataFrame:
    """The same from lines that are parsed: ill-formed lines, segments named twice, links that stand before or without their segments."""
    at = F.concat(F.lit("GFA parse error at line "), F.col("line_no").cast("string"), F.lit(": "), F.col("fault"))
    bad = rows.filter("fault IS NOT NULL").select("line_no", F.lit("GFAParseError").alias("kind"), at.alias("detail"))
    good = rows.filter("fault IS NULL")
    seg = good.filter("record = 'S'").select("line_no", "id")
    first = seg.groupBy("id").agg(F.min("line_no").alias("first"))
    twice = seg.join(first, "id").filter("line_no > first").select("line_no", F.lit("NodeExists").alias("kind"), F.col("id").alias("detail"))
    ends = good.filter("record = 'L'").select("line_no", F.explode(F.array("start.node_id", "end.node_id")).alias("id"))
    loose = ends.join(first, "id", "left").filter(F.col("first").isNull() | (F.col("first") > F.col("line_no")))
    loose = loose.groupBy("line_no").agg(F.min("id").alias("detail")).select("line_no", F.lit("InvalidEdgeEndpoint").alias("kind"), "detail")
    return bad.union(twice).union(loose)


def graph_from_lines(lines: DataFrame, mode: str = "FAILFAST") -> AssemblyGraph:
    """Parse numbered lines.  FAILFAST raises the error of the first bad line; PERMISSIVE leaves bad lines out.

    The text is read and sorted once, by record and line; it is parsed from there, and all else comes from the typed table.
    """
    ship(lines.sparkSession)
    rows = cut(parsed(numbered(records(lines), [F.col("line_no")], group="record")))
    bad = violations_of(rows)
    if mode == "FAILFAST":
        first = bad.orderBy("line_no", "kind").limit(1).collect()
        if first:
            kinds = {k.__name__: k for k in (GFAParseError, NodeExists, EdgeExists, InvalidEdgeEndpoint)}
            raise kinds[first[0]["kind"]](first[0]["detail"])
    else:
        rows = numbered(rows.drop("ord").join(bad.select("line_no").distinct(), "line_no", "left_anti"), [F.col("line_no")], group="record")
    seg = rows.filter("record = 'S'").select("ord", "id", "length_bp", "coverage", "tags")
    link = rows.filter("record = 'L'").select("ord", fn.edge_id(F.col("ord"), F.col("start"), F.col("end")).alias("id"), "start", "end", "overlap", "tags")
    return AssemblyGraph(seg, link)


def read_gfa(spark: SparkSession, source: str | DataFrame, mode: str = "FAILFAST") -> AssemblyGraph:
    """Parse a path, or a DataFrame of numbered lines (line_no, value)."""
    return graph_from_lines(source if isinstance(source, DataFrame) else read_lines(spark, source), mode)


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """GFA files of a folder by name: name without suffix, size, size as text, and whether it is large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gfa").load(folder).select("path", "length")
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.gfa$", "")
    size = F.col("length")
    return files.select(name.alias("name"), size.alias("size_bytes"), fn.format_size(size).alias("size_text"), fn.is_large(size).alias("is_large")).orderBy("name")
