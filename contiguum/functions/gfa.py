"""Column functions for GFA fields: tags, lengths, coverage, ports, names.  All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_MAP = "map<string,string>"
#: What Python's float() accepts, beside blanks around it; Spark's cast accepts suffixes such as 1.0f.
FLOAT = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
COVERAGE_TAGS = ("dp", "DP", "KC", "RC")
SESSION_NAME, STATELESS_NAME = r"[A-Za-z0-9_.-]+", r"[A-Za-z0-9_]+"
LARGE_FILE = 500 * 1024 * 1024


def parse_tags(fields: Column) -> Column:
    """``TAG:TYPE:VALUE`` fields to a map from tag to ``TYPE:VALUE``; malformed fields are skipped, the last of equal tags wins."""
    good = F.filter(fields, lambda f: f.like("%:%:%"))
    name = lambda f: F.substring_index(f, ":", 1)
    paired = lambda fs: F.map_from_arrays(F.transform(fs, name), F.transform(fs, lambda f: F.substring(f, F.instr(f, ":") + 1, F.length(f))))
    last = F.filter(good, lambda f, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda g: name(g) == name(f)))
    names = F.transform(good, name)
    return F.when(F.size(F.array_distinct(names)) < F.size(names), paired(last)).otherwise(paired(good))


def _typed(tags: Column, key: str, types: tuple[str, ...]) -> Column:
    tag = F.try_element_at(tags, F.lit(key))
    return F.when(F.substring_index(tag, ":", 1).isin(*types), F.substring(tag, F.instr(tag, ":") + 1, F.length(tag)))


def int_tag(tags: Column, key: str) -> Column:
    """Value of an ``i`` tag; null if absent, of another type or no integer."""
    v = _typed(tags, key, ("i",))
    return F.when(v.rlike(INTEGER), F.regexp_replace(F.trim(v), "_", "").try_cast("bigint"))


def float_tag(tags: Column, key: str) -> Column:
    """Value of an ``f`` or ``i`` tag; null if absent, of another type or no number."""
    v = _typed(tags, key, ("f", "i"))
    return F.when(v.rlike(FLOAT), F.regexp_replace(F.trim(v), "_", "").try_cast("double"))


def coverage(tags: Column) -> Column:
    """The first coverage tag that has a value: dp, DP, KC, RC."""
    return F.coalesce(*(float_tag(tags, t) for t in COVERAGE_TAGS))


def segment_length(tags: Column, sequence: Column) -> Column:
    """LN if it is an integer (also when it is not positive), else the length of a sequence that is given."""
    given = F.when(~sequence.isin("*", ""), F.length(sequence).cast("bigint"))
    return F.coalesce(int_tag(tags, "LN"), given)


def start_port(orient: Column) -> Column:
    """Port where a segment traversed in this orientation begins."""
    return F.when(orient == "+", "IN").otherwise("OUT")


def end_port(orient: Column) -> Column:
    """Port where a segment traversed in this orientation ends."""
    return F.when(orient == "+", "OUT").otherwise("IN")


def link_endpoints(source: Column, source_orient: Column, target: Column, target_orient: Column) -> tuple[Column, Column]:
    """A link joins the end of its first segment to the start of its second."""
    end = lambda n, p: F.struct(n.alias("node_id"), p.alias("port"))
    return end(source, end_port(source_orient)), end(target, start_port(target_orient))


def edge_id(ordinal: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("e"), ordinal.cast("string"), F.lit(":"), start["node_id"], F.lit(":"), start["port"], F.lit("->"), end["node_id"], F.lit(":"), end["port"])


def port_id(node_id: Column, port: Column) -> Column:
    return F.concat_ws(":", node_id, port)


def port_owner(port: Column) -> Column:
    """Segment of a port id; segment ids may hold colons themselves."""
    return F.regexp_replace(port, ":[^:]*$", "")


def side(port: Column) -> Column:
    """0 for IN, 1 for OUT."""
    return F.when(port == "IN", 0).otherwise(1).cast("tinyint")


def visual_length(length_bp: Column, base: float | Column = 1.0, scale: float = 0.6) -> Column:
    """Length on the page: base + scale * sqrt(bp); base where the length is unknown or not positive."""
    return F.when(length_bp > 0, base + scale * F.sqrt(length_bp.cast("double"))).otherwise(F.lit(base))


def ribbon_width(cov: Column, least: float = 1.0, most: float = 12.0, scale: float = 1.5, unknown: float = 2.0) -> Column:
    """Width on the page: 1 + scale * sqrt(coverage) within bounds; NaN counts as very large."""
    wide = F.greatest(F.lit(least), F.least(F.lit(most), 1.0 + scale * F.sqrt(cov)))
    return F.when(F.isnan(cov), F.lit(most)).when(cov > 0, wide).otherwise(F.lit(unknown))


#: Colours of components, as red, green, blue (fixed values: the common 20-colour categorical palette).
PALETTE = (
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120),
    (44, 160, 44), (152, 223, 138), (214, 39, 40), (255, 152, 150),
    (148, 103, 189), (197, 176, 213), (140, 86, 75), (196, 156, 148),
    (227, 119, 194), (247, 182, 210), (127, 127, 127), (199, 199, 199),
    (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
)


def palette(cid: Column) -> dict[str, Column]:
    """Colour columns r, g, b, a of a component."""
    at = (F.pmod(cid, F.lit(len(PALETTE))) + 1).cast("int")
    return {n: F.element_at(F.array(*(F.lit(c[k]) for c in PALETTE)), at).cast("smallint") for k, n in enumerate("rgb")} | {"a": F.lit(255).cast("smallint")}


def format_size(size: Column) -> Column:
    """Bytes as text: GB with one decimal, MB and KB without, by 1024."""
    gb, mb, kb = (size / float(1 << s) for s in (30, 20, 10))
    return F.when(gb >= 1, F.concat(F.format_string("%.1f", gb), F.lit(" GB"))).when(mb >= 1, F.concat(F.format_string("%.0f", mb), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.0f", kb), F.lit(" KB")))


def is_large(size: Column) -> Column:
    return size >= LARGE_FILE


def valid_dataset_name(name: str, stateless: bool = False) -> bool:
    """One path component; the stateless entry takes neither dots nor hyphens."""
    return re.fullmatch(STATELESS_NAME if stateless else SESSION_NAME, name) is not None
