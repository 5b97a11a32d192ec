"""URL filtering by association rules: FP-growth mines token sets that go with a bad label; rules match by inverted index.

All of it is DataFrame and SQL functions; FP-growth is Spark's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BAD = "label=bad"
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path then up to ``?``, ``#`` or the end.

    Both are empty for a null url or one without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, parts of labels, and path segments with runs of digits as one class."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    joined = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))
    pieces = F.transform(F.flatten(F.transform(joined, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    steps = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), r"[0-9]+", "0")))
    whole = F.array(F.concat(F.lit("host:"), host))
    return F.array_distinct(F.filter(F.concat(labels, pieces, steps, whole), lambda x: ~x.rlike(r"^\w+:$")))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (``domain/path-prefix``) that fits host or a superdomain of it, and its verdict; null if none fits.

    The rules are a configured list, so they become one expression without a join.
    """
    name = verdict = F.lit(None).cast("string")
    for text, _, action in sorted(((d + p, d, a) for d, p, a in rules), key=lambda r: (len(r[0]), r[0])):
        domain, _, prefix = text.partition("/")
        prefix = "/" + prefix
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, F.lit(text)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def signed(baskets: DataFrame, need: int) -> DataFrame:
    """Tokens of at least ``need`` bad pages: (token, c, b, cls), in how many pages and bad pages they are.

    Tokens that are in exactly the same pages are one class, named by its smallest token: their combinations say nothing new.
    """
    each = baskets.select("key", "bad", F.explode("items").alias("token"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("bad").cast("long")).alias("b"), F.bit_xor("key").alias("x"), F.sum(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))).alias("y")).filter(F.col("b") >= need)
    same = Window.partitionBy("c", "b", "x", "y")
    return counted.select("token", "c", "b", F.min("token").over(same).alias("cls"))


def projected(scratch: Scratch, rows: DataFrame, need: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """One item more in front: of rows (prefix, key, bad, items) the projections by each of their items, and the rules among them.

    ``items`` ascend by frequency; a projection holds the pages that have the prefix, with what follows its last item.  There an
    item is left out if fewer than ``need`` bad pages have it (no set with it can be a rule), if it makes a rule with the
    prefix (larger sets match nothing more) or if all pages of the projection have it (with or without it a set is in the same pages).
    """
    child = rows.select("key", "bad", "prefix", "items", F.posexplode("items").alias("at", "next"))
    child = child.select("key", "bad", F.concat("prefix", F.array("next")).alias("prefix"), F.slice("items", F.col("at") + 2, F.greatest(F.size("items"), F.lit(1))).alias("items"))
    child = scratch.save(child, "projected")
    total = child.groupBy("prefix").agg(F.count(F.lit(1)).alias("pages"))
    each = child.select("prefix", "bad", F.explode("items").alias("token")).groupBy("prefix", "token").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("bad").cast("long")).alias("b"))
    each = scratch.save(each.filter(F.col("b") >= need).join(total, "prefix"), "extensions")
    is_rule = F.col("b") >= confidence * F.col("c")
    rules = each.filter(is_rule).select(F.concat("prefix", F.array("token")).alias("items"))
    open_ = each.filter(~is_rule & (F.col("c") < F.col("pages"))).groupBy("prefix").agg(F.collect_list("token").alias("open"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    kept = child.withColumn("salt", salted("key")).join(open_.withColumn("salt", salts), ["prefix", "salt"])
    kept = kept.select("prefix", "key", "bad", F.array_intersect("items", "open").alias("items")).filter(F.size("items") > 0)
    return kept, rules


def grown(scratch: Scratch, rows: DataFrame, need: int, confidence: float) -> DataFrame | None:
    """Rules of two items and more within projections: FP-growth over all of them at once, as items carry their prefix.

    A rule is dropped if a part of it is a rule of the same projection.
    """
    n = rows.count()
    if not n:
        return None
    named = F.transform("items", lambda x: F.to_json(F.struct(F.col("prefix").alias("p"), x.alias("t"))))
    baskets = rows.select(F.when(F.col("bad"), F.concat(named, F.array(F.lit(BAD)))).otherwise(named).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / n)).fit(baskets).freqItemsets
    sets = sets.select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.array_contains("items", BAD).alias("bad"), "freq").filter(F.size("items") > 1)
    sets = scratch.save(sets, "sets")
    bad = sets.filter("bad").select("items", F.col("freq").alias("b"))
    found = sets.filter("not bad").join(bad, "items").filter((F.col("b") >= need) & (F.col("b") >= confidence * F.col("freq"))).select("items")
    parts = F.expr("transform(sequence(1, shiftleft(1, size(items)) - 2), m -> filter(items, (x, i) -> getbit(m, i) = 1))")
    larger = found.select("items", F.explode(parts).alias("part")).join(found.select(F.col("items").alias("part")), "part", "left_semi").select("items").distinct()
    read = F.transform("items", lambda x: F.from_json(x, "p array<string>, t string"))
    read = found.join(larger, "items", "left_anti").select(read.alias("r"))
    return read.select(F.concat(F.col("r")[0]["p"], F.transform("r", lambda x: x["t"])).alias("items"))


def mine(scratch: Scratch, baskets: DataFrame, support: float, confidence: float, least: int, width: int) -> DataFrame | None:
    """Token sets that imply the bad label: rows (rule, need, item, token), where any token of its class stands for an item.

    A set is a rule if at least max(``least``, ``support`` x bad pages) bad pages have it, and they are a share of ``confidence`` or more
    of all pages that have it.  All smallest rules are found, whatever the number of tokens of a page or a rule; a rule of which a
    part is a rule matches nothing more, and is dropped where that is seen.  Single tokens are counted first; what is left is
    mined by FP-growth.  A page with n tokens has up to 2^n sets, so while a page has over ``width`` classes of tokens, the pages
    are projected by each class (see ``projected``), which leaves fewer; projections in which no page is wider are mined together.
    ``width`` moves work between the two ways and changes no rule's matches.  The frequent sets themselves are the work: their
    number is bounded by ``support`` only.  None if no page is bad.
    """
    n_bad = baskets.filter("bad").count()
    if not n_bad:
        return None
    need = max(least, int(-(-support * n_bad // 1)))
    known = scratch.save(signed(baskets, need), "tokens")
    one = known.filter(F.col("b") >= confidence * F.col("c"))
    single = one.select(F.col("cls").alias("rule"), F.lit(1).alias("need"), F.col("cls").alias("item"), "token")
    rest = known.filter(F.col("b") < confidence * F.col("c"))
    left = baskets.select("key", "bad", F.explode("items").alias("token")).join(rest.filter("token = cls").select("token", "c"), "token")
    left = left.groupBy("key", "bad").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))
    rows = scratch.save(left.select(F.array().cast("array<string>").alias("prefix"), "key", "bad", F.transform("t", lambda x: x["token"]).alias("items")), "left")
    narrow, rules = [], []
    while True:
        widths = scratch.save(rows.groupBy("prefix").agg(F.max(F.size("items")).alias("most")), "widths")
        narrow.append(rows.join(widths.filter(F.col("most").between(2, width)).select("prefix"), "prefix", "left_semi"))
        wide = widths.filter(F.col("most") > width)
        if wide.isEmpty():
            break
        rows, found = projected(scratch, rows.join(wide.select("prefix"), "prefix", "left_semi"), need, confidence)
        rows = scratch.save(rows, "rows")
        rules.append(found)
    found = grown(scratch, reduce(DataFrame.union, narrow), need, confidence)
    rules += [found] if found is not None else []
    if not rules:
        return single
    sets = reduce(DataFrame.union, rules).select(F.to_json(F.array_sort("items")).alias("rule"), F.size("items").alias("need"), F.explode("items").alias("item"))
    return single.union(sets.join(rest.select(F.col("cls").alias("item"), "token"), "item").select("rule", "need", "item", "token"))


def salted(column: str) -> Column:
    """A salt by another column, so that the rows of one key are several groups; the other side has each row once for each salt."""
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], support: float = 0.002, confidence: float = 0.6, least: int = 3, width: int = 10, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page's url: by the longest listed rule that fits, else ``block`` if a mined rule matches, else ``allow``.

    Training rows are the pages whose id has a label; a page is bad when its label has quality 0 or toxic 1 (nulls
    are neither).  Without bad pages no rule is mined and everything unlisted is allowed.  Null urls have
    empty host and path and match nothing.  Rows with repeated or null ids are judged one by one, and equal rows train once; other
    columns are not read.  ``support`` is a share of the bad pages; tokens and lengths of rules have no bound (see ``mine``), so urls of any length
    count whole.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    marks = marks.groupBy("page_id").agg(F.max("bad").alias("bad"))
    words = tokens(F.col("host"), F.col("path"))
    baskets = rows.filter("host <> ''").join(marks, "page_id").select(F.xxhash64("page_id", "host", "path").alias("key"), "bad", words.alias("items"))
    baskets = scratch.save(baskets.dropDuplicates(["key"]), "baskets")
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("listed", verdict)
    found = mine(scratch, baskets, support, confidence, least, width)
    if found is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"))
    # inverted index: each rule under the tokens of its items; a url matches a rule when it has all items.  Urls with the same
    # tokens are judged once, so a host that holds a third of all pages is one row here.
    index = scratch.save(found, "rules").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.withColumn("tokens", F.array_sort(words)).withColumn("sig", F.xxhash64("tokens"))
    sets = keyed.filter("listed is null").select("sig", "tokens").distinct()
    sets = sets.select("sig", F.explode("tokens").alias("token")).withColumn("salt", salted("sig"))
    hits = sets.join(index, ["token", "salt"]).select("sig", "rule", "need", "item").distinct()
    hits = hits.groupBy("sig", "rule", "need").agg(F.count(F.lit(1)).alias("have")).filter("have = need").select("sig").distinct()
    hits = hits.select("sig", F.lit(True).alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = keyed.withColumn("salt", salted("page_id")).join(hits, ["sig", "salt"], "left")
    judged = F.coalesce("listed", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"))
