"""From documents to packed token windows: toxic texts go, near copies go, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns of
``documents``; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contiguum.llm import jaccard_join, packing, repeats, toxicity
from contiguum.llm.common import Scratch, table
from contiguum.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' labels, scores below 0.5.  Texts alone decide, so equal texts fare alike."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(COLUMNS), model)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-copy group, once.

    Rows that share an id (or have none) and a text are one document, whichever of them stays; rows that share an id but not
    the text are told apart.  Documents without words are in no group and stay, one for each id and text.  An empty table stays empty; other
    columns than those of ``documents`` are left out.
    """
    found = jaccard_join.jaccard_components(docs)
    others = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    kept = docs.select(COLUMNS).join(others, "doc_id", "left_anti").select(COLUMNS)
    again = Scratch(spark, "again").save(docs.groupBy(F.col("doc_id").alias("again")).count().filter("count > 1").select("again"))
    if again.isEmpty():
        return kept
    same = kept["doc_id"].eqNullSafe(again["again"])
    text = F.sha2(F.col("text").cast("binary"), 256)
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").withColumn("_text", text).dropDuplicates(["doc_id", "_text"]).select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that an earlier document has; n_chars is counted anew.

    A cut can fall inside a character; what is left of it goes too.  A document of which nothing is left goes.
    """
    return repeats.cut_documents(docs.select(COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_group), ("suffix_array_dedup", cut_repeats), ("packing", pack_windows)]

#: Trained weights and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
