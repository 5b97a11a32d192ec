"""The registered queries of the corpus operators: each runs its operator over the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, bpe, conversations, ctw, embed_dedup, jaccard_join, merkle, packing, repeats, sharding, toxicity, url_rules
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file the contracts name; another path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


#: Listed rules (domain, path prefix, verdict): fixed values of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.plan_repairs(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


LINKED = """u AS (SELECT i AS a, j AS b FROM e UNION SELECT j, i FROM e),
r(id, lab) AS (SELECT id, id FROM nodes UNION SELECT u.b, r.lab FROM r JOIN u ON u.a = r.id WHERE r.lab < u.b),
comp AS (SELECT id, min(lab) AS component_id FROM r GROUP BY id)"""

OP2_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
nodes AS (SELECT vec_id AS id FROM v), {LINKED}
SELECT c.id AS vec_id, count(u.b) AS n_links, c.component_id, c.id = c.component_id AS kept FROM comp c LEFT JOIN u ON u.a = c.id GROUP BY ALL"""

OP3_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.x, v.x) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s WHERE score IS NOT NULL AND NOT isnan(score))
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5"""

OP9_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
x AS (SELECT doc_id, unnest(g) AS g FROM s), n AS (SELECT doc_id AS id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i, j FROM p JOIN n a ON a.id = i JOIN n b ON b.id = j WHERE 100 * c >= 80 * (a.n + b.n - c)),
nodes AS (SELECT id FROM n), {LINKED}
SELECT n.id AS doc_id, n.n AS n_shingles, component_id FROM n JOIN comp USING (id)"""


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL, where SQL can say it; the others have brute-force tests."""
    return {"op2_embed_dedup": OP2_SQL, "op3_ann": OP3_SQL, "op9_jaccard_join": OP9_SQL}
