"""The pipeline's stages against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i:02d}" for i in range(60)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, text(40) + (" rotten filth" if i % 5 == 0 else ""), "en", "s", 1) for i in range(100)]
    shared = text(60)
    rows += [(200 + i, f"{text(40)} {shared} {text(40)}", "de", "s", 1) for i in range(4)]
    base = text(120)
    rows += [(300, base, "en", "hot", 1), (301, base + " tail", "en", "hot", 1), (302, base, None, None, None), (303, "", "en", "s", 0), (304, None, "en", "s", None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 100)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, folder, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = kept["toxicity"]
    assert not [t for t in clean.text if t and "filth" in t] and {200, 300, 302, 303, 304} <= set(clean.doc_id) and len(clean) >= 85
    one = kept["ngram_jaccard_join"]
    assert set(clean.doc_id) - set(one.doc_id) == {301, 302}
    cut = kept["suffix_array_dedup"].set_index("doc_id")
    seen, want = set(), {}
    for r in one.sort_values("doc_id").itertuples():
        b = (r.text or "").encode()
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                mask[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[r.doc_id] = None if r.text is None else bytes(np.frombuffer(b, np.uint8)[~mask]).decode()
    assert {i: (None if t is None else t) for i, t in cut.text.items()} == want
    assert any(len(want[i]) < 400 for i in (201, 202, 203)) and cut.lang[201] == "de"
    packed = kept["packing"]
    assert set(packed.doc_id) == set(want) and (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    words = sum(len(re.findall(r"w|\d", t or "")) for t in want.values())
    assert words  # texts are not empty


def test_repeated_rows_leave_one(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text, other = " ".join(WORDS[:20]), " ".join(WORDS[30:50])
    rows = [(1, text)] * 3 + [(2, text), (3, other), (3, other), (4, None), (4, None), (5, ""), (None, text), (None, text), (7, text + " tail"), (8, WORDS[0]), (8, WORDS[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("again", F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in pipeline.keep_one_of_group(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, text), (3, other), (4, None), (5, ""), (None, text), (8, WORDS[0]), (8, WORDS[1])], key=str)
    assert pipeline.keep_one_of_group(spark, docs.limit(0), "").count() == 0
