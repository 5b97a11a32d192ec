"""Models inside operators against plain forms: PU risk, packing plans, shards, columns of scores; empty tables and one very long text."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contiguum.llm import bpe, ctw, jaccard_join, packing, repeats, sharding, toxicity

PRIOR, DECAY = 0.2, 1e-2


def pu_sample():
    rng = np.random.default_rng(12)
    often, rare = np.full(40, 0.2), np.full(40, 0.2)
    often[:6] = 0.7
    draw = lambda p: np.flatnonzero(rng.random(40) < p).astype(np.int32)
    return [draw(often) for _ in range(300)], [draw(often if i % 5 == 0 else rare) for i in range(1500)]


def plain_risk(w, bias, pos, unl):
    """(risk with its penalty, its part for negatives), text by text."""
    z = lambda docs: np.array([w[d].sum() + bias for d in docs])
    zp, zu = z(pos), z(unl)
    negative = np.log1p(np.exp(zu)).mean() - PRIOR * np.log1p(np.exp(zp)).mean()
    return PRIOR * np.log1p(np.exp(-zp)).mean() + max(0.0, negative) + DECAY / 2 * (w**2).sum(), negative


def test_pu_classifier_ends_where_the_risk_is_least():
    """At the fitted weights the plain risk has no slope (by finite differences), and only words that stand out have a weight."""
    pos, unl = pu_sample()
    m = toxicity.PuClassifier.fit(pos, unl, PRIOR, steps=3000, rate=0.01, decay=DECAY, share=1.5)
    names = np.flatnonzero(m.weights)
    assert set(names) == set(range(6))
    risk, negative = plain_risk(m.weights, m.bias, pos, unl)
    assert negative > 0
    for k in [*names.tolist(), None]:
        step = np.zeros_like(m.weights)
        if k is not None:
            step[k] = 1e-4
        up, down = (plain_risk(m.weights + s * step, m.bias + s * 1e-4 * (k is None), pos, unl)[0] for s in (1, -1))
        assert abs(up - down) / 2e-4 < 2e-3
    assert risk < plain_risk(np.zeros_like(m.weights), np.log(PRIOR / (1 - PRIOR)), pos, unl)[0]


def test_scores_are_sums_of_weights(spark):
    """Every column of a score, from the texts alone."""
    w = np.zeros(toxicity.DIMS)
    w[zlib.crc32(b"filth") % toxicity.DIMS], w[zlib.crc32(b"filt~") % toxicity.DIMS], w[zlib.crc32(b"kind") % toxicity.DIMS] = 2.0, 0.5, -1.0
    texts = {1: "Filth, filth!", 2: "kind filth", 3: "filtered", 4: "", 5: None, 6: "kind " * 50_000 + "filth", 10: "9 _ !"}
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in texts.items()], "doc_id long, text string, score double, predicted int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.PuClassifier(w, -1.0)).collect()}
    for i, total in {1: 1.5, 2: 0.5, 3: -0.5, 4: -1.0, 5: -1.0, 6: 0.5, 10: -1.0}.items():
        assert abs(got[i].score - 1 / (1 + np.exp(-total))) < 1e-12 and got[i].predicted == int(total >= 0)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    kept = toxicity.keep_clean(docs, toxicity.PuClassifier(w, -1.0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 10}


def test_shards_cut_few_links(spark):
    """Sizes and checksums of texts, and fewer pairs of copies apart than a random placement would leave."""
    rng = np.random.default_rng(13)
    texts = [f"copy é {k}" for k in range(60) for _ in range(int(rng.integers(2, 9)))] + [f"alone {k}" for k in range(300)] + ["", None]
    got = sharding.shard(spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard int, g string"), shards=8).collect()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    where = {r.doc_id: r.shard for r in got}
    assert sorted(where) == list(range(len(texts)))
    pairs = [(a, b) for _, g in itertools.groupby(range(len(texts)), key=lambda i: texts[i]) for a, b in itertools.combinations(list(g), 2)]
    apart = sum(where[a] != where[b] for a, b in pairs)
    assert apart < 0.3 * len(pairs) < 0.875 * len(pairs)  # 7 of 8 at random


@pytest.mark.parametrize("seed", range(4))
def test_length_combinations(seed):
    """All pairs and triples that fill a window, by trying every one; repeat counts within the histogram."""
    rng = np.random.default_rng(seed)
    hist = rng.integers(0, 4, 24) * rng.integers(0, 300, 24)
    hist[0] = 0
    there = np.flatnonzero(hist).tolist()
    want = {c for k in (2, 3) for c in itertools.combinations_with_replacement(there, k) if sum(c) == len(hist)}
    combos = packing.combinations(hist)
    assert len(combos) == len(set(combos)) and set(combos) == want
    counts = packing.nnls_counts(hist, combos)
    used = np.zeros(len(hist), np.int64)
    for c, n in zip(combos, counts.tolist(), strict=True):
        assert n >= 0
        for length in c:
            used[length] += n
    assert (used <= hist).all()


def test_counts_place_what_can_be_placed():
    """A histogram that whole repeats of some combinations make up leaves next to no residual."""
    rng = np.random.default_rng(14)
    hist = np.zeros(64, np.int64)
    for a in rng.integers(1, 63, 30):
        n = int(rng.integers(50, 500))
        hist[a] += n
        hist[64 - a] += n
    combos = packing.combinations(hist)
    placed = sum(len(c) * n for c, n in zip(combos, packing.nnls_counts(hist, combos).tolist(), strict=True))
    assert placed >= 0.98 * hist.sum()


@pytest.mark.parametrize("seed", range(3))
def test_plan_fills_sequences_without_gaps(seed):
    """Every remainder of every rank, laid out: each token position of a sequence is taken once."""
    rng = np.random.default_rng(seed)
    hist = rng.integers(0, 40, 32)
    hist[0] = 0
    plan, at = packing.Plan(hist, 5), Counter()
    for length in range(1, 32):
        for rank in range(int(hist[length])):
            pieces = plan.place(length, rank)
            assert [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces[:-1]]]).tolist() and sum(p[1] for p in pieces) == length
            for _, n, seq, off in pieces:
                at.update((seq, off + k) for k in range(n))
    assert set(at.values()) == {1}
    seqs = sorted({s for s, _ in at})
    assert seqs == list(range(5, 5 + len(seqs))) and len(at) == int((hist * np.arange(32)).sum())
    assert sum(len([1 for k in range(32) if (s, k) in at]) < 32 for s in seqs) <= 1


def words_of(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_counts_of_scores(spark):
    """held_out, n_tokens, n_known and train_tokens of every document; a longer common text is likelier by byte than an unseen one."""
    texts = {i: t for i, t in enumerate(["the cat sat", "The dog sat", "the cat", "", None, "a\x0bb c", "zebra quagga", "the the the", "é É", "cat dog", "sat the cat on"] * 2)}
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame([(i, t, 0.0, 9) for i, t in texts.items()], "doc_id long, text string, score double, n_known int"), depth=4).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    train = Counter(w for i, t in texts.items() if not held[i] for w in [*words_of(t), None])
    n, v = sum(train.values()), len(train)
    for i, t in texts.items():
        tokens = [*words_of(t), None]
        base = sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(w in train for w in tokens), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and r.score < 0
    assert any(held.values()) and not all(held.values())


def test_one_very_long_text(spark):
    """Half a million words in one row beside short ones: whole, in every operator on texts that works without training."""
    rng = np.random.default_rng(15)
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"], 500_000))
    rows = [(1, long), (2, long + " end"), (3, long[:40_000]), (4, "short text"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}[2] == 1
    sizes = {i: len((t or "").encode()) for i, t in rows}
    cut = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert {i: r.n_bytes for i, r in cut.items()} == sizes
    assert cut[2].n_removed == sizes[1] + 0 and cut[3].n_removed == sizes[3] and cut[4].n_removed == 0
    assert cut[2].kept_sha256 == hashlib.sha256(b" end").hexdigest()
    tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    n = {r.doc_id: r.n_tokens for r in bpe.bpe_digest(docs, tokenizer).collect()}
    packed = packing.pack(docs, tokenizer).toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: k + 1 for i, k in n.items()} and n[1] >= 500_000
    scored = {r.doc_id: r for r in ctw.score(docs, depth=3).collect()}
    assert scored[1].n_tokens == 500_001 and all(np.isfinite(r.score) for r in scored.values())
    assert {r.doc_id: r["size"] for r in sharding.shard(docs).collect()} == {i: k + 1 for i, k in sizes.items()}


def test_stages_take_empty_tables(spark, tmp_path):
    """No document and no label: each stage returns no row, in its own columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_stages_leave_other_columns_out(spark, tmp_path):
    """Columns with names that the operators use inside do not come through or get in the way."""
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rows = [(i, f"plain words number {i} and no more of them here", "en", "s", 9, i, b"x", 0.9, 7) for i in range(12)] + [(None, "no id at all", None, None, None, 0, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block long, ids binary, score double, component_id long")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == pipeline.COLUMNS and out.count() == 13, name
    assert stage_ids(pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}")) == {*range(12), None}


def stage_ids(rows):
    return {r.doc_id for r in rows.select("doc_id").collect()}


def test_block_tables_of_contexts():
    """Grams, their counts and the tables of log gamma against plain loops."""
    from math import lgamma, log, pi

    rng = np.random.default_rng(6)
    stream = rng.integers(0, 256, 300, dtype=np.uint8)
    for depth in (2, 6, 7):
        want = [int.from_bytes(bytes([*stream[t - depth : t][::-1].tolist(), int(stream[t])]), "big") for t in range(depth, 300)]
        assert ctw.grams(stream, depth).tolist() == want
    texts = [b" ".join(bytes(rng.integers(97, 103, int(n), dtype=np.uint8)) for n in rng.integers(1, 9, int(k))) for k in rng.integers(0, 40, 600)]

    def streams(texts, depth):
        sizes = np.array([len(t) for t in texts], np.int64)
        return ctw.Streams({"ids": np.arange(len(texts), dtype=np.int64).tobytes(), "sizes": sizes.tobytes(), "texts": zlib.compress(b"".join(texts))}, depth, 5, 1)

    for some, depth in ((texts, 7), (texts[:1], 7), (texts[:3], 3), ([b""], 7)):
        s = streams(some, depth)
        want: dict = {}
        for k, t in enumerate(some):
            padded = b"\n" * depth + b" ".join(t.split()) + b"\n"
            for at in range(depth, len(padded)):
                key = int.from_bytes(padded[at - depth : at][::-1] + padded[at : at + 1], "big")
                want[key] = want.get(key, 0) + (zlib.crc32(b"%d" % k) % 5 != 1)
        keys, counts = s.table(0)
        assert list(zip(keys.tolist(), counts.tolist(), strict=True)) == sorted(want.items())
        assert s.keys(0).tolist() == keys.tolist() and s.keys(1).tolist() == s.table(1)[0].tolist()
    for z, o in [(0, 0), (3, 5), (ctw.SMALL - 1, ctw.SMALL - 1), (ctw.SMALL, 1), (2, ctw.SMALL), (10**9, 7)]:
        plain = lgamma(z + 0.5) + lgamma(o + 0.5) - lgamma(z + o + 1) - log(pi)
        assert abs(ctw.log_kt(np.array([float(z)]), np.array([float(o)]))[0] - plain) < 1e-6 * max(1, abs(plain))
