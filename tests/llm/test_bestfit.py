"""Best-fit packing: token ids against the library, pieces and sequences against the contract, the plan against bounds and plain best fit."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contiguum.llm import bestfit as bf
from contiguum.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib(tokenizer):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer)


def test_ids_are_the_librarys(tokenizer, lib):
    enc = bf.coder(bf.load(tokenizer))
    rng = np.random.default_rng(3)
    letters = [*"aeiouthrsn'd .,!?$%<|>\n\té\r0123中½İΣß\x1c\x85\xa0", "\U0001f600", "'ll", "'s", "<|endoftext|>", "   ", "\r\n", "​", "﻿"]
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert enc.encode_to_numpy(t, allowed_special="all").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def plain_best_fit(items, capacity):
    """One piece after another, longest first, into the fullest sequence that has room."""
    room = Counter()
    for n in sorted(items, reverse=True):
        free = min((f for f in room if f >= n and room[f]), default=None)
        if free is not None:
            room[free] -= 1
        room[(capacity if free is None else free) - n] += 1
    return sum(room.values())


@pytest.mark.parametrize("seed", range(12))
def test_counted_best_fit_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 40))
    items = rng.integers(1, capacity + 1, rng.integers(0, 200))
    out = bf.best_fit(np.bincount(items, minlength=capacity + 1))
    assert sum(out.values()) == plain_best_fit(items.tolist(), capacity)
    check(out, items, capacity)


def check(out, items, capacity):
    """All pieces are there, and each sequence holds at most its capacity."""
    got = Counter()
    for c, n in out.items():
        assert sum(a * k for a, k in c) <= capacity and n > 0
        for a, k in c:
            got[a] += k * n
    assert got == Counter(items.tolist())


def lower_bound(hist):
    """For every k: pieces over capacity - k stand alone, those over half in sequences of their own, smaller ones fill what is open."""
    c = len(hist) - 1
    size = np.arange(c + 1) * hist
    best = 0
    for k in range(c // 2 + 1):
        alone, half = hist[c - k + 1 :].sum(), hist[c // 2 + 1 : c - k + 1].sum()
        open_ = half * c - size[c // 2 + 1 : c - k + 1].sum()
        best = max(best, alone + half + max(0, -(-(size[k : c // 2 + 1].sum() - open_) // c)))
    return int(best)


@pytest.mark.parametrize(("low", "high", "n", "most"), [(1, 1024, 30_000, 1.01), (200, 700, 30_000, 1.01), (1, 300, 30_000, 1.001), (300, 400, 30_000, 1.09), (1, 1024, 200, 1.02), (7, 8, 999, 1.0), (513, 1025, 5_000, 1.0)])
def test_plan_is_near_the_bound(low, high, n, most):
    rng = np.random.default_rng(n + low)
    items = rng.integers(low, high, n)
    hist = np.bincount(items, minlength=1025)
    out = bf.solve(hist)
    check(out, items, 1024)
    plain = sum(bf.best_fit(hist).values())
    assert sum(out.values()) <= max(most * lower_bound(hist), lower_bound(hist) + 1)
    assert sum(out.values()) <= 1.006 * plain


def test_linear_program_beats_best_fit_where_best_fit_is_bad():
    hist = np.zeros(1025, np.int64)
    hist[[401, 400, 223, 200, 312]] = 3000, 3000, 3000, 3000, 3000  # 401 + 400 + 223 and 312 x 2 + 400 fill a sequence
    out = bf.solve(hist)
    assert sum(out.values()) < sum(bf.best_fit(hist).values())


def corpus():
    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma,", "delta.", "<|endoftext|>", "épsilon", "  ", "\n", "zeta'll", "12345"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(250)]
    rows += [(1000 + k, "same words here") for k in range(300)]
    return rows + [(5, "again"), (5, "again"), (None, "no id"), (2000, None), (2001, ""), (2002, "very long text " * 30_000), (2003, "a" * 20_000)]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pieces_and_sequences(spark, tokenizer, lib, capacity):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS task", "2 AS rank").repartition(5)
    out = bf.pack(df, tokenizer, capacity=capacity)
    assert out.dtypes == [(f.split()[0], {"long": "bigint"}.get(f.split()[1], f.split()[1])) for f in bf.OUT.split(", ")]
    got, want = out.collect(), Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for held in seqs.values():
        at = 0
        for off, n in sorted(held):
            assert off == at
            at += n
        assert at <= capacity
    hist = np.bincount([r.length for r in got], minlength=capacity + 1)
    assert len(seqs) <= 1.02 * lower_bound(hist) + 1


def test_empty(spark, tokenizer):
    assert bf.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer).count() == 0
