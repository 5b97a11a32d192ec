"""Nearest neighbours and URL rules against brute force; repeats by random shifts; hashes."""

import hashlib
import itertools
import time
from collections import Counter

import numpy as np
import pytest

from contiguum.llm import ann, blocks, ctw, jaccard_join, queries, repeats, url_rules


def exact(rows, asked, k=5):
    """(query, rank) -> (id, score) by all cosines; an id counts with its best score."""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q in asked:
            best: dict = {}
            for i, w in good:
                if i != q:
                    best[i] = max(best.get(i, -2.0), float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)))
            for r, i in enumerate(sorted(best, key=lambda i: (-round(best[i], 12), i))[:k], 1):
                out[q, r] = (i, best[i])
    return out


def test_nearest_with_repeated_ids(spark):
    """One id ten times, the query's own among them, must not push other candidates out."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(60)]
    rows += [(7, rows[7][1])] * 10 + [(0, rows[0][1])] * 10 + [(7, (np.array(rows[0][1]) * 2).tolist())] + [(90, rows[5][1]), (91, rows[5][1])]
    rows += [(None, rows[3][1]), (92, None), (93, [0.0] * 12), (94, [float("inf")] * 12), (95, [None] * 12)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 30 = 0")).collect()}
    want = exact(rows, {0, 30, 90})
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) == 15
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    few = ann.nearest(df.filter("vec_id in (7, 30, 31)"), df.filter("vec_id = 30")).collect()
    assert sorted(r.vec_id for r in few) == [7, 31]


def test_recall(spark):
    """Recall over vectors with near neighbours, and over ones without."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 64))
    x = np.concatenate([base[rng.integers(60, size=1200)] + 0.4 * rng.standard_normal((1200, 64)), rng.standard_normal((1200, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -2
        want |= {(q, int(i)) for i in np.argsort(-s)[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(8)
    x, q = ann.unit(rng.standard_normal((500, 48))), ann.unit(rng.standard_normal((40, 48)))
    turn = ann.rotation(48, 256, 1)
    codes, factor = ann.encode(x, turn)
    est = ann.estimates(np.ascontiguousarray(codes.T), factor, q @ turn)
    off = np.abs(est - q @ x.T)
    assert codes.shape == (500, 32) and (off <= ann.bounds(factor, 256, 3.0)).mean() > 0.99 and off.mean() < 0.06


def brute_rules(baskets, need, confidence, longest):
    """Smallest token sets with enough bad pages and confidence."""
    found: list[frozenset] = []
    names = sorted(set().union(*(t for t, _ in baskets)))
    for size in range(1, longest + 1):
        for combo in itertools.combinations(names, size):
            s = frozenset(combo)
            hit = [bad for t, bad in baskets if s <= t]
            if sum(hit) >= need and sum(hit) >= confidence * len(hit) and not any(f <= s for f in found):
                found.append(s)
    return found


def test_mined_rules(spark):
    """Verdicts equal those of a miner that tries all token sets."""
    rng = np.random.default_rng(9)
    parts = ["a", "b", "c", "d", "e"]
    urls, bad = [], []
    for i in range(300):
        steps = sorted(rng.choice(parts, rng.integers(1, 4), replace=False))
        host = str(rng.choice(["x.net", "y-z.net", "q.info"]))
        urls.append(f"http://{host}/{'/'.join(steps)}/{i}")
        odds = 0.95 if {"a", "b"} <= set(steps) or ({"c", "d"} <= set(steps) and host == "q.info") else 0.25
        bad.append(bool(rng.random() < odds))
    pages = spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0, 1) for i, b in enumerate(bad) if i % 4], "doc_id long, quality int, toxic int, page_id int")
    tokens = [{r for r in row.t} for row in pages.select(url_rules.tokens(*url_rules.host_and_path(pages.url)).alias("t"), "page_id").orderBy("page_id").collect()]
    train = [(tokens[i], bad[i]) for i in range(300) if i % 4]
    rules = brute_rules(train, max(3, -(-int(0.03 * sum(b for _, b in train) * 1000) // 1000)), 0.7, 4)
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages, labels, [], support=0.03, confidence=0.7).collect()}
    want = {i: "block" if any(r <= t for r in rules) else "allow" for i, t in enumerate(tokens)}
    assert got == want and set(want.values()) == {"allow", "block"} and any(len(r) > 1 for r in rules)


def minimal_rules(baskets, need, confidence):
    """Smallest rules of any length, level by level: only sets with enough bad pages and no rule inside are extended."""
    names = sorted(set().union(*(t for t, _ in baskets)))
    found, level = [], [frozenset()]
    while level:
        wider = {s | {n} for s in level for n in names if not s or n > max(s)}
        level = []
        for s in sorted(wider, key=sorted):
            hit = [bad for t, bad in baskets if s <= t]
            if sum(hit) < need or any(f <= s for f in found):
                continue
            (found if sum(hit) >= confidence * len(hit) else level).append(s)
    return found


def test_wide_pages_are_mined_whole(spark):
    """Fourteen noise tokens a page: verdicts equal brute force, and do not depend on where projections end and FP-growth begins."""
    rng = np.random.default_rng(21)
    noise = [f"n{chr(97 + k)}" for k in range(14)]
    urls, bad = [], []
    for i in range(160):
        steps = [n for n in noise if rng.random() < 0.8]
        hit = {"na", "nb", "nc", "nd", "ne"} <= set(steps)
        urls.append("http://x.net/" + "/".join(steps))
        bad.append(bool(rng.random() < (0.9 if hit else 0.2)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, b in enumerate(bad) if i % 4], "doc_id long, quality int, toxic int")
    tokens = [set(r.t) for r in pages.select(url_rules.tokens(*url_rules.host_and_path(pages.url)).alias("t"), "page_id").orderBy("page_id").collect()]
    train = {(u, i) for i, u in enumerate(urls) if i % 4}
    train = [(tokens[i], bad[i]) for _, i in sorted(train)]
    need = max(3, -(-int(0.2 * sum(b for _, b in train) * 1000) // 1000))
    rules = minimal_rules(train, need, 0.7)
    assert max(map(len, rules)) > 4
    want = {i: "block" if any(r <= t for r in rules) else "allow" for i, t in enumerate(tokens)}
    assert set(want.values()) == {"allow", "block"}
    for width in (5, 10, 20):
        got = url_rules.url_verdicts(pages, labels, [], support=0.2, confidence=0.7, width=width)
        assert {r.page_id: r.verdict for r in got.collect()} == want, width


def test_long_paths_take_no_longer(spark):
    """Sixty pages below one path of thirty segments, with longer and longer parts of it."""
    path = "/".join(f"step{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    rows = [(i, f"http://good.net/{path}/p{'x' * i}") for i in range(60)] + [(100 + i, f"http://good.net/{'/'.join(path.split('/')[: 1 + i % 30])}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    start = time.time()
    assert url_rules.url_verdicts(pages, labels, queries.URL_RULES).count() == 120
    assert time.time() - start < 60
    assert url_rules.url_verdicts(pages.filter("false"), labels, queries.URL_RULES).count() == 0


def test_thue_morse_words_stay_apart(spark):
    """Two words of 1,024 letters that every polynomial modulo 2^64 takes for equal."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    raw = np.frombuffer((one + two).encode(), np.uint8)
    h = blocks.word_hash(raw, np.array([0, 1024]), np.array([1024, 2048]), jaccard_join.TABLE)
    assert h[0] != h[1]
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.train_tokens for r in ctw.score(df, depth=3).collect()}
    assert len({r.kept_sha256 for r in repeats.remove_repeats(df.filter("doc_id < 3")).collect()}) == 2


def test_word_hash_does_not_depend_on_pieces():
    rng = np.random.default_rng(10)
    sizes = np.concatenate([rng.integers(1, 90, 500), [5000]])
    words = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in sizes]
    raw, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
    each = [blocks.word_hash(raw, end[k : k + 1] - sizes[k], end[k : k + 1], jaccard_join.TABLE)[0] for k in range(len(words))]
    for step in (1, 100, 1 << 19):
        assert blocks.word_hash(raw, end - sizes, end, jaccard_join.TABLE, step).tolist() == each
    assert len(set(each)) == len(set(words))


@pytest.mark.parametrize("period", repeats.COVERS)
def test_covers(period):
    cover = repeats.COVERS[period]
    steps = Counter((a - b) % period for a in cover for b in cover if a != b)
    assert steps == dict.fromkeys(range(1, period), 1)


@pytest.mark.parametrize("length", [16, 26, 40, 100])
def test_repeats_at_any_shift(spark, length):
    rng = np.random.default_rng(length)
    text = lambda n: "".join(rng.choice(list("abcdefghé"), n))
    shared = [text(int(n)) for n in (length - 8, length, length + 1, 2 * length, 5 * length, 9 * length)]
    rows = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 2 * length))) for _ in range(4)]
        rows.append((i * 5 % 61, parts[0] + str(rng.choice(shared)) + parts[1] + str(rng.choice(shared)) + parts[2]))
    rows += [(200, "ab" * 300), (201, "a" * 700), (202, rows[3][1]), (203, shared[5][3:-2]), (204, ""), (205, None), (206, shared[5][: length + 3])]
    first: set[bytes] = set()
    want = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in first:
                gone[k : k + length] = True
            first.add(b[k : k + length])
        want[i] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary")
    assert {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df, length).collect()} == want
