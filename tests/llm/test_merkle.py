"""The manifest against the contract restated with whole lists and plain hashes."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from contiguum.llm import merkle as mk

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc, text, lang, source, n):
    return sha(*map(spelled, (doc, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    out = []
    for low in levels[:-1]:
        run = low[at - at % 8 : at - at % 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def restated(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = mine, levels_of([leaf_of(*r) for r in mine])
    top = levels_of([trees[lang][1][-1][0] for lang in langs])
    out = Counter()
    for k, lang in enumerate(langs):
        mine, levels = trees[lang]
        for at, (doc, text, _, source, n) in enumerate(mine):
            path = siblings(levels, at) + siblings(top, k)
            hit = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 == 0
            node = leaf_of(doc, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if hit else text, lang, source, n)
            for left, right in path:
                node = sha(*left, node, *right)
            out[doc, levels[0][at], levels[-1][0], top[-1][0], sha(*(s for pair in path for side in pair for s in side)), node, node == top[-1][0]] += 1
    return out


def made(n, langs, seed=1):
    rnd = random.Random(seed)
    texts = ["Some Text", "lower", "ÀÉ Upper", "", None, "naïve É", "X" * 50_000, "İI"]
    rows = [(rnd.choice([k, k, k, k // 2, None if rnd.random() < 0.02 else k]), rnd.choice(texts), rnd.choice(langs), rnd.choice(["web", "", None, "bücher"]), rnd.choice([None, k, -k])) for k in range(n)]
    return rows + rows[:5] + [rows[0]] * 20


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (40, ["en", None, "", "de", "é"]), (700, ["en", "en", "en", "de", None]), (60, [f"l{k}" for k in range(30)]), (4200, ["en"])])
def test_manifest(spark, n, langs):
    rows = made(n, langs) if n > 1 else [(7, "A", "en", None, 1)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS tree", "2 AS place", "3 AS leaf", "4 AS node").repartition(3)
    got = Counter(tuple(r) for r in mk.manifest(df).collect())
    assert got == restated(rows)
    assert n == 1 or {r[-1] for r in got} == {True, False}


def test_many_tiers(spark, monkeypatch):
    """Blocks of 8 leaves, tier upon tier, come to the same root; here, as workers have their own constants."""
    for name, value in (("LEVELS", 1), ("BLOCK", 8)):
        monkeypatch.setattr(mk, name, value)
    rows = made(700, ["en", "en", "en", "en", "de", None, *[f"l{k}" for k in range(12)]], seed=4)
    listed = mk.leaves(spark.createDataFrame(rows, COLUMNS)).collect()
    want = {}
    for lang in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        want[lang] = levels_of([leaf_of(*r) for r in mine])[-1][0]
    assert {r.leaf.hex() for r in listed} == {leaf_of(*r) for r in rows}
    for lang, root in want.items():
        nodes = [r.leaf for r in sorted((r for r in listed if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.leaf))]
        while True:
            single = len(nodes) <= 8
            nodes = [bytes.fromhex(mk.Midstates(nodes[k : k + 8], single).root.decode()) for k in range(0, len(nodes), 8)]
            if single:
                break
        assert nodes[0].hex() == root


def test_midstates_fold():
    rnd = random.Random(2)
    for n in (1, 2, 8, 9, 65, 300):
        nodes = [rnd.randbytes(32) for _ in range(n)]
        m = mk.Midstates(nodes, True)
        assert m.root.decode() == levels_of([x.hex() for x in nodes])[-1][0]
        for k in {0, n // 2, n - 1}:
            new = rnd.randbytes(32).hex()
            assert m.folded(k, new.encode()).decode() == levels_of([new if j == k else x.hex() for j, x in enumerate(nodes)])[-1][0]


def test_empty(spark):
    assert mk.manifest(spark.createDataFrame([], COLUMNS)).count() == 0


def test_states_resume():
    """A state before a slot, as 32 bytes, goes on to the digest that all children give."""
    rnd = random.Random(3)
    for n in (1, 3, 8, 9, 20):
        nodes = [rnd.randbytes(32).hex().encode() for _ in range(n)]
        paths = []
        for k, state in enumerate(mk.midstates(nodes)):
            first = k - k % 8
            left = b"".join(nodes[first:k])
            paths.append([{"left": b"?" * len(left), "right": b"".join(nodes[k + 1 : first + 8]), "state": state}])  # the left is in the state
        new = [rnd.randbytes(32).hex().encode() for _ in range(n)]
        want = [hashlib.sha256(b"".join([*nodes[k - k % 8 : k], new[k], *nodes[k + 1 : k - k % 8 + 8]])).hexdigest() for k in range(n)]
        assert [x.decode() for x in mk.resumed(new, range(n), paths)] == want
        assert mk.resumed(new, range(n), [[]] * n) == new


@pytest.mark.parametrize("side", ["root", "right", "state"])
def test_unchanged_leaves_are_folded(spark, side):
    """A leaf that nothing tampered with does not verify against another root, or with a wrong sibling or state above."""
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    subroot, other = (levels_of([x.hex() for x in nodes])[-1][0], sha("other"))
    root = sha(subroot, other)
    path = {"left": b"", "right": other.encode(), "state": mk.midstates([b"0" * 64])[0]}

    def verified(path, root):
        row = ("", 0, 11, [(k, x, k, None) for k, x in enumerate(nodes)], [path], bytes.fromhex(subroot), bytes.fromhex(root))
        got = mk.answers(spark.createDataFrame([row], f"tree string, block long, size long, nodes {mk.NODES}, path {mk.PATH}, subroot binary, root binary")).collect()
        assert len(got) == 11
        return {r.verified for r in got}

    assert verified(path, root) == {True}
    if side == "root":
        root = sha("another")
    elif side == "right":
        path["right"] = sha("another").encode()
    else:
        path["state"] = bytes(32)
    assert verified(path, root) == {False}
