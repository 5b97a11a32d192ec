"""Toxicity scoring by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; all texts of the training fold, without their labels, are the unlabelled
set.  The risk of a linear logistic classifier over hashed words and word stems is estimated from the two with the class
prior, and the part for negatives is held at or above zero: where its estimate falls below, it
no longer pulls.  Training runs in numpy on the driver over a bounded sample; scoring runs where the texts are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import give_back, lean, narrow_batches, small_batches

DIMS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000
STEMS = (4, 6)
_CACHE: dict[str, tuple[int, ...]] = {}


def slots(text: str | None) -> np.ndarray:
    """Distinct hashed words (letters only, lower case) of a whole text, and their stems of ``STEMS`` letters."""
    words = set(WORD.findall(text.lower())) if text else ()
    if len(_CACHE) > CACHE:
        _CACHE.clear()
    out: set[int] = set()
    for w in words:
        s = _CACHE.get(w)
        if s is None:
            names = [w] + [f"{w[:n]}~" for n in STEMS if len(w) > n]
            s = _CACHE[w] = tuple(zlib.crc32(x.encode()) % DIMS for x in names)
        out.update(s)
    return np.fromiter(out, np.int32, len(out))


def forgetting(batches):
    """The batches of a task; its word cache ends with it, as the worker goes on to other operators."""
    try:
        yield from batches
    finally:
        _CACHE.clear()
        give_back()


class PuClassifier:
    """Linear logistic classifier trained with the non-negative PU risk."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, at: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.weights[at].sum() + self.bias, -40, 40))))

    @staticmethod
    def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 5e-4, least: int = 5, share: float = 3.0) -> PuClassifier:
        """``prior``: share of positives among the unlabelled.  Words have a weight only if they are in ``least`` positives
        (a handful of copies must not make a word toxic) and ``share`` times as common there as in all texts."""
        w, b = np.zeros(DIMS), 0.0
        if not pos:
            return PuClassifier(w, -np.log(1e9))
        if not unl:
            return PuClassifier(w, 0.0)
        prior = min(max(prior, 1e-4), 0.9)
        in_pos = np.bincount(np.concatenate(pos), minlength=DIMS)
        in_unl = np.bincount(np.concatenate(unl), minlength=DIMS)
        # words that stand out among the positives: against chance, by a normal bound, and by their share
        rate_unl = (in_unl + 0.5) / (len(unl) + 1)
        excess = (in_pos - len(pos) * rate_unl) / np.sqrt(len(pos) * rate_unl * (1 - rate_unl))
        names = np.flatnonzero((in_pos >= min(least, max(1, len(pos) // 4))) & (excess > 4) & (in_pos > share * len(pos) * rate_unl))
        col = np.full(DIMS, -1, np.int64)
        col[names] = np.arange(len(names))

        def rows(docs):
            parts = [col[d] for d in docs]
            parts = [p[p >= 0] for p in parts]
            return np.concatenate([*parts, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, parts)])

        w, m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        w[-1] = np.log(prior / (1 - prior))
        def logits(x):
            at, ptr = x
            total = np.concatenate([[0.0], np.cumsum(w[at])])
            return total[ptr[1:]] - total[ptr[:-1]] + w[-1]

        def pull(x, g):
            """Gradient of sum(g * logits)."""
            at, ptr = x
            out = np.bincount(at, np.repeat(g, np.diff(ptr)), minlength=len(w))
            out[-1] = g.sum()
            return out

        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        xp, xu = rows(pos), rows(unl)
        for t in range(1, steps + 1):  # Adam on the whole sample: the risk's estimate is too noisy on parts of it
            zp, zu = logits(xp), logits(xu)
            # logistic loss; positives as negatives are taken out of the unlabelled with the class prior
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = prior * pull(xp, (sig(zp) - 1) / len(zp))
            if negative >= 0:
                g = g + pull(xu, sig(zu) / len(zu)) - prior * pull(xp, sig(zp) / len(zp))
            g[:-1] += decay * w[:-1]
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        full = np.zeros(DIMS)
        full[names] = w[:-1]
        return PuClassifier(full, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> PuClassifier:
    """Train on rows with crc32(id as text) mod ``fold`` != 0.

    ``sample`` bounds what reaches the driver: the confirmed toxic texts, and the unlabelled ones, with the smallest
    hashes of their ids, up to so many each; their word sets are hashed by the executors first.  The class
    prior is the share of toxic rows among all labelled rows of the fold.  A document with several labels is toxic if
    one says so; null labels count as none.
    """
    ship(docs.sparkSession)
    narrow_batches(docs.sparkSession)
    in_fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).filter(in_fold)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    n, n_pos = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).filter(in_fold)

    def hashed(batches):
        for batch in forgetting(small_batches(batches, "text")):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([slots(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["h", "at"])

    def smallest(rows: DataFrame) -> list[np.ndarray]:
        """Word sets of the ``sample`` texts with the smallest hashes of ids.  Copies of one text count once: a copied text says no more than one.

        Hashes alone are sorted; the chosen pairs, bounded by ``sample``, are sent to where the texts are read.
        """
        keyed = rows.select(F.xxhash64("text").alias("t"), F.xxhash64("doc_id").alias("h"), "text")
        chosen = keyed.groupBy("t").agg(F.min("h").alias("h")).orderBy("h", "t").limit(sample)
        found = keyed.join(F.broadcast(chosen), ["t", "h"], "left_semi").select("h", "text").mapInArrow(lean(hashed), "h long, at binary")
        return [np.frombuffer(at, np.int32) for _, at in sorted({(r["h"], bytes(r["at"])) for r in found.collect()})]

    # confirmed toxic ids with the smallest hashes: three times the sample, as copies count once; their number is bounded
    wanted = marks.filter("y = 1").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(3 * sample)
    toxic = texts.join(F.broadcast(wanted), "doc_id", "left_semi")
    # the unlabelled draw is by id hash, so that all but a bounded share of the texts is dropped before any shuffle
    total = max(1, texts.count())
    cut = min(1 << 30, int((1 << 30) * min(1.0, 3.0 * sample / total)))
    drawn = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    return PuClassifier.fit(smallest(toxic), smallest(drawn), (n_pos / n if n else 0.0))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: PuClassifier, fold: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.  Null and empty texts get the score of a text without words; a null id is not held out.
    Rows are independent, so repeated rows come back with equal scores; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        m = PuClassifier(*sent.value)
        for batch in forgetting(small_batches(batches, "text")):
            s = [m.score(slots(t)) for t in batch.column(1).to_pylist()]
            out = [zlib.crc32(str(i).encode()) % fold == 0 if i is not None else False for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, sample: int = 12_000) -> DataFrame:
    """Train on the labelled fold and score all documents; without any toxic label every score is near 0."""
    return score(docs, train(docs, labels, fold, sample), fold)


def keep_clean(docs: DataFrame, model: PuClassifier, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns.  Null and empty texts stay unless a text without
    words is toxic to the model."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches):
        m = PuClassifier(*sent.value)
        for batch in forgetting(small_batches(batches, text_col)):
            yield batch.filter(pa.array([m.score(slots(t)) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
