"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each link is a logistic model on hashed word features and on the
probabilities of the links before it; while training, those probabilities are out-of-fold predictions, so a later
link sees earlier ones as uncertain as they will be on new documents.

Features of a text: the set of its lower-cased words and their beginnings of four and five letters, hashed. Each
link keeps the features that tell its classes apart best and scales them by their log-count ratio.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import map_arrow

#: Labelled documents that the chain is fitted on, at most: this many toxic ones and twice as many others.
TRAIN_TOXIC = 1500
#: Features of a link, folds of the out-of-fold predictions, and the size of the hash space.
LINK_FEATURES, FOLDS, SPACE = 2000, 3, 1 << 20
#: The chain's categories in order, each a condition on the label columns toxic and quality.
CATEGORIES = (("toxic_prose", "toxic = 1 AND quality = 1"), ("toxic_junk", "toxic = 1 AND quality = 0"), ("toxic", "toxic = 1"))

_WORD = re.compile(r"[^\W\d_]+")
_KNOWN: dict[str, tuple[int, int, int]] = {}
#: Words that a worker remembers at most: bounds memory, not results.
KNOWN_WORDS = 60_000


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed features of the whole text."""
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        got = _KNOWN.get(word)
        if got is None:
            got = tuple(zlib.crc32(f"{kind}{part}".encode()) % SPACE for kind, part in (("w", word), ("4", word[:4]), ("5", word[:5])))
            if len(_KNOWN) >= KNOWN_WORDS:
                _KNOWN.clear()
            if len(word) < 40:
                _KNOWN[word] = got
        found.update(got)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Link:
    """One linear model: log-count ratio times weight by feature, weights of the earlier probabilities, bias."""

    weights: np.ndarray  # of SPACE
    earlier: np.ndarray
    bias: float

    def probability(self, docs: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        scores = np.array([self.weights[d].sum() for d in docs]) if docs else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(scores + before @ self.earlier + self.bias, -40, 40)))


def _fit_link(docs: list[np.ndarray], before: np.ndarray, y: np.ndarray, steps: int = 150) -> Link:
    n, positive = len(y), int(y.sum())
    if positive in (0, n):  # nothing to learn: the share of this class, never quite sure
        p = (positive + 0.5) / (n + 1)
        return Link(np.zeros(SPACE), np.zeros(before.shape[1]), float(np.log(p / (1 - p))))
    flat, row = np.concatenate(docs), np.repeat(np.arange(n), [len(d) for d in docs])
    pos = np.bincount(flat, weights=y[row], minlength=SPACE)
    neg = np.bincount(flat, minlength=SPACE) - pos
    ratio = np.log((pos + 0.5) / (positive + 1)) - np.log((neg + 0.5) / (n - positive + 1))
    seen = (pos + neg) >= 2
    gap = np.where(seen, np.abs(pos / positive - neg / (n - positive)) * np.abs(ratio), 0)
    kept = np.argsort(-gap, kind="stable")[:LINK_FEATURES]
    kept = kept[gap[kept] > 0]
    column = np.full(SPACE, -1)
    column[kept] = np.arange(len(kept))
    use = column[flat] >= 0
    col, row = column[flat[use]], row[use]
    value = ratio[kept][col]
    w, e, b = np.zeros(len(kept)), np.zeros(before.shape[1]), 0.0
    balance = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))
    moments = [np.zeros(len(kept)), np.zeros(len(e)), 0.0, np.full(len(kept), 1e-8), np.full(len(e), 1e-8), 1e-8]
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=value * w[col], minlength=n) + before @ e + b
        err = balance * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) / n
        grads = (np.bincount(col, weights=value * err[row], minlength=len(kept)) + 1e-4 * w, before.T @ err + 1e-4 * e, float(err.sum()))
        for i, g in enumerate(grads):  # Adam
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 3] = 0.99 * moments[i + 3] + 0.01 * g * g
        move = [0.05 * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 3] / (1 - 0.99**step)) + 1e-8) for i in range(3)]
        w, e, b = w - move[0], e - move[1], b - float(move[2])
    weights = np.zeros(SPACE)
    weights[kept] = w * ratio[kept]
    return Link(weights, e, b)


@dataclass
class Chain:
    names: list[str]
    links: list[Link] = field(default_factory=list)

    def probabilities(self, docs: list[np.ndarray]) -> np.ndarray:
        """A row a document, a column a category in the order of the chain."""
        before = np.zeros((len(docs), 0))
        for link in self.links:
            before = np.column_stack([before, link.probability(docs, before)])
        return before


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, names: list[str], folds: np.ndarray) -> Chain:
    """labels: a row a document, a column a category; folds: the fold of each document, 0 to FOLDS-1."""
    chain, before = Chain(names), np.zeros((len(docs), 0))
    for j in range(len(names)):
        y = labels[:, j].astype(float)
        out = np.zeros(len(docs))
        for fold in range(FOLDS) if j + 1 < len(names) else ():
            rest, held = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(rest) and len(held):
                link = _fit_link([docs[i] for i in rest], before[rest], y[rest])
                out[held] = link.probability([docs[i] for i in held], before[held])
        chain.links.append(_fit_link(docs, before, y))
        before = np.column_stack([before, out])
    return chain


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few texts at a time: their features are held together."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        texts = batch.column(batch.num_columns - 1)
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "f"])


def train(docs: DataFrame, labels: DataFrame, *, categories=CATEGORIES, key: str = "doc_id", text: str = "text", limit: int = TRAIN_TOXIC, seed: int = 1) -> Chain:
    """Fit the chain on a sample of at most ``limit`` toxic and 2 * ``limit`` other labelled documents, those with the smallest hashes.

    Labels of one document that disagree count as toxic; null labels are left out; labels without a document are
    too. Of several texts of one labelled key the least one is used, so the sample has a row a key however often the key
    is there. Without labels, every category has probability 1/2.
    """
    names = [n for n, _ in categories]
    marks = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max("toxic").alias("toxic"), F.max(F.coalesce("quality", F.lit(1))).alias("quality"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"))
    sample = marks.where("toxic = 1").orderBy(order, "key").limit(limit).unionByName(marks.where("toxic = 0").orderBy(order, "key").limit(2 * limit))
    marked = sample.select("key", "toxic", *(F.expr(cond).cast("int").alias(f"y{i}") for i, (_, cond) in enumerate(categories)))
    # At most 3 * limit short rows.
    joined = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(F.broadcast(marked), "key")
    ys = [f"y{i}" for i in range(len(names))]
    ddl = ", ".join(["key long", *(f"{y} int" for y in ys), "f array<int>"])
    one = joined.groupBy("key", *ys).agg(F.min("text").alias("text"))
    rows = sorted(map_arrow(one.select("key", *ys, "text"), _featurize, ddl).collect(), key=lambda r: r["key"])
    if not rows:
        return Chain(names, [Link(np.zeros(SPACE), np.zeros(j), 0.0) for j in range(len(names))])
    folds = np.array([zlib.crc32(str(r["key"]).encode()) % FOLDS for r in rows])
    return fit_chain([np.array(r["f"], np.int32) for r in rows], np.array([[r[y] for y in ys] for r in rows]), names, folds)


def _score(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        got = chain.probabilities([features(t.as_py()) for t in batch.column(batch.num_columns - 1)])
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(got[:, j]) for j in range(got.shape[1]))], names=[*batch.schema.names[:-1], *(f"p_{n}" for n in chain.names)])


def score(docs: DataFrame, chain: Chain, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, p_<category>..., rejected) for each row: rejected if the last category's probability reaches ``threshold``.

    Defined cases: null and empty texts have no features and get the chain's bias; null keys stay null; repeated
    rows each get the same result; an empty table gives no rows; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ddl = ", ".join(["key long", *(f"p_{n} double" for n in chain.names)])
    got = map_arrow(rows, lambda it: _score(it, model.value), ddl)
    return got.select(F.col("key").alias(key), *(f"p_{n}" for n in chain.names), (F.col(f"p_{chain.names[-1]}") >= threshold).alias("rejected"))


def _keep(batches: Iterator[pa.RecordBatch], chain: Chain, column: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for some in _slices(batches):
        p = chain.probabilities([features(t.as_py()) for t in some.column(column)])[:, -1]
        yield some.filter(pa.array(p < threshold))


def drop_toxic(docs: DataFrame, chain: Chain, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rejected rows: one pass, no join.

    Defined cases: null and empty texts are judged by the chain's bias; null keys take part; repeated rows are kept or
    dropped alike; an empty table gives no rows; columns of any name stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    column = docs.columns.index(text)
    return map_arrow(docs, lambda it: _keep(it, model.value, column, threshold), docs.schema)
