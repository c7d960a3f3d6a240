"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken of every whole text in one narrow pass. Trees grow level
by level on binned statistics with logistic loss, learned from a bounded sample
of labelled rows, and are flattened into arrays: one level of all trees is
one numpy gather for a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 0x61) & (_BYTES <= 0x7A),
        (_BYTES >= 0x41) & (_BYTES <= 0x5A),
        (_BYTES >= 0x30) & (_BYTES <= 0x39),
        _BYTES >= 0x80,
        _BYTES == 0x20,
        _BYTES == 0x0A,
        (_BYTES == 0x2E) | (_BYTES == 0x2C),
        (_BYTES == 0x21) | (_BYTES == 0x3F),
        np.isin(_BYTES, list(b"#$%&*@^~_=+")),
        np.isin(_BYTES, list(b"|/\\<>{}[]")),
    ]
).T.astype(float)
N_FEATURES = 22


def features(text: str | None) -> np.ndarray:
    """N_FEATURES statistics of a whole text; null is as empty."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES)
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[:10] = counts @ _CLASSES / n
    share = counts[counts > 0] / n
    out[10] = -(share * np.log2(share)).sum()
    words = raw.split()
    if words:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        distinct = len(set(words))
        out[11] = np.log1p(len(words))
        out[12] = sizes.mean()
        out[13] = sizes.std()
        out[14] = distinct / len(words)
        out[15] = distinct / np.sqrt(len(words))
        out[16] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        out[17] = sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in words) / len(words)
        out[18] = sum(w.isupper() for w in words) / len(words)
    lines = raw.split(b"\n")
    ends = sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines)
    out[19] = ends / len(lines)
    out[20] = len(set(lines)) / len(lines)
    out[21] = len(words) / len(lines)
    return out


class Forest(NamedTuple):
    """Complete binary trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if the statistic is larger
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        margin = self.base + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def learn(
    x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, smooth: float = 1.0
) -> Forest:
    """Boosted trees on the rows of x. Without rows all score one half; with one label, close to it."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(x):
        return Forest(np.zeros((1, inner), int), np.zeros((1, inner)), np.zeros((1, leaves)), 0.0, depth)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), base)
    features_, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            at = (node - first) * bins
            for f in range(width):
                g, h = (
                    np.bincount(at + binned[:, f], weights=w, minlength=count * bins).reshape(count, bins)
                    for w in (grad, hess)
                )
                gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                gain[:, len(edges[f]) :] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(count), cut]
                for k in np.flatnonzero(top > best + 1e-12):
                    best[k] = top[k]
                    feature[first + k], threshold[first + k] = f, edges[f][cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=leaves) for w in (grad, hess))
        value = -rate * g / (h + smooth)
        margin = margin + value[leaf]
        features_.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.stack(features_), np.stack(thresholds), np.stack(values), base, depth)


def _held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 20_000, **options) -> Forest:
    """Trees learned from labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    At most max_rows labels are taken, those with the smallest hash of the id, so
    the choice depends on nothing else. Null ids and labels take no part; ids that
    repeat count as often as they are paired, but of the pairs as well no more than max_rows are
    learned from. Only texts of chosen rows are turned into statistics, and only those reach the driver.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("y"))
        .where("id is not null and y is not null")
        .where(~_held_out("id"))
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(max_rows)
    )
    # At most max_rows ids and labels: a proven bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "id", "y"])

    id_type = chosen.schema["id"].dataType.simpleString()
    paired = rows.mapInArrow(run, f"x array<double>, id {id_type}, y double").orderBy(F.xxhash64("id"), "id", "y", "x").limit(max_rows)
    got = sorted((tuple(r.x), r.y) for r in paired.select("x", "y").collect())
    x = np.array([r[0] for r in got]).reshape(len(got), N_FEATURES)
    return learn(x, np.array([r[1] for r in got]), **options)


def scored(docs: DataFrame, forest: Forest, *, text_col: str = "text") -> DataFrame:
    """docs with a double quality_score of each row's whole text; one of that name is replaced."""
    docs = docs.drop("quality_score")
    at = docs.columns.index(text_col)
    names = [*docs.columns, "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x), pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", quality_score double"
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. A null id is not held out; its text is scored."""
    forest = fit(docs, labels, **options)
    out = scored(docs.select("doc_id", "text"), forest).select("doc_id", "quality_score")
    return out.select(
        "doc_id",
        F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs that score threshold or more, columns unchanged."""
    names = docs.columns
    at = {"quality_score": "__quality_score"} if "quality_score" in names else {}
    out = scored(docs.withColumnsRenamed(at), fit(docs, labels, **options)).where(F.col("quality_score") >= threshold)
    return out.drop("quality_score").withColumnsRenamed({v: k for k, v in at.items()})
