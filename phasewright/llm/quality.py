"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_texts, table, text_batches, utf8

#: Byte classes, each a set of byte values; bytes from 128 on are letters of other alphabets.
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9, 11, 12, 13),
    "newline": (10,),
    "stop": b".?!",
    "comma": b",;:",
    "bang": b"!",
    "pipe": b"|\\/_",
    "symbol": b"#$%&*+<=>@^~`",
    "quote": b"\"'()[]{}",
    "high": range(128, 256),
    "control": [*range(0, 9), *range(14, 32), 127],
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members), _i] = 1.0

FEATURES = [
    *(f"share_{k}" for k in _CLASSES), "entropy", "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "distinct_words",
    "top_word", "top3_words", "next_equal", "caps_words", "odd_ends", "bare_words", "lines_log", "line_words", "distinct_lines", "short_lines", "stop_lines", "distinct_pairs",
]


def _word_statistics(data: bytes) -> list[float]:
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * (len(FEATURES) - len(_CLASSES) - 1)
    n, counts = len(words), Counter(words)
    top = [c for _, c in counts.most_common(3)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(len(data)), np.log1p(n), sizes.mean(), (sizes > 14).mean(), (sizes < 3).mean(), len(counts) / n,
        top[0] / n, sum(top) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(w[-1] in b"#$%&*!|+<=>@^~" for w in words) / n,
        sum(len(w) < 3 and not w.isalpha() and w[0] < 128 for w in words) / n,
        np.log1p(len(lines)), n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines) / max(1, len(lines)),
        len(set(zip(words, words[1:]))) / n,
    ]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each whole text; all are zero for an empty one."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        data = utf8(text)
        if data:
            histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
            seen = histogram[histogram > 0]
            out[i] = [*(histogram @ _TABLE), -(seen * np.log2(seen)).sum(), *_word_statistics(data)]
    return out


@dataclass
class Trees:
    """Complete trees of one depth as flat arrays: node ``i`` has children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; every tree and row goes one level down at a time."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            while node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[at : at + 4096] = self.prior + self.value[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 5.0, least: int = 8) -> Trees:
    """Histogram gradient boosting of the logistic loss.

    Each statistic is cut into at most ``bins`` bins at its quantiles; a level of
    a tree sums gradients by (node, bin) and takes each node's best cut. A node
    without a gain keeps a cut that sends every row left.
    """
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    if len(np.unique(y)) < 2:
        return Trees(feature, threshold, value, prior if len(y) else 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    f = np.full(len(y), prior)
    built = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tf, tt = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key, size = local * (bins + 1) + binned[:, j], width * (bins + 1)
                gs, hs, ns = (np.bincount(key, w, size).reshape(width, -1).cumsum(axis=1) for w in (g, h, None))
                lg, lh, ln = gs[:, : len(e)], hs[:, : len(e)], ns[:, : len(e)]
                tg, th, tn = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                gain[(ln < least) | (tn - ln < least)] = 0
                cut = gain.argmax(axis=1)
                won = gain[np.arange(width), cut]
                for k in np.flatnonzero(won > best):
                    best[k], tf[first + k], tt[first + k] = won[k], j, e[cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tf[node]] > tt[node])
        leaf = node - inner
        tv = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        f += tv[leaf]
        built.append((tf, tt, tv))
    return Trees(*(np.stack(z) for z in zip(*built, strict=True)), prior)


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is 1 modulo 3; never so for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on at most ``max_rows`` labelled rows outside the held-out part.

    The sample is bounded so that its statistics fit the driver (12,000 rows of
    some thirty numbers) whatever the corpus: the ids with the smallest hashes.
    An id labelled twice counts once, with its smallest label; of several texts
    of one id the least by its statistics counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # max_rows bounds it

    def work(x: dict[str, list]) -> dict[str, object]:
        return {"key": x["_id"], "label": x["_label"], "features": [row.tobytes() for row in statistics(x["_text"])]}

    rows = sorted(map(tuple, map_texts(chosen, ["_id", "_label", "_text"], "key long, label int, features binary", work).groupBy("key", "label").agg(F.min("features")).collect()))
    x = np.stack([np.frombuffer(r[2]) for r in rows]) if rows else np.zeros((0, len(FEATURES)))
    return fit_trees(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and prediction for every whole text; the model is some 20 kB in each task."""

    def work(x: dict[str, list]) -> dict[str, object]:
        s = model.scores(statistics(x[text_col]))
        return {"doc_id": x["_id"], "held_out": x["_held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held_out"), F.col(text_col))
    return map_texts(rows, ["_id", "_held_out", text_col], "doc_id long, held_out boolean, score double, predicted int", work)


def quality_scores(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000) -> DataFrame:
    """Fit on labelled documents, then score all documents.

    Only statistics of the text enter a score. A null or empty text has all
    statistics 0 and gets that score; a null id stays null and is not held out;
    repeated rows are scored each; with no usable label every score is 0.5, with
    one class it is that class's smoothed prior. An empty table gives no rows.
    Other columns are not read.
    """
    return score(docs, train(docs, labels, max_rows=max_rows))


def keep_good(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    A null text is scored as an empty one; null ids are scored like others;
    repeated rows stay or go together. An empty table gives none; columns may have
    any names, and only the id and the text are read.
    """
    model = train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(at, 500).to_pylist() for at in range(0, len(texts), 500)]
        return pa.array(np.concatenate([model.scores(statistics(p)) for p in parts]) if parts else [], pa.float64())

    text_batches(docs.sparkSession)
    return docs.where(scores(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
