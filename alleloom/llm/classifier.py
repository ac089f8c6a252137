"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents

SPACE = b" \t\n\x0b\x0c\r"
BYTE_KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "space": SPACE,
    "stop": b".,;:",
    "loud": b"!?",
    "mark": b"#*$%&|<>",
    "other": b"\"'()[]{}/\\@^_`~+-=",
}
KIND = np.full(256, len(BYTE_KINDS), np.int64)
for _i, _k in enumerate(BYTE_KINDS.values()):
    KIND[list(_k)] = _i
FEATURES = (*(f"share_{k}" for k in (*BYTE_KINDS, "high")), "log_words", "log_chars", "word_length", "word_length_sd", "lines", "line_length", "dup_lines", "unique_words", "top_word", "next_same", "upper_words", "title_words", "entropy", "unique_pairs", "long_words", "ends_stop")


def statistics(text: bytes | None) -> np.ndarray:
    """A text's statistics; a null, empty or blank one has zeros where there is nothing to divide by."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    count = np.bincount(raw, minlength=256)
    share = np.bincount(KIND, weights=count, minlength=len(BYTE_KINDS) + 1) / max(1, len(text))
    p = count[count > 0] / max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    times = np.bincount(ids) if words else np.zeros(1)
    pairs = len(np.unique(ids[:-1] * (len(seen) + 1) + ids[1:])) if len(words) > 1 else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, title = sum(map(bytes.isupper, words)), sum(map(bytes.istitle, words))
    rest = (
        np.log1p(len(words)), np.log1p(len(text)), size.mean(), size.std(), np.log1p(len(lines)), np.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        len(seen) / n, times.max() / n, float((ids[1:] == ids[:-1]).sum()) / n, upper / n, title / n, float(-(p * np.log2(p)).sum()), pairs / n, float((size > 15).sum()) / n, float(text.rstrip()[-1:] in (b".", b"!", b"?")),
    )
    return np.concatenate((share, rest))


@dataclass
class Trees:
    """Flat arrays over all nodes; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows walk down each tree together."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: int = 20) -> Trees:
    """Boosting on the logistic loss; splits are sought on histograms of at most ``bins`` quantile bins. Of equal gains the first feature's lowest edge is taken."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(1) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), np.int64)
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(n, start)
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def node() -> int:
        k = len(out["feature"])
        for name, v in zip(out, (0, np.inf, k, k, 0.0), strict=True):
            out[name].append(v)
        return k

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for deep in range(depth + 1):
            below = []
            for k, rows in level:
                sg, sh = g[rows].sum(), h[rows].sum()
                out["value"][k] = float(rate * sg / (sh + smooth))
                if deep == depth or len(rows) < 2 * least:
                    continue
                flat = (binned[rows] + np.arange(m) * bins).ravel()
                hist = [np.bincount(flat, weights=w, minlength=m * bins).reshape(m, bins).cumsum(axis=1) for w in (np.repeat(g[rows], m), np.repeat(h[rows], m), np.ones(len(flat)))]
                lg, lh, ln = hist
                gain = lg**2 / (lh + smooth) + (sg - lg) ** 2 / (sh - lh + smooth) - sg**2 / (sh + smooth)
                gain[(ln < least) | (len(rows) - ln < least)] = -1
                f, b = divmod(int(gain.argmax()), bins)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                go = binned[rows, f] <= b
                a, c = node(), node()
                out["feature"][k], out["threshold"][k], out["left"][k], out["right"][k] = f, float(edges[f][b]), a, c
                below += [(a, rows[go]), (c, rows[~go])]
            for k, rows in level:
                if out["left"][k] == k:
                    score[rows] += out["value"][k]
            level = below
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Trees(*(np.array(v, t) for v, t in zip(out.values(), kinds, strict=True)), np.array(roots, np.int64), depth, start)


def training_part(doc_id) -> F.Column:
    """Remainder by five of the id's crc32; zero is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **how) -> Trees:
    """Trees from a bounded sample: the ``max_rows`` labelled training rows that come first by the id's hash.

    ``max_rows`` bounds what is broadcast (ids) and what comes to the driver (statistics).
    Null labels and ids, held-out rows and labels of unknown documents are passed over. Without
    any labelled row every text scores one half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("double").alias("y")).dropna()
    chosen = known.where(training_part(F.col("label_id")) != 0).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = documents(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "y", "label_id")

    def make(batch: pa.RecordBatch) -> dict:
        x = [statistics(t) for t in batch["text"].to_pylist()]
        return {"x": pa.array([v.tolist() for v in x], pa.list_(pa.float64())), "y": batch["y"], "label_id": batch["label_id"]}

    # repeated rows or labels may match often; the bound holds for what is collected as well
    got = arrow_map(rows, make, "x array<double>, y double, label_id long").orderBy(F.xxhash64("label_id"), "label_id", "x", "y").limit(max_rows).collect()
    x, y = np.array([r["x"] for r in got], np.float64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], np.float64)
    return fit(x, y, **how)


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every input row; texts alone decide, null ones like empty ones.

    Texts are read whole, however long; rows with equal texts score alike, null ids and repeated rows keep theirs. No documents: no rows.
    """

    def make(batch: pa.RecordBatch) -> dict:
        x = np.stack([statistics(t) for t in batch["text"].to_pylist()]) if batch.num_rows else np.zeros((0, len(FEATURES)))
        s = trees.score(x)
        return {"doc_id": batch["doc_id"], "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return arrow_map(documents(docs, id_col, text_col), make, "doc_id long, score double, predicted int")
