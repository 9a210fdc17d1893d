"""Quality rules: base rules and gradient-boosted trees over document statistics.

Trees are grown here on histograms with logistic loss; for chosen statistics (repetition, symbols, capitals) a higher
value may only lower the score, which is kept by refusing splits that would raise it and by bounding what grows below a split.
A forest is a few numpy node arrays that score a whole block of documents at once.

The forest is fitted on a bounded sample: the SAMPLE labelled rows that come first by a hash of their id, leaving out the held-out
fifth (crc32 of the id mod 5 = 0). Everything else runs over all rows and whole texts.

Defined results: a null or empty text has no words and fails the base rules; without labels of both kinds there is no
forest, and what passes the base rules is kept; labels that are null or name no document are ignored; of rows that share a labelled id, the one whose
text has the least hash is learnt from; repeated rows and null ids are judged one by one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, documents, filtered, id_and_text, one_text_each, shingle_hashes, steps, word_hashes

SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
KEEP_FROM = 0.5

#: Statistics that the forest sees, and in which direction the score may move with them (-1: only down; 0: freely).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "top_word": -1, "capitals": -1,
    "digits": 0, "marks": -1, "other_ascii": 0, "wide": 0, "words_a_line": 0, "same_as_last": -1, "longest": 0, "ends": 0,
}


def base_counts(text: str) -> tuple[int, int, int, int, int, list[bytes], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the words and their hashes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - sum(raw.count(c) for c in b" \t\n\x0b\f\r")
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    hashes = word_hashes(words)
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes), words, hashes


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    if len(hashes) < window:
        return 0
    found = shingle_hashes(hashes, window)
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes) + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    twice[starts] += 1
    np.subtract.at(twice, starts + window, 1)
    return int((np.cumsum(twice[:-1]) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The base counts and the forest's features of a text."""
    n, chars, symbols, dups, repeats, words, hashes = base_counts(text)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    total = max(1, len(raw))
    _, each = np.unique(hashes, return_counts=True) if n else (None, np.zeros(1, int))
    lines = max(1, raw.count(b"\n") + 1)
    m = max(1, n)
    features = [
        np.log1p(n), chars / m, symbols / max(1, chars), dups / lines, repeats / m, len(each) / m * np.log1p(n), each.max() / m, kinds[0] / total,
        kinds[1] / total, kinds[2] / m, kinds[3] / total, kinds[4] / total, n / lines, float((hashes[1:] == hashes[:-1]).sum()) / m, max(map(len, words), default=0), sum(w.endswith(b".") for w in words) / m,
    ]
    return (n, chars, symbols, dups, repeats), features


CLASS = np.full(256, 5, np.uint8)
CLASS[ord("A") : ord("Z") + 1] = 0
CLASS[ord("0") : ord("9") + 1] = 1
CLASS[list(b"!?|")] = 2
CLASS[list(b"\"'(),-/:;=@[\\]^_`{}~+")] = 3
CLASS[0xC0:] = 4


class Forest(NamedTuple):
    """Trees as node arrays: a leaf points to itself. `first` are the roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    first: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of good quality for rows of features."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.first:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 8) -> Forest:
    """Boosted trees for labels 0/1; directions: 1, -1 or 0 for each feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total = np.full(len(y), start)
    nodes: list[list[float]] = []
    first = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        first.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        stack = [(first[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while stack:
            at, rows, level, low, high = stack.pop()
            value = float(np.clip(g[rows].sum() / (h[rows].sum() + l2), low, high))
            best = _split(binned[rows], g[rows], h[rows], directions, low, high, l2, least, cuts) if level < depth else None
            if best is None:
                nodes[at] = [0, np.inf, at, at, rate * value]
                total[rows] += rate * value
                continue
            f, cut, vl, vr = best
            left, right = len(nodes), len(nodes) + 1
            nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, right, right, 0.0]]
            nodes[at] = [f, cuts[f][cut], left, right, 0.0]
            goes = binned[rows, f] <= cut
            middle = (vl + vr) / 2
            # Below a split on a constrained feature, either side keeps to its half.
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[f]]
            stack += [(left, rows[goes], level + 1, *bounds[0]), (right, rows[~goes], level + 1, *bounds[1])]
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(feature.astype(int), threshold, left.astype(int), right.astype(int), value, np.array(first), start, depth)


def _split(binned, g, h, directions, low, high, l2, least, cuts):
    best, gain = None, 1e-3
    whole = g.sum() ** 2 / (h.sum() + l2)
    for f, direction in enumerate(directions):
        k = len(cuts[f])
        if not k:
            continue
        gl, hl, nl = (np.cumsum(np.bincount(binned[:, f], w, k + 1))[:-1] for w in (g, h, np.ones(len(g))))
        gr, hr, nr = g.sum() - gl, h.sum() - hl, len(g) - nl
        vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
        gains = 2 * vl * gl - vl**2 * (hl + l2) + 2 * vr * gr - vr**2 * (hr + l2) - whole
        gains[(nl < least) | (nr < least) | ((vr - vl) * direction < 0)] = -np.inf
        c = int(gains.argmax())
        if gains[c] > gain:
            best, gain = (f, c, float(vl[c]), float(vr[c])), gains[c]
    return best


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    """A forest from at most `sample` labelled rows; None if they aren't of both kinds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.filter(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = one_text_each(id_and_text(docs, id_col, text_col), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in steps(batches, "y"):
            features = [statistics(t)[1] for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([y for _, y in ids], pa.int32()), pa.array(features, pa.list_(pa.float64()))], ["y", "x"])

    got = texts.mapInArrow(run, "y int, x array<double>").toArrow()
    y = got["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    # Rows come in any order; sums of floats shouldn't depend on it.
    order = np.lexsort((y, *x.T))
    return grow(x[order], y[order], list(FEATURES.values()))


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def verdicts(texts: list[str], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, kept and the score of each text."""
    found = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in found], np.int64).reshape(-1, 5)
    score = forest.score(np.array([x for _, x in found])) if forest and found else np.ones(len(texts))
    failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
    return counts, failed, ~failed & (score >= KEEP_FROM), score


def _judge(forest: Forest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            counts, failed, kept, score = verdicts(texts, forest)
            columns = [pa.array(ids, pa.int64()), *[pa.array(counts[:, k]) for k in range(5)], pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    return run


def drop_poor(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are kept; each row is judged by its own text."""
    return filtered(docs, text_col, lambda: lambda texts: verdicts(texts, forest)[2].tolist())


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, base_failed, the forest's score and the verdict `kept` of every row."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_judge(forest), SCORED)


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, labels_table(spark, sf_dir)))
