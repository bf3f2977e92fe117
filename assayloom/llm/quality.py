"""Quality rules: document statistics, and gradient-boosted trees over them with monotonic constraints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, with_columns, worker_state

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the trees. The sign says how the score may move as the value grows: -1 never up, +1 never down, 0 free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "pipe_share": -1,
    "mark_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "distinct_share": 0,
    "top_word_share": -1,
    "words_per_line": 0,
    "wide_share": 0,
}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text; null counts as empty, and shares of nothing are 0."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = len(text) - int(hist[9:14].sum() + hist[32])
    symbols = int(hist[_SYMBOLS].sum())
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeated, distinct, top = 0, n, min(n, 1)
    if n:
        codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        _, counts = np.unique(codes, return_counts=True)
        distinct, top = len(counts), int(counts.max())
        if n >= 3:
            windows = codes[:-2] * _MIX[0] ^ (codes[1:-1] * _MIX[1] + (codes[2:] * _MIX[2] >> np.uint64(7)))
            windows ^= codes[2:] * _MIX[2]
            _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
            again = times[which] >= 2
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= again
            repeated = int(covered.sum())
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    features = [
        float(np.log1p(n)),
        chars * per_word,
        symbols * per_char,
        int(hist[124]) * per_word,
        int(hist[33] + hist[63]) * per_word,
        dup_lines / max(len(lines), 1),
        repeated * per_word,
        int(hist[65:91].sum()) * per_char,
        int(hist[48:58].sum()) * per_char,
        distinct * per_word,
        top * per_word if n >= 20 else 0.0,
        n / max(len(lines), 1),
        int(hist[128:].sum()) * per_char,
    ]
    return [n, chars, symbols, dup_lines, repeated], features


class BoostedTrees:
    """Trees as flat node arrays. A leaf points to itself, so every tree is walked `depth` steps at once."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.left, self.right, self.roots = (np.asarray(x, np.int32) for x in (feature, left, right, roots))
        self.threshold, self.value = np.asarray(threshold, float), np.asarray(value, float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive label for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    signs: list[int],
    *,
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    min_weight: float = 1.0,
    l2: float = 1.0,
) -> BoostedTrees:
    """Second-order boosting of the logistic loss on quantile bins. signs: per feature -1, 0 or +1, see FEATURES.

    A split that would break a sign is refused, and both children inherit the middle of their values as a bound, so
    the sum of the trees is monotonic in each constrained feature.
    """
    n, p = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(p)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def gain(w, g, h):
        return -(g * w + 0.5 * (h + l2) * w * w)

    def grow(k: int, rows: np.ndarray, grad, hess, level: int, low: float, high: float) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = weight(g, h, low, high)
        value[k] = rate * own
        if level == depth or len(rows) < 2:
            margin[rows] += rate * own
            return
        best = (1e-6, None)
        for j in range(p):
            m = len(cuts[j]) + 1
            if m < 2:
                continue
            b = binned[rows, j]
            gl, hl = np.cumsum(np.bincount(b, grad[rows], m))[:-1], np.cumsum(np.bincount(b, hess[rows], m))[:-1]
            gr, hr = g - gl, h - hl
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            won = gain(wl, gl, hl) + gain(wr, gr, hr) - gain(own, g, h)
            won[(hl < min_weight) | (hr < min_weight) | (signs[j] * (wr - wl) < 0)] = -np.inf
            c = int(np.argmax(won))
            if won[c] > best[0]:
                best = (float(won[c]), (j, c, float(wl[c]), float(wr[c])))
        if best[1] is None:
            margin[rows] += rate * own
            return
        j, c, wl, wr = best[1]
        feature[k], threshold[k], value[k] = j, cuts[j][c], 0.0
        left[k], right[k] = node(), node()
        middle = (wl + wr) / 2
        bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}
        goes = binned[rows, j] <= c
        for child, part, (lo, hi) in ((left[k], rows[goes], bounds[signs[j]][0]), (right[k], rows[~goes], bounds[signs[j]][1])):
            grow(child, part, grad, hess, level + 1, lo, hi)

    for _ in range(n_trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        roots.append(node())
        grow(roots[-1], np.arange(n), grad, hess, 0, -10.0, 10.0)
    return BoostedTrees(base, feature, threshold, left, right, value, roots, depth)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `max_rows` labelled documents: those whose ids come first by hash.

    Of several labels, and of several rows of a document's id, the least counts, so that the bound holds.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )

    def features(batches):
        for b in (part for batch in batches for part in chunks(batch, 0, 4_000_000)):
            yield pa.RecordBatch.from_arrays(
                [b.column(2), b.column(1), pa.array([describe(t)[1] for t in b.column(0).to_pylist()], pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"],
            )

    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("text", F.col("quality").cast("int").alias("quality"), "doc_id")
        .mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x array<double>")
        .groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("least")).select("least.*").toPandas()
    )
    if not len(rows):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    rows = rows.assign(key=rows["x"].map(tuple)).sort_values(["key", "quality"])  # whatever order the tasks ended in
    return np.array(rows["x"].tolist(), float), rows["quality"].to_numpy(float)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_train_rows: int = 4000,
    min_probability: float = 0.25,
    keep_columns: bool = False,
) -> DataFrame:
    """One row per document: doc_id, COUNTS (long), base_failed, quality_score, kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. Otherwise the trees give
    the verdict: kept where the probability of good quality is `min_probability` or more. The trees are fitted on
    the driver on at most `max_train_rows` labelled documents (the only bounded sample); where fewer than 20 are
    labelled, or all alike, there are no trees, the score is null and what passes the base rules is kept.
    keep_columns: return docs' own columns for the kept rows instead.

    Null text has no words and fails. Null ids, repeated rows and equal texts are judged row by row, so ties can't
    arise; an empty table gives an empty one. Only doc_id and text are read unless keep_columns. No shuffle of texts.
    """
    x, y = training_rows(docs, labels, max_train_rows)
    model = fit_trees(x, y, list(FEATURES.values())) if len(y) >= 20 and 0 < y.mean() < 1 else None
    model = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if keep_columns else docs.select("doc_id", "text")
    if keep_columns:
        out = T.StructType(docs.schema.fields)
    else:
        out = T._parse_datatype_string(
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
            + ", base_failed boolean, quality_score double, kept boolean"
        )
    at = source.columns.index("text")

    def judge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        worker_state()  # what another operator may have left in this process
        schema, trees = to_arrow_schema(out), model.value
        for b in (part for batch in batches for part in chunks(batch, at, 4_000_000)):
            found = [describe(t) for t in b.column(at).to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            score = trees.predict(np.array([f for _, f in found]).reshape(-1, len(FEATURES))) if trees else None
            kept = ~failed if score is None else ~failed & (score >= min_probability)
            if keep_columns:
                yield with_columns(b, schema).filter(pa.array(kept))
            else:
                yield with_columns(
                    b, schema, base_failed=failed, kept=kept, quality_score=[None] * len(kept) if score is None else score,
                    **{c: counts[:, k] for k, c in enumerate(COUNTS)},
                )

    return source.mapInArrow(judge, out)
