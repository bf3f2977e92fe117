"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks

UNKNOWN = "und"
BITS = 17
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x7FEB352D, 0x846CA68B], np.uint32)
_SCALE = 50.0  # term frequencies are shares times this


def _letters() -> np.ndarray:
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


_FOLD = _letters()


def folded(text: str) -> np.ndarray:
    """Lower-case code points with a space for whatever is no letter, and one before and two after."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes) + 3, 32, np.uint32)
    body = out[1:-2]
    low = codes < 0x10000
    body[low] = _FOLD[codes[low]]
    if not low.all():
        high = codes[~low]
        kinds, which = np.unique(high, return_inverse=True)
        body[~low] = np.array([c if chr(c).isalpha() else 32 for c in kinds.tolist()], np.uint32)[which]
    return out


def grams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams around the letters at the given places."""
    m, shift = _MULTIPLIERS, np.uint32(32 - BITS)
    before, here, after = codes[at - 1], codes[at], codes[at + 1]
    one = (here * m[0] ^ m[6]) * m[1] >> shift
    two = (here * m[2] ^ (after * m[3] + m[4])) * m[0] >> shift
    three = (before * m[5] ^ (here * m[2] + (after * m[6] ^ m[1]))) * m[4] >> shift
    return one, two, three


def counted(text: str | None) -> tuple[list[int], list[float]]:
    """Indices and term frequencies of a text's n-grams."""
    codes = folded(text or "")
    at = np.flatnonzero(codes != 32)
    if not len(at):
        return [], []
    index, times = np.unique(np.concatenate(grams(codes, at)), return_counts=True)
    return index.tolist(), (times * (_SCALE / (3 * len(at)))).tolist()


class Ftrl:
    """Follow the regularised leader, per coordinate, for multinomial logistic loss with elastic-net penalties."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = softmax(x @ w)
        g[label] -= 1
        g = x[:, None] * g[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, r = -0.7, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 3, seed: int = 7) -> dict | None:
    """Languages, weights times inverse document frequencies, biases and temperature; None without rows.

    Every fifth row is left out of the descent and calibrates the temperature.
    """
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    label = {x: i for i, x in enumerate(langs)}
    df = np.zeros(1 << BITS)
    for _, index, _ in rows:
        df[index] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    bias = 1 << BITS
    model, order = Ftrl(bias + 1, len(langs)), np.random.default_rng(seed).permutation(len(rows))
    learn, keep = order[len(order) // 5 :], order[: len(order) // 5]
    full = [(np.append(index, bias), np.append(x * idf[index], 1.0), label[lang]) for lang, index, x in rows]
    for _ in range(epochs):
        for i in learn:
            model.learn(*full[i])
    logits = np.array([x @ model.weights(index) for index, x, _ in (full[i] for i in keep)]).reshape(-1, len(langs))
    temperature = fit_temperature(logits, np.array([full[i][2] for i in keep], int))
    w = model.weights(slice(None))
    return {"langs": langs, "weights": (w[:-1] * idf[:, None]).astype(np.float32), "bias": w[-1], "temperature": temperature}


def predict(model: dict | None, texts: list[str | None], limit: int = 2_000_000) -> tuple[list[str], list[float]]:
    """Language and calibrated probability of each text; UNKNOWN and 0 for null or letterless ones."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    start = 0
    while start < len(texts):
        parts, end, size = [], start, 0
        while end < len(texts) and (not parts or size + len(texts[end] or "") < limit):
            parts.append(folded(texts[end] or ""))
            size += len(parts[-1])
            end += 1
        ends = np.cumsum([len(p) for p in parts])
        codes = np.concatenate(parts)
        at = np.flatnonzero(codes != 32)
        count = np.diff(np.searchsorted(at, np.concatenate(([0], ends))))
        some = np.flatnonzero(count)
        if len(some):
            first = (np.cumsum(count) - count)[some]
            total = np.zeros((len(some), len(model["langs"])))
            for g in grams(codes, at):
                for k in range(total.shape[1]):
                    total[:, k] += np.add.reduceat(model["columns"][k][g], first, dtype=np.float64)
            logits = total * (_SCALE / (3 * count[some]))[:, None] + model["bias"]
            prob = softmax(logits / model["temperature"])
            best = prob.argmax(1)
            for i, b, p in zip(some.tolist(), best.tolist(), prob.max(1).tolist(), strict=True):
                langs[start + i], scores[start + i] = model["langs"][b], min(1.0, p)
        start = end
    return langs, scores


def identify_languages(docs: DataFrame, *, max_rows_per_language: int = 600, max_languages: int = 200) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    held_out: crc32 of the id as text leaves 2 on division by 4; such rows, and those without lang or id, teach
    nothing. The model is fitted on the driver on at most `max_rows_per_language` documents of each language, those whose
    ids come first by hash (the only bounded sample), from their whole texts; and for the `max_languages` languages of
    most rows, which bounds the model that is broadcast. Predictions use the text alone, whole
    and by itself: no shuffle of texts. Null or letterless text: "und", 0; so is everything where nothing was learned.
    Repeated rows give repeated results, ties go to the language that sorts first, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    usable = docs.where(~held_out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    rows = []
    if counts:
        # each task lets pass three times the rows wanted of a language, by their ids' hash; of these the first ones count
        share = [(r["lang"], min(1 << 30, 1 + (3 * max_rows_per_language << 30) // r["n"])) for r in counts]
        limits = F.broadcast(spark.createDataFrame(share, "lang string, below bigint"))  # max_languages rows
        drawn = usable.join(limits, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below")).select("doc_id", "lang").distinct()
        place = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
        chosen = drawn.withColumn("place", place).where(F.col("place") <= max_rows_per_language).select("doc_id", "lang")

        def features(batches):
            for batch in batches:
                for b in chunks(batch, 1):
                    found = [counted(t) for t in b.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                        names=["lang", "i", "x"],
                    )

        taught = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
        for lang, i, x in taught.mapInArrow(features, "lang string, i array<int>, x array<float>").toLocalIterator():
            if i:
                rows.append((lang, np.array(i, np.int32), np.array(x, np.float32)))
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # whatever order the tasks ended in
    model = fit(rows)
    if model is not None:
        model["columns"] = [np.ascontiguousarray(model["weights"][:, k]) for k in range(len(model["langs"]))]
        del model["weights"]
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for b in chunks(batch, 2):
                langs, scores = predict(held.value, b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double"
    )
