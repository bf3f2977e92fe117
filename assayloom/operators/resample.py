"""Resampling: null calibration, bootstraps, ratios, permutation enrichment. Streams are keyed by seed and feature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import bh_fdr
from ..functions.rng import stream
from .decompose import bca


def nearest(values: np.ndarray, q: float) -> float:
    """The sorted value at index round((n - 1) q), half up."""
    return float(np.sort(values)[int(np.floor((len(values) - 1) * q + 0.5))])


def sign_stability(point: float, draws: np.ndarray) -> float:
    return float(np.mean(np.sign(draws) == np.sign(point)))


def draws_of(n: int, size: int, cells: int = 1_000_000) -> list[int]:
    """n draws of some size as numbers of draws that are made at once, of `cells` values together where one has fewer.
    Rows of a stream's matrix come in order, so draws don't depend on the parts."""
    step = max(1, cells // max(size, 1))
    return [min(step, n - at) for at in range(0, n, step)]


def drawn(g: np.random.Generator, v: np.ndarray, n: int, statistic) -> np.ndarray:
    """A statistic of n draws of the values with replacement."""
    return np.concatenate([statistic(v[g.integers(0, len(v), (m, len(v)))], 1) for m in draws_of(n, len(v))])


def flipped_t(g: np.random.Generator, d: np.ndarray, n: int) -> np.ndarray:
    """The paired t of n draws of the differences' signs."""
    out, k = [], len(d)
    for m in draws_of(n, k):
        x = g.choice([-1.0, 1.0], (m, k)) * d
        sd = x.std(1, ddof=1)
        out.append(x.mean(1) / np.where(sd > 0, sd / np.sqrt(k), np.inf))
    return np.concatenate(out)


def mixed_medians(g: np.random.Generator, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Differences of medians of n deals of all values to sides of the same sizes."""
    both, out = np.concatenate([x, y]), []
    for m in draws_of(n, len(both)):
        mixed = both[np.argsort(g.random((m, len(both))), 1)]
        out.append(np.median(mixed[:, : len(x)], 1) - np.median(mixed[:, len(x) :], 1))
    return np.concatenate(out)


def null_calibration(pair_rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Sign-flip null of the paired t per feature: observed t, empirical p (c + 1) / (n + 1)."""

    names = [*keys, "n_pairs", "t", "empirical_p", "null_p05"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("subject_id")["d"].to_numpy(float)
        k = len(d)
        if k < 3 or d.std(ddof=1) == 0:
            return pd.DataFrame(columns=names)
        t = flipped_t(stream(seed, *key), d, n)
        t0 = d.mean() / (d.std(ddof=1) / np.sqrt(k))
        p = (int((np.abs(t) >= abs(t0) - 1e-12).sum()) + 1) / (n + 1)
        return pd.DataFrame([[*key, k, t0, p, int((dist.t_two_sided(t, k - 1) < 0.05).sum())]], columns=names)

    df = pair_rows.select(*keys, "subject_id", "d")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{schema}, n_pairs bigint, t double, empirical_p double, null_p05 bigint")


def bootstrap_pairs(pair_rows: DataFrame, keys: list[str], n: int, seed: int, level: float = 0.95) -> DataFrame:
    """Subjects drawn with replacement: interval by nearest-index quantiles, sign stability of the mean difference."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("subject_id")["d"].to_numpy(float)
        draws = drawn(stream(seed, *key), d, n, np.mean)
        tail = (1 - level) / 2
        values = [len(d), d.mean(), nearest(draws, tail), nearest(draws, 1 - tail), sign_stability(d.mean(), draws)]
        return pd.DataFrame([[*key, *values]], columns=[*keys, "n_pairs", "effect", "ci_low", "ci_high", "sign_stability"])

    df = pair_rows.select(*keys, "subject_id", "d")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{schema}, n_pairs bigint, effect double, ci_low double, ci_high double, sign_stability double")


def ratio_effects(df: DataFrame, numerator: list[str], denominator: list[str], feature: str, value: str) -> DataFrame:
    """Log ratios: mean of numerator less mean of denominator values per sample, then the mean over a subject's samples."""
    per = df.groupBy("condition", "subject_id", "sample_id").agg(
        F.avg(F.when(F.col(feature).isin(numerator), F.col(value))).alias("_n"), F.avg(F.when(F.col(feature).isin(denominator), F.col(value))).alias("_d")
    )
    return per.where("_n IS NOT NULL AND _d IS NOT NULL").groupBy("condition", "subject_id").agg(F.avg(F.col("_n") - F.col("_d")).alias("log_ratio"))


def ratio_test(ratios: DataFrame, a: str, b: str, n: int, seed: int) -> DataFrame:
    """Difference of medians with a bootstrap interval and a permutation p; one row per subject comes to one task. An
    empty side leaves all but the numbers of subjects null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["condition", "subject_id"])
        x, y = (rows.loc[rows["condition"] == c, "log_ratio"].to_numpy(float) for c in (a, b))
        if not len(x) or not len(y):
            return pd.DataFrame([{"n_a": len(x), "n_b": len(y), "median_diff": None, "ci_low": None, "ci_high": None, "permutation_p": None}])
        g = stream(seed, a, b)
        point = float(np.median(x) - np.median(y))
        draws = drawn(g, x, n, np.median) - drawn(g, y, n, np.median)
        null = mixed_medians(g, x, y, n)
        p = (int((np.abs(null) >= abs(point) - 1e-12).sum()) + 1) / (n + 1)
        return pd.DataFrame([{"n_a": len(x), "n_b": len(y), "median_diff": point, "ci_low": nearest(draws, 0.025), "ci_high": nearest(draws, 0.975), "permutation_p": p}])

    return ratios.where(F.col("condition").isin(a, b)).groupBy(F.lit(1).alias("_all")).applyInPandas(run, "n_a bigint, n_b bigint, median_diff double, ci_low double, ci_high double, permutation_p double")


def running_peak(hit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Enrichment scores of rows of hit indicators along genes whose |stat| is `size`; the first of equal peaks counts."""
    up = hit * size
    total, misses = up.sum(1, keepdims=True), (~hit).sum(1, keepdims=True)
    run = np.cumsum(np.where(hit, up / np.where(total > 0, total, 1), -1 / np.maximum(misses, 1)), 1)
    at = np.round(np.abs(run), 12).argmax(1)
    return run[np.arange(len(run)), at]


def gsea(ranked: DataFrame, sets: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """ES, NES and p from gene permutations of the same sign: p = (extreme + 1) / (same sign + 1); without any, NES is null.
    leading_edge: the set's genes up to the peak (after it, where ES is negative), in order. q-values within `by`.

    A ranking goes once to each of `parts` groups of sets, not once to each set; draws are made a hundred at a time.
    """
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = ranked.select(*by, "gene_symbol", "stat").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ranked.select(*(F.col(c).alias(c) for c in by)).distinct()  # other columns than the ranking's, though of its names
    dealt = sets.select("set_name", "gene_symbol").distinct().withColumn("part", F.pmod(F.xxhash64("set_name"), F.lit(parts)).cast("int")).join(keys)  # sets by comparisons

    def fit(key: tuple, rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "set_name", "es", "nes", "p_value", "n_same_sign", "leading_edge"]
        rows = rows.assign(stat=rows["stat"].round(10)).sort_values(["stat", "gene_symbol"], ascending=[False, True])  # sums differ by their order
        genes, size, out = rows["gene_symbol"], np.abs(rows["stat"].to_numpy(float)), []
        for name, own in members.groupby("set_name"):
            hit = genes.isin(set(own["gene_symbol"])).to_numpy()
            k = int(hit.sum())
            if not 0 < k < len(hit):
                continue
            es = float(running_peak(hit[None, :], size)[0])
            g, null = stream(seed, *key[:-1], name), []
            for at in range(0, n, 100):
                order = np.argsort(g.random((min(100, n - at), len(hit))), 1)
                drawn = np.zeros(order.shape, bool)
                np.put_along_axis(drawn, order[:, :k], True, 1)
                null.append(running_peak(drawn, size))
            every = np.concatenate(null)
            same = every[np.sign(every) == np.sign(es)]
            p = (int((np.abs(same) >= abs(es) - 1e-12).sum()) + 1) / (len(same) + 1) if len(same) else 1 / (n + 1)
            nes = es / float(np.abs(same).mean()) if len(same) else None
            run = np.cumsum(np.where(hit, size / max(size[hit].sum(), 1e-300), -1 / (len(hit) - k)))
            peak = int(np.round(np.abs(run), 12).argmax())
            edge = genes[hit & (np.arange(len(hit)) <= peak if es > 0 else np.arange(len(hit)) > peak)]
            out.append([*key[:-1], name, es, nes, p, len(same), ",".join(edge)])
        return pd.DataFrame(out, columns=names)

    schema = ", ".join(f"`{k}` {ranked.schema[k].dataType.simpleString()}" for k in by)
    both = numbered.groupBy(*by, "part").cogroup(dealt.groupBy(*by, "part"))
    found = both.applyInPandas(fit, f"{schema}, set_name string, es double, nes double, p_value double, n_same_sign bigint, leading_edge string")
    return found.withColumn("q_value", bh_fdr("p_value", by, ["set_name"]))


def resample_within(g: np.random.Generator, groups: list[np.ndarray]) -> list[np.ndarray]:
    """Each group drawn from itself with replacement, at its own size."""
    return [x[g.integers(0, len(x), len(x))] if len(x) else x for x in groups]


def stratified_bootstrap(df: DataFrame, by: list[str], group: str, levels: tuple[str, str], value: str, n: int, seed: int, level: float = 0.95) -> DataFrame:
    """Difference of the means of two levels within `by`, with an interval from draws within each level. Groups of one
    level alone have no row; the key of a row (sample_id) orders what is drawn from."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "n_a", "n_b", "effect", "ci_low", "ci_high"]
        rows = rows.dropna().sort_values("sample_id")
        x = [rows.loc[rows[group] == v, value].to_numpy(float) for v in levels]
        if not all(map(len, x)):
            return pd.DataFrame(columns=names)
        g, tail = stream(seed, *key), (1 - level) / 2
        draws = np.array([a.mean() - b.mean() for a, b in (resample_within(g, x) for _ in range(n))])
        return pd.DataFrame([[*key, len(x[0]), len(x[1]), x[0].mean() - x[1].mean(), nearest(draws, tail), nearest(draws, 1 - tail)]], columns=names)

    part = df.where(F.col(group).isin(*levels)).select(*by, "sample_id", group, value)
    schema = ", ".join(f"`{k}` {part.schema[k].dataType.simpleString()}" for k in by)
    return part.groupBy(*by).applyInPandas(run, f"{schema}, n_a bigint, n_b bigint, effect double, ci_low double, ci_high double")


def bca_interval(values: np.ndarray, statistic, n: int, seed: int, *key) -> tuple[float, float]:
    """Bias-corrected accelerated interval of a statistic, from draws and leave-one-out values."""
    g = stream(seed, *key)
    draws = np.array([statistic(values[g.integers(0, len(values), len(values))]) for _ in range(n)])
    left_out = np.array([statistic(np.delete(values, i)) for i in range(len(values))]) if len(values) > 1 else draws[:1]
    return bca(float(statistic(values)), draws, left_out)
