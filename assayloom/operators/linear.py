"""Linear models per feature: OLS, contrasts, mixed models, moderated variances, peptide models, post-hoc tests.

A feature's rows go to one task of a grouped Arrow function; groups are bounded by the number of samples. What is
global (variance priors, families of tests) is computed from one row per feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import bh_fdr

GRID = np.array([-18, -12, -8, -4, 0, 4, 8, 12], float)


def per_feature(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """Apply fn to each feature's rows; its dicts become rows with the keys in front."""
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0].strip("`") for c in schema.split(", "))]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *(r.get(n) for n in names[len(keys) :])] for r in fn(rows)], columns=names, dtype=object)

    return df.groupBy(*keys).applyInPandas(run, f"{key_schema}, {schema}")


def design(rows: pd.DataFrame, numeric: list[str], factors: dict[str, list[str]]) -> tuple[np.ndarray, list[str]]:
    """Intercept, numeric columns, and indicators of each factor's levels but the first (levels in order)."""
    columns, names = [np.ones(len(rows))], ["intercept"]
    for c in numeric:
        columns.append(rows[c].to_numpy(float))
        names.append(c)
    for c, levels in factors.items():
        for level in levels[1:]:
            columns.append((rows[c] == level).to_numpy(float))
            names.append(f"{c}[{level}]")
    return np.column_stack(columns), names


class Fit:
    """Least squares by normal equations; `ok` is False where rows don't exceed columns or the design is singular."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, p = x.shape
        self.df, self.ok, self.reason = n - p, False, None
        if n <= p:
            self.reason = "too_few"
            return
        try:
            root = np.linalg.cholesky(x.T @ x)
        except np.linalg.LinAlgError:
            root = None
        if root is None or root.diagonal().min() < 1e-8 * root.diagonal().max():
            self.reason = "zero_variance"
            return
        inverse = np.linalg.inv(root)
        self.cov = inverse.T @ inverse
        self.beta = self.cov @ (x.T @ y)
        self.residuals = y - x @ self.beta
        self.s2 = float(self.residuals @ self.residuals) / self.df
        self.ok = True

    def contrast(self, c: np.ndarray, s2: float | None = None, df: float | None = None) -> tuple[float, float, float, float]:
        """Estimate, standard error, t and p of a combination of coefficients."""
        s2, df = self.s2 if s2 is None else s2, self.df if df is None else df
        estimate, se = float(c @ self.beta), math.sqrt(max(s2 * float(c @ self.cov @ c), 0))
        t = estimate / se if se > 0 else math.nan
        return estimate, se, t, float(dist.t_two_sided(t, df))

    def omnibus(self, columns: list[int]) -> tuple[float, float]:
        """Wald F of several coefficients together, and p."""
        b, v = self.beta[columns], self.cov[np.ix_(columns, columns)]
        f = float(b @ np.linalg.solve(v, b)) / (len(columns) * self.s2) if self.s2 > 0 else math.nan
        return f, float(dist.f_sf(f, len(columns), self.df))


def ols(df: DataFrame, keys: list[str], value: str, numeric: list[str], factors: dict[str, list[str]]) -> DataFrame:
    """Coefficients of complete rows per feature: term, estimate, se, t, p_value, df, n, and the omnibus F of all terms."""
    used = [value, *numeric, *factors]

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        x, names = design(rows, numeric, factors)
        f = Fit(x, rows[value].to_numpy(float))
        if not f.ok:
            return [{"term": None, "n": len(rows), "skip_reason": f.reason}]
        overall = f.omnibus(list(range(1, len(names)))) if len(names) > 1 else (math.nan, math.nan)
        out = []
        for i, name in enumerate(names):
            est, se, t, p = f.contrast(np.eye(len(names))[i])
            out.append({"term": name, "estimate": est, "se": se, "t": t, "p_value": p, "df": float(f.df), "n": len(rows), "f": overall[0], "f_p": overall[1]})
        return out

    return per_feature(
        df.select(*keys, *used), keys, fit, "term string, estimate double, se double, t double, p_value double, df double, n bigint, f double, f_p double, skip_reason string"
    )


def residuals(df: DataFrame, keys: list[str], row: str, value: str, numeric: list[str], factors: dict[str, list[str]]) -> DataFrame:
    """What a design leaves of each value, with the feature's R squared."""
    used = [value, *numeric, *factors]

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        y = rows[value].to_numpy(float)
        f = Fit(design(rows, numeric, factors)[0], y)
        if not f.ok:
            return []
        total = float(((y - y.mean()) ** 2).sum())
        r2 = 1 - float(f.residuals @ f.residuals) / total if total > 0 else math.nan
        return [{row: s, "residual": float(e), "r2": r2} for s, e in zip(rows[row], f.residuals, strict=True)]

    return per_feature(df.select(*keys, row, *used), keys, fit, f"`{row}` {df.schema[row].dataType.simpleString()}, residual double, r2 double")


def search_log_ratio(criterion: Callable[[float], float]) -> float:
    """Least criterion over a log ratio: a coarse grid, then golden sections around its best point."""
    best = GRID[int(np.argmin([criterion(g) for g in GRID]))]
    lo, hi, r = best - 4, best + 4, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if criterion(a) < criterion(b) else (a, hi)
    return (lo + hi) / 2


def mixed_fit(x: np.ndarray, y: np.ndarray, groups: np.ndarray, ridge: np.ndarray | None = None, weights: np.ndarray | None = None) -> dict | None:
    """REML of a random intercept by its profile over log(lambda), lambda = group variance / residual variance."""
    n, p = x.shape
    if n <= p or len(np.unique(groups)) < 2:
        return None
    _, which = np.unique(groups, return_inverse=True)
    w = np.ones(n) if weights is None else weights
    size = np.bincount(which, w)
    penalty = np.zeros(p) if ridge is None else ridge

    def solved(log_ratio: float):
        ratio = math.exp(log_ratio)
        shrink = ratio / (1 + ratio * size)

        def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            sums_a = np.stack([np.bincount(which, w * c) for c in a.T], 1)
            sums_b = np.stack([np.bincount(which, w * c) for c in b.T], 1)
            return (a * w[:, None]).T @ b - (sums_a * shrink[:, None]).T @ sums_b

        xx = product(x, x) + np.diag(penalty)
        xy = product(x, y[:, None])[:, 0]
        beta = np.linalg.solve(xx, xy)
        rss = float(product(y[:, None], y[:, None])[0, 0] - xy @ beta)
        return xx, beta, max(rss, 1e-300), float(np.log1p(ratio * size).sum())

    def criterion(log_ratio: float) -> float:
        xx, _, rss, det = solved(log_ratio)
        return (n - p) * math.log(rss) + det + np.linalg.slogdet(xx)[1]

    try:
        at = search_log_ratio(criterion)
        xx, beta, rss, _ = solved(at)
    except np.linalg.LinAlgError:
        return None
    s2 = rss / (n - p)
    return {"beta": beta, "cov": np.linalg.inv(xx), "s2": s2, "df": n - p, "group_variance": s2 * math.exp(at), "icc": math.exp(at) / (1 + math.exp(at))}


def mixed(df: DataFrame, keys: list[str], value: str, numeric: list[str], factors: dict[str, list[str]], group: str) -> DataFrame:
    """Random-intercept model per feature: term, estimate, se, t, p_value, df, residual and group variance, icc."""
    used = [value, *numeric, *factors, group]

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        x, names = design(rows, numeric, factors)
        f = mixed_fit(x, rows[value].to_numpy(float), rows[group].to_numpy())
        if f is None:
            return [{"term": None, "skip_reason": "not_fitted"}]
        se = np.sqrt(np.maximum(f["s2"] * np.diag(f["cov"]), 0))
        t = np.divide(f["beta"], se, out=np.full(len(se), np.nan), where=se > 0)
        p = dist.t_two_sided(t, f["df"])
        return [
            {"term": names[i], "estimate": f["beta"][i], "se": se[i], "t": t[i], "p_value": p[i], "df": float(f["df"]), "residual_variance": f["s2"], "group_variance": f["group_variance"], "icc": f["icc"]}
            for i in range(len(names))
        ]

    return per_feature(
        df.select(*keys, *used), keys, fit, "term string, estimate double, se double, t double, p_value double, df double, residual_variance double, group_variance double, icc double, skip_reason string"
    )


def prior(s2: np.ndarray, df: np.ndarray) -> tuple[float, float]:
    """(s0 squared, d0) from the moments of log variances; no excess: infinite d0 and the arithmetic mean."""
    ok = (s2 > 0) & (df > 0)
    z, half = np.log(s2[ok]), df[ok] / 2
    e = z - np.array([dist.digamma(h) for h in half]) + np.log(half)
    excess = e.var(ddof=1) - np.mean([dist.trigamma(h) for h in half]) if len(e) > 1 else 0.0
    if excess <= 0:
        return float(s2[ok].mean()) if ok.any() else math.nan, math.inf
    d0 = 2 * dist.trigamma_inverse(float(excess))
    return float(math.exp(e.mean() + dist.digamma(d0 / 2) - math.log(d0 / 2))), d0


def winsorised(s2: np.ndarray, low: float = 0.05, high: float = 0.1) -> np.ndarray:
    """Variances with log values beyond the order statistics of both tails pulled in."""
    z = np.log(np.maximum(s2, 1e-300))
    order = np.sort(z)
    n = len(order)
    return np.exp(np.clip(z, order[int(math.floor(low * n))], order[n - 1 - int(math.floor(high * n))]))


def trend(means: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Variances expected from a quadratic of log variance in log mean."""
    x = np.log(np.maximum(np.abs(means), 1e-12))
    a = np.column_stack([np.ones_like(x), x, x * x])
    return np.exp(a @ np.linalg.lstsq(a, np.log(np.maximum(s2, 1e-300)), rcond=None)[0])


def smoothed_by_count(s2: np.ndarray, counts: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Variances expected from the number of peptides: tricube moving average of log variance over log(count + 1)."""
    x, z = np.log(counts + 1.0), np.log(np.maximum(s2, 1e-300))
    k = max(2, int(math.ceil(span * len(x))))
    out = np.empty(len(x))
    for i in range(len(x)):
        d = np.abs(x - x[i])
        reach = max(np.partition(d, k - 1)[k - 1], 1e-12) * (1 + 1e-9)
        w = np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0)
        out[i] = (w * z).sum() / w.sum()
    return np.exp(out)


def moderate(fits: DataFrame, kind: str = "plain", lfc: float = 0.0) -> DataFrame:
    """Empirical-Bayes t tests from one row per feature: feature, estimate, unscaled (c' (X'X)^-1 c), s2, df, mean, count.

    kind: "plain", "trend" (variance expected from the mean), "robust" (winsorised variances) or "counts" (expected from
    `count`). lfc: test against a smallest difference instead of none. The features come together in one task: there is
    one row for each, not for each measurement.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["s2"].notna()].sort_values("feature")
        s2 = rows["s2"].to_numpy(float)
        df = np.full(len(s2), rows["df"].max(), float)
        expected = np.ones(len(s2))
        if kind == "trend":
            expected = trend(rows["mean"].to_numpy(float), s2)
        elif kind == "counts":
            expected = smoothed_by_count(s2, rows["count"].to_numpy(float))
        basis = winsorised(s2 / expected) if kind == "robust" else s2 / expected
        s0, d0 = prior(basis, df)
        post = expected * s0 if math.isinf(d0) else (d0 * s0 * expected + df * s2) / (d0 + df)
        total = df + d0
        est = rows["estimate"].to_numpy(float)
        se = np.sqrt(post * rows["unscaled"].to_numpy(float))
        t = est / se
        if lfc > 0:
            p = dist.t_sf((np.abs(est) - lfc) / se, total) + dist.t_sf((np.abs(est) + lfc) / se, total)
        else:
            p = dist.t_two_sided(t, total)
        return pd.DataFrame({"feature": rows["feature"], "estimate": est, "s2_post": post, "t": t, "df_total": np.where(np.isinf(total), None, total), "p_value": p})

    return fits.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "feature string, estimate double, s2_post double, t double, df_total double, p_value double")


def feature_fits(df: DataFrame, feature: str, value: str, numeric: list[str], factors: dict[str, list[str]], contrast: list[float]) -> DataFrame:
    """One row per feature for moderate(): the contrast's estimate and unscaled variance, s2, df, mean, count."""
    used = [value, *numeric, *factors]
    c = np.array(contrast, float)

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        y = rows[value].to_numpy(float)
        f = Fit(design(rows, numeric, factors)[0], y)
        if not f.ok:
            return []
        return [{"estimate": float(c @ f.beta), "unscaled": float(c @ f.cov @ c), "s2": f.s2, "df": float(f.df), "mean": float(y.mean()), "count": len(y)}]

    out = per_feature(df.select(feature, *used), [feature], fit, "estimate double, unscaled double, s2 double, df double, mean double, count bigint")
    return out.withColumnRenamed(feature, "feature") if feature != "feature" else out


def peptide_model(df: DataFrame, feature: str, value: str, factors: dict[str, list[str]], peptide: str, ridge: float = 0.0, robust: bool = False) -> DataFrame:
    """Mixed model with a peptide intercept per protein; ridge on all but the intercept; robust: Huber weights (1.345)."""
    used = [value, *factors, peptide]

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        x, names = design(rows, [], factors)
        y, group = rows[value].to_numpy(float), rows[peptide].to_numpy()
        penalty = np.concatenate(([0.0], np.full(x.shape[1] - 1, ridge)))
        weights = np.ones(len(y))
        f = mixed_fit(x, y, group, penalty)
        for _ in range(50 if robust and f else 0):
            _, which = np.unique(group, return_inverse=True)
            e = y - x @ f["beta"]
            ratio = f["group_variance"] / f["s2"]
            e = e - (np.bincount(which, weights * e) * ratio / (1 + ratio * np.bincount(which, weights)))[which]
            scale = max(np.median(np.abs(e - np.median(e))) * 1.4826, 1e-12)
            new = np.minimum(1, 1.345 * scale / np.maximum(np.abs(e), 1e-12))
            if np.abs(new - weights).max() < 1e-6:
                break
            weights = new
            again = mixed_fit(x, y, group, penalty, weights)
            if again is None:
                break
            f = again
        if f is None:
            return []
        return [
            {"term": n, "estimate": float(f["beta"][i]), "unscaled": float(f["cov"][i, i]), "s2": f["s2"], "df": float(f["df"]), "n_peptides": int(len(np.unique(group)))} for i, n in enumerate(names) if i
        ]

    return per_feature(df.select(feature, *used), [feature], fit, "term string, estimate double, unscaled double, s2 double, df double, n_peptides bigint")


def posthoc(df: DataFrame, keys: list[str], value: str, factor: str, levels: list[str], method: str, numeric: list[str] | None = None) -> DataFrame:
    """All pairs of a factor's levels ("sidak", "tukey") or each against the first ("dunnett"), adjusted for numeric columns.

    Against the first, groups whose sizes differ by more than a quarter get the correlations of their own sizes.
    """
    numeric = numeric or []
    used = [value, factor, *numeric]

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        x, names = design(rows, numeric, {factor: levels})
        f = Fit(x, rows[value].to_numpy(float))
        if not f.ok:
            return []
        first = len(names) - len(levels) + 1
        where = {lv: None if i == 0 else first + i - 1 for i, lv in enumerate(levels)}
        pairs = [(a, levels[0]) for a in levels[1:]] if method == "dunnett" else [(a, b) for i, b in enumerate(levels) for a in levels[i + 1 :]]
        out = []
        for a, b in pairs:
            c = np.zeros(len(names))
            for lv, s in ((a, 1.0), (b, -1.0)):
                if where[lv] is not None:
                    c[where[lv]] += s
            est, se, t, p = f.contrast(c)
            if method == "sidak":
                adjusted = 1 - (1 - p) ** len(pairs)
            elif method == "tukey":
                adjusted = 1 - dist.ptukey(abs(t) * math.sqrt(2), len(levels), f.df)
            else:
                n = np.array([(rows[factor] == lv).sum() for lv in levels], float)
                uneven = n.max() / max(n[n > 0].min(), 1) > 1.25
                adjusted = 1 - dist.pdunnett(abs(t), len(pairs), f.df, np.maximum(n[1:], 1) / (np.maximum(n[1:], 1) + n[0]) if uneven else 0.5)
            out.append({"level_a": a, "level_b": b, "estimate": est, "se": se, "t": t, "df": float(f.df), "p_value": p, "p_adjusted": float(min(1, max(0, adjusted)))})
        return out

    return per_feature(df.select(*keys, *used), keys, fit, "level_a string, level_b string, estimate double, se double, t double, df double, p_value double, p_adjusted double")


def paired_ancova(pair_rows: DataFrame, keys: list[str], covariates: list[str]) -> DataFrame:
    """Paired differences adjusted for differences of covariates: the intercept of d on them."""

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna()
        x = np.column_stack([np.ones(len(rows)), *(rows[c].to_numpy(float) for c in covariates)])
        f = Fit(x, rows["d"].to_numpy(float))
        if not f.ok:
            return [{"n": len(rows), "skip_reason": f.reason}]
        est, se, t, p = f.contrast(np.eye(x.shape[1])[0])
        return [{"n": len(rows), "mean_diff": est, "se": se, "t": t, "df": float(f.df), "p_value": p}]

    return per_feature(pair_rows.select(*keys, "d", *covariates), keys, fit, "n bigint, mean_diff double, se double, t double, df double, p_value double, skip_reason string")


def logistic(x: np.ndarray, y: np.ndarray, max_iter: int = 50, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and covariance by reweighted least squares; None where they run away or don't settle."""
    beta = np.zeros(x.shape[1])
    for _ in range(max_iter):
        prob = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(prob * (1 - prob), 1e-9)
        try:
            step = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (y - prob))
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if np.abs(beta).max() > 30:
            return None
        if np.abs(step).max() < tol:
            return beta, np.linalg.inv((x * w[:, None]).T @ x)
    return None


def detectability(grid: DataFrame, keys: list[str], value: str, arm: str) -> DataFrame:
    """Detection (a value is there) by arm with a logistic model, abundance of the detected by least squares.

    grid: one row per feature and sample, null values where nothing was detected; arm is "a" or "b".
    """

    def fit(rows: pd.DataFrame) -> list[dict]:
        a = (rows[arm] == "a").to_numpy(float)
        seen = rows[value].notna().to_numpy(float)
        out: dict = {
            "n": len(rows), "n_a": int(a.sum()), "n_b": int(len(a) - a.sum()), "n_detected_a": int(seen[a == 1].sum()), "n_detected_b": int(seen[a == 0].sum()), "rate_a": float(seen[a == 1].mean()) if a.any() else None, "rate_b": float(seen[a == 0].mean()) if (a == 0).any() else None,
        }
        found = logistic(np.column_stack([np.ones(len(a)), a]), seen) if 0 < seen.mean() < 1 and 0 < a.mean() < 1 else None
        if found:
            z = found[0][1] / math.sqrt(max(found[1][1, 1], 1e-300))
            out |= {"log_odds": float(found[0][1]), "detection_p": float(dist.norm_two_sided(z))}
        f = Fit(np.column_stack([np.ones(int(seen.sum())), a[seen == 1]]), rows[value].dropna().to_numpy(float))
        if f.ok:
            est, _, _, p = f.contrast(np.array([0.0, 1.0]))
            out |= {"abundance_diff": est, "abundance_p": p}
        det, ab = out.get("detection_p"), out.get("abundance_p")
        d, b = det is not None and det < 0.05, ab is not None and ab < 0.05
        out["label"] = "both" if d and b else "detection" if d else "abundance" if b else "untestable" if det is None and ab is None else "neither"
        return [out]

    return per_feature(grid.select(*keys, value, arm), keys, fit, "n bigint, n_a bigint, n_b bigint, n_detected_a bigint, n_detected_b bigint, rate_a double, rate_b double, log_odds double, detection_p double, abundance_diff double, abundance_p double, label string")


def detectability_summary(rows: DataFrame, by: list[str], key: list[str], q: float = 0.05) -> DataFrame:
    """What detectability() says of each comparison: tests, hits under q (detection and abundance corrected apart),
    features detected equally often, differences of detection rates, and a diagnosis."""
    x = rows.withColumn("_dq", bh_fdr("detection_p", by, key)).withColumn("_aq", bh_fdr("abundance_p", by, key)).withColumn("_d", F.abs(F.col("rate_a") - F.col("rate_b")))
    same = (F.col("n_detected_a") == F.col("n_detected_b")) & (F.col("n_a") - F.col("n_detected_a") == F.col("n_b") - F.col("n_detected_b"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    g = x.groupBy(*by).agg(
        F.count("*").alias("n_features"), F.count("detection_p").alias("n_detection_tested"), F.count_if(F.col("_dq") < q).alias("n_detection_hits"), F.count_if(F.col("_aq") < q).alias("n_abundance_hits"),
        F.count_if(same).alias("n_identical_counts"), F.count_if(F.col("_d") < 1e-12).alias("n_zero_delta"), F.count("_d").alias("_n"), F.median("_d").alias("median_abs_delta"), F.max("_d").alias("max_abs_delta"),
    )
    g = g.withColumn("share_identical", share("n_identical_counts", "n_features")).withColumn("share_zero_delta", share("n_zero_delta", "_n")).drop("_n")
    no_hits = F.col("n_detection_hits") == 0
    told = F.when(F.col("n_detection_tested") == 0, "no_detection_tests").when((F.col("share_identical") >= 0.95) | ((F.col("share_zero_delta") >= 0.95) & no_hits), "condition_invariant_detection")
    return g.withColumn("diagnostic", told.when(no_hits & (F.col("median_abs_delta") < 0.02), "weak_detection_contrast").otherwise("detection_informative"))


def squeeze(fits: DataFrame) -> DataFrame:
    """Rows of peptide_model() with variances shrunk towards a prior of all features' variances at their median df:
    s2_post, df_total, se, t, p_value, df_prior, s2_prior. Without a finite prior the figures stay the features' own."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["feature", "term"])
        one = rows.drop_duplicates("feature")
        df0 = float(np.sort(one["df"].to_numpy(float))[len(one) // 2])
        s0, d0 = prior(one["s2"].to_numpy(float), np.full(len(one), df0)) if len(one) > 1 and df0 > 0 else (math.nan, math.inf)
        df, s2 = rows["df"].to_numpy(float), rows["s2"].to_numpy(float)
        known = math.isfinite(d0) and d0 > 0 and math.isfinite(s0)
        total = df + d0 if known else df
        post = (df * s2 + d0 * s0) / total if known else s2
        se = np.sqrt(post * rows["unscaled"].to_numpy(float))
        t = np.divide(rows["estimate"].to_numpy(float), se, out=np.full(len(se), np.nan), where=se > 0)
        return rows[["feature", "term", "estimate", "n_peptides"]].assign(s2_post=post, df_total=total, se=se, t=t, p_value=dist.t_two_sided(t, total), df_prior=d0 if known else None, s2_prior=s0 if known else None)

    return fits.withColumnRenamed(fits.columns[0], "feature").groupBy(F.lit(1).alias("_all")).applyInPandas(  # a row for each feature and term
        run, "feature string, term string, estimate double, n_peptides bigint, s2_post double, df_total double, se double, t double, p_value double, df_prior double, s2_prior double"
    )


def f_fits(df: DataFrame, feature: str, value: str, numeric: list[str], factors: dict[str, list[str]], tested: str) -> DataFrame:
    """One row per feature for moderate_f(): the factor's F, its number of columns, s2, df."""
    used = [value, *numeric, *factors]

    def fit(rows: pd.DataFrame) -> list[dict]:
        rows = rows.dropna(subset=used)
        x, names = design(rows, numeric, factors)
        f = Fit(x, rows[value].to_numpy(float))
        at = [i for i, n in enumerate(names) if n.startswith(f"{tested}[")]
        if not f.ok or not at or f.s2 <= 0:
            return []
        return [{"f": f.omnibus(at)[0], "n_columns": len(at), "s2": f.s2, "df": float(f.df)}]

    out = per_feature(df.select(feature, *used), [feature], fit, "f double, n_columns bigint, s2 double, df double")
    return out.withColumnRenamed(feature, "feature") if feature != "feature" else out


def moderate_f(fits: DataFrame) -> DataFrame:
    """Empirical-Bayes F tests of f_fits(): F over the shrunken variance, with the prior's degrees of freedom added."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("feature")
        s2, df = rows["s2"].to_numpy(float), np.full(len(rows), rows["df"].max(), float)
        s0, d0 = prior(s2, df)
        post = np.full(len(s2), s0) if math.isinf(d0) else (d0 * s0 + df * s2) / (d0 + df)
        f, total, k = rows["f"].to_numpy(float) * s2 / post, df + d0, rows["n_columns"].to_numpy(float)
        return pd.DataFrame({"feature": rows["feature"], "f": f, "df1": rows["n_columns"], "df2": np.where(np.isinf(total), None, total), "p_value": dist.f_sf(f, k, total), "s2_post": post})

    return fits.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "feature string, f double, df1 bigint, df2 double, p_value double, s2_post double")  # a row for each feature


def covariate_levels(samples: DataFrame, columns: list[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Which columns are numeric (every value is a number) and the others' levels in order, for a design.

    A factor of one level, or of none, says nothing and is an error; so is a column that isn't there.
    """
    for c in columns:
        if c not in samples.columns:
            raise ValueError(f"the samples have no column {c}")
    text = {c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns}
    row = samples.agg(*(F.bool_and(v.isNull() | v.try_cast("double").isNotNull()).alias(f"n_{c}") for c, v in text.items()), *(F.count(v).alias(f"k_{c}") for c, v in text.items())).first()
    numeric = [c for c in columns if row[f"n_{c}"] and row[f"k_{c}"]]
    factors = {c: sorted(r[0] for r in samples.select(text[c].alias("v")).where("v IS NOT NULL").distinct().limit(1000).collect()) for c in columns if c not in numeric}
    for c, levels in factors.items():
        if not 2 <= len(levels) < 1000:
            raise ValueError(f"{c} has {len(levels)} levels")
    return numeric, factors
