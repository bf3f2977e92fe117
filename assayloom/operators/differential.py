"""One entry for differential abundance: sample overrides, comparisons, one table of results whatever the test."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bh_fdr, effective, sign, trimmed_mean
from ..functions.dist import normal_quantile, normal_upper, t_critical
from . import linear as L
from . import twogroup as T
from .checks import predicate

#: The result table: its columns, in order, with their types (fixed by the format).
RESULTS = {
    "panel": "string", "assay_id": "string", "gene_symbol": "string", "uniprot": "string", "comparison": "string", "n_pairs": "bigint", "mean_a": "double", "mean_b": "double",
    "mean_diff": "double", "t": "double", "df": "double", "p_value": "double", "bh_q": "double", "skip_reason": "string", "effect_size": "double", "effect_size_method": "string",
    "ci_low": "double", "ci_high": "double", "wilcoxon_p": "double", "wilcoxon_method": "string", "median_diff": "double", "trimmed_mean_diff": "double", "s2_trend": "double",
    "s2_prior": "double", "s2_posterior": "double", "df_prior": "double", "df_total": "double", "f_statistic": "double", "f_p_value": "double", "f_bh_q": "double", "lfc_threshold": "double",
    "n_peptides_observed": "bigint", "peptide_variance_ratio": "double", "ridge_lambda": "double", "method": "string", "posthoc_method": "string", "posthoc_p": "double",
    "posthoc_adj_p": "double", "n_a": "bigint", "n_b": "bigint",
}
METHODS = ("paired-t", "moderated", "welch-t", "ols", "mixed", "limma")
KEY = ["comparison", "panel", "gene_symbol"]
_SKIP = {"too_few": "insufficient_pairs", "zero_variance": "zero_variance"}


def parse_comparisons(text: str) -> list[tuple[str, str]]:
    """"A-B,C-D" as pairs; a level can't hold a dash, and an empty or odd part is an error."""
    out = []
    for part in text.split(","):
        sides = [x.strip() for x in part.split("-")]
        if len(sides) != 2 or not all(sides):
            raise ValueError(f"not one A-B comparison: {part.strip()!r}")
        out.append((sides[0], sides[1]))
    return out


def _own(samples: DataFrame, column: str) -> Column:
    if column not in samples.columns:
        raise ValueError(f"the samples have no column {column}")
    return F.nullif(F.trim(F.col(f"`{column}`").cast("string")), F.lit(""))


def override_condition(samples: DataFrame, column: str) -> DataFrame:
    """Another column of the samples as their condition; empty cells are none."""
    return samples.withColumn("condition", _own(samples, column))


def override_subject(samples: DataFrame, column: str) -> DataFrame:
    """Another column of the samples as the pairing key; empty cells are none."""
    return samples.withColumn("subject_id", _own(samples, column))


def collapse_others(samples: DataFrame, comparisons: list[tuple[str, str]], label: str) -> DataFrame:
    """Conditions that no comparison names become `label`, which must be a side of one; no condition stays none."""
    named = sorted({x for pair in comparisons for x in pair})
    if label not in named:
        raise ValueError(f"{label} is no side of a comparison")
    return samples.withColumn("condition", F.when(F.col("condition").isin(*named) | F.col("condition").isNull(), F.col("condition")).otherwise(label))


def in_scope(scope: str) -> Column:
    """all, controls, cases or condition=X as a filter on samples."""
    scope = scope.strip()
    control = F.coalesce("is_control", F.lit(False))
    if scope.startswith("condition="):
        return F.col("condition") == scope.removeprefix("condition=").strip()
    found = {"all": F.lit(True), "controls": control, "cases": ~control}
    if scope not in found:
        raise ValueError(f"{scope!r} is none of all, controls, cases, condition=X")
    return found[scope]


def gene_metadata(proteins: DataFrame) -> DataFrame:
    """panel, gene_symbol, assay_id, uniprot (joined by commas): of several assays of a gene the first by id."""
    uniprot = F.array_join("uniprot", ",") if dict(proteins.dtypes).get("uniprot", "").startswith("array") else F.col("uniprot")
    rows = proteins.where("panel IS NOT NULL AND gene_symbol IS NOT NULL").select("panel", "gene_symbol", "assay_id", uniprot.alias("uniprot"))
    first = rows.groupBy("panel", "gene_symbol").agg(F.min(F.struct("assay_id", "uniprot")).alias("x"))
    return first.select("panel", "gene_symbol", "x.assay_id", F.coalesce("x.uniprot", F.lit("")).alias("uniprot"))


def gene_cells(measurements: DataFrame, samples: DataFrame, how: str = "none") -> DataFrame:
    """Usable cells with their samples' columns: one value for each panel, gene and sample.

    Masked cells, unknown and control samples and rows without subject, condition, panel or gene are left out. Several
    assays of a gene: "none" keeps the first by id, "max-observed" the one with most values, "mean" their mean.
    """
    m = measurements.select("sample_id", "assay_id", "panel", "gene_symbol", effective().alias("value"))
    s = samples.where(~F.coalesce("is_control", F.lit(False)) & F.col("subject_id").isNotNull() & F.col("condition").isNotNull())
    rows = m.where("value IS NOT NULL AND panel IS NOT NULL AND gene_symbol IS NOT NULL").join(s, "sample_id")
    gene = ["panel", "gene_symbol"]
    if how == "mean":
        values = rows.groupBy(*gene, "sample_id").agg(F.avg("value").alias("value"))
        return values.join(s, "sample_id")
    if how not in ("none", "max-observed"):
        raise ValueError(f"unknown way to collapse genes: {how}")
    seen = rows.groupBy(*gene, "assay_id").agg(F.count("*").alias("n"))
    order = F.struct((F.lit(0) if how == "none" else -F.col("n")).alias("n"), F.col("assay_id").alias("a"))
    chosen = seen.groupBy(*gene).agg(F.min(order)["a"].alias("assay_id"))
    return rows.join(chosen, [*gene, "assay_id"]).drop("assay_id")


def subject_pairs(rows: DataFrame) -> DataFrame:
    """pairs() for results: of several samples of a subject in one arm, the last by id counts."""
    arm = lambda a: F.max(F.when(F.col("arm") == a, F.struct("sample_id", "value")))["value"]
    both = rows.groupBy(*KEY, "subject_id").agg(arm("a").alias("va"), arm("b").alias("vb"))
    return both.where("va IS NOT NULL AND vb IS NOT NULL").withColumn("d", F.col("va") - F.col("vb"))


def _paired(rows: DataFrame, min_pairs: int) -> DataFrame:
    p = subject_pairs(rows)
    figures = T.robust_paired_block(p, KEY, (F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b")))
    test = T.paired_test(figures, min_pairs).withColumnRenamed("n", "n_pairs")
    rank = T.signed_rank(p, KEY).select(*KEY, "wilcoxon_p", "n_nonzero")
    ok = F.col("n_pairs") >= F.greatest(F.lit(min_pairs), F.lit(2))
    spread = ok & (F.col("sd") > 0)
    return test.join(rank, KEY, "left").withColumns({
        "effect_size": F.when(spread, F.col("cohen_dz")), "effect_size_method": F.when(ok, "cohen_dz"), "wilcoxon_method": F.when(ok, "signed_rank"),
        "ci_low": F.when(spread, F.col("ci_low")), "ci_high": F.when(spread, F.col("ci_high")), "wilcoxon_p": F.when(ok & (F.col("n_nonzero") >= 2), F.col("wilcoxon_p")),
        "median_diff": F.when(ok, F.col("median_diff")), "trimmed_mean_diff": F.when(ok, F.col("trimmed_mean")),
    }).drop("n_nonzero", "cohen_dz", "trimmed_mean")


def _welch(rows: DataFrame, min_pairs: int) -> DataFrame:
    side = lambda a: F.when(F.col("arm") == a, F.col("value"))
    more = ((F.median(side("a")) - F.median(side("b"))).alias("median_diff"), F.collect_list(side("a")).alias("_a"), F.collect_list(side("b")).alias("_b"))
    test = T.welch(rows, KEY, "value", max(min_pairs, 2), more).withColumn("trimmed_mean_diff", trimmed_mean(F.col("_a")) - trimmed_mean(F.col("_b"))).drop("_a", "_b")
    rank = T.rank_sum(rows, KEY, "value").select(*KEY, "rank_sum_p")
    free = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.when(free > 0, free)
    hedges = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(F.when(pooled > 0, pooled))) * (1 - 3 / (4 * free - 1))
    ok = (F.col("n_a") >= max(min_pairs, 2)) & (F.col("n_b") >= max(min_pairs, 2))
    half = t_critical(F.lit(0.975), F.col("df")) * F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return test.join(rank, KEY).withColumn("_half", half).withColumn("hedges_g", hedges).withColumns({
        "n_pairs": F.col("n_a") + F.col("n_b"), "effect_size": F.when(ok, F.col("hedges_g")), "effect_size_method": F.when(ok, "hedges_g"), "wilcoxon_p": F.when(ok, F.col("rank_sum_p")),
        "wilcoxon_method": F.when(ok, "rank_sum"), "ci_low": F.col("mean_diff") - F.col("_half"), "ci_high": F.col("mean_diff") + F.col("_half"),
        "median_diff": F.when(ok, F.col("median_diff")), "trimmed_mean_diff": F.when(ok, F.col("trimmed_mean_diff")),
        **{c: F.when(F.col("skip_reason").isNull(), F.col(c)) for c in ("mean_a", "mean_b", "mean_diff")},
    })


def _moderated(rows: DataFrame, min_pairs: int, prior_df: float) -> DataFrame:
    x = T.moderated(_paired(rows, min_pairs).withColumn("n", F.col("n_pairs")), ["comparison"], prior_df)
    return x.withColumns({"s2_prior": F.col("s0"), "s2_posterior": F.when(F.col("t").isNotNull(), F.col("s2_post")), "df_prior": F.lit(prior_df)}).withColumns(
        {"p_value": F.when(F.col("t").isNotNull(), F.col("p_mod")), "df": F.when(F.col("t").isNotNull(), F.col("df_mod")), "df_total": F.when(F.col("t").isNotNull(), F.col("df_mod")), "t": F.when(F.col("t").isNotNull(), F.col("t_mod"))}
    )


def _modelled(rows: DataFrame, numeric: list[str], factors: dict[str, list[str]], group: str | None, min_rows: int) -> DataFrame:
    """The arm's coefficient (first less second) beside covariates, by least squares or with a random intercept."""
    used = ["value", "arm", *numeric, *factors, *([group] if group else [])]

    def fit(part: pd.DataFrame) -> list[dict]:
        part = part.dropna(subset=used)
        y, arm = part["value"].to_numpy(float), (part["arm"] == "a").to_numpy(float)
        x, _ = L.design(part, numeric, factors)
        x = np.column_stack([x[:, :1], arm, x[:, 1:]])
        n_a, n_b = int(arm.sum()), int(len(arm) - arm.sum())
        out: dict = {"n_pairs": len(y), "n_a": n_a, "n_b": n_b}
        if n_a < min_rows or n_b < min_rows:
            return [out | {"skip_reason": "too_few"}]
        out |= {"mean_a": float(y[arm == 1].mean()), "mean_b": float(y[arm == 0].mean())}
        unit = np.eye(x.shape[1])[1]
        if group:
            f = L.mixed_fit(x, y, part[group].to_numpy())
            if f is None:
                return [out | {"skip_reason": "too_few"}]
            se = float(np.sqrt(max(f["s2"] * f["cov"][1, 1], 0)))
            t = float(f["beta"][1]) / se if se > 0 else None
            return [out | {"mean_diff": float(f["beta"][1]), "t": t, "df": float(f["df"]), "p_value": None if t is None else float(L.dist.t_two_sided(t, f["df"]))}]
        f = L.Fit(x, y)
        if not f.ok:
            return [out | {"skip_reason": f.reason}]
        est, _, t, p = f.contrast(unit)
        pooled = ((n_a - 1) * y[arm == 1].var(ddof=1) + (n_b - 1) * y[arm == 0].var(ddof=1)) / (n_a + n_b - 2)
        d = (out["mean_a"] - out["mean_b"]) / np.sqrt(pooled) if pooled > 0 else None
        half = 1.96 * np.sqrt((n_a + n_b) / (n_a * n_b) + d * d / (2 * (n_a + n_b))) if d is not None else None
        out |= {"mean_diff": est, "t": t, "df": float(f.df), "p_value": p}
        return [out if d is None else out | {"effect_size": float(d), "effect_size_method": "cohen_d", "ci_low": float(d - half), "ci_high": float(d + half)}]

    names = ("n_pairs", "n_a", "n_b", "mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "skip_reason", "effect_size", "effect_size_method", "ci_low", "ci_high")
    return L.per_feature(rows.select(*KEY, *used), KEY, fit, ", ".join(f"{c} {RESULTS[c]}" for c in names))


def _limma(rows: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """Moderated tests of the arms' difference: the features of one comparison share a prior."""
    parts = []
    for a, b in comparisons:
        one = rows.where(F.col("comparison") == f"{a}-{b}").withColumn("_f", F.concat_ws("\t", "panel", "gene_symbol"))
        counts = one.groupBy("_f").agg(
            F.count_if(F.col("arm") == "a").alias("n_a"), F.count_if(F.col("arm") == "b").alias("n_b"),
            F.avg(F.when(F.col("arm") == "a", F.col("value"))).alias("mean_a"), F.avg(F.when(F.col("arm") == "b", F.col("value"))).alias("mean_b"),
        )
        fits = L.feature_fits(one, "_f", "value", [], {"arm": ["b", "a"]}, [0, 1]).withColumn("feature", F.col("feature"))
        made = L.moderate(fits).join(counts.withColumnRenamed("_f", "feature"), "feature")
        half = F.split("feature", "\t")
        parts.append(made.select(F.lit(f"{a}-{b}").alias("comparison"), half[0].alias("panel"), half[1].alias("gene_symbol"), (F.col("n_a") + F.col("n_b")).alias("n_pairs"), "n_a", "n_b", "mean_a", "mean_b",
                                 F.col("estimate").alias("mean_diff"), "t", F.col("df_total").alias("df"), "df_total", "p_value", F.col("s2_post").alias("s2_posterior")))
    return reduce(DataFrame.unionByName, parts)


def differential(
    measurements: DataFrame, samples: DataFrame, proteins: DataFrame, *, test: str, groups: str, condition_col: str | None = None, paired_by: str | None = None, subset: str | None = None,
    collapse_others_to: str | None = None, include_controls: bool = False, numeric: list[str] | None = None, factors: dict[str, list[str]] | None = None, proxy: DataFrame | None = None,
    min_pairs: int = 3, max_missing: float = 1.0, collapse_genes: str = "none", prior_df: float = 4.0,
) -> DataFrame:
    """RESULTS for every comparison of `groups` ("A-B,C-D") and gene, with q-values per comparison across panels.

    test: one of METHODS. Samples may take condition and subject from other columns, be filtered by `subset`, count
    as cases though controls, and have unnamed conditions joined. Covariates (numeric and factors with their levels)
    turn "welch-t" into least squares; proxy, one number for each subject (subject_id, proxy), does so whatever the
    test. Genes with more than max_missing of a comparison's samples missing are left out. What can't be tested has a
    skip_reason, and null figures.
    """
    if test not in METHODS:
        raise ValueError(f"{test!r} is none of {', '.join(METHODS)}")
    if min_pairs < 2 or not 0 <= max_missing <= 1:
        raise ValueError("min_pairs must be 2 or more and max_missing within 0 and 1")
    comparisons, numeric, factors = parse_comparisons(groups), list(numeric or []), dict(factors or {})
    s = samples.where(predicate(subset)) if subset else samples  # of the samples' own columns
    s = override_condition(s, condition_col) if condition_col else s
    s = override_subject(s, paired_by) if paired_by else s
    s = s.withColumn("is_control", F.lit(False)) if include_controls else s
    s = collapse_others(s, comparisons, collapse_others_to) if collapse_others_to else s
    if proxy is not None:
        if test == "mixed":
            raise ValueError("a proxy goes with least squares, not with a mixed model")
        s, numeric, test = s.join(proxy.select("subject_id", F.col("proxy").cast("double").alias("proxy")), "subject_id", "left"), [*numeric, "proxy"], "ols"
    if test == "welch-t" and (numeric or factors):
        test = "ols"
    s = s.select(*dict.fromkeys(["sample_id", "subject_id", "condition", "is_control", *numeric, *factors]))
    rows = T.arms(gene_cells(measurements, s, collapse_genes), comparisons)
    if max_missing < 1:
        size = T.arms(s.where(~F.coalesce("is_control", F.lit(False))), comparisons).groupBy("comparison").agg(F.count("*").alias("_n"))
        seen = rows.groupBy(*KEY).agg(F.count("*").alias("_seen")).join(F.broadcast(size), "comparison")  # a row for each comparison
        rows = rows.join(seen.where(1 - F.col("_seen") / F.col("_n") <= max_missing + 1e-12).select(*KEY), KEY, "left_semi")
    if test == "paired-t":
        out = _paired(rows, min_pairs)
    elif test == "moderated":
        out = _moderated(rows, min_pairs, prior_df)
    elif test == "welch-t":
        out = _welch(rows, min_pairs)
    elif test == "limma":
        out = _limma(rows, comparisons)
    else:
        out = _modelled(rows, numeric, factors, "subject_id" if test == "mixed" else None, min_pairs)
    if "skip_reason" in out.columns:
        named = reduce(lambda c, kv: c.when(F.col("skip_reason") == kv[0], kv[1]), _SKIP.items(), F)
        out = out.withColumn("skip_reason", F.coalesce(named, F.lit("")))
    out = out.join(gene_metadata(proteins), ["panel", "gene_symbol"], "left").withColumn("method", F.lit(test))
    out = out.withColumn("bh_q", bh_fdr("p_value", ["comparison"], ["panel", "gene_symbol"]))
    blank = {"skip_reason": "", "effect_size_method": "", "wilcoxon_method": "", "posthoc_method": "", "assay_id": "", "uniprot": ""}
    return out.select(*(
        (F.coalesce(F.col(c), F.lit(blank[c])) if c in blank else F.col(c)).cast(kind).alias(c) if c in out.columns else F.lit(blank.get(c)).cast(kind).alias(c) for c, kind in RESULTS.items()
    ))


def sort_results(results: DataFrame) -> DataFrame:
    """By comparison, q (none last), size of the difference, gene."""
    return results.orderBy("comparison", F.col("bh_q").asc_nulls_last(), F.abs("mean_diff").desc_nulls_last(), "gene_symbol")


def report(results: DataFrame, strict: float = 0.05, relaxed: float = 0.1) -> DataFrame:
    """Per comparison and panel: tests, skipped ones, q-values under both limits, the least q, the largest difference."""
    return results.groupBy("comparison", "panel").agg(
        F.count("*").alias("n_tests"), F.count_if(F.col("bh_q").isNull()).alias("n_skipped"), F.count_if(F.col("bh_q") < strict).alias("n_q_strict"),
        F.count_if(F.col("bh_q") < relaxed).alias("n_q_relaxed"), F.min("bh_q").alias("min_q"), F.max(F.abs("mean_diff")).alias("max_abs_effect"),
    )


def ensemble(results: DataFrame, *, alpha: float = 0.05, provisional: float = 0.5, validated: float = 1.0) -> DataFrame:
    """One row per comparison and gene from several methods' results: how many applied, were significant and agree in
    sign (zero counts as positive), a grade from these shares, and Stouffer's combined p and its q as a mere ranking."""
    key = ["comparison", "panel", "assay_id", "gene_symbol", "uniprot"]
    x = results.where("p_value IS NOT NULL AND mean_diff IS NOT NULL").withColumn("_s", sign(F.col("mean_diff"), 1))
    x = x.withColumn("_z", -normal_quantile(F.greatest(F.lit(1e-300), F.least(F.lit(1 - 1e-16), F.col("p_value")))))
    g = x.groupBy(*key).agg(
        F.count("*").alias("n_applied"), F.count_if(F.col("bh_q") < alpha).alias("n_significant"), F.count_if(F.col("_s") > 0).alias("_up"), F.count_if(F.col("_s") < 0).alias("_down"),
        (F.sum("_z") / F.sqrt(F.count("*").cast("double"))).alias("_z"), F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods_applied"),
    )
    g = g.withColumn("n_sign_consistent", F.greatest("_up", "_down")).withColumn("majority_sign", F.when(F.col("_up") >= F.col("_down"), 1.0).otherwise(-1.0)).withColumn("ensemble_p", normal_upper("_z"))
    share = F.least(F.col("n_significant"), F.col("n_sign_consistent")) / F.col("n_applied")
    g = g.withColumn("grade", F.when(share >= validated, "VALIDATED").when(share >= provisional, "PROVISIONAL").otherwise("INSUFFICIENT"))
    every = results.select(*key).distinct().join(g.drop("_up", "_down", "_z"), key, "left")
    filled = every.fillna(0, ["n_applied", "n_significant", "n_sign_consistent"]).fillna(0.0, ["majority_sign"]).fillna("INSUFFICIENT", ["grade"]).fillna("", ["methods_applied"])
    return filled.withColumn("ensemble_q", bh_fdr("ensemble_p", ["comparison"], ["assay_id", "panel", "gene_symbol"]))
