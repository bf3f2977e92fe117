"""Two-group comparisons as grouped aggregates: t tests, moderation, fold changes, effect sizes, rank tests.

All take long rows with one value per cell. Comparisons are (a, b) pairs and always a - b; all of them run in one job:
every row is sent to the comparisons it takes part in, a small constant factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import average_rank, bh_fdr, trimmed_mean
from ..functions.dist import chi2_pvalue, normal_pvalue, t_critical, t_pvalue


def arms(df: DataFrame, comparisons: list[tuple[str, str]], condition: str = "condition") -> DataFrame:
    """Rows with comparison ("a-b") and arm ("a" or "b") for each comparison whose condition they have."""
    sides = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("comparison"), F.lit(c).alias("level"), F.lit(s).alias("arm")) for a, b in comparisons for c, s in ((a, "a"), (b, "b"))))
    mine = F.filter(sides, lambda x: x["level"] == F.col(condition))
    return df.withColumn("_s", F.explode(mine)).withColumns({"comparison": F.col("_s.comparison"), "arm": F.col("_s.arm")}).drop("_s")


def pairs(df: DataFrame, by: list[str], subject: str = "subject_id", value: str = "abundance") -> DataFrame:
    """One row per subject with a value in both arms: by, subject, va, vb, d. Several values of an arm are averaged."""
    both = df.groupBy(*by, subject).agg(F.avg(F.when(F.col("arm") == "a", F.col(value))).alias("va"), F.avg(F.when(F.col("arm") == "b", F.col(value))).alias("vb"))
    return both.where("va IS NOT NULL AND vb IS NOT NULL").withColumn("d", F.col("va") - F.col("vb"))


def welch(df: DataFrame, by: list[str], value: str = "abundance", min_n: int = 3, more: tuple[Column, ...] = ()) -> DataFrame:
    """Welch's test per group: n_a, n_b, mean_a, mean_b, mean_diff, var_a, var_b, t, df, p_value, skip_reason; and
    further aggregates of the same pass."""
    v = F.col(value)
    a, b = F.when(F.col("arm") == "a", v), F.when(F.col("arm") == "b", v)
    g = df.groupBy(*by).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"), *more
    )
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    skip = F.when((F.col("n_a") < min_n) | (F.col("n_b") < min_n), "too_few").when((F.col("var_a") <= 0) & (F.col("var_b") <= 0), "zero_variance")
    ok = F.col("skip_reason").isNull()
    return (
        g.withColumn("mean_diff", F.col("mean_a") - F.col("mean_b")).withColumn("skip_reason", skip)
        .withColumn("t", F.when(ok, F.try_divide(F.col("mean_diff"), F.sqrt(sa + sb))))
        .withColumn("df", F.when(ok, F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))))
        .withColumn("p_value", t_pvalue("t", "df"))
    )


def paired(pair_rows: DataFrame, by: list[str], min_pairs: int = 3) -> DataFrame:
    """Paired t test per group of pairs(): n, mean_diff, sd, t, df, p_value, skip_reason."""
    return paired_test(pair_rows.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")), min_pairs)


def paired_test(g: DataFrame, min_pairs: int = 3) -> DataFrame:
    """Rows with n, mean_diff and sd, and their paired t test."""
    skip = F.when(F.col("n") < max(min_pairs, 2), "too_few").when(F.col("sd") <= 0, "zero_variance")
    ok = F.col("skip_reason").isNull()
    return (
        g.withColumn("skip_reason", skip)
        .withColumn("t", F.when(ok, F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))))
        .withColumn("df", F.when(ok, F.col("n") - 1).cast("double"))
        .withColumn("p_value", t_pvalue("t", "df"))
    )


def moderated(paired_rows: DataFrame, family: list[str], prior_df: float = 4.0) -> DataFrame:
    """Shrink each feature's variance towards the family's median variance: s2_post, t_mod, df_mod, p_mod."""
    s2 = F.col("sd") * F.col("sd")
    out = paired_rows.withColumn("s0", F.median(F.when(F.col("t").isNotNull(), s2)).over(W.partitionBy(*family)))
    out = out.withColumn("s2_post", (prior_df * F.col("s0") + F.col("df") * s2) / (prior_df + F.col("df")))
    out = out.withColumn("t_mod", F.try_divide(F.col("mean_diff"), F.sqrt(F.col("s2_post") / F.col("n")))).withColumn("df_mod", F.col("df") + prior_df)
    return out.withColumn("p_mod", t_pvalue("t_mod", "df_mod"))


def with_q(df: DataFrame, p: str, family: list[str], key: list[str], name: str = "q_value") -> DataFrame:
    return df.withColumn(name, bh_fdr(p, family, key))


def fold_change(df: DataFrame, by: list[str], value: str = "abundance") -> DataFrame:
    """log2 of the ratio of arm means on the linear scale; null if a side is empty or the second mean is zero."""
    lin = F.pow(F.lit(2.0), F.col(value))
    a, b = F.avg(F.when(F.col("arm") == "a", lin)), F.avg(F.when(F.col("arm") == "b", lin))
    return df.groupBy(*by).agg(a.alias("_a"), b.alias("_b")).withColumn("log2_fc", F.when(F.col("_b") > 0, F.log2(F.try_divide(F.col("_a"), F.col("_b"))))).drop("_a", "_b")


def effect_sizes(df: DataFrame, by: list[str], value: str = "abundance") -> DataFrame:
    """Pooled Cohen's d with its normal interval, and Hedges' g (d times 1 - 3 / (4 df - 1))."""
    v = F.col(value)
    a, b = F.when(F.col("arm") == "a", v), F.when(F.col("arm") == "b", v)
    g = df.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    n = F.col("n_a") + F.col("n_b")
    pooled = ((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / F.when(n > 2, n - 2)
    d = F.try_divide(F.col("_ma") - F.col("_mb"), F.sqrt(F.when(pooled > 0, pooled)))
    half = 1.96 * F.sqrt(n / (F.col("n_a") * F.col("n_b")) + F.col("cohen_d") * F.col("cohen_d") / (2 * n))
    return (
        g.withColumn("cohen_d", d).withColumn("d_low", F.col("cohen_d") - half).withColumn("d_high", F.col("cohen_d") + half)
        .withColumn("hedges_g", F.col("cohen_d") * (1 - 3 / (4 * (n - 2) - 1))).drop("_ma", "_mb", "_va", "_vb")
    )


def robust_paired_block(pair_rows: DataFrame, by: list[str], more: tuple[Column, ...] = ()) -> DataFrame:
    """Per group of pairs(): Cohen's dz, median, 20% trimmed mean and the 95% t interval of the mean difference; and
    further aggregates of the same pass."""
    g = pair_rows.groupBy(*by).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.median("d").alias("median_diff"), F.collect_list("d").alias("_d"), *more
    )
    half = F.col("_crit") * F.col("sd") / F.sqrt("n")
    return (
        g.withColumn("cohen_dz", F.try_divide(F.col("mean_diff"), F.col("sd"))).withColumn("trimmed_mean", trimmed_mean(F.col("_d")))
        .withColumn("_crit", t_critical(F.lit(0.975), (F.col("n") - 1).cast("double")))
        .withColumn("ci_low", F.col("mean_diff") - half).withColumn("ci_high", F.col("mean_diff") + half).drop("_d", "_crit")
    )


def signed_rank(pair_rows: DataFrame, by: list[str]) -> DataFrame:
    """Wilcoxon's signed-rank test, normal approximation: zeros dropped, no correction for ties or continuity."""
    d = pair_rows.where("d <> 0").withColumn("_abs", F.abs("d"))
    ranked = d.withColumn("_r", average_rank("_abs", *by))
    g = ranked.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.count("*").alias("n_nonzero"))
    n = F.col("n_nonzero")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return g.withColumn("z", z).withColumn("wilcoxon_p", normal_pvalue("z"))


def rank_sum(df: DataFrame, by: list[str], value: str = "abundance", ties: bool = False) -> DataFrame:
    """Wilcoxon's rank-sum test (normal approximation) and the AUC U / (n_a n_b) on average ranks.

    ties: correct the variance for ties.
    """
    ranked = df.withColumn("_r", average_rank(value, *by)).withColumn("_t", F.count("*").over(W.partitionBy(*by, value)))
    in_a = F.col("arm") == "a"
    g = ranked.groupBy(*by).agg(
        F.sum(F.when(in_a, 1).otherwise(0)).alias("n_a"), F.sum(F.when(in_a, 0).otherwise(1)).alias("n_b"), F.sum(F.when(in_a, F.col("_r")).otherwise(0.0)).alias("_ra"),
        F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("_ties"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    var = na * nb / 12 * ((n + 1) - (F.try_divide(F.col("_ties"), (n * (n - 1)).cast("double")) if ties else F.lit(0.0)))
    out = g.withColumn("u", F.col("_ra") - na * (na + 1) / 2)
    out = out.withColumn("auc", F.try_divide(F.col("u"), (na * nb).cast("double"))).withColumn("z", F.try_divide(F.col("u") - na * nb / 2, F.sqrt(F.when(var > 0, var))))
    return out.withColumn("rank_sum_p", normal_pvalue("z")).drop("_ra", "_ties")


def kruskal_wallis(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Tie-corrected H over the levels of `group`, with its chi-squared tail."""
    ranked = df.withColumn("_r", average_rank(value, *by)).withColumn("_t", F.count("*").over(W.partitionBy(*by, value)))
    per = ranked.groupBy(*by, group).agg(F.count("*").alias("_n"), F.sum("_r").alias("_s"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("_ties"))
    g = per.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("n_groups"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_q"), F.sum("_ties").alias("_ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.col("_ties") / (n * n * n - n))
    return g.withColumn("h", h).withColumn("kruskal_p", chi2_pvalue("h", (F.col("n_groups") - 1).cast("double"))).drop("_q", "_ties")


def jackknife_paired(pair_rows: DataFrame, by: list[str], min_pairs: int = 3) -> DataFrame:
    """Leave-one-pair-out t statistics in closed form from the group's sums, and what they say of stability.

    n, mean_diff, t, loo_sign_stability (share of replicates with the full data's sign; none for a zero mean),
    loo_p_stability (share with p < 0.05), min_t, max_t, most_influential (subject whose absence moves t most).
    A group with fewer than min_pairs + 1 pairs has no replicates.
    """
    w = W.partitionBy(*by)
    x = pair_rows.withColumn("_m", F.avg("d").over(w)).withColumn("_c", F.col("d") - F.col("_m"))
    x = x.withColumn("_n", F.count("*").over(w)).withColumn("_s", F.sum("_c").over(w)).withColumn("_q", F.sum(F.col("_c") * F.col("_c")).over(w))
    k = F.col("_n") - 1
    mean = (F.col("_s") - F.col("_c")) / F.when(k > 0, k)
    var = (F.col("_q") - F.col("_c") * F.col("_c") - k * mean * mean) / F.when(k > 1, k - 1)
    x = x.withColumn("_mean", mean + F.col("_m")).withColumn("_t", F.when(k >= min_pairs, F.try_divide(F.col("_mean"), F.sqrt(F.when(var > 1e-300, var) / k))))
    x = x.withColumn("_p", t_pvalue("_t", k.cast("double") - 1))
    full_sd = F.sqrt(F.col("_q") / F.when(F.col("_n") > 1, F.col("_n") - 1))
    x = x.withColumn("_full", F.try_divide(F.col("_m"), full_sd / F.sqrt("_n")))
    same = F.when(F.col("_t").isNotNull(), (F.col("_mean") * F.col("_m") > 0).cast("double"))
    return x.groupBy(*by).agg(
        F.first("_n").alias("n"), F.first("_m").alias("mean_diff"), F.first("_full").alias("t"), F.avg(same).alias("loo_sign_stability"),
        F.avg(F.when(F.col("_t").isNotNull(), (F.col("_p") < 0.05).cast("double"))).alias("loo_p_stability"), F.min("_t").alias("min_t"), F.max("_t").alias("max_t"),
        F.max_by("subject_id", F.when(F.col("_t").isNotNull(), F.struct(F.abs(F.col("_t") - F.col("_full")), -F.col("subject_id")))).alias("most_influential"),
    )


def sorted_results(df: DataFrame) -> DataFrame:
    """By comparison, q (nulls last), size of the difference, gene."""
    return df.orderBy("comparison", F.col("q_value").asc_nulls_last(), F.abs("mean_diff").desc(), "gene_symbol")
