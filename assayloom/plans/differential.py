"""Queries: two-group tests, effect sizes, rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import twogroup as T
from .common import ARMS_SQL, KEY, armed, bh_sql, effective_rows, normal_p_sql, round_sql, rounded, t_p_sql, with_views

_TAIL = ["panel", "gene_symbol"]


def de_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch tests for every comparison and gene, with q-values per comparison across all panels."""
    out = T.with_q(T.welch(armed(spark, sf_dir), KEY), "p_value", ["comparison"], _TAIL)
    return rounded(out.select(*KEY, "n_a", "n_b", "mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "q_value", "skip_reason"))


_WELCH_SQL = """
SELECT *, CASE WHEN skip_reason IS NULL THEN (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) END AS t,
  CASE WHEN skip_reason IS NULL THEN pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) END AS df, mean_a - mean_b AS mean_diff
FROM (
  SELECT *, CASE WHEN n_a < 3 OR n_b < 3 THEN 'too_few' WHEN var_a <= 0 AND var_b <= 0 THEN 'zero_variance' END AS skip_reason FROM (
    SELECT comparison, panel, gene_symbol, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b,
      avg(abundance) FILTER (arm = 'a') AS mean_a, avg(abundance) FILTER (arm = 'b') AS mean_b,
      var_samp(abundance) FILTER (arm = 'a') AS var_a, var_samp(abundance) FILTER (arm = 'b') AS var_b FROM arm GROUP BY ALL))"""


def de_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired tests on the subjects' means."""
    out = T.with_q(T.paired(T.pairs(armed(spark, sf_dir), KEY), KEY), "p_value", ["comparison"], _TAIL)
    return rounded(out.select(*KEY, "n", "mean_diff", "sd", "t", "df", "p_value", "q_value", "skip_reason"))


_PAIRED_SQL = """
SELECT *, CASE WHEN skip_reason IS NULL THEN mean_diff / (sd / sqrt(n)) END AS t, CASE WHEN skip_reason IS NULL THEN CAST(n - 1 AS DOUBLE) END AS df
FROM (SELECT *, CASE WHEN n < 3 THEN 'too_few' WHEN sd <= 0 THEN 'zero_variance' END AS skip_reason FROM (
  SELECT comparison, panel, gene_symbol, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM prs GROUP BY ALL))"""


def de_moderated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired tests with variances shrunk towards the comparison's median."""
    out = T.moderated(T.paired(T.pairs(armed(spark, sf_dir), KEY), KEY), ["comparison"])
    return rounded(out.select(*KEY, "s2_post", "t_mod", "df_mod", "p_mod"))


def fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.fold_change(armed(spark, sf_dir), KEY))


def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.effect_sizes(armed(spark, sf_dir), KEY))


def robust_paired_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dz, median, trimmed mean and the t interval of paired differences."""
    return rounded(T.robust_paired_block(T.pairs(armed(spark, sf_dir), KEY), KEY).select(*KEY, "n", "mean_diff", "cohen_dz", "median_diff", "trimmed_mean"))


def paired_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95% intervals of the mean paired difference (their quantile has no SQL form here)."""
    return rounded(T.robust_paired_block(T.pairs(armed(spark, sf_dir), KEY), KEY).select(*KEY, "ci_low", "ci_high"))


def wilcoxon_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.signed_rank(T.pairs(armed(spark, sf_dir), KEY), KEY))


def wilcoxon_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.rank_sum(armed(spark, sf_dir), KEY))


def wilcoxon_rank_sum_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-corrected, on prices rounded so that ties occur."""
    return rounded(T.rank_sum(armed(spark, sf_dir).withColumn("abundance", F.round("abundance", 1)), KEY, ties=True))


def kruskal_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.kruskal_wallis(effective_rows(spark, sf_dir), ["gene_symbol"], "condition", "abundance"))


def robust_paired_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-pair-out stability in closed form."""
    return rounded(T.jackknife_paired(T.pairs(armed(spark, sf_dir), KEY), KEY))


def panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests, skips, hits, least q and largest difference per comparison and panel."""
    de = T.with_q(T.welch(armed(spark, sf_dir), KEY), "p_value", ["comparison"], _TAIL)
    out = de.groupBy("comparison", "panel").agg(
        F.count("p_value").alias("n_tests"), F.count_if(F.col("p_value").isNull()).alias("n_skipped"), F.count_if(F.col("q_value") < 0.05).alias("n_strict"),
        F.count_if(F.col("q_value") < 0.5).alias("n_relaxed"), F.min("q_value").alias("min_q"), F.max(F.abs("mean_diff")).alias("max_abs_diff"),
    )
    return rounded(out)


QUERIES = {
    f.__name__: f
    for f in (
        de_welch, de_paired, de_moderated, fold_change, effect_sizes, robust_paired_block, paired_t_interval, wilcoxon_signed_rank, wilcoxon_rank_sum,
        wilcoxon_rank_sum_ties, kruskal_by_condition, robust_paired_jackknife, panel_report,
    )
}

_V = with_views(ARMS_SQL)
_WELCH_P = f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_WELCH_SQL})"
_KEYS = "comparison, panel, gene_symbol"


def _rank_sum_sql(rows: str, ties: bool) -> str:
    corrected = " - ties / (n * (n - 1))" if ties else ""
    return f"""
SELECT *, {normal_p_sql('z')} AS rank_sum_p FROM (
  SELECT {_KEYS}, n_a, n_b, u, u / (n_a * n_b) AS auc, (u - n_a * n_b / 2) / sqrt(n_a * n_b / 12 * ((n + 1){corrected})) AS z FROM (
    SELECT *, ra - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n FROM (
      SELECT {_KEYS}, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b, sum(r) FILTER (arm = 'a') AS ra, CAST(sum(tied * tied - 1) AS DOUBLE) AS ties FROM (
        SELECT *, rank() OVER (PARTITION BY {_KEYS} ORDER BY abundance) + (tied - 1) / 2 AS r FROM (
          SELECT *, count(*) OVER (PARTITION BY {_KEYS}, abundance) AS tied FROM ({rows}))) GROUP BY ALL)))"""


ORACLE = {
    "de_welch": _V + round_sql(["mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "q_value"], bh_sql("p_value", "comparison", "panel, gene_symbol", _WELCH_P), plain=(_KEYS, "n_a", "n_b", "skip_reason")),
    "de_paired": _V + round_sql(
        ["mean_diff", "sd", "t", "df", "p_value", "q_value"], bh_sql("p_value", "comparison", "panel, gene_symbol", f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_PAIRED_SQL})"), plain=(_KEYS, "n", "skip_reason")
    ),
    "de_moderated": _V + round_sql(["s2_post", "t_mod", "df_mod", "p_mod"], f"""
SELECT *, {t_p_sql('t_mod', 'df_mod')} AS p_mod FROM (SELECT *, mean_diff / sqrt(s2_post / n) AS t_mod, df + 4 AS df_mod FROM (
  SELECT *, (4 * median(CASE WHEN t IS NOT NULL THEN sd * sd END) OVER (PARTITION BY comparison) + df * sd * sd) / (4 + df) AS s2_post FROM ({_PAIRED_SQL})))""", plain=(_KEYS,)),
    "fold_change": _V + f"""
SELECT {_KEYS}, round(log2(avg(pow(2, abundance)) FILTER (arm = 'a') / avg(pow(2, abundance)) FILTER (arm = 'b')), 6) + 0.0 AS log2_fc FROM arm GROUP BY ALL""",
    "effect_sizes": _V + round_sql(["cohen_d", "d_low", "d_high", "hedges_g"], f"""
SELECT *, cohen_d - half AS d_low, cohen_d + half AS d_high, cohen_d * (1 - 3.0 / (4.0 * (n_a + n_b - 2) - 1)) AS hedges_g FROM (
  SELECT *, 1.96 * sqrt((n_a + n_b) / (n_a * n_b) + cohen_d * cohen_d / (2.0 * (n_a + n_b))) AS half FROM (
    SELECT {_KEYS}, n_a, n_b, (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS cohen_d FROM ({_WELCH_SQL})))""", plain=(_KEYS, "n_a", "n_b")),
    "robust_paired_block": _V + f"""
SELECT {_KEYS}, count(*) AS n, round(avg(d), 6) + 0.0 AS mean_diff, round(avg(d) / stddev_samp(d), 6) + 0.0 AS cohen_dz, round(median(d), 6) + 0.0 AS median_diff,
  round(list_avg(list_sort(list(d))[CAST(floor(count(*) * 0.2) AS INT) + 1 : CAST(count(*) - floor(count(*) * 0.2) AS INT)]), 6) + 0.0 AS trimmed_mean FROM prs GROUP BY ALL""",
    "wilcoxon_signed_rank": _V + round_sql(["w_plus", "z", "wilcoxon_p"], f"""
SELECT *, {normal_p_sql('z')} AS wilcoxon_p FROM (
  SELECT *, (w_plus - n_nonzero * (n_nonzero + 1) / 4) / sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24) AS z FROM (
    SELECT {_KEYS}, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus, count(*) AS n_nonzero FROM (
      SELECT *, rank() OVER (PARTITION BY {_KEYS} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {_KEYS}, abs(d)) - 1) / 2 AS r FROM prs WHERE d <> 0) GROUP BY ALL))""", plain=(_KEYS, "n_nonzero")),
    "wilcoxon_rank_sum": _V + round_sql(["u", "auc", "z", "rank_sum_p"], _rank_sum_sql("SELECT * FROM arm", False), plain=(_KEYS, "n_a", "n_b")),
    "wilcoxon_rank_sum_ties": _V + round_sql(["u", "auc", "z", "rank_sum_p"], _rank_sum_sql("SELECT * REPLACE (round(abundance, 1) AS abundance) FROM arm", True), plain=(_KEYS, "n_a", "n_b")),
    "kruskal_by_condition": _V + round_sql(["h", "kruskal_p"], """
SELECT *, exp(-h / 2) AS kruskal_p FROM (
  SELECT gene_symbol, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_groups, (12.0 / (sum(k) * (sum(k) + 1)) * sum(s * s / k) - 3 * (sum(k) + 1)) / (1 - sum(t) / (pow(sum(k), 3) - sum(k))) AS h FROM (
    SELECT gene_symbol, condition, count(*) AS k, sum(r) AS s, sum(tied * tied - 1) AS t FROM (
      SELECT *, rank() OVER (PARTITION BY gene_symbol ORDER BY abundance) + (tied - 1) / 2 AS r FROM (
        SELECT *, count(*) OVER (PARTITION BY gene_symbol, abundance) AS tied FROM eff)) GROUP BY ALL) GROUP BY gene_symbol)""", plain=("gene_symbol", "n", "n_groups")),
    "panel_report": _V + f"""
SELECT comparison, panel, count(p_value) AS n_tests, count(*) FILTER (p_value IS NULL) AS n_skipped, count(*) FILTER (q_value < 0.05) AS n_strict,
  count(*) FILTER (q_value < 0.5) AS n_relaxed, round(min(q_value), 6) + 0.0 AS min_q, round(max(abs(mean_diff)), 6) + 0.0 AS max_abs_diff
FROM ({bh_sql("p_value", "comparison", "panel, gene_symbol", _WELCH_P)}) GROUP BY ALL""",
    "robust_paired_jackknife": _V + round_sql(["mean_diff", "t", "loo_sign_stability", "loo_p_stability", "min_t", "max_t"], f"""
SELECT {_KEYS}, any_value(fn) AS n, any_value(fm) AS mean_diff, any_value(ft) AS t,
  avg(CASE WHEN lt IS NOT NULL THEN CASE WHEN lm * fm > 0 THEN 1.0 ELSE 0.0 END END) AS loo_sign_stability,
  avg(CASE WHEN lt IS NOT NULL THEN CASE WHEN lp < 0.05 THEN 1.0 ELSE 0.0 END END) AS loo_p_stability,
  min(lt) AS min_t, max(lt) AS max_t, max_by(subject_id, row(abs(lt - ft), -subject_id)) FILTER (lt IS NOT NULL) AS most_influential
FROM (SELECT *, {t_p_sql('lt', '(fn - 2)')} AS lp FROM (
  SELECT f.*, a.subject_id, l.lm, CASE WHEN fn - 1 >= 3 THEN l.lm / (l.ls / sqrt(fn - 1)) END AS lt
  FROM (SELECT {_KEYS}, count(*) AS fn, avg(d) AS fm, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS ft FROM prs GROUP BY ALL) f
  JOIN prs a USING ({_KEYS})
  JOIN (SELECT x.comparison, x.panel, x.gene_symbol, x.subject_id, avg(y.d) AS lm, stddev_samp(y.d) AS ls FROM prs x JOIN prs y
        ON x.comparison = y.comparison AND x.panel = y.panel AND x.gene_symbol = y.gene_symbol AND x.subject_id <> y.subject_id GROUP BY ALL) l
  ON l.comparison = a.comparison AND l.panel = a.panel AND l.gene_symbol = a.gene_symbol AND l.subject_id = a.subject_id)) GROUP BY ALL""", plain=(_KEYS, "n", "most_influential")),
}
