"""Queries: meta-analysis, concordance, coupling, reliability, scores, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import combine as M
from ..operators import scores as S
from ..operators import twogroup as T
from ..sources import views
from .common import ARMS_SQL, KEY, armed, bh_sql, effective_rows, normal_p_sql, round_sql, rounded, t_p_sql, with_views
from .differential import _WELCH_P


def _de(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_q(T.welch(armed(spark, sf_dir), KEY), "p_value", ["comparison"], ["panel", "gene_symbol"])


def _regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.welch(armed(spark, sf_dir), ["region", "comparison", "gene_symbol"])


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, gene_symbol: brands by their number's last digits."""
    brand = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_symbol")).distinct()
    return brand.select(F.concat(F.lit("M"), views.brand_number("gene_symbol") % 5).alias("module"), "gene_symbol")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.brand_number("gene_symbol")
    return modules(spark, sf_dir).select("module", "gene_symbol", ((n % 7 - 3) / 3.0).alias("loading"))


def meta_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as cohorts of Welch effects."""
    e = _regional(spark, sf_dir).select("comparison", "gene_symbol", F.col("mean_diff").alias("effect"), "t")
    out = M.meta(e, ["comparison", "gene_symbol"])
    return rounded(out.select("comparison", "gene_symbol", "n_cohorts", "fixed", "fixed_z", "fixed_p", "q", "i2", "tau2", "random", "random_z", "random_p", "stouffer_z", "stouffer_p"), 5)


def meta_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module effects over regions, with the binomial tail of their signs."""
    rows = armed(spark, sf_dir).join(modules(spark, sf_dir), "gene_symbol")
    means = rows.groupBy("region", "comparison", "module", "arm", "sample_id").agg(F.avg("abundance").alias("abundance"))
    e = T.welch(means, ["region", "comparison", "module"]).select("comparison", "module", F.col("mean_diff").alias("effect"), "t")
    out = M.meta(e, ["comparison", "module"])
    most, n = F.greatest("n_up", "n_down").cast("int"), (F.col("n_up") + F.col("n_down")).cast("int")
    return rounded(out.select("comparison", "module", "n_cohorts", "fixed", "random", "n_up", "n_down", M.binomial_tail(most, n).alias("sign_p")))


def asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.asymmetry(_de(spark, sf_dir), "A-N", "A-R", ["panel", "gene_symbol"], 0.5))


def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    de = _de(spark, sf_dir).withColumn("hit", F.coalesce(F.col("p_value") < 0.5, F.lit(False)))
    pairs = [("A-N", "A-R"), ("A-N", "N-R"), ("A-R", "N-R")]
    return rounded(M.concordance(de, pairs, "comparison", "gene_symbol", "mean_diff", "hit", 10))


def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gene: the subjects' A and N values against each other, each less the mean of all of them."""
    e = effective_rows(spark, sf_dir).groupBy("gene_symbol", "subject_id").agg(
        F.avg(F.when(F.col("condition") == "A", F.col("abundance"))).alias("x"), F.avg(F.when(F.col("condition") == "N", F.col("abundance"))).alias("y")
    )
    both = e.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_m", F.avg((F.col("x") + F.col("y")) / 2).over(W.partitionBy("gene_symbol")))
    return rounded(M.coupling(both.withColumns({"x": F.col("x") - F.col("_m"), "y": F.col("y") - F.col("_m")}), "x", "y", ["gene_symbol"]))


def partial_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.partial_rank_correlation(views.scores(spark, sf_dir), "s1", "s2", "s3", ["cohort"]))


def icc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of a user's events within their type."""
    return rounded(M.icc1(views.table(spark, sf_dir, "events"), "user_id", "value", ["event_type"]))


def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch results against those without one region each."""
    key = ["comparison", "panel", "gene_symbol"]
    rows = armed(spark, sf_dir)
    out = rows.select("region").distinct().withColumnRenamed("region", "replicate")
    loo = T.welch(rows.join(F.broadcast(out), F.col("region") != F.col("replicate")), ["replicate", *key])  # five regions
    loo = T.with_q(loo, "p_value", ["replicate", "comparison"], ["panel", "gene_symbol"])
    return rounded(M.robustness(_de(spark, sf_dir), loo, key, 0.9, 10).drop("stability_rank"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch, paired and moderated results of a gene, counted and graded."""
    a, key = armed(spark, sf_dir), ["comparison", "gene_symbol"]
    p = T.paired(T.pairs(a, KEY), KEY)
    rows = T.welch(a, KEY).select(*key, "mean_diff", "p_value").unionByName(p.select(*key, "mean_diff", "p_value"))
    rows = rows.unionByName(T.moderated(p, ["comparison"]).select(*key, "mean_diff", F.col("p_mod").alias("p_value")))
    return rounded(M.ensemble(rows, key, 0.2))


def score_modules_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.module_scores(effective_rows(spark, sf_dir), modules(spark, sf_dir), "mean"))


def score_modules_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.module_scores(effective_rows(spark, sf_dir), modules(spark, sf_dir), "median"))


def score_modules_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.module_scores(effective_rows(spark, sf_dir), modules(spark, sf_dir), "zscore"))


def singscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.singscore(effective_rows(spark, sf_dir), views.gene_sets(spark, sf_dir)))


def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir).select(F.col("gene_symbol").alias("feature"), F.col("loading").alias("weight"))
    return rounded(S.weighted_scores(effective_rows(spark, sf_dir), w))


def program_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading-weighted means; modules stand for programs."""
    w = weights(spark, sf_dir).withColumnRenamed("module", "program")
    return rounded(S.weighted_mean(effective_rows(spark, sf_dir), w))


def module_de(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = S.module_means(armed(spark, sf_dir), modules(spark, sf_dir))
    out = T.with_q(T.welch(means, ["comparison", "module"]), "p_value", ["comparison"], ["module"])
    return rounded(out.select("comparison", "module", "n_a", "n_b", "mean_diff", "t", "df", "p_value", "q_value"))


def ora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of p below a half in each comparison, against the part types' brands."""
    de = _de(spark, sf_dir)
    hits = de.where("p_value < 0.5").select(F.col("comparison").alias("query"), "gene_symbol")
    return rounded(S.over_representation(hits, views.gene_sets(spark, sf_dir), de.select("gene_symbol")))


def gsea_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.enrichment_scores(S.rank_statistic(_de(spark, sf_dir), "t"), views.gene_sets(spark, sf_dir), ["comparison"]))


def module_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the three comparisons' differences per subject and module."""
    p = T.pairs(armed(spark, sf_dir), KEY).join(modules(spark, sf_dir), "gene_symbol")
    wide = p.groupBy("subject_id", "module", "gene_symbol").agg(*(F.avg(F.when(F.col("comparison") == c, F.col("d"))).alias(c.replace("-", "_")) for c in ("A-N", "A-R", "N-R")))
    return rounded(S.trajectory(wide, ["A_N", "A_R", "N_R"]))


def programs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir).withColumnRenamed("module", "program")
    notes = w.groupBy("program").agg((F.abs(F.sum("loading")) / 10).alias("p_value"))
    return rounded(S.program_filter(w, notes, top_n=3, pattern="#1", max_p=0.05, min_loading=0.9, max_contamination=0.5))


def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir).withColumnRenamed("module", "program")
    a = S.weighted_mean(effective_rows(spark, sf_dir), w).withColumnRenamed("score", "activation")
    return rounded(S.counterfactual(w, a, "M2", 1.5))


_FUNCTIONS = (
    meta_protein, meta_module, asymmetry, concordance, coupling, partial_rank, icc_events, robustness, ensemble, score_modules_mean, score_modules_median, score_modules_zscore,
    singscore, score_weighted, program_scores, module_de, ora, gsea_scores, module_trajectory, programs_filter, counterfactual,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_V = with_views(ARMS_SQL) + """,
mdl AS (SELECT DISTINCT 'M' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 5) AS module, p_brand AS gene_symbol, (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 7 - 3) / 3.0::DOUBLE AS loading FROM part)"""
_DE = _V + f", de AS ({bh_sql('p_value', 'comparison', 'panel, gene_symbol', _WELCH_P)})"


def _welch_sql(by: str, rows: str) -> str:
    return f"""
SELECT *, mean_a - mean_b AS mean_diff, CASE WHEN ok THEN (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) END AS t,
  CASE WHEN ok THEN pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) END AS df
FROM (SELECT *, n_a >= 3 AND n_b >= 3 AND (va > 0 OR vb > 0) AS ok FROM (
  SELECT {by}, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b, avg(abundance) FILTER (arm = 'a') AS mean_a, avg(abundance) FILTER (arm = 'b') AS mean_b,
    var_samp(abundance) FILTER (arm = 'a') AS va, var_samp(abundance) FILTER (arm = 'b') AS vb FROM ({rows}) GROUP BY ALL))"""


def _meta_sql(key: str, rows: str) -> str:
    return f"""
WITH e AS (SELECT {key}, mean_diff AS effect, t, 1 / pow(mean_diff / t, 2) AS w FROM ({rows}) WHERE t IS NOT NULL AND t <> 0 AND mean_diff <> 0),
f AS (SELECT {key}, count(*) AS n_cohorts, sum(w) AS sw, sum(w * w) AS sw2, sum(w * effect) / sum(w) AS fixed, sum(t) / sqrt(count(*)) AS stouffer_z,
  count(*) FILTER (effect > 0) AS n_up, count(*) FILTER (effect < 0) AS n_down FROM e GROUP BY ALL HAVING count(*) >= 2),
h AS (SELECT {key}, any_value(sw) AS sw, any_value(sw2) AS sw2, greatest(0, sum(w * pow(effect - fixed, 2))) AS q FROM e JOIN f USING ({key}) GROUP BY ALL),
d AS (SELECT {key}, q, greatest(0, (q - (n_cohorts - 1)) / (h.sw - h.sw2 / h.sw)) AS tau2 FROM h JOIN f USING ({key})),
r AS (SELECT {key}, sum(effect / (1 / w + tau2)) / sum(1 / (1 / w + tau2)) AS random, sum(1 / (1 / w + tau2)) AS rw FROM e JOIN d USING ({key}) GROUP BY ALL)
SELECT *, fixed * sqrt(sw) AS fixed_z, random * sqrt(rw) AS random_z, CASE WHEN q > 0 THEN greatest(0, (q - (n_cohorts - 1)) / q) ELSE 0 END AS i2 FROM f JOIN d USING ({key}) JOIN r USING ({key})"""


def _scores_sql(how: str, value: str) -> str:
    return f"""
SELECT module, sample_id, round({how}(v), 6) + 0.0 AS score, round(count(DISTINCT gene_symbol) / any_value(declared), 6) AS coverage FROM (
  SELECT sample_id, gene_symbol, {value} AS v FROM (SELECT sample_id, gene_symbol, avg(abundance) AS x FROM eff GROUP BY ALL))
JOIN (SELECT module, gene_symbol, count(*) OVER (PARTITION BY module) AS declared FROM mdl) USING (gene_symbol) GROUP BY module, sample_id"""


_Z = "(x - avg(x) OVER (PARTITION BY gene_symbol)) / nullif(stddev_samp(x) OVER (PARTITION BY gene_symbol), 0)"
_HYPER = (
    "list_sum(list_transform(range(CAST(n_overlap AS INT), CAST(least(n_hits, n_set) AS INT) + 1), lambda i: CASE WHEN n_universe - n_set - n_hits + i < 0 THEN 0 ELSE exp("
    "lgamma(n_set + 1) - lgamma(i + 1) - lgamma(n_set - i + 1) + lgamma(n_universe - n_set + 1) - lgamma(n_hits - i + 1) - lgamma(n_universe - n_set - n_hits + i + 1) "
    "- lgamma(n_universe + 1) + lgamma(n_hits + 1) + lgamma(n_universe - n_hits + 1)) END))"
)
ORACLE = {
    "meta_protein": _V + round_sql(
        ["fixed", "fixed_z", "fixed_p", "q", "i2", "tau2", "random", "random_z", "random_p", "stouffer_z", "stouffer_p"],
        f"SELECT *, {normal_p_sql('fixed_z')} AS fixed_p, {normal_p_sql('random_z')} AS random_p, {normal_p_sql('stouffer_z')} AS stouffer_p FROM ({_meta_sql('comparison, gene_symbol', _welch_sql('region, comparison, gene_symbol', 'SELECT * FROM arm'))})",
        5, ("comparison", "gene_symbol", "n_cohorts"),
    ),
    "meta_module": _V + round_sql(["fixed", "random", "sign_p"], f"""
SELECT *, list_sum(list_transform(range(CAST(greatest(n_up, n_down) AS INT), CAST(n_up + n_down AS INT) + 1), lambda i: exp(lgamma(n_up + n_down + 1) - lgamma(i + 1) - lgamma(n_up + n_down - i + 1)))) / pow(2, n_up + n_down) AS sign_p
FROM ({_meta_sql('comparison, module', _welch_sql('region, comparison, module', 'SELECT region, comparison, module, arm, sample_id, avg(abundance) AS abundance FROM arm JOIN mdl USING (gene_symbol) GROUP BY ALL'))})""",
        plain=("comparison", "module", "n_cohorts", "n_up", "n_down")),
    "asymmetry": _DE + """
SELECT count(*) AS n_common, count(*) FILTER (a.p_value < 0.5) AS n_sig_first, count(*) FILTER (b.p_value < 0.5) AS n_sig_second, round(median(abs(a.mean_diff) / abs(b.mean_diff)), 6) AS median_abs_ratio,
  round(avg(CASE WHEN sign(a.mean_diff) = sign(b.mean_diff) THEN 1.0 ELSE 0.0 END), 6) AS sign_concordance
FROM de a JOIN de b ON a.gene_symbol = b.gene_symbol AND a.panel = b.panel AND a.comparison = 'A-N' AND b.comparison = 'A-R'""",
    "concordance": _DE + """,
tp AS (SELECT *, p_value < 0.5 AS hit, row_number() OVER (PARTITION BY comparison ORDER BY abs(mean_diff) DESC, gene_symbol) <= 10 AS top FROM de),
j AS (SELECT a.comparison AS label_a, b.comparison AS label_b, a.mean_diff AS ea, b.mean_diff AS eb, a.hit AS ha, b.hit AS hb, a.top AS ta, b.top AS tb FROM tp a JOIN tp b ON a.gene_symbol = b.gene_symbol AND a.comparison < b.comparison)
SELECT label_a, label_b, count(*) AS n_shared, round(corr(ra, rb), 6) AS spearman, round(avg(CASE WHEN (ea >= 0) = (eb >= 0) THEN 1.0 ELSE 0.0 END), 6) AS sign_concordance,
  count(*) FILTER (ha AND hb) AS n_hits_both, round(count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb), 6) AS top_jaccard
FROM (SELECT *, rank() OVER (PARTITION BY label_a, label_b ORDER BY ea) AS ra, rank() OVER (PARTITION BY label_a, label_b ORDER BY eb) AS rb FROM j) GROUP BY ALL""",
    "coupling": _V + round_sql(["rho", "ci_low", "ci_high", "p_value", "sign_p"], f"""
SELECT *, tanh(z - 1.96 / sqrt(n - 3)) AS ci_low, tanh(z + 1.96 / sqrt(n - 3)) AS ci_high, {normal_p_sql('z * sqrt(n - 3)')} AS p_value,
  list_sum(list_transform(range(CAST(n_same_sign AS INT), CAST(n_signed AS INT) + 1), lambda i: exp(lgamma(n_signed + 1) - lgamma(i + 1) - lgamma(n_signed - i + 1) - n_signed * ln(2)))) AS sign_p
FROM (SELECT *, atanh(greatest(-0.999999, least(0.999999, rho))) AS z FROM (
  SELECT gene_symbol, count(*) AS n, corr(rx, ry) AS rho, count(*) FILTER (x * y > 0) AS n_same_sign, count(*) FILTER (x * y <> 0) AS n_signed FROM (
    SELECT *, rank() OVER (PARTITION BY gene_symbol ORDER BY x) + (count(*) OVER (PARTITION BY gene_symbol, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY gene_symbol ORDER BY y) + (count(*) OVER (PARTITION BY gene_symbol, y) - 1) / 2 AS ry FROM (
      SELECT gene_symbol, x - avg((x + y) / 2) OVER (PARTITION BY gene_symbol) AS x, y - avg((x + y) / 2) OVER (PARTITION BY gene_symbol) AS y FROM (
        SELECT gene_symbol, subject_id, avg(abundance) FILTER (condition = 'A') AS x, avg(abundance) FILTER (condition = 'N') AS y FROM eff GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)))
  GROUP BY ALL HAVING count(*) >= 4))""", plain=("gene_symbol", "n", "n_same_sign", "n_signed")),
    "partial_rank": _V + """
SELECT cohort, count(*) AS n, round((corr(r1, r2) - corr(r1, r3) * corr(r2, r3)) / sqrt((1 - pow(corr(r1, r3), 2)) * (1 - pow(corr(r2, r3), 2))), 6) + 0.0 AS partial_rho FROM (
  SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY s1) AS r1, rank() OVER (PARTITION BY cohort ORDER BY s2) AS r2, rank() OVER (PARTITION BY cohort ORDER BY s3) AS r3 FROM sco) GROUP BY ALL""",
    "icc_events": """
SELECT event_type, n_subjects, n_single, round((msb - msw) / (msb + (k0 - 1) * msw), 6) + 0.0 AS icc FROM (
  SELECT event_type, count(*) FILTER (k >= 2) AS n_subjects, count(*) FILTER (k < 2) AS n_single,
    (sum(k * m * m) FILTER (k >= 2) - pow(sum(k * m) FILTER (k >= 2), 2) / sum(k) FILTER (k >= 2)) / (count(*) FILTER (k >= 2) - 1) AS msb,
    sum((k - 1) * v) FILTER (k >= 2) / (sum(k) FILTER (k >= 2) - count(*) FILTER (k >= 2)) AS msw,
    (sum(k) FILTER (k >= 2) - sum(k * k) FILTER (k >= 2) / sum(k) FILTER (k >= 2)) / (count(*) FILTER (k >= 2) - 1) AS k0
  FROM (SELECT event_type, user_id, count(*) AS k, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY ALL) GROUP BY event_type)""",
    "robustness": _DE + f""",
loo AS ({bh_sql('p_value', 'replicate, comparison', 'panel, gene_symbol', f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_welch_sql('replicate, comparison, panel, gene_symbol', 'SELECT r.replicate, a.* FROM arm a JOIN (SELECT DISTINCT region AS replicate FROM smp) r ON a.region <> r.replicate')})")})
SELECT comparison, panel, gene_symbol, n_replicates, round(s, 6) AS sign_match_rate, round(hit_rate, 6) AS hit_rate, round(abs(e) * s * (1 - q), 6) AS stability FROM (
  SELECT d.comparison, d.panel, d.gene_symbol, any_value(d.mean_diff) AS e, any_value(d.q_value) AS q, count(l.mean_diff) AS n_replicates,
    avg(CASE WHEN sign(d.mean_diff) = sign(l.mean_diff) THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN l.q_value < 0.9 THEN 1.0 ELSE 0.0 END) AS hit_rate
  FROM de d JOIN loo l USING (comparison, panel, gene_symbol) GROUP BY ALL)""",
    "score_modules_mean": _V + _scores_sql("avg", "x"),
    "score_modules_median": _V + _scores_sql("median", "x"),
    "score_modules_zscore": _V + _scores_sql("avg", _Z),
    "singscore": _V + """
SELECT set_name, sample_id, count(*) AS n_members, round(CASE WHEN count(*) >= 2 AND count(*) < any_value(n) THEN (2 * avg(r) - any_value(n) - 1) / (2 * (any_value(n) - count(*))) END, 6) + 0.0 AS score FROM (
  SELECT sample_id, gene_symbol, rank() OVER (PARTITION BY sample_id ORDER BY abundance) + (count(*) OVER (PARTITION BY sample_id, abundance) - 1) / 2 AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM eff)
JOIN gst USING (gene_symbol) GROUP BY set_name, sample_id""",
    "score_weighted": _V + f"""
SELECT sample_id, count(*) AS n_used, round(sum(loading * z) / sum(abs(loading)), 6) + 0.0 AS score FROM (SELECT sample_id, gene_symbol, {_Z.replace('(x', '(abundance')} AS z FROM eff)
JOIN mdl USING (gene_symbol) WHERE z IS NOT NULL GROUP BY sample_id HAVING count(*) >= 10""",
    "program_scores": _V + "SELECT module AS program, sample_id, round(sum(loading * abundance) / nullif(sum(abs(loading)), 0), 6) + 0.0 AS score FROM eff JOIN mdl USING (gene_symbol) GROUP BY ALL",
    "module_de": _V + round_sql(["mean_diff", "t", "df", "p_value", "q_value"], bh_sql(
        "p_value", "comparison", "module",
        f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_welch_sql('comparison, module', 'SELECT comparison, module, arm, sample_id, avg(abundance) AS abundance FROM arm JOIN mdl USING (gene_symbol) GROUP BY ALL')})",
    ), plain=("comparison", "module", "n_a", "n_b")),
    "ora": _DE + round_sql(["odds_ratio", "p_value", "q_value"], bh_sql("p_value", "query", "set_name", f"""
SELECT * REPLACE (least(1.0, p_value) AS p_value) FROM (
SELECT *, {_HYPER} AS p_value, CASE WHEN (n_hits - n_overlap) * (n_set - n_overlap) > 0 THEN n_overlap * (n_universe - n_hits - n_set + n_overlap) / ((n_hits - n_overlap) * (n_set - n_overlap))
  WHEN n_overlap * (n_universe - n_hits - n_set + n_overlap) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS odds_ratio FROM (
  SELECT comparison AS query, set_name, any_value(n_hits) AS n_hits, any_value(n_universe) AS n_universe, any_value(n_set) AS n_set, count(g.gene_symbol) AS n_overlap
  FROM (SELECT *, count(*) OVER (PARTITION BY comparison) AS n_hits, (SELECT count(DISTINCT gene_symbol) FROM de) AS n_universe FROM de WHERE p_value < 0.5) h
  CROSS JOIN (SELECT set_name, count(*) AS n_set FROM gst GROUP BY ALL) s LEFT JOIN gst g USING (set_name, gene_symbol) GROUP BY comparison, set_name))"""),
        plain=("query", "set_name", "n_hits", "n_set", "n_universe", "n_overlap")),
    "gsea_scores": _DE + """
SELECT comparison, set_name, round(run, 6) + 0.0 AS es, i AS peak, nh AS n_members FROM (
  SELECT *, row_number() OVER (PARTITION BY comparison, set_name ORDER BY round(abs(run), 12) DESC, i) AS best FROM (
    SELECT *, sum(CASE WHEN hit THEN abs(t) / nr ELSE -1.0 / (n - nh) END) OVER (PARTITION BY comparison, set_name ORDER BY t DESC, gene_symbol ROWS UNBOUNDED PRECEDING) AS run,
      row_number() OVER (PARTITION BY comparison, set_name ORDER BY t DESC, gene_symbol) AS i FROM (
      SELECT *, sum(CASE WHEN hit THEN abs(t) ELSE 0 END) OVER w AS nr, count(*) OVER w AS n, count(*) FILTER (hit) OVER w AS nh FROM (
        SELECT d.comparison, s.set_name, d.gene_symbol, d.t, EXISTS (SELECT 1 FROM gst g WHERE g.set_name = s.set_name AND g.gene_symbol = d.gene_symbol) AS hit
        FROM de d CROSS JOIN (SELECT DISTINCT set_name FROM gst) s WHERE d.t IS NOT NULL) WINDOW w AS (PARTITION BY comparison, set_name)) WHERE nh > 0 AND nh < n)) WHERE best = 1""",
    "module_trajectory": _V + """
SELECT subject_id, module, round(avg(d) FILTER (comparison = 'A-N'), 6) + 0.0 AS "mean_A_N", round(avg(d) FILTER (comparison = 'A-R'), 6) + 0.0 AS "mean_A_R", round(avg(d) FILTER (comparison = 'N-R'), 6) + 0.0 AS "mean_N_R"
FROM prs JOIN mdl USING (gene_symbol) GROUP BY ALL""",
    "programs_filter": _V + """
SELECT program, round(max_loading, 6) AS max_loading, round(contamination, 6) AS contamination, round(best_p, 6) AS best_p, r AS fail_reasons, r = '' AS kept FROM (
  SELECT *, concat_ws(',', CASE WHEN best_p > 0.05 THEN 'annotation' END, CASE WHEN max_loading < 0.9 THEN 'loading' END, CASE WHEN contamination > 0.5 THEN 'contamination' END) AS r FROM (
    SELECT module AS program, max(abs(loading)) AS max_loading, abs(sum(loading)) / 10 AS best_p, avg(CASE WHEN gene_symbol LIKE '%#1%' THEN 1.0 ELSE 0.0 END) FILTER (place <= 3) AS contamination
    FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY abs(loading) DESC, gene_symbol) AS place FROM mdl) GROUP BY ALL))""",
    "counterfactual": _V + """
SELECT sample_id, m.gene_symbol, round(m.loading * (a.activation - 1.5), 6) + 0.0 AS shift FROM (
  SELECT sample_id, sum(loading * abundance) / sum(abs(loading)) AS activation FROM eff JOIN mdl USING (gene_symbol) WHERE module = 'M2' GROUP BY ALL) a CROSS JOIN (SELECT * FROM mdl WHERE module = 'M2') m""",
}
