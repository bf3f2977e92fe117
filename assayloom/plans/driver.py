"""Queries: the differential-abundance driver, ensembles, detectability, plexes, summaries; and SQL for models elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators import differential as DA
from ..operators import linear as L
from ..operators import network as G
from ..operators import plex as P
from ..operators import resample as R
from ..operators import scores as S
from ..operators import twogroup as T
from ..sources import views
from . import models, networks
from .combining import weights
from .common import ARMS_SQL, KEY, armed, bh_sql, effective_rows, normal_p_sql, round_sql, rounded, simpson, t_p_sql, with_views
from .differential import _PAIRED_SQL, _WELCH_SQL, _rank_sum_sql

GROUPS = "A-N,A-R,N-R"


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.brand_number("p_brand")
    return views.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), n % 4).alias("panel"), F.col("p_brand").alias("gene_symbol"), F.col("p_brand").alias("assay_id"), F.array(F.concat(F.lit("U"), n)).alias("uniprot")).distinct()


def _run(spark: SparkSession, sf_dir: str, test: str, groups: str = GROUPS, **more) -> DataFrame:
    return DA.differential(views.measurements(spark, sf_dir), views.samples(spark, sf_dir), _proteins(spark, sf_dir), test=test, groups=groups, **more)


def de_driver_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result table of paired tests: all 40 columns."""
    return rounded(_run(spark, sf_dir, "paired-t"), 5)


def de_driver_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir, "welch-t"), 5)


def de_driver_moderated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir, "moderated").select(*KEY, "n_pairs", "mean_diff", "t", "df", "p_value", "bh_q", "s2_prior", "s2_posterior", "df_prior", "method"), 5)


def de_driver_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch with a covariate becomes least squares."""
    return rounded(_run(spark, sf_dir, "welch-t", numeric=["acctbal"]).select(*KEY, "n_pairs", "n_a", "n_b", "mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "bh_q", "effect_size", "effect_size_method", "ci_low", "ci_high", "method"), 5)


def de_driver_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each subject beside the arm: the supplier's balance once more."""
    proxy = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.col("s_acctbal").alias("proxy"))
    return rounded(_run(spark, sf_dir, "paired-t", "A-R", proxy=proxy).select(*KEY, "mean_diff", "t", "df", "p_value", "bh_q", "method"), 5)


def de_driver_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as conditions, the unnamed ones as EUROPE, controls among the cases, one flag only."""
    out = _run(spark, sf_dir, "welch-t", "ASIA-EUROPE", condition_col="region", subset="condition==R", collapse_others_to="EUROPE", include_controls=True)
    return rounded(out.select(*KEY, "n_a", "n_b", "mean_diff", "t", "df", "p_value", "bh_q"), 5)


def de_driver_paired_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by nation: of a nation's samples under a flag, the last by id counts. Sparse genes are left out."""
    out = _run(spark, sf_dir, "paired-t", "A-N", paired_by="nation", max_missing=0.5)
    return rounded(out.select(*KEY, "n_pairs", "mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "bh_q"), 5)


def de_driver_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir, "mixed", "A-R").select(*KEY, "n_pairs", "mean_diff", "t", "df", "p_value", "bh_q", "method"), 4)


def de_driver_limma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir, "limma", "A-N,A-R").select(*KEY, "n_a", "n_b", "mean_diff", "t", "df", "p_value", "bh_q", "s2_posterior", "method"), 5)


def de_driver_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(DA.report(_run(spark, sf_dir, "welch-t"), 0.2, 0.6), 5)


def de_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four methods' results of a gene, with their agreement and grade."""
    rows = _run(spark, sf_dir, "paired-t")
    for test, more in (("moderated", {}), ("welch-t", {}), ("ols", {"numeric": ["acctbal"]})):
        rows = rows.unionByName(_run(spark, sf_dir, test, **more))
    found = DA.ensemble(rows, alpha=0.5)
    return rounded(found.select("comparison", "panel", "gene_symbol", "assay_id", "n_applied", "n_significant", "n_sign_consistent", "majority_sign", "grade", "methods_applied"))


def de_ensemble_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stouffer's p of two methods, by which the ensemble ranks genes."""
    return rounded(DA.ensemble(_run(spark, sf_dir, "paired-t").unionByName(_run(spark, sf_dir, "welch-t"))).select(*KEY, "ensemble_p", "ensemble_q"), 4)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models._detectability(spark, sf_dir).withColumn("comparison", F.lit("A-R"))


def detectability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.detectability_summary(_detected(spark, sf_dir), ["comparison"], ["assay_id"], 0.5), 5)


def weighted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted signature under two conditions: d with its interval, Welch's p, AUC."""
    w = weights(spark, sf_dir).select(F.col("gene_symbol").alias("feature"), F.col("loading").alias("weight"))
    scored = S.weighted_scores(effective_rows(spark, sf_dir), w).join(views.samples(spark, sf_dir).select("sample_id", "condition"), "sample_id")
    return rounded(S.weighted_summary(T.arms(scored, [("A", "R")])), 5)


def recover_plex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples joined by what they lack, as plexes."""
    m = views.measurements(spark, sf_dir, by_type=True)
    return rounded(P.recover(m, "sample_id", "assay_id", views.samples(spark, sf_dir), 0.6)[0], 5)


def recover_plex_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.measurements(spark, sf_dir, by_type=True)
    found, means = P.recover(m, "sample_id", "assay_id", views.samples(spark, sf_dir), 0.6)
    return rounded(P.diagnosed(found, means, 10), 5)


def plex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two flags paired within a nation by the nearest numbers in their ids."""
    s = views.samples(spark, sf_dir).where("NOT is_control AND condition IN ('A', 'R')").select("sample_id", "condition", F.col("nation").alias("plex"))
    both = s.groupBy("plex").pivot("condition", ["A", "R"]).count().where("A = R").select("plex")
    return P.infer_pairs(s.join(both, "plex"), "A-R", 1_000_000)


def bootstrap_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the paired differences of programs' loading-weighted means."""
    w = weights(spark, sf_dir).withColumnRenamed("module", "program")
    scored = S.weighted_mean(effective_rows(spark, sf_dir), w).join(views.samples(spark, sf_dir).select("sample_id", "subject_id", "condition"), "sample_id")
    p = T.pairs(T.arms(scored, [("A", "N"), ("A", "R")]), ["comparison", "program"], value="score")
    return rounded(R.bootstrap_pairs(p, ["comparison", "program"], 500, 5))


def archetype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many archetypes there are, span cohorts, and hold all of them, and agree in the category of their programs."""
    members = networks.align_archetypes(spark, sf_dir)
    programs = networks._loadings(spark, sf_dir).select("cohort", "program").distinct()
    named = programs.select(F.concat_ws(":", "cohort", "program").alias("node"), "cohort", (F.substring("program", 2, 1).cast("int") % 2).cast("string").alias("category"))
    return rounded(G.archetype_summary(members.join(named, "node"), programs))


def align_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted pairs and reciprocal matches by metric, number of top features and threshold."""
    return rounded(G.alignment_sweep(networks._loadings(spark, sf_dir), [("jaccard", n) for n in (2, 3, 4)] + [("cosine", 0)], [0.2, 0.4, 0.6]))


def endmember_ora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that stand out in each condition's mean profile, against the gene sets."""
    means = effective_rows(spark, sf_dir).groupBy("condition", "gene_symbol").agg(F.avg("abundance").alias("level"))
    return rounded(S.endmember_enrichment(means.withColumnRenamed("condition", "endmember"), views.gene_sets(spark, sf_dir), 8))


def msqrob_squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptide models with variances shrunk across proteins, and their tests."""
    return rounded(L.squeeze(L.peptide_model(models._peptides(spark, sf_dir), "gene_symbol", "abundance", models.LEVELS, "peptide", ridge=0.1)), 5)


def stratified_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals of a score's cohort differences, drawn within cohort and condition."""
    s = views.scores(spark, sf_dir).select("sample_id", "cohort", "condition", "s1")
    return rounded(R.stratified_bootstrap(s, ["cohort"], "condition", ("L0", "L1"), "s1", 400, 3))


def align_bootstrap_bca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of each program to its best match in other cohorts, with bias-corrected accelerated intervals."""
    best = networks.align_best_matches(spark, sf_dir).groupBy("a_cohort").agg(F.sort_array(F.collect_list("similarity")).alias("v"))

    def run(batches):
        for b in batches:
            rows = []
            for cohort, v in zip(b["a_cohort"], b["v"], strict=True):
                v = np.asarray(v, float)
                lo, hi = R.bca_interval(v, np.mean, 800, 13, cohort)
                rows.append((cohort, len(v), float(v.mean()), lo, hi))
            yield pd.DataFrame(rows, columns=["cohort", "n", "mean_similarity", "ci_low", "ci_high"])

    return rounded(best.mapInPandas(run, "cohort string, n bigint, mean_similarity double, ci_low double, ci_high double"), 5)


def limma_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderated F tests over all conditions."""
    return rounded(L.moderate_f(L.f_fits(effective_rows(spark, sf_dir), "gene_symbol", "abundance", [], models.LEVELS, "condition")), 5)


def limma_f_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the moderated F tests start from: each gene's own F and variance."""
    return rounded(L.f_fits(effective_rows(spark, sf_dir), "gene_symbol", "abundance", [], models.LEVELS, "condition"), 5)


def limma_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the moderated t tests start from: the contrast of two conditions beside the third, and the pooled variance."""
    return rounded(models._fits(spark, sf_dir), 5)


def align_centred_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.program_similarity(networks._loadings(spark, sf_dir), "centred-cosine"))


def decompose_ica_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of every component and feature, from the first seed."""
    return rounded(D.ica_runs(spark, models._scores(spark, sf_dir), 4, 1).drop("seed"), 4)


def decompose_nmf_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both factors of one run as long rows: what each sample has of a program, and each program of a feature."""
    wide = models._scores(spark, sf_dir)
    x = spark.sparkContext.broadcast((np.power(2.0, np.clip(wide.to_numpy(), -6, 6)), [str(i) for i in wide.index], [str(c) for c in wide.columns]))

    def kernel(seed: int) -> list[tuple]:
        values, rows, columns = x.value
        f = D.nmf(values, 3, seed)
        return [("sample", r, k, float(f["w"][i, k])) for i, r in enumerate(rows) for k in range(3)] + [("feature", c, k, float(f["h"][k, j])) for j, c in enumerate(columns) for k in range(3)]

    return rounded(D.seeds(spark, kernel, 1, "axis string, name string, program bigint, value double"), 4)


def paired_t_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical values of t for the comparisons' degrees of freedom."""
    n = T.paired(T.pairs(armed(spark, sf_dir), KEY), KEY).where("df IS NOT NULL").select("df").distinct()
    return rounded(n.withColumn("critical", DA.t_critical(F.lit(0.975), F.col("df"))), 5)


_FUNCTIONS = (
    de_driver_paired, de_driver_welch, de_driver_moderated, de_driver_adjusted, de_driver_proxy, de_driver_overrides, de_driver_paired_by, de_driver_mixed, de_driver_limma, de_driver_report,
    de_ensemble, de_ensemble_p, detectability_summary, weighted_summary, recover_plex, recover_plex_quality, plex_pairs, bootstrap_program, archetype_summary, align_sweep, endmember_ora,
    msqrob_squeezed, stratified_draws, align_bootstrap_bca, paired_t_bounds, limma_f, limma_f_fits, limma_fits, align_centred_cosine,
    decompose_ica_loadings, decompose_nmf_factors,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_V = with_views(ARMS_SQL)
_KEYS = "comparison, panel, gene_symbol"


def _t_quantile(rows: str, df: str = "df", steps: int = 9) -> str:
    """SQL: rows with crit, the 97.5 % quantile of t for their df, by Newton's steps from below."""
    dense = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + crit * crit / {df}, -({df} + 1) / 2)"
    out = f"SELECT *, 1.9::DOUBLE AS crit FROM ({rows})"
    for _ in range(steps):
        out = f"SELECT * REPLACE (crit + ({t_p_sql('crit', df)} - 0.05) / (2 * {dense}) AS crit) FROM ({out})"
    return out


_RESULT = {c: ("''" if c in ("skip_reason", "effect_size_method", "wilcoxon_method", "posthoc_method") else f"CAST(NULL AS {'BIGINT' if k == 'bigint' else 'DOUBLE'})" if k != "string" else "''") for c, k in DA.RESULTS.items()}
_META = {"assay_id": "gene_symbol", "uniprot": "'U' || regexp_extract(gene_symbol, '([0-9]+)', 1)"}


def _result_sql(rows: str, given: dict[str, str]) -> str:
    """The 40 columns from rows that have bh_q; what isn't given is empty."""
    cells = {**_RESULT, **_META, **{c: c for c in ("panel", "gene_symbol", "comparison")}, **given}
    return "SELECT " + ", ".join(f"round({cells[c]}, 5) + 0.0 AS {c}" if k == "double" and not cells[c].startswith("CAST(NULL") else f"{cells[c]} AS {c}" for c, k in DA.RESULTS.items()) + f" FROM ({rows})"


_SKIPS = "CASE skip_reason WHEN 'too_few' THEN 'insufficient_pairs' WHEN 'zero_variance' THEN 'zero_variance' ELSE '' END"
_PAIRED_Q = bh_sql("p_value", "comparison", "panel, gene_symbol", f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_PAIRED_SQL})")
_WELCH_Q = bh_sql("p_value", "comparison", "panel, gene_symbol", f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_WELCH_SQL})")
_TRIM = "list_avg(list_sort({l})[CAST(floor(len({l}) * 0.2) AS INT) + 1 : CAST(len({l}) - floor(len({l}) * 0.2) AS INT)])"
_RANK = f"""
SELECT {_KEYS}, n_nonzero, {normal_p_sql('z')} AS wilcoxon_p FROM (
  SELECT *, (w_plus - n_nonzero * (n_nonzero + 1) / 4) / sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24) AS z FROM (
    SELECT {_KEYS}, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus, count(*) AS n_nonzero FROM (
      SELECT *, rank() OVER (PARTITION BY {_KEYS} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {_KEYS}, abs(d)) - 1) / 2 AS r FROM prs WHERE d <> 0) GROUP BY ALL))"""
_PAIRED_ALL = f"""
SELECT q.*, x.mean_a, x.mean_b, x.med, x.trim, r.wilcoxon_p, r.n_nonzero, c.crit FROM ({_PAIRED_Q}) q
JOIN (SELECT {_KEYS}, avg(va) AS mean_a, avg(vb) AS mean_b, median(d) AS med, {_TRIM.format(l='list(d)')} AS trim FROM prs GROUP BY ALL) x USING ({_KEYS})
LEFT JOIN ({_RANK}) r USING ({_KEYS}) LEFT JOIN ({_t_quantile(f"SELECT DISTINCT df FROM ({_PAIRED_SQL}) WHERE df IS NOT NULL")}) c ON c.df = q.df"""
_WELCH_ALL = f"""
SELECT q.*, x.med, x.trim, e.g, r.rank_sum_p, c.crit FROM ({_WELCH_Q}) q
JOIN (SELECT {_KEYS}, median(abundance) FILTER (arm = 'a') - median(abundance) FILTER (arm = 'b') AS med,
  {_TRIM.format(l="list(abundance) FILTER (arm = 'a')")} - {_TRIM.format(l="list(abundance) FILTER (arm = 'b')")} AS trim FROM arm GROUP BY ALL) x USING ({_KEYS})
JOIN (SELECT {_KEYS}, (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) * (1 - 3.0 / (4.0 * (n_a + n_b - 2) - 1)) AS g FROM ({_WELCH_SQL})) e USING ({_KEYS})
JOIN ({_rank_sum_sql('SELECT * FROM arm', False)}) r USING ({_KEYS})
LEFT JOIN ({_t_quantile(f"SELECT {_KEYS}, df FROM ({_WELCH_SQL}) WHERE df IS NOT NULL")}) c USING ({_KEYS})"""


def _plain_welch(rows: str, min_n: int = 3) -> str:
    """Welch of rows with comparison, panel, gene_symbol, arm and abundance, with q-values."""
    return bh_sql("p_value", "comparison", "panel, gene_symbol", f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM ({_WELCH_SQL.replace('FROM arm GROUP BY ALL', f'FROM ({rows}) GROUP BY ALL').replace('< 3', f'< {min_n}')})")


def _ancova(rows: str, x: str) -> str:
    """The arm's coefficient beside one covariate, by sums of squares within the arms."""
    return f"""
SELECT *, {t_p_sql('t', 'df')} AS p_value FROM (SELECT *, mean_diff / se AS t FROM (
  SELECT *, sqrt(s2 * (1.0 / n_a + 1.0 / n_b + pow(xa - xb, 2) / sxx)) AS se, 1.96 * sqrt((n_a + n_b) / (n_a * n_b) + d * d / (2.0 * (n_a + n_b))) AS half FROM (
    SELECT *, (mean_a - mean_b) - sxy / sxx * (xa - xb) AS mean_diff, (syy - sxy * sxy / sxx) / (n_a + n_b - 3) AS s2, CAST(n_a + n_b - 3 AS DOUBLE) AS df, (mean_a - mean_b) / sqrt(syy / (n_a + n_b - 2)) AS d FROM (
      SELECT {_KEYS}, sum(n) FILTER (arm = 'a') AS n_a, sum(n) FILTER (arm = 'b') AS n_b, any_value(y) FILTER (arm = 'a') AS mean_a, any_value(y) FILTER (arm = 'b') AS mean_b,
        any_value(x) FILTER (arm = 'a') AS xa, any_value(x) FILTER (arm = 'b') AS xb, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM (
        SELECT {_KEYS}, arm, CAST(count(*) AS BIGINT) AS n, avg(abundance) AS y, avg({x}) AS x, regr_sxx(abundance, {x}) AS sxx, regr_sxy(abundance, {x}) AS sxy, regr_syy(abundance, {x}) AS syy FROM ({rows}) GROUP BY ALL)
      GROUP BY {_KEYS}))))"""


_ADJUSTED = bh_sql("p_value", "comparison", "panel, gene_symbol", _ancova("SELECT * FROM arm", "acctbal"))
_ONE_ARM = _ancova("SELECT * FROM arm WHERE comparison = 'A-R'", "acctbal")
_MODERATED = f"""
SELECT * EXCLUDE (t, df), t_mod AS t, df_mod AS df, {t_p_sql('t_mod', 'df_mod')} AS p_value FROM (SELECT *, mean_diff / sqrt(s2_post / n) AS t_mod, df + 4 AS df_mod FROM (
  SELECT *, (4 * s0 + df * sd * sd) / (4 + df) AS s2_post FROM (SELECT *, median(CASE WHEN t IS NOT NULL THEN sd * sd END) OVER (PARTITION BY comparison) AS s0 FROM ({_PAIRED_SQL}))) WHERE t IS NOT NULL)"""
_MODERATED_Q = bh_sql("p_value", "comparison", "panel, gene_symbol", _MODERATED)
_NATION = f"""
SELECT {_KEYS}, count(d) AS n, avg(va) AS mean_a, avg(vb) AS mean_b, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM (
  SELECT comparison, panel, gene_symbol, nation, max_by(abundance, sample_id) FILTER (arm = 'a') AS va, max_by(abundance, sample_id) FILTER (arm = 'b') AS vb, va - vb AS d
  FROM arm WHERE comparison = 'A-N' GROUP BY ALL HAVING va IS NOT NULL AND vb IS NOT NULL)
WHERE (panel, gene_symbol) IN (SELECT (panel, gene_symbol) FROM arm WHERE comparison = 'A-N' GROUP BY panel, gene_symbol
  HAVING 1 - count(*) / (SELECT count(*) FROM smp WHERE NOT is_control AND condition IN ('A', 'N')) <= 0.5) GROUP BY ALL"""
_DETECT = f"""
SELECT *, CASE WHEN NOT tested THEN NULL ELSE {normal_p_sql('log_odds / se')} END AS detection_p FROM (
  SELECT *, rate_a > 0 AND rate_a < 1 AND rate_b > 0 AND rate_b < 1 AS tested, CASE WHEN tested THEN ln(rate_a / (1 - rate_a)) - ln(rate_b / (1 - rate_b)) END AS log_odds,
    CASE WHEN tested THEN sqrt(1 / (n_a * rate_a * (1 - rate_a)) + 1 / (n_b * rate_b * (1 - rate_b))) END AS se FROM (
    SELECT assay_id, count(*) AS n, count(*) FILTER (condition = 'A') AS n_a, count(*) FILTER (condition = 'R') AS n_b, count(v) FILTER (condition = 'A') AS n_detected_a, count(v) FILTER (condition = 'R') AS n_detected_b,
      n_detected_a / n_a AS rate_a, n_detected_b / n_b AS rate_b, avg(v) FILTER (condition = 'A') - avg(v) FILTER (condition = 'R') AS raw_diff,
      var_samp(v) FILTER (condition = 'A') AS va, var_samp(v) FILTER (condition = 'R') AS vb FROM (
      SELECT a.assay_id, s.sample_id, s.condition, f.abundance AS v FROM (SELECT DISTINCT assay_id FROM fine) a CROSS JOIN (SELECT * FROM smp WHERE condition IN ('A', 'R') AND NOT is_control) s
      LEFT JOIN (SELECT * FROM fine WHERE NOT below_lod) f ON f.assay_id = a.assay_id AND f.sample_id = s.sample_id) GROUP BY assay_id))"""
_DETECT_ALL = f"""
SELECT *, CASE WHEN ok THEN {t_p_sql('t', 'df')} END AS abundance_p, CASE WHEN ok THEN raw_diff END AS abundance_diff FROM (SELECT *, CASE WHEN ok THEN raw_diff / sqrt(s2 * (1.0 / n_detected_a + 1.0 / n_detected_b)) END AS t FROM (
  SELECT *, n_detected_a > 0 AND n_detected_b > 0 AND n_detected_a + n_detected_b > 2 AS ok, CAST(n_detected_a + n_detected_b - 2 AS DOUBLE) AS df,
    (coalesce(va, 0) * greatest(n_detected_a - 1, 0) + coalesce(vb, 0) * greatest(n_detected_b - 1, 0)) / (n_detected_a + n_detected_b - 2) AS s2 FROM ({_DETECT})))"""


def _components_sql(edges: str, a: str = "a", b: str = "b") -> str:
    """Nodes with the least node reachable, by repeated closure."""
    return f"""
e AS (SELECT {a} AS x, {b} AS y FROM ({edges}) UNION SELECT {b}, {a} FROM ({edges})),
r(node, seen) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen)
SELECT node, min(seen) AS root FROM r GROUP BY node"""


def _f_tail(f: str, d1: str, d2: str) -> str:
    """SQL for the upper tail of F: the incomplete beta integral over the angle."""
    body = f"pow(greatest(0, sin({{x}})), ({d2}) - 1) * pow(greatest(0, cos({{x}})), ({d1}) - 1)"
    return f"({simpson(body, '0.0', f'asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))')} / {simpson(body, '0.0', 'pi() / 2')})"


_OLS = f"""
SELECT *, {t_p_sql('t', 'df')} AS p_value, {_f_tail('f', '3', 'df')} AS f_p FROM (SELECT *, estimate / se AS t FROM (
  SELECT gene_symbol, unnest([{{'term': 'intercept', 'estimate': ya - b * xa, 'se': sqrt(s2 * (1.0 / na + xa * xa / sxx))}}, {{'term': 'acctbal', 'estimate': b, 'se': sqrt(s2 / sxx)}},
    {{'term': 'condition[N]', 'estimate': yn - ya - b * (xn - xa), 'se': sqrt(s2 * (1.0 / na + 1.0 / nn + pow(xn - xa, 2) / sxx))}},
    {{'term': 'condition[R]', 'estimate': yr - ya - b * (xr - xa), 'se': sqrt(s2 * (1.0 / na + 1.0 / nr + pow(xr - xa, 2) / sxx))}}], recursive := true), df, n, ((sst - sse) / 3) / s2 AS f FROM (
    SELECT *, sxy / sxx AS b, syy - sxy * sxy / sxx AS sse, CAST(n - 4 AS DOUBLE) AS df, sse / df AS s2 FROM (
      SELECT gene_symbol, sum(k) AS n, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy, {', '.join(f"any_value(k) FILTER (condition = '{c}') AS n{c.lower()}, any_value(y) FILTER (condition = '{c}') AS y{c.lower()}, any_value(x) FILTER (condition = '{c}') AS x{c.lower()}" for c in 'ANR')} FROM (
        SELECT gene_symbol, condition, CAST(count(*) AS BIGINT) AS k, avg(abundance) AS y, avg(acctbal) AS x, regr_sxx(abundance, acctbal) AS sxx, regr_sxy(abundance, acctbal) AS sxy, regr_syy(abundance, acctbal) AS syy FROM eff GROUP BY ALL)
      GROUP BY gene_symbol) JOIN (SELECT gene_symbol, var_samp(abundance) * (count(*) - 1) AS sst FROM eff GROUP BY ALL) USING (gene_symbol))))"""
_ENSEMBLE = " UNION ALL ".join(
    f"SELECT {_KEYS}, mean_diff, p_value, q_value, '{m}' AS method FROM ({rows})" for m, rows in (("paired-t", _PAIRED_Q), ("moderated", _MODERATED_Q), ("welch-t", _WELCH_Q), ("ols", _ADJUSTED))
)
_PLEX = """,
o AS (SELECT DISTINCT sample_id AS x, assay_id AS y FROM fine),
ab AS (SELECT x, y FROM (SELECT sample_id AS x FROM smp) CROSS JOIN (SELECT DISTINCT y FROM o) EXCEPT SELECT x, y FROM o),
k AS (SELECT s.sample_id AS x, count(ab.y) AS n FROM smp s LEFT JOIN ab ON ab.x = s.sample_id GROUP BY ALL),
bt AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM ab a JOIN ab b ON a.y = b.y AND a.x < b.x GROUP BY ALL),
ds AS (SELECT ka.x AS a, kb.x AS b, CASE WHEN ka.n + kb.n = 0 THEN 0.0 ELSE 1 - coalesce(bt.n, 0) / (ka.n + kb.n - coalesce(bt.n, 0)) END AS distance
  FROM k ka JOIN k kb ON ka.x < kb.x LEFT JOIN bt ON bt.a = ka.x AND bt.b = kb.x),
e AS (SELECT a AS x, b AS y FROM ds WHERE distance <= 0.6 UNION SELECT b, a FROM ds WHERE distance <= 0.6),
r(node, seen) AS (SELECT sample_id, sample_id FROM smp UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
cl AS (SELECT node, min(seen) AS root FROM r GROUP BY node),
pl AS (SELECT *, dense_rank() OVER (ORDER BY root) AS plex, count(*) OVER (PARTITION BY root) AS size FROM cl)"""
_ARCHETYPES = _components_sql("""
SELECT a_cohort || ':' || a_program AS a, b_cohort || ':' || b_program AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY a_cohort, a_program, b_cohort ORDER BY round(similarity, 12) DESC, b_program) AS x, row_number() OVER (PARTITION BY b_cohort, b_program, a_cohort ORDER BY round(similarity, 12) DESC, a_program) AS y
  FROM (""" + networks._COS + """)) WHERE x = 1 AND y = 1 AND similarity >= 0.3""")


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _sweep_sql() -> str:
    jac = """SELECT 'jaccard' AS metric, {n} AS top_n, a.cohort AS ac, a.program AS ap, b.cohort AS bc, b.program AS bp, len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))) AS s
FROM (SELECT cohort, program, list(feature) AS f FROM top WHERE p <= {n} GROUP BY ALL) a JOIN (SELECT cohort, program, list(feature) AS f FROM top WHERE p <= {n} GROUP BY ALL) b ON a.cohort < b.cohort"""
    parts = [jac.format(n=n) for n in (2, 3, 4)] + [f"SELECT 'cosine', 0, a_cohort, a_program, b_cohort, b_program, similarity FROM ({networks._COS})"]
    return f""",
top AS (SELECT *, row_number() OVER (PARTITION BY cohort, program ORDER BY abs(loading) DESC, feature) AS p FROM ldg), sim AS ({' UNION ALL '.join(parts)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY metric, top_n, ac, ap, bc ORDER BY round(s, 12) DESC, bp) AS x, row_number() OVER (PARTITION BY metric, top_n, bc, bp, ac ORDER BY round(s, 12) DESC, ap) AS y FROM sim)
SELECT metric, CAST(top_n AS BIGINT) AS top_n, tau, count(*) AS n_pairs, count(*) FILTER (s >= tau) AS n_admitted, round(count(*) FILTER (s >= tau) / count(*), 6) AS admitted_share, count(*) FILTER (s >= tau AND x = 1 AND y = 1) AS n_reciprocal
FROM rk CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE]) AS tau) GROUP BY ALL"""


_HYPER = (
    "least(1.0, list_sum(list_transform(range(CAST(n_overlap AS INT), CAST(least(n_hits, n_set) AS INT) + 1), lambda i: CASE WHEN n_universe - n_set - n_hits + i < 0 THEN 0 ELSE exp("
    "lgamma(n_set + 1) - lgamma(i + 1) - lgamma(n_set - i + 1) + lgamma(n_universe - n_set + 1) - lgamma(n_hits - i + 1) - lgamma(n_universe - n_set - n_hits + i + 1) "
    "- lgamma(n_universe + 1) + lgamma(n_hits + 1) + lgamma(n_universe - n_hits + 1)) END)))"
)
ORACLE = {
    "de_driver_paired": _V + _result_sql(_PAIRED_ALL, {
        "n_pairs": "n", "mean_a": "CASE WHEN t IS NOT NULL OR n >= 3 THEN mean_a END", "mean_b": "CASE WHEN t IS NOT NULL OR n >= 3 THEN mean_b END", "mean_diff": "mean_diff", "t": "t", "df": "df", "p_value": "p_value", "bh_q": "q_value", "skip_reason": _SKIPS,
        "effect_size": "CASE WHEN n >= 3 AND sd > 0 THEN mean_diff / sd END", "effect_size_method": "CASE WHEN n >= 3 THEN 'cohen_dz' ELSE '' END", "ci_low": "mean_diff - crit * sd / sqrt(n)", "ci_high": "mean_diff + crit * sd / sqrt(n)",
        "wilcoxon_p": "CASE WHEN n >= 3 AND n_nonzero >= 2 THEN wilcoxon_p END", "wilcoxon_method": "CASE WHEN n >= 3 THEN 'signed_rank' ELSE '' END", "median_diff": "CASE WHEN n >= 3 THEN med END",
        "trimmed_mean_diff": "CASE WHEN n >= 3 THEN trim END", "method": "'paired-t'",
    }),
    "de_driver_welch": _V + _result_sql(_WELCH_ALL, {
        "n_pairs": "n_a + n_b", **{c: f"CASE WHEN skip_reason IS NULL THEN {c} END" for c in ("mean_a", "mean_b", "mean_diff")}, "t": "t", "df": "df", "p_value": "p_value", "bh_q": "q_value", "skip_reason": _SKIPS,
        "effect_size": "CASE WHEN n_a >= 3 AND n_b >= 3 THEN g END", "effect_size_method": "CASE WHEN n_a >= 3 AND n_b >= 3 THEN 'hedges_g' ELSE '' END",
        "ci_low": "mean_diff - crit * sqrt(var_a / n_a + var_b / n_b)", "ci_high": "mean_diff + crit * sqrt(var_a / n_a + var_b / n_b)", "wilcoxon_p": "CASE WHEN n_a >= 3 AND n_b >= 3 THEN rank_sum_p END",
        "wilcoxon_method": "CASE WHEN n_a >= 3 AND n_b >= 3 THEN 'rank_sum' ELSE '' END", "median_diff": "CASE WHEN n_a >= 3 AND n_b >= 3 THEN med END", "trimmed_mean_diff": "CASE WHEN n_a >= 3 AND n_b >= 3 THEN trim END",
        "method": "'welch-t'", "n_a": "n_a", "n_b": "n_b",
    }),
    "de_driver_moderated": _V + round_sql(["mean_diff", "t", "df", "p_value", "bh_q", "s2_prior", "s2_posterior", "df_prior"],
        f"SELECT *, n AS n_pairs, q_value AS bh_q, s0 AS s2_prior, s2_post AS s2_posterior, 4.0::DOUBLE AS df_prior, 'moderated' AS method FROM ({_MODERATED_Q})", 5, (_KEYS, "n_pairs", "method")),
    "de_driver_adjusted": _V + round_sql(["mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "bh_q", "effect_size", "ci_low", "ci_high"],
        f"SELECT *, n_a + n_b AS n_pairs, q_value AS bh_q, d AS effect_size, 'cohen_d' AS effect_size_method, d - half AS ci_low, d + half AS ci_high, 'ols' AS method FROM ({_ADJUSTED})", 5, (_KEYS, "n_pairs", "n_a", "n_b", "effect_size_method", "method")),
    "de_driver_proxy": _V + round_sql(["mean_diff", "t", "df", "p_value", "bh_q"], f"SELECT *, q_value AS bh_q, 'ols' AS method FROM ({bh_sql('p_value', 'comparison', 'panel, gene_symbol', _ONE_ARM)})", 5, (_KEYS, "method")),
    "de_driver_overrides": _V + round_sql(["mean_diff", "t", "df", "p_value", "bh_q"], f"""SELECT * REPLACE (CASE WHEN skip_reason IS NULL THEN mean_diff END AS mean_diff), q_value AS bh_q FROM ({_plain_welch("SELECT 'ASIA-EUROPE' AS comparison, m.panel, m.gene_symbol, m.abundance, CASE WHEN s.region = 'ASIA' THEN 'a' ELSE 'b' END AS arm FROM msr m JOIN smp s USING (sample_id) WHERE NOT m.dropped_by_qc AND isfinite(m.abundance) AND s.condition = 'R'")})""", 5, (_KEYS, "n_a", "n_b")),
    "de_driver_paired_by": _V + round_sql(["mean_a", "mean_b", "mean_diff", "t", "df", "p_value", "bh_q"], "SELECT *, n AS n_pairs, q_value AS bh_q FROM (" + bh_sql("p_value", "comparison", "panel, gene_symbol",
        f"SELECT *, {t_p_sql('t', 'df')} AS p_value FROM (SELECT *, mean_diff / (sd / sqrt(n)) AS t, CAST(n - 1 AS DOUBLE) AS df FROM ({_NATION}))") + ")", 5, (_KEYS, "n_pairs")),
    "de_driver_report": _V + f"""
SELECT comparison, panel, count(*) AS n_tests, count(*) FILTER (q_value IS NULL) AS n_skipped, count(*) FILTER (q_value < 0.2) AS n_q_strict, count(*) FILTER (q_value < 0.6) AS n_q_relaxed, round(min(q_value), 5) + 0.0 AS min_q,
  round(max(abs(mean_diff)) FILTER (skip_reason IS NULL), 5) + 0.0 AS max_abs_effect FROM ({_WELCH_Q}) GROUP BY ALL""",
    "de_ensemble": _V + f"""
SELECT {_KEYS}, gene_symbol AS assay_id, n_applied, n_significant, greatest(up, down) AS n_sign_consistent, CASE WHEN up >= down THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS majority_sign,
  CASE WHEN least(n_significant, greatest(up, down)) >= n_applied THEN 'VALIDATED' WHEN 2 * least(n_significant, greatest(up, down)) >= n_applied THEN 'PROVISIONAL' ELSE 'INSUFFICIENT' END AS grade, methods_applied FROM (
  SELECT {_KEYS}, count(*) AS n_applied, count(*) FILTER (q_value < 0.5) AS n_significant, count(*) FILTER (mean_diff >= 0) AS up, count(*) FILTER (mean_diff < 0) AS down, array_to_string(list_sort(list(method)), ',') AS methods_applied
  FROM ({_ENSEMBLE}) WHERE p_value IS NOT NULL GROUP BY ALL)""",
    "detectability": _V + round_sql(["rate_a", "rate_b", "log_odds", "detection_p", "abundance_diff", "abundance_p"], f"""
SELECT *, CASE WHEN d AND b THEN 'both' WHEN d THEN 'detection' WHEN b THEN 'abundance' WHEN detection_p IS NULL AND abundance_p IS NULL THEN 'untestable' ELSE 'neither' END AS label FROM (
  SELECT *, coalesce(detection_p < 0.05, false) AS d, coalesce(abundance_p < 0.05, false) AS b FROM ({_DETECT_ALL}))""", plain=("assay_id", "n", "n_a", "n_b", "n_detected_a", "n_detected_b", "label")),
    "detectability_summary": _V + f""",
dq AS ({bh_sql('detection_p', 'comparison', 'assay_id', f"SELECT *, 'A-R' AS comparison FROM ({_DETECT_ALL})").replace('AS q_value', 'AS dq')}), aq AS ({bh_sql('abundance_p', 'comparison', 'assay_id', 'SELECT * FROM dq').replace('AS q_value', 'AS aq')})
SELECT *, CASE WHEN n_detection_tested = 0 THEN 'no_detection_tests' WHEN share_identical >= 0.95 OR (share_zero_delta >= 0.95 AND n_detection_hits = 0) THEN 'condition_invariant_detection'
  WHEN n_detection_hits = 0 AND median_abs_delta < 0.02 THEN 'weak_detection_contrast' ELSE 'detection_informative' END AS diagnostic FROM (
  SELECT comparison, count(*) AS n_features, count(detection_p) AS n_detection_tested, count(*) FILTER (dq < 0.5) AS n_detection_hits, count(*) FILTER (aq < 0.5) AS n_abundance_hits,
    count(*) FILTER (n_detected_a = n_detected_b AND n_a = n_b) AS n_identical_counts, count(*) FILTER (abs(rate_a - rate_b) < 1e-12) AS n_zero_delta, round(median(abs(rate_a - rate_b)), 5) AS median_abs_delta,
    round(max(abs(rate_a - rate_b)), 5) AS max_abs_delta, round(n_identical_counts / n_features, 5) AS share_identical, round(n_zero_delta / n_features, 5) AS share_zero_delta FROM aq GROUP BY comparison)""",
    "weighted_summary": _V + f""",
mdl AS (SELECT DISTINCT p_brand AS gene_symbol, (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 7 - 3) / 3.0::DOUBLE AS loading FROM part),
sc AS (SELECT sample_id, sum(loading * z) / sum(abs(loading)) AS score FROM (SELECT sample_id, gene_symbol, (abundance - avg(abundance) OVER (PARTITION BY gene_symbol)) / nullif(stddev_samp(abundance) OVER (PARTITION BY gene_symbol), 0) AS z FROM eff)
  JOIN mdl USING (gene_symbol) WHERE z IS NOT NULL GROUP BY sample_id HAVING count(*) >= 10),
ar AS (SELECT 'A-R' AS comparison, CASE WHEN condition = 'A' THEN 'a' ELSE 'b' END AS arm, score FROM sc JOIN smp USING (sample_id) WHERE condition IN ('A', 'R'))
SELECT comparison, n_a, n_b, round(d, 5) + 0.0 AS cohen_d, round(d - half, 5) + 0.0 AS d_low, round(d + half, 5) + 0.0 AS d_high, round({t_p_sql('t', 'df')}, 5) + 0.0 AS welch_p, round(u / (n_a * n_b), 5) + 0.0 AS auc FROM (
  SELECT *, 1.96 * sqrt((n_a + n_b) / (n_a * n_b) + d * d / (2.0 * (n_a + n_b))) AS half FROM (
    SELECT comparison, count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b, avg(score) FILTER (arm = 'a') - avg(score) FILTER (arm = 'b') AS md, var_samp(score) FILTER (arm = 'a') AS va, var_samp(score) FILTER (arm = 'b') AS vb,
      md / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS d, md / sqrt(va / n_a + vb / n_b) AS t, pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df,
      sum(r) FILTER (arm = 'a') - n_a * (n_a + 1) / 2 AS u FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ar) GROUP BY comparison))""",
    "recover_plex": _recursive(_V) + _PLEX + """
SELECT node AS sample_id, plex AS recovered_plex_id, size AS cluster_size, round(w, 5) + 0.0 AS mean_within_distance FROM pl
LEFT JOIN (SELECT p.root, avg(distance) AS w FROM ds JOIN cl p ON p.node = ds.a JOIN cl q ON q.node = ds.b AND p.root = q.root GROUP BY p.root) USING (root)""",
    "recover_plex_quality": _recursive(_V) + _PLEX + """
SELECT * EXCLUDE (w, b), round(w, 5) AS mean_within, round(b, 5) AS mean_between, round(b / w, 5) AS separation, CASE WHEN b IS NULL THEN 'single_cluster' WHEN n_singletons / n_samples > 0.5 THEN 'absence_not_plex_coherent' WHEN w IS NULL OR b / w < 2 THEN 'weak_plex_signal'
  WHEN median_size < 5 OR median_size > 20 THEN 'atypical_cluster_size' ELSE 'plex_coherent' END AS diagnostic FROM (
  SELECT (SELECT count(*) FROM pl) AS n_samples, (SELECT count(DISTINCT root) FROM pl) AS n_clusters, (SELECT count(*) FROM pl WHERE size = 1) AS n_singletons, (SELECT round(median(n), 5) FROM (SELECT count(*) AS n FROM pl GROUP BY root)) AS median_size, s.w, s.b FROM (
    SELECT avg(distance) FILTER (p.root = q.root) AS w, avg(distance) FILTER (p.root <> q.root) AS b FROM ds JOIN cl p ON p.node = ds.a JOIN cl q ON q.node = ds.b) s)""",
    "archetype_summary": _recursive(networks._V) + ",\n" + _ARCHETYPES.replace("SELECT node, min(seen) AS root FROM r GROUP BY node", """,
m AS (SELECT node, min(seen) AS root FROM r GROUP BY node),
g AS (SELECT root, count(DISTINCT split_part(node, ':', 1)) AS cohorts, count(DISTINCT CAST(substr(split_part(node, ':', 2), 2, 1) AS INT) % 2) AS kinds FROM m GROUP BY root HAVING count(*) >= 2)
SELECT count(*) AS n_archetypes, count(*) FILTER (cohorts >= 2) AS n_multi_cohort, count(*) FILTER (cohorts = (SELECT count(DISTINCT cohort) FROM ldg)) AS n_universal,
  round(avg(CASE WHEN kinds = 1 THEN 1.0 ELSE 0.0 END), 6) AS category_recovery FROM g"""),
    "align_sweep": networks._V + _sweep_sql(),
    "align_archetypes": _recursive(networks._V) + ",\n" + _ARCHETYPES,
    "endmember_ora": _V + round_sql(["p_value", "q_value"], bh_sql("p_value", "endmember", "set_name", f"""
SELECT *, {_HYPER} AS p_value FROM (
  SELECT t.endmember, s.set_name, any_value(t.n_hits) AS n_hits, any_value(s.n_set) AS n_set, any_value(t.n_universe) AS n_universe, count(g.gene_symbol) AS n_overlap
  FROM (SELECT condition AS endmember, gene_symbol, count(*) OVER (PARTITION BY condition) AS n_hits, (SELECT count(DISTINCT gene_symbol) FROM eff) AS n_universe FROM (
      SELECT *, row_number() OVER (PARTITION BY condition ORDER BY level DESC, gene_symbol) AS p FROM (SELECT condition, gene_symbol, avg(abundance) AS level FROM eff GROUP BY ALL)) WHERE p <= 8) t
  CROSS JOIN (SELECT set_name, count(*) AS n_set FROM gst WHERE gene_symbol IN (SELECT gene_symbol FROM eff) GROUP BY ALL) s LEFT JOIN gst g ON g.set_name = s.set_name AND g.gene_symbol = t.gene_symbol GROUP BY ALL)"""),
        plain=("endmember", "set_name", "n_hits", "n_set", "n_universe", "n_overlap")),
    "limma_f_fits": _V + """
SELECT gene_symbol AS feature, round(((sst - sse) / 2) / (sse / (n - 3)), 5) + 0.0 AS f, CAST(2 AS BIGINT) AS n_columns, round(sse / (n - 3), 5) + 0.0 AS s2, CAST(n - 3 AS DOUBLE) AS df FROM (
  SELECT gene_symbol, sum(k) AS n, sum(v * (k - 1)) AS sse FROM (SELECT gene_symbol, condition, count(*) AS k, var_samp(abundance) AS v FROM eff GROUP BY ALL) GROUP BY gene_symbol)
JOIN (SELECT gene_symbol, var_samp(abundance) * (count(*) - 1) AS sst FROM eff GROUP BY ALL) USING (gene_symbol)""",
    "limma_fits": _V + """
SELECT gene_symbol AS feature, round(mn - ma, 5) + 0.0 AS estimate, round(1.0 / kn + 1.0 / ka, 5) + 0.0 AS unscaled, round(sse / (n - 3), 5) + 0.0 AS s2, CAST(n - 3 AS DOUBLE) AS df, round(mean, 5) + 0.0 AS mean, CAST(n AS BIGINT) AS count FROM (
  SELECT gene_symbol, sum(k) AS n, sum(v * (k - 1)) AS sse, sum(k * m) / sum(k) AS mean, any_value(m) FILTER (condition = 'A') AS ma, any_value(m) FILTER (condition = 'N') AS mn, any_value(k) FILTER (condition = 'A') AS ka, any_value(k) FILTER (condition = 'N') AS kn
  FROM (SELECT gene_symbol, condition, count(*) AS k, avg(abundance) AS m, var_samp(abundance) AS v FROM eff GROUP BY ALL) GROUP BY gene_symbol)""",
    "align_centred_cosine": networks._V + """,
cen AS (SELECT cohort, program, feature, loading - avg(loading) OVER (PARTITION BY cohort, program) AS loading FROM ldg)
SELECT a.cohort AS a_cohort, a.program AS a_program, b.cohort AS b_cohort, b.program AS b_program, round(abs(sum(a.loading * b.loading) / sqrt(sum(a.loading * a.loading) * sum(b.loading * b.loading))), 6) + 0.0 AS similarity
FROM cen a JOIN cen b ON a.feature = b.feature AND a.cohort < b.cohort GROUP BY ALL""",
    "decompose_variance": _V + f""",
l AS (SELECT *, CASE WHEN condition = 'L0' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM (UNPIVOT (SELECT cohort, condition, s1, s2, s3, s4, s5, s6, s7, s8 FROM sco) ON s1, s2, s3, s4, s5, s6, s7, s8 INTO NAME program VALUE y)),
r AS (SELECT program, y - avg(y) OVER c AS yr, x - avg(x) OVER c AS xr, y - avg(y) OVER (PARTITION BY program, condition) AS yc FROM l WINDOW c AS (PARTITION BY program, cohort)),
g AS (SELECT program, sum(xr * yr) * sum(xr * yr) / sum(xr * xr) AS own, sum(yr * yr) - own AS rest, sum(yc * yc) - rest AS other, CAST(count(*) - 4 AS DOUBLE) AS dof FROM r GROUP BY program)
SELECT program, 'condition' AS factor, round(own, 6) + 0.0 AS ss, CAST(1 AS BIGINT) AS df, round(own / (rest / dof), 6) + 0.0 AS f, round({t_p_sql('sqrt(own / (rest / dof))', 'dof')}, 6) + 0.0 AS p_value FROM g
UNION ALL SELECT program, 'cohort', round(other, 6) + 0.0, 2, round(other / 2 / (rest / dof), 6) + 0.0, round(pow(1 + other / rest, -dof / 2), 6) + 0.0 FROM g""",
    "paired_t_bounds": _V + f"SELECT df, round(crit, 5) AS critical FROM ({_t_quantile(f'SELECT DISTINCT df FROM ({_PAIRED_SQL}) WHERE df IS NOT NULL')})",
    "paired_t_interval": _V + f"""
SELECT {_KEYS}, round(mean_diff - crit * sd / sqrt(n), 6) + 0.0 AS ci_low, round(mean_diff + crit * sd / sqrt(n), 6) + 0.0 AS ci_high FROM (
  SELECT {_KEYS}, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd, CAST(count(d) - 1 AS DOUBLE) AS df FROM prs GROUP BY ALL) p
LEFT JOIN ({_t_quantile('SELECT DISTINCT CAST(count(d) - 1 AS DOUBLE) AS df FROM prs GROUP BY comparison, panel, gene_symbol')}) c USING (df)""",
    "ols_adjusted": _V + f"SELECT gene_symbol, term, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('estimate', 'se', 't', 'p_value', 'f', 'f_p'))}, df, n, CAST(NULL AS VARCHAR) AS skip_reason FROM ({_OLS})",
    "absence_components": _recursive(_V) + """,
o AS (SELECT DISTINCT assay_id AS x, sample_id AS y FROM fine),
ab AS (SELECT x, y FROM (SELECT DISTINCT x FROM o) CROSS JOIN (SELECT DISTINCT y FROM o) EXCEPT SELECT x, y FROM o),
k AS (SELECT x, count(*) AS n FROM ab GROUP BY x HAVING count(*) >= 5),
ed AS (SELECT a.x AS a, b.x AS b FROM ab a JOIN ab b ON a.y = b.y AND a.x < b.x JOIN k ka ON ka.x = a.x JOIN k kb ON kb.x = b.x GROUP BY a.x, b.x
  HAVING 1 - count(*) / (any_value(ka.n) + any_value(kb.n) - count(*)) <= 0.75),""" + _components_sql("SELECT * FROM ed"),
    "paired_ancova": _V + f"""
SELECT {_KEYS}, n, round(est, 6) + 0.0 AS mean_diff, round(se, 6) + 0.0 AS se, round(est / se, 6) + 0.0 AS t, df, round({t_p_sql('est / se', 'df')}, 6) + 0.0 AS p_value, CAST(NULL AS VARCHAR) AS skip_reason FROM (
  SELECT *, sqrt((syy - sxy * sxy / sxx) / df * (1.0 / n + mx * mx / sxx)) AS se FROM (
    SELECT {_KEYS}, count(*) AS n, regr_intercept(d, x) AS est, regr_sxx(d, x) AS sxx, regr_sxy(d, x) AS sxy, regr_syy(d, x) AS syy, avg(x) AS mx, CAST(count(*) - 2 AS DOUBLE) AS df
    FROM (SELECT *, va * 0.1 + subject_id % 7 AS x FROM prs) GROUP BY ALL))""",
}
