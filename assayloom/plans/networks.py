"""Queries: similarity networks, absence topology, alignment, axes, harmonisation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pearson_agg
from ..operators import network as G
from ..operators import twogroup as T
from ..sources import views
from .combining import modules
from .common import effective_rows, normal_p_sql, round_sql, rounded, with_views

_S = [f"s{i}" for i in range(1, 9)]


def _edges(spark: SparkSession, sf_dir: str, metric: str = "pearson") -> DataFrame:
    return G.pairwise(effective_rows(spark, sf_dir), "gene_symbol", "sample_id", "abundance", ["condition"], metric)


def _long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).withColumn("arm", F.when(F.col("condition") == "L0", "case").otherwise("control"))
    return s.unpivot(["cohort", "sample_id", "arm"], _S, "feature", "value")


def pairwise_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_edges(spark, sf_dir))


def pairwise_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.pairwise(effective_rows(spark, sf_dir).where("condition = 'A'"), "gene_symbol", "sample_id", "abundance", [], "spearman"))


def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.pairwise(_long_scores(spark, sf_dir), "feature", "sample_id", "value", [], "cosine"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).where("condition = 'A'")
    hard = G.adjacency(e, "hard", 0.2).withColumnRenamed("weight", "hard")
    return rounded(G.adjacency(hard, "soft", 2.0).select("f1", "f2", "hard", F.col("weight").alias("soft")))


def topological_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.topological_overlap(G.adjacency(_edges(spark, sf_dir).where("condition = 'A'"), "soft", 2.0)))


def edge_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.edge_differences(_edges(spark, sf_dir), "condition"))


def edge_pairwise_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 edges that differ most."""
    return rounded(G.edge_differences(_edges(spark, sf_dir), "condition", 20).select("condition_a", "condition_b", "f1", "f2", "z"))


def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.edge_summary(_edges(spark, sf_dir)))


def module_rewiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.rewiring(_edges(spark, sf_dir), modules(spark, sf_dir), "condition"))


def absence_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine features absent from much the same samples."""
    m = views.measurements(spark, sf_dir, by_type=True)
    return rounded(G.absence_pairs(m, "assay_id", "sample_id", 5, 0.75).select("a", "b", F.col("both").alias("n_both"), "distance"))


def absence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.absence_pairs(views.measurements(spark, sf_dir, by_type=True), "assay_id", "sample_id", 5, 0.75)
    return G.components(e.select("a", "b"))


def recover_plex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the other side: samples that lack much the same features."""
    m = views.measurements(spark, sf_dir, by_type=True)
    return rounded(G.absence_pairs(m, "sample_id", "assay_id", 5, 0.85).select("a", "b", F.col("both").alias("n_both"), "distance"))


def _loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_scores(spark, sf_dir).select("cohort", F.concat(F.lit("P"), F.col("sample_id") % 6).alias("program"), "feature", "value").groupBy("cohort", "program", "feature").agg(F.avg("value").alias("loading"))


def align_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.program_similarity(_loadings(spark, sf_dir), "jaccard", 3))


def align_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.program_similarity(_loadings(spark, sf_dir), "cosine"))


def align_best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.best_matches(G.program_similarity(_loadings(spark, sf_dir), "cosine"), 0.3, True))


def align_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.selectivity(G.program_similarity(_loadings(spark, sf_dir), "cosine"), 0.5))


def align_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs joined by reciprocal best matches, as components."""
    m = G.best_matches(G.program_similarity(_loadings(spark, sf_dir), "cosine"), 0.3, True)
    return G.components(m.select(F.concat_ws(":", "a_cohort", "a_program").alias("a"), F.concat_ws(":", "b_cohort", "b_program").alias("b")))


def axes_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir).withColumn("arm", F.when(F.col("condition") == "L0", "case").otherwise("control"))
    return rounded(G.displacement(s, _S, "arm"))


def axes_displacement_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines between the cohorts' displacement vectors."""
    d = _long_scores(spark, sf_dir).groupBy("cohort", "feature").agg((F.avg(F.when(F.col("arm") == "case", F.col("value"))) - F.avg(F.when(F.col("arm") == "control", F.col("value")))).alias("d"))
    return rounded(G.pairwise(d, "cohort", "feature", "d", [], "cosine").select("f1", "f2", "r"))


def axes_leave_cohort_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.leave_cohort_out(views.scores(spark, sf_dir), "s1"))


def axes_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes, means and medians of an expression of scores, and Kruskal-Wallis over cohorts."""
    from ..functions.expressions import column

    s = views.scores(spark, sf_dir).withColumn("x", column("(s1 + s2) / 2 - s3"))
    k = T.kruskal_wallis(s.withColumn("all", F.lit("x")), ["all"], "cohort", "x")
    g = s.groupBy("cohort").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"))
    return rounded(g.crossJoin(F.broadcast(k.select("h"))))


def axes_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unadjusted contrasts of every score: d, interval and Welch's t per cohort."""
    rows = _long_scores(spark, sf_dir).withColumn("arm", F.when(F.col("arm") == "case", "a").otherwise("b"))
    key = ["cohort", "feature"]
    return rounded(T.effect_sizes(rows, key, "value").join(T.welch(rows, key, "value").select(*key, "t", "df"), key))


def axes_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho of two scores by cohort and scope."""
    from ..functions.columns import average_rank

    s = views.scores(spark, sf_dir)
    scoped = s.withColumn("scope", F.lit("all")).unionByName(s.withColumn("scope", F.concat(F.lit("condition="), F.col("condition"))))
    r = scoped.withColumn("a", average_rank("s1", "cohort", "scope")).withColumn("b", average_rank("s2", "cohort", "scope"))
    return rounded(r.groupBy("cohort", "scope").agg(F.count("*").alias("n"), pearson_agg("a", "b").alias("rho")))


def axes_orthogonalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of one score on another within cohorts, then z-scores over all."""
    from pyspark.sql import Window as W

    from ..functions.columns import zscore

    w = W.partitionBy("cohort")
    s = views.scores(spark, sf_dir)
    s = s.withColumn("e", F.col("s1") - F.regr_intercept("s1", "s2").over(w) - F.regr_slope("s1", "s2").over(w) * F.col("s2"))
    return rounded(s.select("sample_id", zscore("e").alias("z")))


def harmonise_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.harmonise_fit(_long_scores(spark, sf_dir).where("cohort <> 'C2'")))


def harmonise_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long_scores(spark, sf_dir)
    return rounded(G.harmonise_apply(G.harmonise_fit(rows.where("cohort <> 'C2'")), rows, {"C0", "C1"}, "C2"))


def harmonise_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.represent(_long_scores(spark, sf_dir), "rank").select("sample_id", "feature", "represented"))


def harmonise_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.represent(_long_scores(spark, sf_dir), "reference", ["s1", "s2"]).select("sample_id", "feature", "represented"))


def shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine features with kept values under every condition."""
    m = views.measurements(spark, sf_dir, by_type=True)
    n = m.select("condition").distinct().count()
    return m.groupBy("assay_id").agg(F.count_distinct("condition").alias("n")).where(F.col("n") == n).select("assay_id")


def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many score variances reach four fifths of their sum."""
    s = views.scores(spark, sf_dir).unpivot(["sample_id"], _S, "component", "v").groupBy("component").agg(F.var_samp("v").alias("eigenvalue"))
    return G.components_for_variance(s, 0.8, 2, 6)


_FUNCTIONS = (
    pairwise_pearson, pairwise_spearman, pairwise_cosine, adjacency, topological_overlap, edge_pairwise, edge_pairwise_top, edge_summary, module_rewiring, absence_topology, absence_components,
    recover_plex_pairs, align_jaccard, align_cosine, align_best_matches, align_selectivity, align_archetypes, axes_displacement, axes_displacement_cosine, axes_leave_cohort_out, axes_groups,
    axes_contrast, axes_anchor, axes_orthogonalise, harmonise_direction, harmonise_apply, harmonise_ranks, harmonise_reference, shared_features, variance_components,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_V = with_views("""
edg AS (
  SELECT a.condition, a.gene_symbol AS f1, b.gene_symbol AS f2, corr(a.abundance, b.abundance) AS r, count(*) AS n
  FROM eff a JOIN eff b ON a.sample_id = b.sample_id AND a.gene_symbol < b.gene_symbol GROUP BY ALL),
lng AS (
  SELECT cohort, sample_id, CASE WHEN condition = 'L0' THEN 'case' ELSE 'control' END AS arm, feature, value FROM (
    UNPIVOT (SELECT cohort, sample_id, condition, s1, s2, s3, s4, s5, s6, s7, s8 FROM sco) ON s1, s2, s3, s4, s5, s6, s7, s8 INTO NAME feature VALUE value)),
ldg AS (SELECT cohort, 'P' || (sample_id % 6) AS program, feature, avg(value) AS loading FROM lng GROUP BY ALL)""",)


def _absent_sql(rows: str, axis: str, other: str, threshold: float) -> str:
    return f"""
, o AS (SELECT DISTINCT {axis} AS x, {other} AS y FROM {rows}),
ab AS (SELECT x, y FROM (SELECT DISTINCT x FROM o) CROSS JOIN (SELECT DISTINCT y FROM o) EXCEPT SELECT x, y FROM o),
k AS (SELECT x, count(*) AS n FROM ab GROUP BY x HAVING count(*) >= 5)
SELECT a.x AS a, b.x AS b, count(*) AS n_both, round(1 - count(*) / (any_value(ka.n) + any_value(kb.n) - count(*)), 6) + 0.0 AS distance
FROM ab a JOIN ab b ON a.y = b.y AND a.x < b.x JOIN k ka ON ka.x = a.x JOIN k kb ON kb.x = b.x GROUP BY a.x, b.x HAVING 1 - count(*) / (any_value(ka.n) + any_value(kb.n) - count(*)) <= {threshold}"""


_EDGE_DIFF = f"""
SELECT a.condition AS condition_a, b.condition AS condition_b, f1, f2, a.r AS r_a, b.r AS r_b, (atanh(a.r) - atanh(b.r)) / sqrt(1.0 / (a.n - 3) + 1.0 / (b.n - 3)) AS z FROM edg a JOIN edg b USING (f1, f2) WHERE a.condition < b.condition AND a.n >= 4 AND b.n >= 4"""
_COS = """
SELECT a.cohort AS a_cohort, a.program AS a_program, b.cohort AS b_cohort, b.program AS b_program, abs(sum(a.loading * b.loading) / sqrt(sum(a.loading * a.loading) * sum(b.loading * b.loading))) AS similarity
FROM ldg a JOIN ldg b ON a.feature = b.feature AND a.cohort < b.cohort GROUP BY ALL"""
_FIT = """(
SELECT feature, avg(d) AS direction FROM (SELECT cohort, feature, avg(z) FILTER (arm = 'case') - avg(z) FILTER (arm = 'control') AS d FROM (
  SELECT *, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM lng WHERE cohort <> 'C2' WINDOW w AS (PARTITION BY cohort, feature)) GROUP BY ALL) GROUP BY ALL HAVING count(d) = 2)"""
ORACLE = {
    "pairwise_pearson": _V + "SELECT condition, f1, f2, round(r, 6) + 0.0 AS r, n, r IS NULL AS undefined FROM edg",
    "pairwise_spearman": _V + """
SELECT f1, f2, round(corr(ra, rb), 6) + 0.0 AS r, count(*) AS n, false AS undefined FROM (
  SELECT a.gene_symbol AS f1, b.gene_symbol AS f2, rank() OVER (PARTITION BY a.gene_symbol, b.gene_symbol ORDER BY a.abundance) + (count(*) OVER (PARTITION BY a.gene_symbol, b.gene_symbol, a.abundance) - 1) / 2 AS ra,
    rank() OVER (PARTITION BY a.gene_symbol, b.gene_symbol ORDER BY b.abundance) + (count(*) OVER (PARTITION BY a.gene_symbol, b.gene_symbol, b.abundance) - 1) / 2 AS rb
  FROM eff a JOIN eff b ON a.sample_id = b.sample_id AND a.gene_symbol < b.gene_symbol WHERE a.condition = 'A') GROUP BY ALL""",
    "pairwise_cosine": _V + "SELECT a.feature AS f1, b.feature AS f2, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) + 0.0 AS r, count(*) AS n, false AS undefined FROM lng a JOIN lng b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY ALL",
    "adjacency": _V + "SELECT f1, f2, round(CASE WHEN abs(r) >= 0.2 THEN abs(r) ELSE 0 END, 6) AS hard, round(r * r, 6) + 0.0 AS soft FROM edg WHERE condition = 'A'",
    "topological_overlap": _V + """,
w AS (SELECT f1 AS i, f2 AS j, r * r AS a FROM edg WHERE condition = 'A' UNION ALL SELECT f2, f1, r * r FROM edg WHERE condition = 'A'), k AS (SELECT i, sum(a) AS k FROM w GROUP BY i)
SELECT e.i AS f1, e.j AS f2, round((coalesce((SELECT sum(x.a * y.a) FROM w x JOIN w y ON x.j = y.i WHERE x.i = e.i AND y.j = e.j), 0) + e.a) / (least(ki.k, kj.k) + 1 - e.a), 6) + 0.0 AS tom
FROM w e JOIN k ki ON ki.i = e.i JOIN k kj ON kj.i = e.j WHERE e.i < e.j""",
    "edge_pairwise": _V + round_sql(["r_a", "r_b", "z", "p_value"], f"SELECT *, {normal_p_sql('z')} AS p_value FROM ({_EDGE_DIFF})", plain=("condition_a", "condition_b", "f1", "f2")),
    "edge_pairwise_top": _V + f"SELECT condition_a, condition_b, f1, f2, round(z, 6) + 0.0 AS z FROM ({_EDGE_DIFF}) ORDER BY round(abs(z), 9) DESC, f1, f2, condition_a, condition_b LIMIT 20",
    "edge_summary": _V + """
SELECT f1, f2, count(*) AS n_cohorts, round(avg(r), 6) + 0.0 AS mean_r, round(stddev_samp(r), 6) + 0.0 AS sd_r, round(min(abs(r)), 6) AS min_abs, round(max(abs(r)), 6) AS max_abs, least(count(*) FILTER (r > 0), count(*) FILTER (r < 0)) AS sign_flips,
  round(greatest(count(*) FILTER (r > 0), count(*) FILTER (r < 0)) / count(*), 6) AS conservation, round(stddev_samp(r) / (abs(avg(r)) + 1e-3), 6) + 0.0 AS divergence FROM edg GROUP BY ALL""",
    "module_rewiring": _V + """,
mdl AS (SELECT DISTINCT 'M' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 5) AS module, p_brand AS g FROM part)
SELECT module, condition, round(m, 6) AS mean_abs_r, n AS n_edges, round(stddev_samp(m) OVER (PARTITION BY module), 6) AS sd_over_cohorts FROM (
  SELECT a.module, condition, avg(abs(r)) AS m, count(*) AS n FROM edg JOIN mdl a ON a.g = f1 JOIN mdl b ON b.g = f2 AND a.module = b.module GROUP BY ALL)""",
    "absence_topology": _V + _absent_sql("fine", "assay_id", "sample_id", 0.75),
    "recover_plex_pairs": _V + _absent_sql("fine", "sample_id", "assay_id", 0.85),
    "align_jaccard": _V + """,
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort, program ORDER BY abs(loading) DESC, feature) AS p FROM ldg) WHERE p <= 3), g AS (SELECT cohort, program, list(feature) AS f FROM t GROUP BY ALL)
SELECT a.cohort AS a_cohort, a.program AS a_program, b.cohort AS b_cohort, b.program AS b_program, round(len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))), 6) AS similarity FROM g a JOIN g b ON a.cohort < b.cohort""",
    "align_cosine": _V + round_sql(["similarity"], _COS, plain=("a_cohort", "a_program", "b_cohort", "b_program")),
    "align_best_matches": _V + round_sql(["similarity"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_cohort, a_program, b_cohort ORDER BY round(similarity, 12) DESC, b_program) AS x, row_number() OVER (PARTITION BY b_cohort, b_program, a_cohort ORDER BY round(similarity, 12) DESC, a_program) AS y FROM ({_COS}))
WHERE x = 1 AND y = 1 AND similarity >= 0.3""", plain=("a_cohort", "a_program", "b_cohort", "b_program")),
    "align_selectivity": _V + f"SELECT round(avg(CASE WHEN similarity >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS admitted_share, count(*) AS n_pairs FROM ({_COS})",
    "axes_displacement": _V + "SELECT feature AS score, round(avg(value) FILTER (arm = 'case') - avg(value) FILTER (arm = 'control'), 6) + 0.0 AS displacement FROM lng GROUP BY ALL",
    "axes_displacement_cosine": _V + """,
d AS (SELECT cohort, feature, avg(value) FILTER (arm = 'case') - avg(value) FILTER (arm = 'control') AS d FROM lng GROUP BY ALL)
SELECT a.cohort AS f1, b.cohort AS f2, round(sum(a.d * b.d) / sqrt(sum(a.d * a.d) * sum(b.d * b.d)), 6) + 0.0 AS r FROM d a JOIN d b ON a.feature = b.feature AND a.cohort < b.cohort GROUP BY ALL""",
    "axes_leave_cohort_out": _V + round_sql(["z"], "SELECT left_out, sample_id, (s1 - avg(s1) OVER w) / stddev_samp(s1) OVER w AS z FROM sco JOIN (SELECT DISTINCT cohort AS left_out FROM sco) ON cohort <> left_out WINDOW w AS (PARTITION BY left_out)", plain=("left_out", "sample_id")),
    "axes_groups": _V + """,
x AS (SELECT cohort, (s1 + s2) / 2 - s3 AS x FROM sco), r AS (SELECT cohort, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r, count(*) OVER (PARTITION BY x) AS t FROM x),
h AS (SELECT (12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - sum(t) / (pow(sum(n), 3) - sum(n))) AS h FROM (SELECT cohort, count(*) AS n, sum(r) AS s, sum(t * t - 1) AS t FROM r GROUP BY ALL))
SELECT cohort, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(median(x), 6) + 0.0 AS median, round((SELECT h FROM h), 6) + 0.0 AS h FROM x GROUP BY cohort""",
    "axes_contrast": _V + round_sql(["cohen_d", "d_low", "d_high", "hedges_g", "t", "df"], """
SELECT *, d - half AS d_low, d + half AS d_high, d AS cohen_d, d * (1 - 3.0 / (4.0 * (n_a + n_b - 2) - 1)) AS hedges_g FROM (SELECT *, 1.96 * sqrt((n_a + n_b) / (n_a * n_b) + d * d / (2.0 * (n_a + n_b))) AS half FROM (
  SELECT *, (ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS d, (ma - mb) / sqrt(va / n_a + vb / n_b) AS t, pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df FROM (
    SELECT cohort, feature, count(*) FILTER (arm = 'case') AS n_a, count(*) FILTER (arm <> 'case') AS n_b, avg(value) FILTER (arm = 'case') AS ma, avg(value) FILTER (arm <> 'case') AS mb, var_samp(value) FILTER (arm = 'case') AS va, var_samp(value) FILTER (arm <> 'case') AS vb
    FROM lng GROUP BY ALL)))""", plain=("cohort", "feature", "n_a", "n_b")),
    "axes_anchor": _V + """
SELECT cohort, scope, count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho FROM (SELECT cohort, scope, rank() OVER (PARTITION BY cohort, scope ORDER BY s1) AS a, rank() OVER (PARTITION BY cohort, scope ORDER BY s2) AS b FROM (
  SELECT *, 'all' AS scope FROM sco UNION ALL SELECT *, 'condition=' || condition FROM sco)) GROUP BY ALL""",
    "axes_orthogonalise": _V + round_sql(["z"], "SELECT sample_id, (e - avg(e) OVER ()) / stddev_samp(e) OVER () AS z FROM (SELECT sample_id, s1 - i - b * s2 AS e FROM sco JOIN (SELECT cohort, regr_intercept(s1, s2) AS i, regr_slope(s1, s2) AS b FROM sco GROUP BY ALL) USING (cohort))", plain=("sample_id",)),
    "harmonise_direction": _V + f"SELECT feature, round(direction, 6) + 0.0 AS direction FROM {_FIT}",
    "harmonise_apply": _V + f"SELECT sample_id, round(avg(direction * z), 6) + 0.0 AS score, count(*) AS n_used FROM (SELECT *, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM lng WHERE cohort = 'C2' WINDOW w AS (PARTITION BY feature)) JOIN {_FIT} USING (feature) GROUP BY ALL",
    "harmonise_ranks": _V + "SELECT sample_id, feature, round((rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2 - 1) / 7, 6) AS represented FROM lng",
    "harmonise_reference": _V + "SELECT sample_id, feature, round(value - avg(value) FILTER (feature IN ('s1', 's2')) OVER (PARTITION BY sample_id), 6) + 0.0 AS represented FROM lng",
    "shared_features": _V + "SELECT assay_id FROM fine GROUP BY 1 HAVING count(DISTINCT condition) = (SELECT count(DISTINCT condition) FROM fine)",
    "variance_components": _V + """
SELECT min(k) FILTER (share >= 0.8) AS free_k, greatest(2, least(6, min(k) FILTER (share >= 0.8))) AS k, min(k) FILTER (share >= 0.8) < 2 AS at_lower, min(k) FILTER (share >= 0.8) > 6 AS at_upper FROM (
  SELECT row_number() OVER w AS k, sum(v) OVER (ORDER BY v DESC, feature ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS share FROM (SELECT feature, var_samp(value) AS v FROM lng GROUP BY ALL) WINDOW w AS (ORDER BY v DESC, feature))""",
}
