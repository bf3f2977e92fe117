"""Queries: linear and mixed models, moderation, post-hoc tests, resampling, decompositions. Most have no SQL form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import zscore
from ..operators import decompose as D
from ..operators import linear as L
from ..operators import resample as R
from ..operators import scores as S
from ..operators import twogroup as T
from ..sources import views
from .combining import _de, modules
from .common import ARMS_SQL, KEY, armed, effective_rows, round_sql, rounded, t_p_sql, with_views

LEVELS = {"condition": ["A", "N", "R"]}


def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundance on the supplier's balance, per gene."""
    out = L.ols(effective_rows(spark, sf_dir), ["gene_symbol"], "abundance", ["acctbal"], {})
    return rounded(out.where("term = 'acctbal'").select("gene_symbol", F.round(F.col("estimate") * 1e6, 3).alias("estimate"), "t", "p_value", "df", "n"), 5)


def ols_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions adjusted for the balance, with the omnibus F."""
    return rounded(L.ols(effective_rows(spark, sf_dir), ["gene_symbol"], "abundance", ["acctbal"], LEVELS))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.residuals(effective_rows(spark, sf_dir), ["gene_symbol"], "sample_id", "abundance", ["acctbal"], {}))


def mixed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.mixed(effective_rows(spark, sf_dir), ["gene_symbol"], "abundance", [], LEVELS, "subject_id"))


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.feature_fits(effective_rows(spark, sf_dir), "gene_symbol", "abundance", [], LEVELS, [0, 1, 0])


def limma_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.moderate(_fits(spark, sf_dir)))


def limma_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.moderate(_fits(spark, sf_dir), "trend"))


def limma_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.moderate(_fits(spark, sf_dir), "robust"))


def limma_treat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.moderate(_fits(spark, sf_dir), lfc=0.02))


def deqms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.count("*").alias("count"))
    return rounded(L.moderate(_fits(spark, sf_dir).drop("count").join(counts, "feature"), "counts"))


def _peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as peptides of a brand: log mean price by return flag."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("gene_symbol"), F.col("p_partkey").alias("peptide"), F.col("l_returnflag").alias("condition")).agg(F.log2(F.avg("l_extendedprice")).alias("abundance"))


def msqrob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.peptide_model(_peptides(spark, sf_dir), "gene_symbol", "abundance", LEVELS, "peptide", ridge=0.1))


def msqrob_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.peptide_model(_peptides(spark, sf_dir), "gene_symbol", "abundance", LEVELS, "peptide", robust=True), 4)


def posthoc_sidak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.posthoc(effective_rows(spark, sf_dir), ["gene_symbol"], "abundance", "condition", LEVELS["condition"], "sidak"))


def posthoc_tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.posthoc(effective_rows(spark, sf_dir), ["gene_symbol"], "abundance", "condition", LEVELS["condition"], "tukey"))


def posthoc_dunnett(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.posthoc(effective_rows(spark, sf_dir), ["gene_symbol"], "abundance", "condition", LEVELS["condition"], "dunnett"))


def paired_ancova(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.pairs(armed(spark, sf_dir), KEY).withColumn("x", F.col("va") * 0.1 + F.pmod(F.col("subject_id"), F.lit(7)))
    return rounded(L.paired_ancova(p, KEY, ["x"]))


def _detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection of fine features under two conditions over the full grid of samples."""
    m = views.measurements(spark, sf_dir, by_type=True)
    s = views.samples(spark, sf_dir).where("condition IN ('A', 'R') AND NOT is_control").select("sample_id", "condition")
    grid = m.select("assay_id").distinct().crossJoin(s).join(m.where("NOT below_lod").select("assay_id", "sample_id", "abundance"), ["assay_id", "sample_id"], "left")
    return L.detectability(grid.withColumn("arm", F.when(F.col("condition") == "A", "a").otherwise("b")), ["assay_id"], "abundance", "arm")


def detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_detectability(spark, sf_dir))


def null_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.null_calibration(T.pairs(armed(spark, sf_dir), KEY), KEY, 500, 11))


def bootstrap_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.bootstrap_pairs(T.pairs(armed(spark, sf_dir), KEY), KEY, 500, 5))


def bootstrap_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = S.module_means(armed(spark, sf_dir), modules(spark, sf_dir))
    return rounded(R.bootstrap_pairs(T.pairs(means, ["comparison", "module"]), ["comparison", "module"], 500, 5))


def ratio_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.ratio_effects(effective_rows(spark, sf_dir), ["Brand#1", "Brand#2"], ["Brand#3"], "assay_id", "abundance"))


def ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.ratio_test(R.ratio_effects(effective_rows(spark, sf_dir), ["Brand#1", "Brand#2"], ["Brand#3"], "assay_id", "abundance"), "A", "N", 1000, 3))


def gsea(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.gsea(S.rank_statistic(_de(spark, sf_dir), "t"), views.gene_sets(spark, sf_dir), ["comparison"], 500, 9))


def _scores(spark: SparkSession, sf_dir: str) -> pd.DataFrame:
    s = views.scores(spark, sf_dir, 16)
    return D.matrix(s.unpivot(["sample_id"], [f"s{i}" for i in range(1, 17)], "feature", "value"), "sample_id", "feature", "value")


def decompose_ica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the score matrix with their stability over seeds."""
    wide = _scores(spark, sf_dir)
    runs = D.ica_runs(spark, wide, 4, 6)

    def rate(rows: pd.DataFrame) -> pd.DataFrame:
        by_seed = {s: g.pivot(index="feature", columns="program", values="loading").loc[list(wide.columns)].to_numpy() for s, g in rows.groupby("seed")}
        found = D.stability(by_seed[0], [v for s, v in sorted(by_seed.items()) if s], 5)
        return pd.DataFrame({"program": range(len(found)), "stability": found})

    return rounded(runs.groupBy(F.lit(1).alias("_all")).applyInPandas(rate, "program bigint, stability double"))


def decompose_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the factors for several k and seeds, a task for each."""
    x = spark.sparkContext.broadcast(np.power(2.0, np.clip(_scores(spark, sf_dir).to_numpy(), -6, 6)))
    return rounded(D.seeds(spark, lambda s: [(s, 2 + s % 4, D.nmf(x.value, 2 + s % 4, s // 4)["error"])], 12, "run bigint, k bigint, error double"), 3)


def decompose_unmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endmembers by successive projection and every sample's abundances of them."""
    wide = _scores(spark, sf_dir)
    picked = wide.iloc[D.spa(wide.to_numpy(), 4)].to_numpy()
    held = spark.sparkContext.broadcast(picked)
    cols = list(wide.columns)
    s = views.scores(spark, sf_dir, 16)

    def run(batches):
        for b in batches:
            a = D.fcls(held.value, b[cols].to_numpy(float))
            yield pd.DataFrame({"sample_id": b["sample_id"], **{f"a{i}": a[:, i] for i in range(a.shape[1])}})

    return rounded(s.select("sample_id", *cols).mapInPandas(run, "sample_id bigint, " + ", ".join(f"a{i} double" for i in range(len(picked)))), 4)


def decompose_mnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ICA with holes below a limit, one task per limit."""
    x = spark.sparkContext.broadcast(_scores(spark, sf_dir).to_numpy())

    def kernel(i: int) -> list[tuple]:
        r = D.mnar_ica(np.where(x.value > np.quantile(x.value, 0.02 * (i + 1)), x.value, np.nan), 3, 1)
        return [(i, float(r["curve"][1]), r["stopped"], r["rounds"])]

    return rounded(D.seeds(spark, kernel, 3, "run bigint, slope double, stopped string, rounds bigint"), 4)


def decompose_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type III sums of squares of cohort and condition for every score."""
    s = views.scores(spark, sf_dir).unpivot(["cohort", "condition"], [f"s{i}" for i in range(1, 9)], "program", "activation")
    return rounded(D.variance_shares(s, {"cohort": ["C0", "C1", "C2"], "condition": ["L0", "L1"]}))


def network_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvector and betweenness centralities per condition from hard-threshold adjacency."""
    from ..operators import network as G

    e = G.adjacency(G.pairwise(effective_rows(spark, sf_dir), "gene_symbol", "sample_id", "abundance", ["condition"]), "hard", 0.15)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["f1"], *rows["f2"]})
        at = {f: i for i, f in enumerate(names)}
        a = np.zeros((len(names), len(names)))
        for f1, f2, w in zip(rows["f1"], rows["f2"], rows["weight"], strict=True):
            a[at[f1], at[f2]] = a[at[f2], at[f1]] = w
        ev, bt = D.eigenvector_centrality(a), D.betweenness_centrality(a)
        return pd.DataFrame({"condition": key[0], "feature": names, "eigenvector": ev, "betweenness": bt, "influence": ev * bt})

    return rounded(e.groupBy("condition").applyInPandas(run, "condition string, feature string, eigenvector double, betweenness double, influence double"))


def modules_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters of genes on 1 - topological overlap; small ones are grey."""
    from ..operators import network as G

    e = G.pairwise(effective_rows(spark, sf_dir), "gene_symbol", "sample_id", "abundance", [])
    tom = G.topological_overlap(G.adjacency(e, "soft", 1.0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["f1"], *rows["f2"]})
        at = {f: i for i, f in enumerate(names)}
        d = np.ones((len(names), len(names)))
        for f1, f2, w in zip(rows["f1"], rows["f2"], rows["tom"], strict=True):
            d[at[f1], at[f2]] = d[at[f2], at[f1]] = 1 - w
        merges = D.upgma(d)
        cluster = D.cut(merges, len(names), float(np.median([m[2] for m in merges])))
        size = np.bincount(cluster)
        return pd.DataFrame({"feature": names, "module": [f"m{c}" if size[c] >= 3 else "grey" for c in cluster]})

    return tom.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "feature string, module string")


def axes_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage tree of the cohorts' displacement vectors."""
    s = views.scores(spark, sf_dir).withColumn("c", F.concat("cohort", F.lit("_"), F.pmod("sample_id", F.lit(3))))
    long = s.unpivot(["c", "condition"], [f"s{i}" for i in range(1, 9)], "feature", "value")
    d = long.groupBy("c", "feature").agg((F.avg(F.when(F.col("condition") == "L0", F.col("value"))) - F.avg(F.when(F.col("condition") == "L1", F.col("value")))).alias("d"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.pivot(index="c", columns="feature", values="d").sort_index()
        u = x.to_numpy() / np.linalg.norm(x.to_numpy(), axis=1, keepdims=True)
        merges = D.upgma(1 - u @ u.T)
        return pd.DataFrame([(i, a, b, round(h, 6), n) for i, (a, b, h, n) in enumerate(merges)], columns=["step", "left_node", "right_node", "height", "size"])

    return d.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "step bigint, left_node bigint, right_node bigint, height double, size bigint")


def align_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge projection of samples onto an atlas of mean loadings."""
    wide = _scores(spark, sf_dir)
    atlas = D.fast_ica(wide.to_numpy(), 3, 0)["loadings"]
    held, cols = spark.sparkContext.broadcast(atlas), list(wide.columns)

    def run(batches):
        for b in batches:
            a = D.project(held.value, b[cols].to_numpy(float), 0.01)
            yield pd.DataFrame({"sample_id": b["sample_id"], **{f"p{i}": a[:, i] for i in range(3)}})

    return rounded(views.scores(spark, sf_dir, 16).select("sample_id", *cols).mapInPandas(run, "sample_id bigint, p0 double, p1 double, p2 double"), 4)


def align_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often resampled fits find each component again, a task per iteration."""
    x = spark.sparkContext.broadcast(_scores(spark, sf_dir).to_numpy())

    def kernel(i: int) -> list[tuple]:
        from ..functions.rng import stream

        ref = D.fast_ica(x.value, 3, 0)["loadings"]
        again = D.fast_ica(x.value[stream(4, i).integers(0, len(x.value), len(x.value))], 3, 0)["loadings"]
        cos = np.abs(ref.T @ again) / np.outer(np.linalg.norm(ref, axis=0), np.linalg.norm(again, axis=0))
        return [(i, c, float(cos[c].max())) for c in range(3)]

    runs = D.seeds(spark, kernel, 8, "iteration bigint, program bigint, similarity double")
    return rounded(runs.groupBy("program").agg(F.avg("similarity").alias("mean_similarity"), F.avg((F.col("similarity") >= 0.5).cast("double")).alias("match_rate")), 4)


def decompose_endmembers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endmembers of three methods on the score matrix, a task for each, with the residual they leave."""
    x = spark.sparkContext.broadcast(_scores(spark, sf_dir).to_numpy())

    def kernel(i: int) -> list[tuple]:
        picked = [lambda: D.spa(x.value, 4), lambda: D.vca(x.value, 4, 1), lambda: D.n_findr(x.value, 4, 1)][i]()
        e = x.value[picked]
        return [(["spa", "vca", "n_findr"][i], len(set(picked)), float(np.linalg.norm(x.value - D.fcls(e, x.value) @ e)), float(np.linalg.norm(x.value - D.ucls(e, x.value) @ e)))]

    return rounded(D.seeds(spark, kernel, 3, "method string, n bigint, fcls_residual double, ucls_residual double"), 4)


def decompose_unmix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals for several numbers of endmembers, and the one at their knee."""
    k, found = D.unmix_sizes(_scores(spark, sf_dir).to_numpy(), 2, 7)
    return spark.createDataFrame([(2 + i, round(r, 4), 2 + i == k) for i, r in enumerate(found)], "k bigint, residual double, chosen boolean")


def decompose_nmf_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cophenetic correlation of the runs' co-assignments for each k, a task for each."""
    x = spark.sparkContext.broadcast(np.power(2.0, np.clip(_scores(spark, sf_dir).to_numpy(), -6, 6)))

    def kernel(i: int) -> list[tuple]:
        runs = np.array([D.nmf(x.value, 2 + i, s)["w"].argmax(1) for s in range(5)])
        return [(2 + i, D.cophenetic(runs))]

    return rounded(D.seeds(spark, kernel, 4, "k bigint, cophenetic double"), 4)


def decompose_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of components on shuffled matrices, an iteration per task."""
    x = spark.sparkContext.broadcast(_scores(spark, sf_dir).to_numpy())
    return rounded(D.seeds(spark, lambda i: [(i, D.archetype_null(x.value, 3, i))], 16, "iteration bigint, max_stability double"), 4)


def bench_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted sources against what ICA finds in their mixtures, a task per seed."""

    def kernel(i: int) -> list[tuple]:
        from ..functions.rng import stream

        g = stream(i, "planted")
        truth = g.laplace(size=(200, 3))
        found = D.fast_ica(g.normal(size=(40, 3)) @ truth.T + 0.05 * g.normal(size=(40, 200)), 3, i)["loadings"]
        return [(i, a, b, c) for a, b, c in D.recovery(truth, found)]

    return rounded(D.seeds(spark, kernel, 4, "seed bigint, planted bigint, found bigint, cosine double"), 4)


def score_modules_pc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-component scores of every module: z-scores of its genes, missing ones zero."""
    genes = effective_rows(spark, sf_dir).groupBy("sample_id", "gene_symbol").agg(F.avg("abundance").alias("v"))
    z = genes.withColumn("z", zscore("v", "gene_symbol")).join(modules(spark, sf_dir), "gene_symbol")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="sample_id", columns="gene_symbol", values="z").sort_index().sort_index(axis=1)
        return pd.DataFrame({"module": key[0], "sample_id": wide.index, "score": D.first_component(wide.to_numpy(float))})

    return rounded(z.select("module", "sample_id", "gene_symbol", "z").groupBy("module").applyInPandas(run, "module string, sample_id string, score double"), 4)


def modules_soft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale-free fit of the genes' similarities for each power."""
    from ..operators import network as G

    e = G.pairwise(effective_rows(spark, sf_dir), "gene_symbol", "sample_id", "abundance", [])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["f1"], *rows["f2"]})
        at = {f: i for i, f in enumerate(names)}
        s = np.eye(len(names))
        for f1, f2, r in zip(rows["f1"], rows["f2"], rows["r"], strict=True):
            s[at[f1], at[f2]] = s[at[f2], at[f1]] = r
        chosen, fits = D.soft_power(s, int(rows["n"].max()))
        return pd.DataFrame([(p, *D.scale_free(np.abs(s) ** p), p == chosen, fits) for p in range(1, 11)], columns=["power", "r2", "slope", "chosen", "fits"])

    return rounded(e.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "power bigint, r2 double, slope double, chosen boolean, fits boolean"), 4)


def axes_tree_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of resampled trees with each clade of the cohorts' tree, a task per replicate."""
    s = views.scores(spark, sf_dir).withColumn("c", F.concat("cohort", F.lit("_"), F.pmod("sample_id", F.lit(2))))
    held = spark.sparkContext.broadcast(s.select("c", *(f"s{i}" for i in range(1, 9))).orderBy("sample_id").toPandas())

    def tree(rows: pd.DataFrame) -> list:
        x = rows.groupby("c").mean().sort_index().to_numpy()
        return D.upgma(np.linalg.norm(x[:, None] - x[None], axis=2))

    def kernel(i: int) -> list[tuple]:
        from ..functions.rng import stream

        rows = held.value
        again = tree(rows.iloc[stream(7, i).integers(0, len(rows), len(rows))])
        n = rows["c"].nunique()
        return [(step, ",".join(map(str, sorted(c))), hit) for step, (c, hit) in enumerate(zip(D.clades(tree(rows), n), D.clade_support(tree(rows), [again], n), strict=True))]

    runs = D.seeds(spark, kernel, 10, "step bigint, leaves string, hit double")
    return rounded(runs.groupBy("step", "leaves").agg(F.avg("hit").alias("support")))


_FUNCTIONS = (
    decompose_endmembers, decompose_unmix_sizes, decompose_nmf_consensus, decompose_null, bench_recovery, score_modules_pc1, modules_soft_power, axes_tree_support,
    ols_simple, ols_adjusted, residuals, mixed_models, limma_plain, limma_trend, limma_robust, limma_treat, deqms, msqrob, msqrob_robust, posthoc_sidak, posthoc_tukey, posthoc_dunnett, paired_ancova, detectability,
    null_calibration, bootstrap_protein, bootstrap_module, ratio_effects, ratio_test, gsea, decompose_ica, decompose_nmf, decompose_unmix, decompose_mnar, decompose_variance, network_influence, modules_discover,
    axes_tree, align_project, align_bootstrap,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_V = with_views(ARMS_SQL)
ORACLE = {
    "ols_simple": _V + f"""
SELECT gene_symbol, round(round(b * 1e6, 3), 5) + 0.0 AS estimate, round(t, 5) + 0.0 AS t, round({t_p_sql('t', 'df')}, 5) + 0.0 AS p_value, df, n FROM (
  SELECT *, b / sqrt((syy - b * sxy) / df / sxx) AS t FROM (
    SELECT gene_symbol, regr_slope(abundance, acctbal) AS b, regr_syy(abundance, acctbal) AS syy, regr_sxy(abundance, acctbal) AS sxy, regr_sxx(abundance, acctbal) AS sxx, CAST(count(*) - 2 AS DOUBLE) AS df, count(*) AS n FROM eff GROUP BY ALL))""",
    "residuals": _V + round_sql(["residual", "r2"], """
SELECT gene_symbol, sample_id, abundance - i - b * acctbal AS residual, r2 FROM eff JOIN (
  SELECT gene_symbol, regr_intercept(abundance, acctbal) AS i, regr_slope(abundance, acctbal) AS b, regr_r2(abundance, acctbal) AS r2 FROM eff GROUP BY ALL) USING (gene_symbol)""", plain=("gene_symbol", "sample_id")),
    "posthoc_sidak": _V + f""", g AS (SELECT gene_symbol, condition, count(*) AS n, avg(abundance) AS m, var_samp(abundance) AS v FROM eff GROUP BY ALL)
SELECT gene_symbol, level_a, level_b, round(estimate, 6) + 0.0 AS estimate, round(se, 6) AS se, round(t, 6) + 0.0 AS t, df, round(p, 6) + 0.0 AS p_value, round(1 - pow(1 - p, 3), 6) + 0.0 AS p_adjusted FROM (
  SELECT *, {t_p_sql('t', 'df')} AS p FROM (SELECT *, estimate / se AS t FROM (
    SELECT a.gene_symbol, a.condition AS level_a, b.condition AS level_b, a.m - b.m AS estimate, sqrt(s2 * (1 / a.n + 1 / b.n)) AS se, df FROM g a JOIN g b ON a.gene_symbol = b.gene_symbol AND a.condition > b.condition
    JOIN (SELECT gene_symbol, sum(v * (n - 1)) / (sum(n) - 3) AS s2, CAST(sum(n) - 3 AS DOUBLE) AS df FROM g GROUP BY ALL) p ON p.gene_symbol = a.gene_symbol)))""",
    "ratio_effects": _V + """
SELECT condition, subject_id, round(avg(n - d), 6) + 0.0 AS log_ratio FROM (
  SELECT condition, subject_id, sample_id, avg(abundance) FILTER (assay_id IN ('Brand#1', 'Brand#2')) AS n, avg(abundance) FILTER (assay_id = 'Brand#3') AS d FROM eff GROUP BY ALL) WHERE n IS NOT NULL AND d IS NOT NULL GROUP BY ALL""",
}
