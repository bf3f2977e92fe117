"""Signature scores, enrichment and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import twogroup as T
from ..functions.columns import average_rank, bh_fdr, top_abs, zscore
from ..functions.dist import hypergeom_pvalue


def module_scores(df: DataFrame, modules: DataFrame, method: str, value: str = "abundance") -> DataFrame:
    """module, sample_id, score, coverage: mean, median or mean z-score (over samples) of the members' gene values."""
    genes = df.where(F.col(value).isNotNull()).groupBy("sample_id", "gene_symbol").agg(F.avg(value).alias("_v"))
    if method == "zscore":
        genes = genes.withColumn("_v", zscore("_v", "gene_symbol"))
    declared = modules.groupBy("module").agg(F.count_distinct("gene_symbol").alias("_declared"))
    m = modules.join(declared, "module").select("module", "gene_symbol", "_declared").distinct()
    how = F.median("_v") if method == "median" else F.avg("_v")
    g = genes.join(m, "gene_symbol").groupBy("module", "sample_id").agg(how.alias("score"), F.count_distinct("gene_symbol").alias("_seen"), F.first("_declared").alias("_declared"))
    return g.withColumn("coverage", F.col("_seen") / F.col("_declared")).drop("_seen", "_declared")


def module_means(df: DataFrame, modules: DataFrame, value: str = "abundance") -> DataFrame:
    """Mean over a module's measurement rows in each sample (not of gene means); keeps the samples' arm and subject."""
    return df.join(modules, "gene_symbol").groupBy("module", "comparison", "arm", "sample_id", "subject_id").agg(F.avg(value).alias("abundance"))


def singscore(df: DataFrame, sets: DataFrame, min_size: int = 2, value: str = "abundance") -> DataFrame:
    """(2 r - n - 1) / (2 (n - m)) from the mean rank r of the m members among a sample's n genes; null if m < min or m >= n."""
    ranked = df.withColumn("_r", average_rank(value, "sample_id")).withColumn("_n", F.count("*").over(W.partitionBy("sample_id")))
    g = ranked.join(sets, "gene_symbol").groupBy("set_name", "sample_id").agg(F.avg("_r").alias("_r"), F.first("_n").alias("_n"), F.count("*").alias("n_members"))
    ok = (F.col("n_members") >= min_size) & (F.col("n_members") < F.col("_n"))
    return g.withColumn("score", F.when(ok, F.try_divide(2 * F.col("_r") - F.col("_n") - 1, (2 * (F.col("_n") - F.col("n_members"))).cast("double")))).drop("_r", "_n")


def weighted_scores(df: DataFrame, weights: DataFrame, min_shared: int = 10, value: str = "abundance") -> DataFrame:
    """Sum of weight times z over the sum of absolute weights, for samples with enough weighted features."""
    z = df.withColumn("_z", zscore(value, "gene_symbol")).where("_z IS NOT NULL").join(weights, F.col("gene_symbol") == F.col("feature"))
    g = z.groupBy("sample_id").agg(F.count("*").alias("n_used"), F.try_divide(F.sum(F.col("weight") * F.col("_z")), F.sum(F.abs("weight"))).alias("score"))
    return g.where(F.col("n_used") >= min_shared)


def over_representation(queries: DataFrame, sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Hypergeometric over-representation of sets in queries (query, gene_symbol) within a universe, q-values per query."""
    u = universe.select("gene_symbol").distinct()
    q, s = queries.distinct().join(u, "gene_symbol", "left_semi"), sets.distinct().join(u, "gene_symbol", "left_semi")
    total = u.agg(F.count("*").alias("n_universe"))
    sizes = s.groupBy("set_name").agg(F.count("*").alias("n_set"))
    hits = q.groupBy("query").agg(F.count("*").alias("n_hits"))
    both = q.join(s, "gene_symbol").groupBy("query", "set_name").agg(F.count("*").alias("n_overlap"))
    grid = hits.crossJoin(F.broadcast(total)).join(sizes)  # one row for each query and set
    g = grid.join(both, ["query", "set_name"], "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)))
    k, h, m, n = (F.col(c).cast("double") for c in ("n_overlap", "n_hits", "n_set", "n_universe"))
    odds = F.when((h - k) * (m - k) > 0, F.try_divide(k * (n - h - m + k), (h - k) * (m - k))).otherwise(F.when(k * (n - h - m + k) > 0, float("inf")).otherwise(0.0))
    g = g.withColumn("odds_ratio", odds).withColumn("p_value", hypergeom_pvalue("n_overlap", "n_hits", "n_set", "n_universe"))
    return g.withColumn("q_value", bh_fdr("p_value", ["query"], ["set_name"]))


def enrichment_scores(ranked: DataFrame, sets: DataFrame, by: list[str], power: float = 1.0) -> DataFrame:
    """Running-sum enrichment score of each set: hits step up by |stat|^power, misses down evenly; the first largest
    deviation counts. ranked: by, gene_symbol, stat; genes in order of falling stat, then name."""
    g = W.partitionBy(*by)
    r = ranked.withColumn("_i", F.row_number().over(g.orderBy(F.desc("stat"), "gene_symbol"))).withColumn("_n", F.count("*").over(g))
    # between two hits the sum only falls, so it is largest after a hit and least before one: hits are all that is needed
    w = W.partitionBy(*by, "set_name")
    o = w.orderBy("_i")
    h = r.join(sets.select("set_name", "gene_symbol").distinct(), "gene_symbol").withColumn("_up", F.pow(F.abs("stat"), F.lit(power)))
    h = h.withColumn("_nr", F.sum("_up").over(w)).withColumn("_nh", F.count("*").over(w)).where("_nh < _n")
    h = h.withColumn("_k", F.row_number().over(o)).withColumn("_sum", F.sum("_up").over(o.rowsBetween(W.unboundedPreceding, 0)))
    fall = (F.col("_i") - F.col("_k")) / (F.col("_n") - F.col("_nh")).cast("double")
    after = F.struct((F.try_divide(F.col("_sum"), F.col("_nr")) - fall).alias("run"), F.col("_i").alias("i"))
    before = F.struct((F.try_divide(F.col("_sum") - F.col("_up"), F.col("_nr")) - fall).alias("run"), (F.col("_i") - 1).alias("i"))
    x = h.select(*by, "set_name", "_nh", F.explode(F.array(after, before)).alias("x")).select(*by, "set_name", "_nh", "x.run", "x.i").where("i > 0")
    best = F.struct(F.round(F.abs("run"), 12), -F.col("i"))
    return x.groupBy(*by, "set_name").agg(F.max_by("run", best).alias("es"), F.max_by("i", best).cast("long").alias("peak"), F.first("_nh").cast("long").alias("n_members"))


def rank_statistic(de: DataFrame, by: str) -> DataFrame:
    """gene_symbol and stat: t, log2fc, or sign * -log10 p; of a gene's rows the one largest in size."""
    stat = {"t": F.col("t"), "log2fc": F.col("mean_diff"), "signed_p": F.signum("mean_diff") * -F.log10(F.greatest(F.col("p_value"), F.lit(1e-300)))}[by]
    return de.withColumn("stat", stat).where("stat IS NOT NULL").groupBy("comparison", "gene_symbol").agg(F.max_by("stat", F.struct(F.abs("stat"), "stat")).alias("stat"))


def trajectory(deltas: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of fixed delta columns per subject and module."""
    return deltas.groupBy("subject_id", "module").agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))


def program_filter(loadings: DataFrame, annotation: DataFrame, *, top_n: int, pattern: str, max_p: float, min_loading: float, max_contamination: float) -> DataFrame:
    """Programs with their best annotation p, largest loading, share of contaminants among the top loadings, and why they fail."""
    top = top_abs(loadings, "loading", top_n, ["program"], "gene_symbol").groupBy("program").agg(F.avg(F.col("gene_symbol").rlike(pattern).cast("double")).alias("contamination"))
    largest = loadings.groupBy("program").agg(F.max(F.abs("loading")).alias("max_loading"))
    best = annotation.groupBy("program").agg(F.min("p_value").alias("best_p"))
    g = largest.join(top, "program").join(best, "program", "left")
    reasons = F.concat_ws(
        ",", F.when(F.coalesce(F.col("best_p") > max_p, F.lit(True)), "annotation"), F.when(F.col("max_loading") < min_loading, "loading"), F.when(F.col("contamination") > max_contamination, "contamination")
    )
    return g.withColumn("fail_reasons", reasons).withColumn("kept", F.col("fail_reasons") == "")


def counterfactual(loadings: DataFrame, activations: DataFrame, program: str, to: float) -> DataFrame:
    """How far each feature of a sample would move if the program's activation were `to`."""
    a = activations.where(F.col("program") == program).select("sample_id", "activation")
    ell = loadings.where(F.col("program") == program).select("gene_symbol", "loading")
    return a.crossJoin(F.broadcast(ell)).select("sample_id", "gene_symbol", (F.col("loading") * (F.col("activation") - F.lit(to))).alias("shift"))


def weighted_mean(df: DataFrame, loadings: DataFrame, value: str = "abundance") -> DataFrame:
    """Program scores: sum of loading times value over the sum of absolute loadings."""
    g = df.join(loadings, "gene_symbol").groupBy("program", "sample_id")
    return g.agg(F.try_divide(F.sum(F.col("loading") * F.col(value)), F.sum(F.abs("loading"))).alias("score"))


def weighted_summary(armed: DataFrame) -> DataFrame:
    """Per comparison of scored samples (comparison, arm, score): Cohen's d with its interval, Welch's p, AUC."""
    d = T.effect_sizes(armed, ["comparison"], "score").select("comparison", "n_a", "n_b", "cohen_d", "d_low", "d_high")
    p = T.welch(armed, ["comparison"], "score", 2).select("comparison", F.col("p_value").alias("welch_p"))
    return d.join(p, "comparison").join(T.rank_sum(armed, ["comparison"], "score").select("comparison", "auc"), "comparison")


def endmember_enrichment(levels: DataFrame, sets: DataFrame, top_n: int) -> DataFrame:
    """Over-representation of sets among each endmember's top_n features by level (ties by name), within all features."""
    place = F.row_number().over(W.partitionBy("endmember").orderBy(F.desc("level"), "gene_symbol"))
    top = levels.where("level IS NOT NULL").withColumn("_p", place).where(F.col("_p") <= top_n).select(F.col("endmember").alias("query"), "gene_symbol")
    return over_representation(top, sets, levels.select("gene_symbol")).drop("odds_ratio").withColumnRenamed("query", "endmember")
