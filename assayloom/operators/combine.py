"""Results of several comparisons or cohorts together: meta-analysis, asymmetry, concordance, coupling, robustness, ICC."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import average_rank, pearson_agg, sign
from ..functions.dist import normal_pvalue


def meta(effects: DataFrame, key: list[str]) -> DataFrame:
    """Fixed and DerSimonian-Laird effects and signed Stouffer z over cohorts (columns cohort, effect, t).

    The standard error is |effect / t|; rows with t zero or unknown are left out, and so are keys of one cohort.
    """
    e = effects.where("t IS NOT NULL AND t <> 0 AND effect IS NOT NULL").withColumn("_se", F.abs(F.col("effect") / F.col("t"))).where("_se > 0")
    e = e.withColumn("_w", 1 / (F.col("_se") * F.col("_se")))
    g = e.groupBy(*key).agg(
        F.count("*").alias("n_cohorts"), F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"), F.sum(F.col("_w") * F.col("effect")).alias("_we"),
        F.sum(F.col("_w") * F.col("effect") * F.col("effect")).alias("_wee"), F.sum("t").alias("_z"), F.collect_list(F.struct("effect", "_se")).alias("_rows"),
        F.count_if(F.col("effect") > 0).alias("n_up"), F.count_if(F.col("effect") < 0).alias("n_down"),
    ).where("n_cohorts >= 2")
    k = F.col("n_cohorts")
    g = g.withColumn("fixed", F.col("_we") / F.col("_w")).withColumn("fixed_z", F.col("fixed") * F.sqrt("_w"))
    g = g.withColumn("q", F.greatest(F.lit(0.0), F.col("_wee") - F.col("_we") * F.col("_we") / F.col("_w")))
    g = g.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (k - 1)) / F.col("q"))).otherwise(0.0))
    g = g.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (k - 1), F.col("_w") - F.col("_w2") / F.col("_w")), F.lit(0.0))))
    weight = lambda x: 1 / (x["_se"] * x["_se"] + F.col("tau2"))
    total = F.aggregate("_rows", F.lit(0.0), lambda a, x: a + weight(x))
    g = g.withColumn("_rw", total).withColumn("random", F.aggregate("_rows", F.lit(0.0), lambda a, x: a + weight(x) * x["effect"]) / F.col("_rw"))
    g = g.withColumn("random_z", F.col("random") * F.sqrt("_rw")).withColumn("stouffer_z", F.col("_z") / F.sqrt(k.cast("double")))
    g = g.withColumn("fixed_p", normal_pvalue("fixed_z")).withColumn("random_p", normal_pvalue("random_z")).withColumn("stouffer_p", normal_pvalue("stouffer_z"))
    return g.drop("_w", "_w2", "_we", "_wee", "_z", "_rows", "_rw")


def binomial_tail(k: F.Column, n: F.Column) -> F.Column:
    """P(X >= k) of n fair trials, as a sum of terms whose logarithms are built upwards from that of k: 0.5^n itself is
    zero from 1,075 trials on."""
    first = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), n * F.lit(math.log(0.5)), lambda a, i: F.when(i <= k, a + F.ln((n - i + 1) / i)).otherwise(a))
    tail = F.aggregate(
        F.sequence(k, F.greatest(n, k)), F.struct(F.lit(0.0).alias("s"), first.alias("t")),
        lambda a, i: F.struct((a["s"] + F.exp(a["t"])).alias("s"), (a["t"] + F.ln((n - i) / (i + 1))).alias("t")), lambda a: a["s"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


def asymmetry(de: DataFrame, first: str, second: str, key: list[str], alpha: float) -> DataFrame:
    """Two comparisons of one result table against each other; zero effects don't count for the signs."""
    side = lambda c, n: de.where(F.col("comparison") == c).select(*key, F.col("mean_diff").alias(f"e{n}"), F.col("p_value").alias(f"p{n}"))
    both = side(first, 1).join(side(second, 2), key).where("e1 IS NOT NULL AND e2 IS NOT NULL")
    signed = (F.col("e1") != 0) & (F.col("e2") != 0)
    return both.agg(
        F.count("*").alias("n_common"), F.count_if(F.col("p1") < alpha).alias("n_sig_first"), F.count_if(F.col("p2") < alpha).alias("n_sig_second"),
        F.median(F.try_divide(F.abs("e1"), F.abs("e2"))).alias("median_abs_ratio"), F.avg(F.when(signed, (sign(F.col("e1")) == sign(F.col("e2"))).cast("double"))).alias("sign_concordance"),
    )


def concordance(effects: DataFrame, pairs: list[tuple[str, str]], label: str, feature: str, effect: str, hit: str, top_n: int) -> DataFrame:
    """For pairs of labelled effect tables: shared features, Spearman's rho, sign concordance (zero counts as positive),
    hits of both, Jaccard index of the top n features by absolute effect."""
    table = effects.sparkSession.createDataFrame(pairs, "label_a string, label_b string")
    place = F.row_number().over(W.partitionBy(label).orderBy(F.abs(F.col(effect)).desc(), feature))
    e = effects.where(F.col(effect).isNotNull()).withColumn("_top", place <= top_n)
    side = lambda n: e.select(F.col(label).alias(f"label_{n}"), F.col(feature).alias(f"f{n}"), F.col(effect).alias(f"e{n}"), F.col(hit).alias(f"h{n}"), F.col("_top").alias(f"t{n}"))
    both = F.broadcast(table).join(side("a"), "label_a").join(side("b"), "label_b").where("fa = fb")
    ranked = both.withColumn("_ra", average_rank("ea", "label_a", "label_b")).withColumn("_rb", average_rank("eb", "label_a", "label_b"))
    out = ranked.groupBy("label_a", "label_b").agg(
        F.count("*").alias("n_shared"), pearson_agg("_ra", "_rb").alias("spearman"), F.avg((sign(F.col("ea"), 1) == sign(F.col("eb"), 1)).cast("double")).alias("sign_concordance"),
        F.count_if(F.col("ha") & F.col("hb")).alias("n_hits_both"), F.count_if(F.col("ta") & F.col("tb")).alias("_inner"),
    )
    tops = e.where("_top").groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    out = out.join(F.broadcast(tops), F.col("label_a") == F.col("_l")).withColumnRenamed("_n", "_na").drop("_l")
    out = out.join(F.broadcast(tops), F.col("label_b") == F.col("_l")).withColumnRenamed("_n", "_nb").drop("_l")
    return out.withColumn("top_jaccard", F.col("_inner") / (F.col("_na") + F.col("_nb") - F.col("_inner"))).drop("_inner", "_na", "_nb")


def coupling(rows: DataFrame, x: str, y: str, by: list[str], min_n: int = 4) -> DataFrame:
    """Spearman's rho of two per-subject values with Fisher's interval and p, and the share of equal signs."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, *by)).withColumn("_y", average_rank(y, *by))
    signed = (F.col(x) != 0) & (F.col(y) != 0)
    g = r.groupBy(*by).agg(
        F.count("*").alias("n"), pearson_agg("_x", "_y").alias("rho"), F.count_if(signed & (F.col(x) * F.col(y) > 0)).alias("n_same_sign"), F.count_if(signed).alias("n_signed")
    ).where(F.col("n") >= min_n)
    held = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("rho")))
    z, se = F.atanh(held), 1 / F.sqrt(F.col("n") - 3)
    out = g.withColumn("ci_low", F.tanh(z - 1.96 * se)).withColumn("ci_high", F.tanh(z + 1.96 * se)).withColumn("_z", z / se)
    return out.withColumn("p_value", normal_pvalue("_z")).withColumn("sign_p", binomial_tail(F.col("n_same_sign").cast("int"), F.col("n_signed").cast("int"))).drop("_z")


def partial_rank_correlation(rows: DataFrame, x: str, y: str, given: str, by: list[str]) -> DataFrame:
    """Pearson correlation of the ranks' residuals after a straight line on the third value's ranks."""
    r = rows
    for c in (x, y, given):
        r = r.withColumn(f"_{c}", average_rank(c, *by))
    w = W.partitionBy(*by)
    for c in (x, y):
        slope, cut = F.regr_slope(F.col(f"_{c}"), F.col(f"_{given}")).over(w), F.regr_intercept(F.col(f"_{c}"), F.col(f"_{given}")).over(w)
        r = r.withColumn(f"_e{c}", F.col(f"_{c}") - cut - slope * F.col(f"_{given}"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), pearson_agg(f"_e{x}", f"_e{y}").alias("partial_rho"))


def icc1(rows: DataFrame, subject: str, value: str, by: list[str]) -> DataFrame:
    """One-way intraclass correlation of unbalanced groups; subjects with one value are left out and counted."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, subject).agg(F.count("*").alias("_k"), F.avg(value).alias("_m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("_v"))
    many = F.col("_k") >= 2
    k, m, v = (F.when(many, F.col(c)) for c in ("_k", "_m", "_v"))
    g = per.groupBy(*by).agg(
        F.count(k).alias("n_subjects"), F.count_if(~many).alias("n_single"), F.sum(k).alias("_N"), F.sum(k * k).alias("_K2"), F.sum(k * m).alias("_km"), F.sum(k * m * m).alias("_kmm"), F.sum((k - 1) * v).alias("_ssw")
    )
    n, total = F.col("n_subjects"), F.col("_N").cast("double")
    msb = F.try_divide(F.col("_kmm") - F.col("_km") * F.col("_km") / total, (n - 1).cast("double"))
    msw = F.try_divide(F.col("_ssw"), total - n)
    k0 = F.try_divide(total - F.col("_K2") / total, (n - 1).cast("double"))
    return g.withColumn("icc", F.try_divide(msb - msw, msb + (k0 - 1) * msw)).drop("_N", "_K2", "_km", "_kmm", "_ssw")


def robustness(baseline: DataFrame, replicates: DataFrame, key: list[str], alpha: float, top_k: int) -> DataFrame:
    """How results of replicates (column replicate) hold up against a baseline: sign match, kept hits, stability score.

    Zero effects are no sign. stability = |effect| * sign match rate * (1 - q); stability_rank orders it from 1.
    """
    b = baseline.select(*key, F.col("mean_diff").alias("_b"), F.col("q_value").alias("_q"))
    r = replicates.select("replicate", *key, F.col("mean_diff").alias("_r"), F.col("q_value").alias("_rq"))
    signed = (F.col("_b") != 0) & (F.col("_r") != 0)
    g = b.join(r, key, "left").groupBy(*key, "_b", "_q").agg(
        F.count("_r").alias("n_replicates"), F.avg(F.when(signed, (sign(F.col("_b")) == sign(F.col("_r"))).cast("double"))).alias("sign_match_rate"),
        F.avg(F.when(F.col("_r").isNotNull(), (F.coalesce(F.col("_rq"), F.lit(1.0)) < alpha).cast("double"))).alias("hit_rate"),
    )
    g = g.withColumn("stability", F.abs("_b") * F.col("sign_match_rate") * (1 - F.col("_q")))
    return g.withColumn("stability_rank", F.row_number().over(W.orderBy(F.col("stability").desc_nulls_last(), *key)).cast("long")).drop("_b", "_q")


def ensemble(results: DataFrame, key: list[str], alpha: float) -> DataFrame:
    """Several methods' results per feature: methods, significant ones, share of the majority sign (zero counts as
    positive) and a grade from these."""
    up = F.count_if(sign(F.col("mean_diff"), 1) > 0)
    g = results.where("p_value IS NOT NULL").groupBy(*key).agg(F.count("*").alias("n_methods"), F.count_if(F.col("p_value") < alpha).alias("n_significant"), up.alias("_up"))
    g = g.withColumn("sign_fraction", F.greatest(F.col("_up"), F.col("n_methods") - F.col("_up")) / F.col("n_methods"))
    agreed = F.col("sign_fraction") >= 1.0
    grade = F.when((F.col("n_significant") == F.col("n_methods")) & agreed, "A").when((F.col("n_significant") * 2 >= F.col("n_methods")) & agreed, "B").when(F.col("n_significant") >= 1, "C").otherwise("D")
    return g.withColumn("grade", grade).drop("_up")
