"""Queries: masks, predicates, validation, reports, normalisation, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bh_fdr, finite, nearest_quantile, trimmed_mean, zscore
from ..operators import checks as C
from ..operators import normalise as N
from ..sources import views
from .common import effective_rows, round_sql, rounded, with_views

_GENES = [f"Brand#{i}" for i in range(1, 26)]


def canonical_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.measurements(spark, sf_dir))


def canonical_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir)


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gene_sets(spark, sf_dir)


def qc_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by sample and assay flags (here: warning where the mean price is high, failure for single lines)."""
    m = views.measurements(spark, sf_dir).withColumn("qc_sample", F.when(F.col("abundance") > 15.6, "WARN").otherwise("PASS"))
    m = C.mask_flags(m.withColumn("qc_assay", F.when(F.col("n_rows") < 3, "FAIL").otherwise("PASS")))
    return m.groupBy("qc_sample", "qc_assay", "dropped_by_qc").agg(F.count("*").alias("n"))


def qc_sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.qc_counts(views.measurements(spark, sf_dir))


def qc_condition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per condition: samples, distinct subjects, kept cells."""
    e = effective_rows(spark, sf_dir)
    return e.groupBy("condition").agg(F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("subject_id").alias("n_subjects"), F.count("*").alias("n_cells"))


def lod_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.lod_gate(views.measurements(spark, sf_dir)))


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.measurements(spark, sf_dir, by_type=True)
    return rounded(C.missingness(m, views.samples(spark, sf_dir), m))


def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that take no part, by the first reason that holds."""
    s = views.samples(spark, sf_dir).where("nation <> 'NATION_3'").select("sample_id", "is_control", F.lit(True).alias("known"))
    m = views.measurements(spark, sf_dir).withColumn("panel", F.when(F.col("panel") != "P3", F.col("panel")))
    return m.join(s, "sample_id", "left").groupBy(F.coalesce(C.skip_reason(), F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset by text predicates; null fails == and passes !=."""
    s = views.samples(spark, sf_dir).withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    return s.where(C.predicate("region != EUROPE; condition == A")).select("sample_id", "region", "condition")


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.measurements(spark, sf_dir)
    s = views.samples(spark, sf_dir).where("nation <> 'NATION_3'")
    return C.validate(m.unionAll(m.where("panel = 'P0' AND condition = 'A'")), s, m.where("panel <> 'P1'"))


def missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine features with at most a third of their samples missing, and how many cells they have."""
    m = views.measurements(spark, sf_dir, by_type=True)
    n = views.samples(spark, sf_dir).agg(F.count("*").alias("n"))
    return N.missing_filter(m, n, 1 / 3).groupBy("assay_id").agg(F.count("*").alias("n_cells"))


def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.measurements(spark, sf_dir).withColumn("abundance", F.when(F.col("n_rows") > 3, F.col("abundance")))
    return rounded(N.mean_impute(m).select("sample_id", "assay_id", "abundance"))


def median_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.median_normalise(effective_rows(spark, sf_dir)).select("sample_id", "assay_id", "normalised"))


def quantile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.quantile_normalise(effective_rows(spark, sf_dir)).select("sample_id", "assay_id", "normalised"))


def median_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.median_spread(effective_rows(spark, sf_dir)))


def absolute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.absolute_scale(effective_rows(spark, sf_dir), "acctbal").select("sample_id", "assay_id", "scaled"))


def within_cohort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.measurements(spark, sf_dir).select("sample_id", "assay_id", "abundance", "dropped_by_qc")
    return rounded(N.within_cohort_rank(m, ["assay_id"]).select("sample_id", "assay_id", "rank_value"))


def centred_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.log_ratio(effective_rows(spark, sf_dir)).select("sample_id", "assay_id", "log_ratio"))


def additive_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.log_ratio(effective_rows(spark, sf_dir), reference="Brand#7").select("sample_id", "assay_id", "log_ratio"))


def isometric_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.isometric_log_ratio(effective_rows(spark, sf_dir)))


def nonnegative_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = N.shift_min(effective_rows(spark, sf_dir).withColumn("centred", F.col("abundance") - 15.1), "centred")
    return rounded(e.select("sample_id", "assay_id", N.exp2_clip("centred").alias("exp2"), "shifted"))


def matrix_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by brands; masked cells stay empty."""
    m = views.measurements(spark, sf_dir).where("condition = 'A'")
    return rounded(N.wide_panel(m.withColumn("abundance", F.when(~F.col("dropped_by_qc"), F.col("abundance"))), _GENES))


def ingest_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide text matrix to long rows: unpivot, parse, log2, mask what has no value."""
    wide = (
        views.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("assay_id"))
        .agg(*(F.coalesce(F.max(F.when(F.col("p_brand") == b, F.col("p_size"))).cast("string"), F.lit("NA")).alias(b) for b in _GENES))
        .withColumn("Brand#1", F.lit("nan")).withColumn("Brand#2", F.lit("0")).withColumn("note", F.lit("no sample"))
    )
    long = N.unpivot_matrix(wide, ["assay_id"], _GENES).withColumn("abundance", N.parse_abundance("source", log2=True))
    return rounded(long.select("assay_id", "sample_id", "abundance", F.col("abundance").isNull().alias("dropped_by_qc")))


def collapse_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.collapse_genes(views.measurements(spark, sf_dir, by_type=True), "mean"))


def collapse_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.collapse_genes(views.measurements(spark, sf_dir, by_type=True), "none"))


def collapse_max_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.collapse_genes(views.measurements(spark, sf_dir, by_type=True), "max-observed"))


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, linear and nearest-index quantiles and the trimmed mean of each gene."""
    v = F.col("abundance")
    out = effective_rows(spark, sf_dir).groupBy("gene_symbol").agg(
        F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.median(v).alias("median"), F.percentile(v, 0.25).alias("linear_q25"),
        nearest_quantile(F.collect_list(v), 0.25).alias("nearest_q25"), trimmed_mean(F.collect_list(v), 0.2).alias("trimmed_mean"),
    )
    return rounded(out)


def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effective_rows(spark, sf_dir).select("sample_id", "assay_id", zscore(finite("abundance"), "assay_id").alias("z")))


def bh_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg over families with missing p-values (here: discounts and taxes as p-values)."""
    rows = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min(F.col("l_tax") * F.col("l_extendedprice") / 10000).alias("x"))
    rows = rows.withColumn("p", F.when((F.col("x") > 0) & (F.col("x") <= 1), F.col("x")))
    return rounded(rows.select("l_suppkey", "l_returnflag", "p", bh_fdr("p", ["l_returnflag"], ["l_suppkey"]).alias("q")))


_FUNCTIONS = (
    canonical_measurements, canonical_samples, gene_sets, qc_mask, qc_sample_report, qc_condition_report, lod_gate, missingness, skip_counts, predicates, validate,
    missing_filter, mean_impute, median_normalise, quantile_normalise, median_spread, absolute_scale, within_cohort_rank, centred_log_ratio, additive_log_ratio,
    isometric_log_ratio, nonnegative_transforms, matrix_panel, ingest_matrix, collapse_mean, collapse_first, collapse_max_observed, order_statistics, standard_scores, bh_families,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_V = with_views()
_CELL = ("sample_id", "assay_id")
ORACLE = {
    "canonical_measurements": _V + "SELECT sample_id, subject_id, condition, assay_id, gene_symbol, panel, round(abundance, 6) AS abundance, below_lod, dropped_by_qc, n_rows FROM msr",
    "canonical_samples": _V + "SELECT * FROM smp",
    "gene_sets": _V + "SELECT * FROM gst",
    "qc_mask": _V + """
SELECT qc_sample, qc_assay, dropped_by_qc OR qc_sample <> 'PASS' OR qc_assay <> 'PASS' AS dropped_by_qc, count(*) AS n FROM (
  SELECT *, CASE WHEN abundance > 15.6 THEN 'WARN' ELSE 'PASS' END AS qc_sample, CASE WHEN n_rows < 3 THEN 'FAIL' ELSE 'PASS' END AS qc_assay FROM msr) GROUP BY ALL""",
    "qc_sample_report": _V + "SELECT sample_id, count(*) AS n_rows, count(*) FILTER (NOT dropped_by_qc) AS n_kept, count(*) FILTER (below_lod) AS n_below_lod FROM msr GROUP BY ALL",
    "qc_condition_report": _V + "SELECT condition, count(DISTINCT sample_id) AS n_samples, count(DISTINCT subject_id) AS n_subjects, count(*) AS n_cells FROM eff GROUP BY ALL",
    "lod_gate": _V + "SELECT round(x, 6) AS below_share, x <= 0.5 AS passes FROM (SELECT count(*) FILTER (below_lod) / count(*) AS x FROM msr WHERE NOT dropped_by_qc)",
    "missingness": _V + """
SELECT scope, level, expected, observed, round((expected - observed) / expected, 6) + 0.0 AS absent_share FROM (
  SELECT CASE WHEN grouping(condition) = 1 THEN 'all' ELSE 'condition' END AS scope, coalesce(condition, '') AS level,
    count(*) * (SELECT count(DISTINCT assay_id) FROM fine) AS expected, CAST(sum((SELECT count(*) FROM fine f WHERE f.sample_id = s.sample_id)) AS BIGINT) AS observed
  FROM smp s GROUP BY GROUPING SETS ((), (condition)))""",
    "skip_counts": _V + """
SELECT CASE WHEN dropped_by_qc THEN 'masked' WHEN s.sample_id IS NULL THEN 'unknown_sample' WHEN s.is_control THEN 'control' WHEN panel = 'P3' THEN 'no_panel' ELSE 'used' END AS reason, count(*) AS n
FROM msr m LEFT JOIN (SELECT * FROM smp WHERE nation <> 'NATION_3') s ON m.sample_id = s.sample_id GROUP BY 1""",
    "predicates": _V + "SELECT sample_id, nullif(region, 'ASIA') AS region, condition FROM smp WHERE region <> 'EUROPE' AND condition = 'A'",
    "validate": _V + """,
m2 AS (SELECT * FROM msr UNION ALL SELECT * FROM msr WHERE panel = 'P0' AND condition = 'A')
SELECT 'empty_key' AS rule, 0::BIGINT AS n_bad UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM m2 GROUP BY assay_id, sample_id HAVING count(*) > 1)
UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'unknown_sample', count(*) FROM m2 WHERE sample_id NOT IN (SELECT sample_id FROM smp WHERE nation <> 'NATION_3')
UNION ALL SELECT 'unknown_assay', count(*) FROM m2 WHERE panel = 'P1'""",
    "missing_filter": _V + """
SELECT assay_id, count(*) AS n_cells FROM fine GROUP BY ALL HAVING 1 - count(DISTINCT sample_id) / (SELECT count(*) FROM smp) <= 1.0 / 3 + 1e-12""",
    "mean_impute": _V + """
SELECT sample_id, assay_id, round(coalesce(v, avg(v) OVER (PARTITION BY assay_id)), 6) AS abundance FROM (SELECT *, CASE WHEN n_rows > 3 THEN abundance END AS v FROM msr)""",
    "median_normalise": _V + round_sql(["normalised"], """
SELECT sample_id, assay_id, abundance - m + (SELECT avg(m) FROM (SELECT median(abundance) AS m FROM eff GROUP BY sample_id)) AS normalised
FROM eff JOIN (SELECT sample_id, median(abundance) AS m FROM eff GROUP BY sample_id) USING (sample_id)""", plain=_CELL),
    "quantile_normalise": _V + """,
whole AS (SELECT assay_id FROM eff GROUP BY 1 HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM eff)),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abundance, assay_id) AS r FROM eff WHERE assay_id IN (SELECT assay_id FROM whole) AND (SELECT count(*) FROM whole) >= 2),
med AS (SELECT sample_id, median(abundance) AS m FROM eff GROUP BY sample_id)""" + round_sql(["normalised"], """
SELECT sample_id, assay_id, avg(abundance) OVER (PARTITION BY r) AS normalised FROM rk UNION ALL
SELECT e.sample_id, assay_id, abundance - m + (SELECT avg(m) FROM med) FROM eff e JOIN med USING (sample_id)
WHERE assay_id NOT IN (SELECT assay_id FROM whole) OR (SELECT count(*) FROM whole) < 2""", plain=_CELL),
    "median_spread": _V + "SELECT round(max(m) - min(m), 6) AS spread, max(m) - min(m) > 1 AS unnormalised FROM (SELECT median(abundance) AS m FROM eff GROUP BY sample_id)",
    "absolute_scale": _V + round_sql(["scaled"], "SELECT sample_id, assay_id, abundance - log2(sum(pow(2, abundance)) OVER (PARTITION BY sample_id)) + log2(acctbal) AS scaled FROM (SELECT * FROM eff WHERE acctbal > 0)", plain=_CELL),
    "within_cohort_rank": _V + round_sql(["rank_value"], """
SELECT sample_id, assay_id, rank() OVER (PARTITION BY assay_id ORDER BY abundance) + (count(*) OVER (PARTITION BY assay_id, abundance) - 1) / 2 AS rank_value FROM msr WHERE NOT dropped_by_qc
UNION ALL SELECT sample_id, assay_id, abundance FROM msr WHERE dropped_by_qc""", plain=_CELL),
    "centred_log_ratio": _V + round_sql(["log_ratio"], "SELECT sample_id, assay_id, abundance - avg(abundance) OVER (PARTITION BY sample_id) AS log_ratio FROM eff", plain=_CELL),
    "additive_log_ratio": _V + round_sql(["log_ratio"], "SELECT e.sample_id, e.assay_id, e.abundance - r.abundance AS log_ratio FROM eff e LEFT JOIN (SELECT * FROM eff WHERE assay_id = 'Brand#7') r USING (sample_id)", plain=_CELL),
    "isometric_log_ratio": _V + round_sql(["ilr"], """
SELECT sample_id, i - 1 AS coordinate, sqrt((i - 1) / i) * (before - abundance) AS ilr FROM (
  SELECT sample_id, abundance, row_number() OVER w AS i, avg(abundance) OVER (PARTITION BY sample_id ORDER BY assay_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM eff WINDOW w AS (PARTITION BY sample_id ORDER BY assay_id)) WHERE i > 1""", plain=("sample_id", "coordinate")),
    "nonnegative_transforms": _V + round_sql(["exp2", "shifted"], """
SELECT sample_id, assay_id, pow(2, least(6, greatest(-6, abundance - 15.1))) AS exp2, abundance - (SELECT min(abundance) FROM eff) AS shifted FROM eff""", plain=_CELL),
    "matrix_panel": _V + "SELECT sample_id, " + ", ".join(f"""round(max(abundance) FILTER (gene_symbol = '{g}' AND NOT dropped_by_qc), 6) AS "{g}" """ for g in _GENES) + "FROM msr WHERE condition = 'A' GROUP BY ALL",
    "ingest_matrix": f"""
SELECT t.assay_id, b.sample_id, round(CASE WHEN b.sample_id NOT IN ('Brand#1', 'Brand#2') AND v > 0 THEN log2(v) END, 6) AS abundance,
  b.sample_id IN ('Brand#1', 'Brand#2') OR v IS NULL OR v <= 0 AS dropped_by_qc
FROM (SELECT DISTINCT p_type AS assay_id FROM part) t CROSS JOIN (SELECT unnest([{', '.join(f"'{g}'" for g in _GENES)}]) AS sample_id) b
LEFT JOIN (SELECT p_type AS assay_id, p_brand AS sample_id, max(p_size) AS v FROM part GROUP BY ALL) x ON x.assay_id = t.assay_id AND x.sample_id = b.sample_id""",
    "collapse_mean": _V + "SELECT sample_id, gene_symbol, round(avg(abundance), 6) AS abundance FROM fine GROUP BY ALL",
    "collapse_first": _V + "SELECT sample_id, gene_symbol, round(abundance, 6) AS abundance FROM fine WHERE assay_id IN (SELECT min(assay_id) FROM fine GROUP BY gene_symbol)",
    "collapse_max_observed": _V + """
SELECT sample_id, gene_symbol, round(abundance, 6) AS abundance FROM fine WHERE assay_id IN (
  SELECT assay_id FROM (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY n DESC, assay_id) AS r FROM (SELECT gene_symbol, assay_id, count(*) AS n FROM fine GROUP BY ALL)) WHERE r = 1)""",
    "order_statistics": _V + """
SELECT gene_symbol, round(avg(abundance), 6) AS mean, round(var_samp(abundance), 6) AS variance, round(median(abundance), 6) AS median, round(quantile_cont(abundance, 0.25), 6) AS linear_q25,
  round(list_sort(list(abundance))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS INT) + 1], 6) AS nearest_q25,
  round(list_avg(list_sort(list(abundance))[CAST(floor(count(*) * 0.2) AS INT) + 1 : CAST(count(*) - floor(count(*) * 0.2) AS INT)]), 6) AS trimmed_mean FROM eff GROUP BY ALL""",
    "standard_scores": _V + round_sql(["z"], "SELECT sample_id, assay_id, (abundance - avg(abundance) OVER w) / nullif(stddev_samp(abundance) OVER w, 0) AS z FROM eff WINDOW w AS (PARTITION BY assay_id)", plain=_CELL),
    "bh_families": """
SELECT l_suppkey, l_returnflag, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (PARTITION BY l_returnflag ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM (
  SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS m, row_number() OVER (PARTITION BY l_returnflag ORDER BY p, l_suppkey) AS r FROM (
    SELECT l_suppkey, l_returnflag, min(l_tax * l_extendedprice / 10000) AS p FROM lineitem GROUP BY ALL HAVING min(l_tax * l_extendedprice / 10000) > 0 AND min(l_tax * l_extendedprice / 10000) <= 1))
UNION ALL SELECT l_suppkey, l_returnflag, NULL, NULL FROM lineitem GROUP BY ALL HAVING NOT (min(l_tax * l_extendedprice / 10000) > 0 AND min(l_tax * l_extendedprice / 10000) <= 1)""",
}
