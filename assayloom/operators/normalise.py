"""Normalisation and reshaping of long measurement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import average_rank
from .network import checkpointed

NUMBERLESS = ("", "na", "nan")


def unpivot_matrix(wide: DataFrame, ids: list[str], columns: list[str], name: str = "sample_id", value: str = "source") -> DataFrame:
    """A wide matrix as long rows; without any value column there is nothing to read, which is an error."""
    found = [c for c in wide.columns if c in set(columns)]
    if not found:
        raise ValueError("no column of the matrix is a known id")
    return wide.select(*ids, *(F.col(c).cast("string").alias(c) for c in found)).unpivot(ids, found, name, value)


def parse_abundance(source: str, log2: bool = False) -> F.Column:
    """Text to a number: empty, na, nan, infinities and (for log2) what is not positive are null; other text raises."""
    text = F.lower(F.trim(F.col(source)))
    number = text.cast("double")
    number = F.when(text.isin(*NUMBERLESS) | text.isNull(), None).otherwise(number)
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.when(number > 0, F.log2(number)) if log2 else number


def median_normalise(df: DataFrame, value: str = "abundance") -> DataFrame:
    """Each value less its sample's median plus the mean of the samples' medians, as `normalised`."""
    medians = df.groupBy("sample_id").agg(F.median(value).alias("_median"))
    centre = medians.agg(F.avg("_median").alias("_centre"))
    return df.join(medians, "sample_id").crossJoin(F.broadcast(centre)).withColumn("normalised", F.col(value) - F.col("_median") + F.col("_centre")).drop("_median", "_centre")


def quantile_normalise(df: DataFrame, value: str = "abundance") -> DataFrame:
    """Quantile normalisation of the assays that every sample has; the others are median-centred.

    A value of a complete assay becomes the mean over samples of the values of its rank, ties in order of assay. With
    fewer than two complete assays all are median-centred, with fewer than two samples nothing changes.
    """
    n = df.select("sample_id").distinct().agg(F.count("*").alias("_samples"))
    present = df.where(F.col(value).isNotNull()).groupBy("assay_id").agg(F.count_distinct("sample_id").alias("_in"))
    complete = present.crossJoin(F.broadcast(n)).where("_in = _samples").select("assay_id", F.lit(True).alias("_whole"))
    total = complete.agg(F.count("*").alias("_complete"))
    x = df.join(F.broadcast(complete), "assay_id", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total))
    usable = F.coalesce(F.col("_whole"), F.lit(False)) & (F.col("_complete") >= 2)
    x = x.withColumn("_use", usable)
    ranked = x.where("_use").withColumn("_r", F.row_number().over(W.partitionBy("sample_id").orderBy(value, "assay_id")))
    means = ranked.groupBy("_r").agg(F.avg(value).alias("_mean"))
    done = ranked.join(means, "_r").withColumn("normalised", F.when(F.col("_samples") >= 2, F.col("_mean")).otherwise(F.col(value)))
    rest = median_normalise(df, value).join(F.broadcast(complete), "assay_id", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total))
    rest = rest.where(~usable).withColumn("normalised", F.when(F.col("_samples") >= 2, F.col("normalised")).otherwise(F.col(value)))
    keep = [*df.columns, "normalised"]
    return done.select(*keep).unionByName(rest.select(*keep))


def median_spread(df: DataFrame, value: str = "abundance") -> DataFrame:
    """Largest less smallest sample median, and whether that calls for normalisation (over 1)."""
    medians = df.groupBy("sample_id").agg(F.median(value).alias("m"))
    return medians.agg((F.max("m") - F.min("m")).alias("spread")).withColumn("unnormalised", F.col("spread") > 1.0)


def absolute_scale(df: DataFrame, total: str, value: str = "abundance") -> DataFrame:
    """Value less log2 of the sample's linear sum plus log2 of its given total; samples without a positive total go."""
    linear = F.sum(F.pow(F.lit(2.0), F.col(value))).over(W.partitionBy("sample_id"))
    return df.where(F.col(total) > 0).withColumn("scaled", F.col(value) - F.log2(linear) + F.log2(total))


BUCKET = 20_000


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with average_rank(value, *by) as `name`, by buckets of values: the ranks in a bucket and how many values the lower
    ones of its group have. Groups have a bucket of equal width for each BUCKET values, so a task needn't hold a group.

    df is read more than once, and the same values must come each time: checkpoint what sums make.
    """
    x = F.col(value)
    proper = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    ends = df.groupBy(*by).agg(F.min(proper).alias("_low"), F.max(proper).alias("_high"), F.ceil(F.count("*") / BUCKET).alias("_n"))
    share = F.try_divide(x - F.col("_low"), F.col("_high") - F.col("_low"))
    place = F.when(proper.isNotNull() & ~F.isnan(share), F.least(F.floor(share * F.col("_n")), F.col("_n") - 1))
    placed = F.when(F.isnan(x), F.col("_n") + 1).when(x == float("inf"), F.col("_n")).when(x == float("-inf"), F.lit(-1)).otherwise(F.coalesce(place, F.lit(0)))
    dealt = df.join(ends.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)}), [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]) if by else df.crossJoin(ends)
    dealt = dealt.withColumn("_bucket", placed.cast("bigint")).select(*df.columns, "_bucket")
    sizes = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lower = sizes.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_bucket").alias("_b"), before.alias("_before"))
    ranked = dealt.withColumn("_rank", average_rank(value, *by, "_bucket"))
    both = ranked.join(lower, [*(F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.col("_bucket") == F.col("_b")])
    return both.select(*df.columns, (F.col("_rank") + F.col("_before")).alias(name))


def within_cohort_rank(df: DataFrame, by: list[str], value: str = "abundance", dropped: str = "dropped_by_qc") -> DataFrame:
    """Average-tie ranks of the kept cells of each assay as `rank_value`; masked rows pass with their own value. df is
    checkpointed, as average_ranks() needs it: select what is wanted before."""
    df = checkpointed(df)
    ok = F.col(value).isNotNull() & ~F.coalesce(F.col(dropped), F.lit(False))
    kept = average_ranks(df.where(ok), by, value, "rank_value").withColumn("rank_value", F.col("rank_value").cast("double"))
    return kept.unionByName(df.where(~ok).withColumn("rank_value", F.col(value)))


def log_ratio(df: DataFrame, value: str = "abundance", reference: str | None = None) -> DataFrame:
    """Compositional transforms of log values: less the sample's mean (CLR), or less its reference assay (ALR)."""
    w = W.partitionBy("sample_id")
    base = F.avg(value).over(w) if reference is None else F.max(F.when(F.col("assay_id") == reference, F.col(value))).over(w)
    return df.withColumn("log_ratio", F.col(value) - base)


def isometric_log_ratio(df: DataFrame, value: str = "abundance") -> DataFrame:
    """Helmert coordinates of each sample's values in order of assay: coordinate i of n - 1."""
    w = W.partitionBy("sample_id").orderBy("assay_id")
    x = df.withColumn("_i", F.row_number().over(w)).withColumn("_before", F.avg(value).over(w.rowsBetween(W.unboundedPreceding, -1)))
    i = F.col("_i") - 1
    return x.where("_i > 1").select("sample_id", i.cast("long").alias("coordinate"), (F.sqrt(i / (i + 1)) * (F.col("_before") - F.col(value))).alias("ilr"))


def exp2_clip(value: str, bound: float = 6.0) -> F.Column:
    return F.pow(F.lit(2.0), F.least(F.lit(bound), F.greatest(F.lit(-bound), F.col(value))))


def shift_min(df: DataFrame, value: str) -> DataFrame:
    low = df.agg(F.min(value).alias("_low"))
    return df.crossJoin(F.broadcast(low)).withColumn("shifted", F.col(value) - F.col("_low")).drop("_low")


def wide_panel(df: DataFrame, genes: list[str], value: str = "abundance") -> DataFrame:
    """Samples by genes; masked cells are null. genes: the columns, known beforehand so that no job is spent on them."""
    return df.groupBy("sample_id").pivot("gene_symbol", sorted(genes)).agg(F.first(value, ignorenulls=True))


def missing_filter(df: DataFrame, n_samples: DataFrame, limit: float, value: str = "abundance") -> DataFrame:
    """Rows of assays whose missing share is at most limit. n_samples: one row, column n."""
    seen = df.where(F.col(value).isNotNull()).groupBy("assay_id").agg(F.count_distinct("sample_id").alias("_in"))
    kept = seen.crossJoin(F.broadcast(n_samples)).where(1 - F.col("_in") / F.col("n") <= limit + 1e-12).select("assay_id")
    return df.join(kept, "assay_id", "left_semi")


def mean_impute(df: DataFrame, value: str = "abundance") -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(W.partitionBy("assay_id"))))


def collapse_genes(df: DataFrame, how: str, value: str = "abundance") -> DataFrame:
    """One value per sample and gene: "none" the lexically first assay, "mean" the mean, "max-observed" the assay seen
    in most samples (ties: lexically first)."""
    if how == "mean":
        return df.groupBy("sample_id", "gene_symbol").agg(F.avg(value).alias(value))
    if how == "none":
        chosen = df.groupBy("gene_symbol").agg(F.min("assay_id").alias("assay_id"))
    elif how == "max-observed":
        seen = df.where(F.col(value).isNotNull()).groupBy("gene_symbol", "assay_id").agg(F.count_distinct("sample_id").alias("_n"))
        place = F.row_number().over(W.partitionBy("gene_symbol").orderBy(F.desc("_n"), "assay_id"))
        chosen = seen.withColumn("_p", place).where("_p = 1").select("gene_symbol", "assay_id")
    else:
        raise ValueError(f"unknown way to collapse genes: {how}")
    return df.join(F.broadcast(chosen), ["gene_symbol", "assay_id"]).select("sample_id", "gene_symbol", value)
