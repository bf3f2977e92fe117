"""The measurement, sample and feature tables as views of the star-schema test tables.

A sample is a supplier under a return flag, a feature a brand, a panel a quarter of the brands; an abundance is log2 of
the mean price of the sample's lines of the brand, masked where only one line stands behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, subject_id, condition, is_control, acctbal, nation, region: one row per supplier and flag."""
    people = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("subject_id"), F.col("s_acctbal").alias("acctbal"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("condition")).distinct()
    return flags.join(people, "subject_id").select(
        F.concat_ws("_", "subject_id", "condition").alias("sample_id"), "subject_id", "condition",
        (F.col("subject_id") % 10 == 0).alias("is_control"), "acctbal", "nation", "region",
    )


def brand_number(c) -> F.Column:
    return F.regexp_extract(c, "([0-9]+)", 1).cast("int")


def measurements(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """sample_id, subject_id, condition, assay_id, gene_symbol, panel, abundance, below_lod, dropped_by_qc, n_rows.

    by_type: the finer features brand and type, of which many cells are missing; nothing is masked there.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    assay = F.concat_ws("|", "p_brand", "p_type") if by_type else F.col("p_brand")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_returnflag").alias("condition"), assay.alias("assay_id"), F.col("p_brand").alias("gene_symbol"))
        .agg(F.log2(F.avg("l_extendedprice")).alias("abundance"), (F.round(F.avg("l_discount"), 6) < 0.045).alias("below_lod"), F.count("*").alias("n_rows"))
        .select(
            F.concat_ws("_", "subject_id", "condition").alias("sample_id"), "subject_id", "condition", "assay_id", "gene_symbol",
            F.concat(F.lit("P"), brand_number("gene_symbol") % 4).alias("panel"), "abundance", "below_lod",
            (F.lit(False) if by_type else F.col("n_rows") < 2).alias("dropped_by_qc"), "n_rows",
        )
    )


def scores(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """sample_id, cohort, condition and k numeric score columns, from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.concat(F.lit("C"), F.col("label") % 3).alias("cohort"), F.concat(F.lit("L"), F.col("label") % 2).alias("condition"),
        *(F.col("embedding")[i].cast("double").alias(f"s{i + 1}") for i in range(k)),
    )


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_name, gene_symbol: brands with more parts of a type than the mean over that type's brands."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("set_name"), F.col("p_brand").alias("gene_symbol")).agg(F.count("*").alias("n"))
    means = counts.groupBy("set_name").agg(F.avg("n").alias("mean"))
    return counts.join(F.broadcast(means), "set_name").where("n > mean").select("set_name", "gene_symbol")


#: The same views for the SQL oracles, stated on their own.
SQL = """
smp AS (
  SELECT DISTINCT l_suppkey || '_' || l_returnflag AS sample_id, l_suppkey AS subject_id, l_returnflag AS condition,
    l_suppkey % 10 = 0 AS is_control, s_acctbal AS acctbal, n_name AS nation, r_name AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
msr AS (
  SELECT l_suppkey || '_' || l_returnflag AS sample_id, l_suppkey AS subject_id, l_returnflag AS condition, p_brand AS assay_id,
    p_brand AS gene_symbol, 'P' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 4) AS panel,
    log2(avg(l_extendedprice)) AS abundance, round(avg(l_discount), 6) < 0.045 AS below_lod, count(*) < 2 AS dropped_by_qc, count(*) AS n_rows
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
fine AS (
  SELECT l_suppkey || '_' || l_returnflag AS sample_id, l_suppkey AS subject_id, l_returnflag AS condition, p_brand || '|' || p_type AS assay_id,
    p_brand AS gene_symbol, 'P' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 4) AS panel,
    log2(avg(l_extendedprice)) AS abundance, round(avg(l_discount), 6) < 0.045 AS below_lod, count(*) AS n_rows
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
eff AS (
  SELECT m.*, s.is_control, s.acctbal, s.nation, s.region FROM msr m JOIN smp s USING (sample_id)
  WHERE NOT m.dropped_by_qc AND isfinite(m.abundance) AND NOT s.is_control),
sco AS (
  SELECT vec_id AS sample_id, 'C' || (label % 3) AS cohort, 'L' || (label % 2) AS condition,
    CAST(embedding[1] AS DOUBLE) AS s1, CAST(embedding[2] AS DOUBLE) AS s2, CAST(embedding[3] AS DOUBLE) AS s3, CAST(embedding[4] AS DOUBLE) AS s4,
    CAST(embedding[5] AS DOUBLE) AS s5, CAST(embedding[6] AS DOUBLE) AS s6, CAST(embedding[7] AS DOUBLE) AS s7, CAST(embedding[8] AS DOUBLE) AS s8
  FROM embeddings),
gst AS (
  SELECT set_name, gene_symbol FROM (
    SELECT *, avg(n) OVER (PARTITION BY set_name) AS mean FROM (SELECT p_type AS set_name, p_brand AS gene_symbol, count(*) AS n FROM part GROUP BY ALL))
  WHERE n > mean)
"""
