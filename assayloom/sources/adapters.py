"""Vendor exports to canonical measurement rows: semicolon long files, wide matrices, log-ratio matrices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from .tables import read_text_table

#: The header of the long export (fixed by the format).
LONG_EXPORT = (
    "SampleID", "Index", "OlinkID", "UniProt", "Assay", "MissingFreq", "Panel", "Panel_Lot_Nr", "PlateID", "QC_Warning", "LOD", "NPX", "Normalization", "Assay_Warning",
)
#: Names of columns of log-ratio matrices that hold no biological sample (fixed value).
NO_SAMPLE = r"^(?:TumorOnlyIR|NormalOnlyIR|QC\d*|Pool\d*|Reference|RefMix\d*)$"
_SUMMARY_ROWS = ("mean", "median", "stddev")


def long_export(spark: SparkSession, path: str, subject: str = r"^([^_]+)", condition: str = r"_([^_]+)$", control: str = "CONTROL") -> tuple[DataFrame, DataFrame]:
    """Measurements and samples of a semicolon-separated long export with exactly the known columns.

    Only plate-control normalisation is accepted. Subject and condition come from the sample id by regular expressions;
    ids that begin with `control` are controls and have neither.
    """
    raw = read_text_table(spark, path, sep=";")
    if tuple(raw.columns) != LONG_EXPORT:
        raise ValueError(f"{path} is no long export: its columns are {raw.columns}")
    other = raw.where(~F.col("Normalization").eqNullSafe("Plate control")).limit(1).collect()
    if other:
        raise ValueError(f"{path} has another normalisation: {other[0]['Normalization']}")
    value, limit = finite(F.col("NPX").cast("double")), F.col("LOD").cast("double")
    flag = lambda c: F.upper(F.coalesce(F.col(c), F.lit("PASS")))
    m = raw.select(
        F.lit("olink_explore_ngs").alias("platform"), F.col("SampleID").alias("sample_id"), F.col("OlinkID").alias("assay_id"), F.col("Assay").alias("gene_symbol"), F.col("Panel").alias("panel"),
        F.col("NPX").alias("npx_source_str"), value.alias("abundance"), F.lit("log2_npx").alias("abundance_unit"), flag("QC_Warning").alias("qc_sample"), flag("Assay_Warning").alias("qc_assay"),
        limit.alias("detection_limit"), F.coalesce(value < limit, F.lit(False)).alias("below_lod"), value.isNull().alias("dropped_by_qc"), F.col("PlateID").alias("plate_id"), F.col("Panel_Lot_Nr").alias("panel_lot"),
    )
    is_control = F.upper("sample_id").startswith(control.upper())
    part = lambda pattern: F.when(~is_control, F.nullif(F.regexp_extract("sample_id", pattern, 1), F.lit("")))
    s = m.select("sample_id").distinct().select("sample_id", part(subject).alias("subject_id"), part(condition).alias("condition"), is_control.alias("is_control"))
    return m, s


def wide_matrix(raw: DataFrame, assay: str, samples: list[str]) -> DataFrame:
    """A wide text matrix with features as rows, as (assay_id, sample_id, abundance, dropped_by_qc)."""
    found = [c for c in raw.columns if c in set(samples)]
    if not found:
        raise ValueError("no column of the matrix is a known sample")
    long = raw.select(F.col(assay).alias("assay_id"), *(F.col(f"`{c}`") for c in found)).unpivot(["assay_id"], found, "sample_id", "source")
    number = finite(F.expr("try_cast(source AS double)"))
    return long.select("assay_id", "sample_id", number.alias("abundance"), number.isNull().alias("dropped_by_qc"))


def log_ratio_matrix(raw: DataFrame, gene: str = "Gene", no_sample: str = NO_SAMPLE) -> DataFrame:
    """A log-ratio matrix: summary rows go, of the sample columns those ending in " Log Ratio" stay (not "Unshared"),
    without those whose name matches no_sample (pools, references, controls)."""
    end = " Log Ratio"
    keep = {c: c.removesuffix(end) for c in raw.columns if c.endswith(end) and not c.endswith(f"Unshared{end}")}
    keep = {c: s for c, s in keep.items() if not re.search(no_sample, s.strip())}
    rows = raw.where(~F.lower(F.trim(gene)).isin(*_SUMMARY_ROWS)).select(F.col(gene), *(F.col(f"`{c}`").alias(s) for c, s in keep.items()))
    return wide_matrix(rows, gene, list(keep.values()))
