"""Quality masks, predicates, reports and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_flags(df: DataFrame) -> DataFrame:
    """Rows whose sample or assay flag is not PASS are dropped; what was dropped stays so."""
    bad = (F.coalesce("qc_sample", F.lit("PASS")) != "PASS") | (F.coalesce("qc_assay", F.lit("PASS")) != "PASS")
    return df.withColumn("dropped_by_qc", F.coalesce("dropped_by_qc", F.lit(False)) | bad)


def parse_predicates(text: str) -> list[tuple[str, str, str]]:
    """"a==x; b!=y; c=z" as (column, operator, value)."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        for op in ("!=", "==", "="):
            if op in part:
                column, value = (x.strip() for x in part.split(op, 1))
                if not column:
                    raise ValueError(f"no column in predicate {part!r}")
                out.append((column, "!=" if op == "!=" else "==", value))
                break
        else:
            raise ValueError(f"no comparison in predicate {part!r}")
    return out


def predicate(text: str) -> Column:
    """The conjunction as a condition on trimmed text; null fails == and passes !=."""
    terms = []
    for column, op, value in parse_predicates(text):
        same = F.trim(F.col(column).cast("string")).eqNullSafe(F.lit(value))
        terms.append(same if op == "==" else ~same)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def skip_reason(known_sample: str = "known") -> Column:
    """Why a row takes no part, the first reason that holds; null if none does."""
    return (
        F.when(F.coalesce("dropped_by_qc", F.lit(False)) | F.col("abundance").isNull(), "masked").when(F.col(known_sample).isNull(), "unknown_sample")
        .when(F.col("is_control"), "control").when(F.col("subject_id").isNull(), "no_subject").when(F.col("condition").isNull(), "no_condition")
        .when(F.col("panel").isNull(), "no_panel").when(F.col("gene_symbol").isNull(), "no_gene")
    )


def qc_counts(df: DataFrame) -> DataFrame:
    """Per sample: rows, kept rows, rows below the detection limit."""
    return df.groupBy("sample_id").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("dropped_by_qc") & F.col("abundance").isNotNull()).alias("n_kept"), F.count_if("below_lod").alias("n_below_lod")
    )


def lod_gate(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Share of kept rows below the detection limit, and whether it passes."""
    kept = ~F.col("dropped_by_qc")
    return df.agg(F.try_divide(F.count_if(kept & F.col("below_lod")).cast("double"), F.count_if(kept).cast("double")).alias("below_share")).withColumn("passes", F.col("below_share") <= limit)


def missingness(df: DataFrame, samples: DataFrame, assays: DataFrame) -> DataFrame:
    """Expected, observed and absent cells over all samples and by condition, as grouping sets."""
    n_assays = assays.select("assay_id").distinct().agg(F.count("*").alias("_assays"))
    cells = df.where(~F.col("dropped_by_qc") & F.col("abundance").isNotNull()).groupBy("sample_id").agg(F.count_distinct("assay_id").alias("_seen"))
    s = samples.select("sample_id", "condition").distinct().join(cells, "sample_id", "left").crossJoin(F.broadcast(n_assays))
    g = s.groupingSets([[], ["condition"]], "condition").agg(
        F.grouping("condition").alias("_all"), F.sum("_assays").alias("expected"), F.sum(F.coalesce("_seen", F.lit(0))).alias("observed")
    )
    share = F.try_divide((F.col("expected") - F.col("observed")).cast("double"), F.col("expected").cast("double"))
    return g.select(F.when(F.col("_all") == 1, "all").otherwise("condition").alias("scope"), F.coalesce("condition", F.lit("")).alias("level"), "expected", "observed", share.alias("absent_share"))


def validate(df: DataFrame, samples: DataFrame, assays: DataFrame) -> DataFrame:
    """rule and n_bad for each rule on measurements: empty keys, repeated keys, numbers, unknown samples and assays."""
    key = ["assay_id", "sample_id"]
    rules = {
        "empty_key": df.where(F.coalesce(F.trim("assay_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("sample_id"), F.lit("")).eqNullSafe("")),
        "repeated_key": df.groupBy(*key).count().where("count > 1"),
        "not_finite": df.where(F.isnan("abundance") | (F.abs("abundance") == float("inf"))),
        "unknown_sample": df.join(samples.select("sample_id").distinct(), "sample_id", "left_anti"),
        "unknown_assay": df.join(assays.select("assay_id").distinct(), "assay_id", "left_anti"),
    }
    return reduce(DataFrame.unionAll, (x.agg(F.lit(rule).alias("rule"), F.count("*").alias("n_bad")) for rule, x in rules.items()))
