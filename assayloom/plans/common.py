"""What the query modules share: inputs, rounding, and SQL fragments for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..operators.twogroup import arms
from ..sources import views

COMPARISONS = [("A", "N"), ("A", "R"), ("N", "R")]
KEY = ["comparison", "panel", "gene_symbol"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits; + 0.0 turns a negative zero into zero."""
    return df.select(*(F.round(F.col(c), digits).__add__(F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def effective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, finite cells of samples that are no controls, with the samples' columns."""
    m = views.measurements(spark, sf_dir).where(~F.col("dropped_by_qc") & finite("abundance").isNotNull())
    s = views.samples(spark, sf_dir).where(~F.col("is_control")).select("sample_id", "acctbal", "nation", "region")
    return m.join(s, "sample_id")


def armed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms(effective_rows(spark, sf_dir), COMPARISONS)


#: Rows with comparison and arm, after views.SQL.
ARMS_SQL = """
cmp AS (SELECT * FROM (VALUES ('A-N','A','a'), ('A-N','N','b'), ('A-R','A','a'), ('A-R','R','b'), ('N-R','N','a'), ('N-R','R','b')) AS t(comparison, level, arm)),
arm AS (SELECT e.*, c.comparison, c.arm FROM eff e JOIN cmp c ON e.condition = c.level),
prs AS (
  SELECT * FROM (
    SELECT comparison, panel, gene_symbol, subject_id, avg(abundance) FILTER (arm = 'a') AS va, avg(abundance) FILTER (arm = 'b') AS vb,
      avg(abundance) FILTER (arm = 'a') - avg(abundance) FILTER (arm = 'b') AS d
    FROM arm GROUP BY ALL) WHERE d IS NOT NULL)
"""


def simpson(f: str, low: str, high: str, panels: int = 2000) -> str:
    """SQL for the integral of f, in terms of x, by Simpson's rule."""
    x = f"(({low}) + (({high}) - ({low})) * i / {panels}.0)"
    body = f.replace("{x}", x)
    weight = f"(CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, {panels + 1}), lambda i: {weight} * {body})) * (({high}) - ({low})) / {3 * panels}.0)"


def t_p_sql(t: str, df: str) -> str:
    """SQL for the two-sided p-value of Student's t, by quadrature over the angle."""
    f = f"pow(greatest(0, cos({{x}})), ({df}) - 1)"
    return f"(CASE WHEN ({t}) IS NULL THEN NULL ELSE {simpson(f, f'atan(abs({t}) / sqrt({df}))', 'pi() / 2')} / {simpson(f, '0.0', 'pi() / 2')} END)"


def normal_p_sql(z: str) -> str:
    return f"(CASE WHEN ({z}) IS NULL THEN NULL ELSE 1 - 2 * {simpson('exp(-{x} * {x} / 2)', '0.0', f'abs({z})')} / sqrt(2 * pi()) END)"


def bh_sql(p: str, family: str, key: str, rows: str) -> str:
    """SQL: every column of `rows` and q_value, by counting instead of a running minimum over row numbers."""
    return f"""
SELECT * EXCLUDE (_m, _r), CASE WHEN {p} IS NULL THEN NULL ELSE least(1.0, min({p} * _m / _r) OVER (
  PARTITION BY {family} ORDER BY _r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q_value
FROM (SELECT *, count({p}) OVER (PARTITION BY {family}) AS _m, row_number() OVER (PARTITION BY {family} ORDER BY {p} ASC NULLS LAST, {key}) AS _r FROM ({rows}))
"""


def with_views(*more: str) -> str:
    return "WITH " + ",".join([views.SQL, *more])


def round_sql(columns: list[str], rows: str, digits: int = 6, plain: tuple[str, ...] = ()) -> str:
    return f"SELECT {', '.join([*plain, *(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns)])} FROM ({rows})"
