"""Result tables and small inputs of the commands: readers, writers, manifests, and hashes of files."""

from __future__ import annotations

import hashlib
import shlex
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..operators.checks import parse_predicates
from ..operators.differential import RESULTS
from .tables import MEASUREMENTS, PROTEINS, read_text_table, sidecar, write_table


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table by its columns' names: columns of later versions are ignored, missing ones are null."""
    raw = read_text_table(spark, path)
    return raw.select(*((finite(F.col(c).cast(kind)) if kind == "double" else F.col(c).cast(kind)).alias(c) if c in raw.columns else F.lit(None).cast(kind).alias(c) for c, kind in RESULTS.items()))


def write_results(results: DataFrame, path: str) -> None:
    """All columns of the format in their order, nulls as empty cells."""
    write_table(results.select(*RESULTS), path)


def _column(raw: DataFrame, name: str, path: str) -> str:
    if name not in raw.columns:
        raise ValueError(f"{path} lacks {name}")
    return name


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """module, gene_symbol: distinct, without empty cells."""
    raw = read_text_table(spark, path)
    return raw.select(*(F.trim(_column(raw, c, path)).alias(c) for c in ("module", "gene_symbol"))).dropna().distinct()


def read_weights(spark: SparkSession, path: str, feature_col: str = "feature", weight_col: str = "weight") -> DataFrame:
    """feature, weight from the named columns; a weight that is no finite number is an error, a repeated feature too."""
    raw = read_text_table(spark, path)
    out = raw.select(F.trim(_column(raw, feature_col, path)).alias("feature"), finite(F.expr(f"try_cast(`{_column(raw, weight_col, path)}` AS double)")).alias("weight")).where("feature IS NOT NULL")
    bad = out.where("weight IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{path} has no weight for {bad[0]['feature']}")
    twice = out.groupBy("feature").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path} has {twice[0]['feature']} twice")
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query, gene_symbol: rows without a query, and files without that column, belong to the query "all"."""
    raw = read_text_table(spark, path)
    query = F.coalesce(F.trim("query"), F.lit("all")) if "query" in raw.columns else F.lit("all")
    return raw.select(query.alias("query"), F.trim(_column(raw, "gene_symbol", path)).alias("gene_symbol")).where("gene_symbol IS NOT NULL").distinct()


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """gene_symbol: that column of a table with a header, or else every line of a plain list."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    first = spark.read.text(path).limit(1).collect()
    if first and "gene_symbol" in first[0][0].strip().split("\t"):
        return read_text_table(spark, path, "\t").select(F.trim("gene_symbol").alias("gene_symbol")).dropna().distinct()
    return lines.select(F.split("line", "\t")[0].alias("gene_symbol")).distinct()


def _told(spark: SparkSession, path: str, needed: tuple[str, ...]) -> list[dict]:
    raw = read_text_table(spark, path, "\t")
    for c in needed:
        _column(raw, c, path)
    return [{k: (v or "").strip() for k, v in r.asDict().items()} for r in raw.collect()]  # a manifest has a line for each table or contrast


def read_contrasts(spark: SparkSession, path: str) -> list[dict]:
    """Contrasts: label (unique), cohort, case and control levels (split at "|"), family, condition_col, subset.

    Control "*" stands for all levels that aren't case: control is then None. Lines without a label are left out.
    """
    out: list[dict] = []
    for row in _told(spark, path, ("label", "cohort", "case", "control", "family")):
        if not row["label"]:
            continue
        if any(c["label"] == row["label"] for c in out):
            raise ValueError(f"{path} has contrast {row['label']} twice")
        levels = {side: [x.strip() for x in row[side].split("|") if x.strip()] for side in ("case", "control")}
        rest = row["control"] == "*"
        if not levels["case"] or not (rest or levels["control"]):
            raise ValueError(f"contrast {row['label']} has no {'control' if levels['case'] else 'case'}")
        out.append({
            "label": row["label"], "cohort": row["cohort"], "case": levels["case"], "control": None if rest else levels["control"], "family": row["family"],
            "condition_col": row.get("condition_col") or "condition", "subset": parse_predicates(row.get("subset") or ""),
        })
    if not out:
        raise ValueError(f"{path} has no contrasts")
    return out


def select_contrast(table: DataFrame, contrast: dict) -> DataFrame:
    """The rows of a score table that a contrast takes, with arm "a" (case) or "b" (control)."""
    level = F.trim(F.col(contrast["condition_col"]).cast("string"))
    rows = table.where(F.col("cohort") == contrast["cohort"]) if contrast["cohort"] else table
    for column, op, value in contrast["subset"]:
        same = F.trim(F.col(column).cast("string")).eqNullSafe(F.lit(value))
        rows = rows.where(same if op == "==" else ~same)
    case = level.isin(*contrast["case"])
    control = level.isNotNull() if contrast["control"] is None else level.isin(*contrast["control"])
    return rows.withColumn("arm", F.when(case, "a").when(control, "b")).where("arm IS NOT NULL").withColumn("contrast", F.lit(contrast["label"]))


def read_effect_specs(spark: SparkSession, path: str) -> list[dict]:
    """Effect tables to compare: label, path, effect_col, feature_col (gene_symbol), q_col, stage; (label, stage) unique."""
    out: list[dict] = []
    for row in _told(spark, path, ("label", "path", "effect_col")):
        if not row["label"]:
            continue
        key = (row["label"], row.get("stage", ""))
        if any((t["label"], t["stage"]) == key for t in out):
            raise ValueError(f"{path} has {key} twice")
        out.append({"label": key[0], "path": row["path"], "effect_col": row["effect_col"], "feature_col": row.get("feature_col") or "gene_symbol", "q_col": row.get("q_col") or None, "stage": key[1]})
    if not out:
        raise ValueError(f"{path} names no tables")
    return out


def write_fold_changes(folds: DataFrame, comparisons: list[str], path: str) -> None:
    """One folder per panel with a row for each assay and a column for each comparison; no other panel names than plain ones."""
    bad = folds.where(~F.col("panel").rlike("^[A-Za-z0-9_. -]+$") | F.col("panel").contains("..")).limit(1).collect()
    if bad:
        raise ValueError(f"not a panel name for a folder: {bad[0]['panel']!r}")
    wide = folds.groupBy("panel", F.col("gene_symbol").alias("Assay")).pivot("comparison", comparisons).agg(F.first("log2_fc"))
    wide.repartition("panel").sortWithinPartitions("Assay").withColumn("panel", F.concat(F.lower("panel"), F.lit("_log2_fc"))).write.mode("overwrite").partitionBy("panel").csv(path, header=True, nullValue="", emptyValue="")


def write_scores(scores: DataFrame, samples: DataFrame, path: str, unit: str = "module_score") -> None:
    """Module scores (module, sample_id, score) as canonical tables, so that the tests run on them like on measurements."""
    named = {"platform": F.lit("somascan"), "assay_id": F.col("module"), "gene_symbol": F.col("module"), "panel": F.lit("module_score")}
    own = {
        "npx_source_str": F.col("score").cast("string"), "abundance": F.col("score"), "abundance_raw": F.col("score"), "abundance_unit": F.lit(unit), "qc_sample": F.lit("PASS"), "qc_assay": F.lit("PASS"),
        "below_lod": F.lit(False), "dropped_by_qc": F.lit(False), "ingest_order": F.xxhash64("sample_id", "module"),
    }
    kinds = {"flag": "string", "long": "bigint"}

    def table(df: DataFrame, columns: dict[str, str], values: dict) -> DataFrame:
        return df.select(*(values.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(k.rstrip("*"), k.rstrip("*"))).alias(c) for c, k in columns.items()))

    write_table(table(scores.where("score IS NOT NULL"), MEASUREMENTS, named | own), f"{path}/measurements")
    write_table(table(scores.select("module").distinct(), PROTEINS, named), f"{path}/proteins")
    write_table(samples, f"{path}/samples")


def write_side_tables(path: str, **tables: DataFrame) -> None:
    """Further tables of a run (covariates, omnibus, design, proxy), each in a folder of its name."""
    for name, df in tables.items():
        write_table(df, f"{path}/de_{name}")


def file_digests(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """SHA-256 of files or of all files in folders, read where they are; inputs that aren't there are left out.

    A folder's digest is that of its files' digests in order of their names. Files are read as pieces of a stream by the
    tasks, one for each file.
    """
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    out = {}
    for label, path in paths.items():
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(hadoop).exists(where):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha"))
        found = [(r["path"].rsplit("/", 1)[-1], r["sha"]) for r in files.orderBy("path").collect()]
        found = [(n, s) for n, s in found if not n.startswith(("_", "."))]
        out[label] = found[0][1] if len(found) == 1 else hashlib.sha256("".join(f"{n}:{s}\n" for n, s in sorted(found)).encode()).hexdigest()
    return out


def run_record(spark: SparkSession, command: str, arguments: dict, inputs: dict[str, str], outputs: dict[str, str], started: datetime) -> str:
    """A sidecar with SHA-256 of inputs and outputs, an id of its own, and the command line that would run it again."""
    line = " ".join([shlex.quote(command), *(f"--{k} {shlex.quote(str(v))}" for k, v in arguments.items() if v is not None)])
    own = arguments | {"_reinvoke": line, "_run_id": str(uuid.uuid4())}
    return sidecar(command, own, file_digests(spark, inputs), file_digests(spark, outputs), started.astimezone(UTC))
