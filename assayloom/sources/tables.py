"""Readers and writers of the canonical tab-separated tables, wide matrices, manifests and models.

Columns are found by name, in any order; unknown ones are ignored (or kept, where covariates may stand), missing
required ones are an error. Schemas are never inferred. Empty cells are null, and so are numbers that aren't finite.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite

#: Canonical columns and types; a star marks required ones (fixed by the format).
MEASUREMENTS = {
    "platform": "string", "sample_id": "string*", "assay_id": "string*", "gene_symbol": "string", "panel": "string", "npx_source_str": "string",
    "abundance": "double*", "abundance_raw": "double", "abundance_unit": "string", "qc_sample": "flag", "qc_assay": "flag", "detection_limit": "double",
    "below_lod": "boolean", "dropped_by_qc": "boolean", "plate_id": "string", "panel_lot": "string", "ingest_order": "long",
}
SAMPLES = {"sample_id": "string*", "subject_id": "string", "condition": "string", "is_control": "boolean", "sample_type": "string", "ingest_order": "long"}
PROTEINS = {"platform": "string", "assay_id": "string*", "uniprot": "string", "gene_symbol": "string", "panel": "string", "panel_lot": "string"}
PEPTIDES = {"peptide_id": "string*", "assay_id": "string*", "sequence": "string", "charge": "int", "modifications": "string", "missed_cleavages": "int"}
PEPTIDE_MEASUREMENTS = {"sample_id": "string*", "peptide_id": "string*", "abundance": "double*", "abundance_unit": "string"}


def read_text_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text, empty cells null; comma for .csv, tab otherwise; lines that begin with # are skipped."""
    sep = sep or ("," if path.endswith(".csv") else "\t")
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, comment="#", quote='"' if sep == "," else "")
    return df.select(*(F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) for c in df.columns))


def _typed(name: str, kind: str) -> Column:
    c = F.trim(F.col(f"`{name}`"))
    if kind == "double":
        return finite(c.cast("double"))
    if kind == "boolean":
        return F.coalesce(c.cast("int") != 0, F.lit(False))
    if kind == "flag":
        flag = F.upper(F.coalesce(c, F.lit("PASS")))
        return F.when(flag.isin("PASS", "WARN", "FAIL"), flag).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not PASS, WARN or FAIL: "), flag)).cast("string"))
    return c if kind == "string" else c.cast(kind)


def read_canonical(spark: SparkSession, path: str, columns: dict[str, str], extras: bool = False, keep: Column | None = None) -> DataFrame:
    """A canonical table by its column types; extras keeps further columns as text, keep one more expression of the text."""
    raw = read_text_table(spark, path)
    missing = [c for c, kind in columns.items() if kind.endswith("*") and c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    out = []
    for c, kind in columns.items():
        kind = kind.rstrip("*")
        if c in raw.columns:
            out.append(_typed(c, kind).alias(c))
        else:
            default = {"boolean": F.lit(False), "flag": F.lit("PASS")}.get(kind, F.lit(None).cast(kind if kind != "flag" else "string"))
            out.append(default.alias(c))
    return raw.select(*out, *([] if keep is None else [keep]), *(F.col(f"`{c}`") for c in raw.columns if extras and c not in columns))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurements; an empty abundance falls back on the raw one, and a cell without either must be a dropped one.

    NaN and infinities stand for missing values and are read as such; a cell that is empty though kept raises.
    """
    raw = read_text_table(spark, path)
    both = [F.trim(F.col(c)) for c in ("abundance", "abundance_raw") if c in raw.columns]
    empty = F.coalesce(*both).isNull() if both else F.lit(False)
    df = read_canonical(spark, path, MEASUREMENTS, keep=empty.alias("_empty")).withColumn("abundance", F.coalesce("abundance", "abundance_raw"))
    lost = F.col("_empty") & ~F.col("dropped_by_qc")
    checked = F.when(lost, F.raise_error(F.concat(F.lit("no abundance though not dropped: "), F.col("sample_id"), F.lit(", "), F.col("assay_id"))).cast("double")).otherwise(F.col("abundance"))
    return df.withColumns({"abundance": checked, "platform": platform("platform"), "abundance_unit": unit("abundance_unit")}).drop("_empty")


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    return read_canonical(spark, path, PEPTIDES)


def read_peptide_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Peptide abundances; those that are no finite number are null."""
    return read_canonical(spark, path, PEPTIDE_MEASUREMENTS)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A wide score table: sample_id, cohort, condition, is_control, and every further column as numbers (else null)."""
    raw = read_text_table(spark, path)
    missing = [c for c in ("sample_id", "cohort", "condition") if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    known = ["sample_id", "cohort", "condition", "is_control"]
    control = _typed("is_control", "boolean") if "is_control" in raw.columns else F.lit(False)
    return raw.select(*known[:3], control.alias("is_control"), *(finite(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in raw.columns if c not in known))


def require_columns(samples: DataFrame, columns: list[str], numeric: bool = False) -> DataFrame:
    """Samples with a value (numeric: a finite number) in every column; a column that isn't there is an error."""
    for c in columns:
        if c not in samples.columns:
            raise ValueError(f"the samples have no column {c}")
        text = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        samples = samples.where(finite(text.try_cast("double")).isNotNull() if numeric else text.isNotNull())
    return samples


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_canonical(spark, path, SAMPLES, extras=True)


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    return read_canonical(spark, path, PROTEINS).withColumn("uniprot", F.split("uniprot", r"[,;]\s*"))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path).select("set_name", "gene_symbol").dropna().distinct()


def read_effects(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Labelled effect tables with named feature, effect and q columns; features must be unique, effects finite."""
    parts = []
    for s in specs:
        t = read_text_table(spark, s["path"])
        q = _typed(s["q_col"], "double") if s.get("q_col") else F.lit(None).cast("double")
        parts.append(t.select(F.lit(s["label"]).alias("label"), F.col(s["feature_col"]).alias("feature"), _typed(s["effect_col"], "double").alias("effect"), q.alias("q_value")).where("effect IS NOT NULL"))
    both = reduce(DataFrame.unionByName, parts)
    repeated = both.groupBy("label", "feature").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"feature {repeated[0]['feature']} stands in {repeated[0]['label']} twice")
    return both


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """Covariates by sample: wide as they are, or the long form (sample_id, program, value) turned wide."""
    t = read_text_table(spark, path)
    if t.columns[1:2] == ["program"] and len(t.columns) == 3:
        names = [r[0] for r in t.select("program").distinct().orderBy("program").collect()]  # columns of the result
        return t.groupBy("sample_id").pivot("program", names).agg(F.first(F.col(t.columns[2]).cast("double")))
    return t.select("sample_id", *(F.col(f"`{c}`").cast("double").alias(c) for c in t.columns if c != "sample_id"))


def join_covariates(samples: DataFrame, covariates: DataFrame) -> DataFrame:
    """Samples with covariates; a sample that is no control and has none is an error."""
    without = samples.where(~F.coalesce("is_control", F.lit(False))).join(covariates.select("sample_id"), "sample_id", "left_anti").limit(1).collect()
    if without:
        raise ValueError(f"sample {without[0]['sample_id']} has no covariates")
    return samples.join(covariates, "sample_id")


def merge_covariates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two covariate tables as one; different values of one sample and column are an error."""
    shared = [c for c in a.columns if c in b.columns and c != "sample_id"]
    both = a.alias("a").join(b.alias("b"), "sample_id", "full_outer")
    clash = reduce(lambda x, y: x | y, ((F.col(f"a.{c}") != F.col(f"b.{c}")) for c in shared), F.lit(False))
    if both.where(F.coalesce(clash, F.lit(False))).limit(1).count():
        raise ValueError("two covariate tables disagree")
    rest = [F.col(f"a.{c}") for c in a.columns if c not in (*shared, "sample_id")] + [F.col(f"b.{c}") for c in b.columns if c not in (*shared, "sample_id")]
    return both.select("sample_id", *(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in shared), *rest)


def unit(c: str) -> Column:
    """Abundance units by their usual spellings; others are raw."""
    u = F.lower(F.trim(F.col(c)))
    return F.when(u.isin("log2npx", "log2_npx", "npx"), "log2_npx").when(u.isin("log2intensity", "log2_intensity", "log2"), "log2_intensity").when(u == "ibaq", "ibaq").otherwise("raw")


def platform(c: str) -> Column:
    """Platform names in lower case with underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s-]+", "_")


def numeric_columns(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which text columns hold numbers only (and one at least), in one pass."""
    row = df.agg(*(F.bool_and(F.expr(f"try_cast(`{c}` AS double)").isNotNull() | F.col(f"`{c}`").isNull()).alias(c) for c in columns), *(F.count(F.col(f"`{c}`")).alias(f"_{c}") for c in columns)).first()
    return {c: bool(row[c]) and row[f"_{c}"] > 0 for c in columns}


def escape(c: Column) -> Column:
    """Tabs and line ends as spaces."""
    return F.translate(c, "\t\n\r", "   ")


def write_table(df: DataFrame, path: str, six_decimals: bool = False) -> None:
    """A folder of tab-separated parts: flags as 0/1, arrays with commas, nulls empty, numbers in full or with six decimals."""
    out = []
    for c, t in df.dtypes:
        v = F.col(f"`{c}`")
        if t == "boolean":
            v = v.cast("int")
        elif t.startswith("array"):
            v = F.array_join(v, ",")
        elif t == "double" and six_decimals:
            v = F.format_string("%.6f", v)
        elif t == "string":
            v = escape(v)
        out.append(v.cast("string").alias(c))
    df.select(*out).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="", quote="")


def write_panels(wide: DataFrame, path: str, panel: str = "panel") -> None:
    """One folder per panel, named in lower case; names that aren't plain are refused."""
    bad = wide.where(~F.col(panel).rlike("^[A-Za-z0-9_. -]+$") | F.col(panel).contains("..")).limit(1).collect()
    if bad:
        raise ValueError(f"not a panel name for a folder: {bad[0][panel]!r}")
    wide.withColumn("_panel", F.lower(panel)).write.mode("overwrite").partitionBy("_panel").csv(path, header=True)


def trim_zeros(c: str) -> Column:
    """A decimal text without trailing zeros, one digit after the point at least."""
    return F.regexp_replace(F.col(c), r"(\.\d+?)0+$", "$1")


def numeric_stem(c: str) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(F.col(c), r"(\d+)", 1), F.lit(""))


def content_hash(df: DataFrame) -> str:
    """A hash of a table's columns and rows, whatever the rows' order, as 16 hex digits and a count.

    Rows' hashes are added up, not folded together, so that equal rows don't cancel each other.
    """
    names = int.from_bytes(hashlib.sha256(json.dumps(df.dtypes).encode()).digest()[:8])
    row = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("x"), F.count("*").alias("n")).first()
    return f"{(int(row['x'] or 0) + names) & 0xFFFFFFFFFFFFFFFF:016x}:{row['n']}"


def sidecar(command: str, arguments: dict, inputs: dict[str, str], outputs: dict[str, str], started: datetime) -> str:
    """What made a result, as JSON: command, arguments, hashes of inputs and outputs, times, and its own digest."""
    body = {
        "command": command, "arguments": arguments, "inputs": inputs, "outputs": outputs,
        "started": started.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "ended": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
    }
    body["digest"] = hashlib.sha256(json.dumps({k: body[k] for k in ("command", "arguments", "inputs", "outputs")}, sort_keys=True).encode()).hexdigest()
    return json.dumps(body, indent=1, sort_keys=True)


def read_annotations(spark: SparkSession, text: str, root: str = "result") -> DataFrame:
    """Enrichment answers of an annotation service, from its saved JSON."""
    rows = [(r.get("source"), r.get("native"), r.get("name"), float(r.get("p_value", 1))) for r in json.loads(text).get(root, [])]
    return spark.createDataFrame(rows, "source string, term_id string, name string, p_value double")


def read_model(text: str, required: tuple[str, ...] = ("method", "features", "direction", "fit_cohorts")) -> dict:
    """A harmonisation model; any missing field is refused, and so is one fitted on permuted labels."""
    model = json.loads(text)
    missing = [k for k in required if model.get(k) in (None, [], {})]
    if missing:
        raise ValueError(f"the model lacks {', '.join(missing)}")
    if model.get("permuted"):
        raise ValueError("the model was fitted on permuted labels")
    return model
