"""Readers and writers of small inputs and results, manifests, hashes, plans and outside tools: round trips."""

import hashlib
import json
from datetime import UTC, datetime

import pytest

from assayloom.operators import differential as DA
from assayloom.plans import runner
from assayloom.sources import adapters, results, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_measurements_need_a_value(spark, tmp_path):
    head = "sample_id\tassay_id\tabundance\tabundance_raw\tdropped_by_qc\n"
    ok = write(tmp_path / "ok.tsv", head + "s\ta\t\t2.5\t0\ns\tb\t\t\t1\ns\tc\tNaN\t\t0\n")
    assert {r["assay_id"]: r["abundance"] for r in tables.read_measurements(spark, ok).collect()} == {"a": 2.5, "b": None, "c": None}
    with pytest.raises(Exception, match="no abundance"):
        tables.read_measurements(spark, write(tmp_path / "bad.tsv", head + "s\ta\t\t\t0\n")).collect()


def test_peptides_and_scores(spark, tmp_path):
    p = write(tmp_path / "p.tsv", "peptide_id\tassay_id\tcharge\tmore\nQ\ta\t2\tx\n")
    assert [(r["peptide_id"], r["charge"], r["sequence"]) for r in tables.read_peptides(spark, p).collect()] == [("Q", 2, None)]
    p = write(tmp_path / "m.tsv", "sample_id\tpeptide_id\tabundance\ns\tQ\tinf\ns\tR\t1.5\n")
    assert {r["peptide_id"]: r["abundance"] for r in tables.read_peptide_measurements(spark, p).collect()} == {"Q": None, "R": 1.5}
    p = write(tmp_path / "s.tsv", "sample_id\tcohort\tcondition\tis_control\tx\ty\ns\tc\tA\t1\t1.5\tword\n")
    r = tables.read_scores(spark, p).collect()[0]
    assert (r["is_control"], r["x"], r["y"]) == (True, 1.5, None)
    with pytest.raises(ValueError, match="lacks cohort"):
        tables.read_scores(spark, write(tmp_path / "t.tsv", "sample_id\tcondition\ns\tA\n"))


def test_required_columns(spark):
    s = spark.createDataFrame([("a", "1", "x"), ("b", " ", "y"), ("c", "old", None)], "sample_id string, age string, site string")
    ids = lambda df: {r["sample_id"] for r in df.collect()}
    assert ids(tables.require_columns(s, ["age"])) == {"a", "c"} and ids(tables.require_columns(s, ["age"], numeric=True)) == {"a"} and ids(tables.require_columns(s, ["age", "site"])) == {"a"}
    with pytest.raises(ValueError, match="no column"):
        tables.require_columns(s, ["sex"])


def test_small_inputs(spark, tmp_path):
    p = write(tmp_path / "mod.tsv", "module\tgene_symbol\nM\ta\nM\ta\nM\t\nN\tb\n")
    assert {tuple(r) for r in results.read_modules(spark, p).collect()} == {("M", "a"), ("N", "b")}
    p = write(tmp_path / "w.tsv", "protein\tcoef\na\t0.5\nb\t-1\n")
    assert {tuple(r) for r in results.read_weights(spark, p, "protein", "coef").collect()} == {("a", 0.5), ("b", -1.0)}
    for bad, why in (("a\tx\n", "no weight"), ("a\t1\na\t2\n", "twice")):
        with pytest.raises(ValueError, match=why):
            results.read_weights(spark, write(tmp_path / f"{why[:2]}.tsv", "feature\tweight\n" + bad))
    with pytest.raises(ValueError, match="lacks"):
        results.read_weights(spark, p)
    p = write(tmp_path / "q.tsv", "query\tgene_symbol\nup\ta\n\tb\n")
    assert {tuple(r) for r in results.read_queries(spark, p).collect()} == {("up", "a"), ("all", "b")}
    assert {tuple(r) for r in results.read_queries(spark, write(tmp_path / "q2.tsv", "gene_symbol\nc\n")).collect()} == {("all", "c")}
    for name, text in (("u.txt", "a\nb\n\nb\n"), ("u.tsv", "gene_symbol\tx\na\t1\nb\t2\n")):
        assert {r[0] for r in results.read_universe(spark, write(tmp_path / name, text)).collect()} == {"a", "b"}


def test_manifests(spark, tmp_path):
    head = "label\tcohort\tcase\tcontrol\tfamily\tcondition_col\tsubset\n"
    found = results.read_contrasts(spark, write(tmp_path / "c.tsv", head + "one\tC0\tL0\t*\tf\t\t\ntwo\t\tL0|L2\tL1\tf\tsite\ta==b\n\tx\ty\tz\tf\t\t\n"))
    assert [(c["label"], c["case"], c["control"], c["condition_col"], c["subset"]) for c in found] == [
        ("one", ["L0"], None, "condition", []), ("two", ["L0", "L2"], ["L1"], "site", [("a", "==", "b")]),
    ]
    for bad, why in (("x\t\tL0\t*\tf\t\t\nx\t\tL0\t*\tf\t\t\n", "twice"), ("x\t\t\t*\tf\t\t\n", "no case"), ("x\t\tL0\t\tf\t\t\n", "no control"), ("", "no contrasts")):
        with pytest.raises(ValueError, match=why):
            results.read_contrasts(spark, write(tmp_path / f"{why[-4:]}.tsv", head + bad))
    t = spark.createDataFrame([("s1", "C0", "L0", "S"), ("s2", "C0", "L1", "S"), ("s3", "C1", "L0", "S"), ("s4", "C0", None, "S")], "sample_id string, cohort string, condition string, site string")
    assert {(r["sample_id"], r["arm"]) for r in results.select_contrast(t, found[0]).collect()} == {("s1", "a"), ("s2", "b")}
    p = write(tmp_path / "t.tsv", "label\tpath\teffect_col\tstage\na\tx.tsv\tlfc\t1\na\ty.tsv\tlfc\t2\n")
    assert [(s["path"], s["feature_col"], s["q_col"], s["stage"]) for s in results.read_effect_specs(spark, p)] == [("x.tsv", "gene_symbol", None, "1"), ("y.tsv", "gene_symbol", None, "2")]
    with pytest.raises(ValueError, match="twice"):
        results.read_effect_specs(spark, write(tmp_path / "t2.tsv", "label\tpath\teffect_col\na\tx\te\na\ty\te\n"))


def test_results_round_trip(spark, tmp_path):
    row = {c: None for c in DA.RESULTS} | {"panel": "P", "gene_symbol": "g", "comparison": "A-B", "n_pairs": 3, "t": -1.25, "p_value": 1e-12, "method": "welch-t", "n_a": 4}
    schema = ", ".join(f"{c} {k}" for c, k in DA.RESULTS.items())
    df = spark.createDataFrame([tuple(row[c] for c in DA.RESULTS)], schema)
    results.write_results(df, str(tmp_path / "out"))
    assert results.read_results(spark, str(tmp_path / "out")).collect() == df.collect()
    old = results.read_results(spark, write(tmp_path / "old.tsv", "gene_symbol\tt\tbeyond\ng\t2\tx\n")).collect()[0]
    assert (old["gene_symbol"], old["t"], old["n_a"], len(old)) == ("g", 2.0, None, 40)


def test_fold_changes_and_scores(spark, tmp_path):
    folds = spark.createDataFrame([("Onc", "g1", "A-B", 0.5), ("Onc", "g1", "A-C", None), ("Onc", "g0", "A-B", 1.0)], "panel string, gene_symbol string, comparison string, log2_fc double")
    results.write_fold_changes(folds, ["A-B", "A-C"], str(tmp_path / "fc"))
    (folder,) = (tmp_path / "fc").glob("panel=*")
    text = "".join(f.read_text() for f in folder.glob("*.csv"))
    assert folder.name == "panel=onc_log2_fc" and text.splitlines()[:3] == ["Assay,A-B,A-C", "g0,1.0,", "g1,0.5,"]
    with pytest.raises(ValueError, match="panel name"):
        results.write_fold_changes(spark.createDataFrame([("../x", "g", "A-B", 1.0)], folds.schema), ["A-B"], str(tmp_path / "no"))
    scores = spark.createDataFrame([("M", "s1", 0.25), ("M", "s2", None)], "module string, sample_id string, score double")
    samples = spark.createDataFrame([("s1", "p1", "A"), ("s2", "p2", "B")], "sample_id string, subject_id string, condition string")
    results.write_scores(scores, samples, str(tmp_path / "canon"))
    m = tables.read_measurements(spark, str(tmp_path / "canon/measurements")).collect()
    assert [(r["sample_id"], r["assay_id"], r["panel"], r["abundance"], r["dropped_by_qc"]) for r in m] == [("s1", "M", "module_score", 0.25, False)]
    assert tables.read_samples(spark, str(tmp_path / "canon/samples")).count() == 2 and tables.read_proteins(spark, str(tmp_path / "canon/proteins")).count() == 1
    results.write_side_tables(str(tmp_path / "side"), covariates=samples, omnibus=scores)
    assert {x.name for x in (tmp_path / "side").iterdir()} == {"de_covariates", "de_omnibus"}


def test_hashes(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    h = tables.content_hash
    assert h(rows("a", "a", "b")) != h(rows("c", "c", "b")) and h(rows("a", "b")) == h(rows("b", "a")) and h(rows("a")) != h(rows("a", "a"))
    assert h(rows("a")) != h(rows("a").withColumnRenamed("v", "w")) and h(rows("a").limit(0)).endswith(":0")
    p = write(tmp_path / "x.tsv", "a\tb\n1\t2\n")
    found = results.file_digests(spark, {"x": p, "gone": str(tmp_path / "gone.tsv")})
    assert found == {"x": hashlib.sha256(b"a\tb\n1\t2\n").hexdigest()}
    record = json.loads(results.run_record(spark, "de", {"groups": "A-B", "input-dir": "my data", "none": None}, {"x": p}, {}, datetime(2020, 1, 1, tzinfo=UTC)))
    assert record["arguments"]["_reinvoke"] == "de --groups A-B --input-dir 'my data'" and record["inputs"] == found and len(record["arguments"]["_run_id"]) == 36


def test_columns_without_samples(spark):
    names = ["T1", "TumorOnlyIR", "NormalOnlyIR", "QC", "QC7", "Pool", "Pool12", "Reference", "RefMix", "RefMix3", "Whirlpool", "QCfree", "Reference2"]
    raw = spark.createDataFrame([("g", *["1.0"] * len(names), "9")], ", ".join(["Gene string", *(f"`{n} Log Ratio` string" for n in names), "`T1 Unshared Log Ratio` string"]))
    assert {r["sample_id"] for r in adapters.log_ratio_matrix(raw).collect()} == {"T1", "Whirlpool", "QCfree", "Reference2"}
    assert "T1" not in {r["sample_id"] for r in adapters.log_ratio_matrix(raw, no_sample="^T").collect()}


def test_plans_and_tools(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    told = {"name": "n", "plan_commit": "c", "vars": {"x": "1"}, "stages": [{"id": "a", "command": "k", "outputs": ["o${x}"]}]}
    assert runner.parse(yaml.safe_dump(told)).digest() == runner.parse(json.dumps(told)).digest()
    with pytest.raises(ValueError, match="lacks plan_commit"):
        runner.parse("name: n\nstages: [1]\n")
    script = tmp_path / "tool.sh"
    script.write_text('#!/bin/sh\nmkdir -p "$2"\n[ -e "$1/t" ] || exit 3\nprintf "k\\tv\\na\\t1\\n" > "$2/made"\n')
    script.chmod(0o755)
    t = spark.createDataFrame([("a",)], "k string")
    assert [tuple(r) for r in runner.external(str(script), spark, {"t": t}, ["made"], str(tmp_path / "w"))["made"].collect()] == [("a", "1")]
    with pytest.raises(RuntimeError, match="made no other"):
        runner.external(str(script), spark, {"t": t}, ["other"], str(tmp_path / "w"))
    with pytest.raises(RuntimeError, match="ended with 3"):
        runner.external(str(script), spark, {"u": t}, ["made"], str(tmp_path / "w2"))


def test_annotations_are_kept(spark, tmp_path):
    from assayloom.sources import annotations

    sent = []

    def post(endpoint, body):
        sent.append(json.loads(body))
        return json.dumps({"result": [{"source": "GO", "native": "T1", "name": "term", "p_value": 0.01}]})

    told = {"background": ["a", "b", "c"], "endpoint": "http://nowhere", "cache": str(tmp_path / "kept"), "sources": ("GO",)}
    found, digests = annotations.annotate(spark, {"up": ["b", "a"]}, post=post, **told)
    assert [tuple(r) for r in found.collect()] == [("up", "GO", "T1", "term", 0.01)] and sent[0]["query"] == ["a", "b"]
    again, same = annotations.annotate(spark, {"up": ["a", "b", "a"]}, post=post, offline=True, **told)
    assert again.count() == 1 and same == digests and len(sent) == 1
    with pytest.raises(FileNotFoundError, match="no answer"):
        annotations.annotate(spark, {"up": ["c"]}, post=post, offline=True, **told)
    with pytest.raises(ValueError, match="background"):
        annotations.annotate(spark, {"up": ["c"]}, post=post, **(told | {"background": []}))
