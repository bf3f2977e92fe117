"""Distributions, kernels, formulas and readers against known values and identities."""

import json
import math
import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions import columns, dist
from assayloom.functions.expressions import column, design_terms
from assayloom.functions.rng import splitmix, stream, sub_seed
from assayloom.operators import checks, decompose, linear, network, normalise
from assayloom.plans import runner
from assayloom.sources import tables
from assayloom.streaming import ingest


def test_tails():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803477, abs=1e-10)
    assert dist.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert dist.t_two_sided(1.96, math.inf) == pytest.approx(0.0499957902, abs=1e-9)
    assert dist.f_sf(4.0, 1, 10) == pytest.approx(float(dist.t_two_sided(2.0, 10)), abs=1e-12)
    assert dist.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), abs=1e-12)
    assert dist.chi2_sf(100.0, 2) == pytest.approx(math.exp(-50), rel=1e-9)
    assert dist.f_sf(2.0, 3, math.inf) == pytest.approx(float(dist.chi2_sf(6.0, 3)), abs=1e-12)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert np.isnan(dist.t_two_sided(1.0, 0))


def test_special():
    assert dist.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert dist.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert dist.trigamma_inverse(dist.trigamma(3.7)) == pytest.approx(3.7, rel=1e-9)
    assert dist.hypergeom_sf(0, 5, 5, 20) == pytest.approx(1.0)
    assert dist.hypergeom_sf(5, 5, 5, 20) == pytest.approx(1 / math.comb(20, 5), rel=1e-9)


def test_ranges():
    # two groups: the range is sqrt(2) |t|
    assert dist.ptukey(2.0 * math.sqrt(2), 2, 10) == pytest.approx(1 - float(dist.t_two_sided(2.0, 10)), abs=1e-5)
    assert dist.quantile_of(lambda q: dist.ptukey(q, 3, 20), 0.95) == pytest.approx(3.578, abs=2e-3)
    assert dist.pdunnett(2.228, 1, 10) == pytest.approx(0.95, abs=1e-3)
    assert dist.quantile_of(lambda q: dist.pdunnett(q, 3, 20), 0.95) == pytest.approx(2.54, abs=5e-3)


def test_random_streams():
    assert int(splitmix(np.uint64(0))) == 0
    assert sub_seed(1, 0) != sub_seed(1, 1) and sub_seed(0, 0) == sub_seed(0x9E3779B97F4A7C15, 0)
    assert stream(1, "a", 2).random() == stream(1, "a", 2).random() != stream(1, "a", 3).random()


def test_least_squares():
    g = np.random.default_rng(0)
    x = np.column_stack([np.ones(40), g.normal(size=(40, 2))])
    y = x @ [1, 2, 0] + g.normal(size=40)
    fit = linear.Fit(x, y)
    assert fit.beta == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    _, _, t, p = fit.contrast(np.array([0, 1.0, 0]))
    assert fit.omnibus([1])[0] == pytest.approx(t * t) and fit.omnibus([1])[1] == pytest.approx(p)
    assert linear.Fit(np.ones((3, 3)), np.ones(3)).reason == "too_few"
    assert linear.Fit(np.ones((5, 2)), np.arange(5.0)).reason == "zero_variance"


def test_mixed_model():
    g = np.random.default_rng(1)
    groups = np.repeat(np.arange(40), 5)
    y = 3 + np.repeat(g.normal(0, 2, 40), 5) + g.normal(0, 1, 200)
    fit = linear.mixed_fit(np.ones((200, 1)), y, groups)
    # balanced one-way design: REML is the analysis of variance
    means = y.reshape(40, 5).mean(1)
    within = ((y.reshape(40, 5) - means[:, None]) ** 2).sum() / 160
    between = (means.var(ddof=1) * 5 - within) / 5
    assert fit["s2"] == pytest.approx(within, rel=1e-4) and fit["group_variance"] == pytest.approx(between, rel=1e-4)


def test_variance_prior():
    g = np.random.default_rng(2)
    s2 = 0.5 * 8 / g.chisquare(8, 4000) * g.chisquare(10, 4000) / 10
    s0, d0 = linear.prior(s2, np.full(4000, 10.0))
    assert s0 == pytest.approx(0.5, rel=0.1) and d0 == pytest.approx(8, rel=0.25)
    assert math.isinf(linear.prior(np.ones(10), np.full(10, 5.0))[1])


def test_kernels():
    g = np.random.default_rng(3)
    s, a = g.laplace(size=(300, 3)), g.normal(size=(50, 3))
    found = decompose.fast_ica((s @ a.T).T, 3, 0)["loadings"]
    cos = np.abs(found.T @ s) / np.outer(np.linalg.norm(found, axis=0), np.linalg.norm(s, axis=0))
    assert cos.max(1).min() > 0.9
    w, h = g.random((30, 3)), g.random((3, 40))
    assert decompose.nmf(w @ h, 3, 0, 3000, 1e-9)["error"] < 0.05 * np.linalg.norm(w @ h)
    with pytest.raises(ValueError):
        decompose.nmf(np.array([[-1.0]]), 1, 0)
    e = np.eye(3) * 2
    mix = g.dirichlet(np.ones(3), 20)
    x = np.vstack([e, mix @ e])
    assert sorted(decompose.spa(x, 3)) == [0, 1, 2]
    assert decompose.fcls(e, mix @ e, 5000, 1e-12) == pytest.approx(mix, abs=1e-6)


def test_tree():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    merges = decompose.upgma(d)
    assert merges == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 4.5, 4)]
    assert decompose.cut(merges, 4, 2.0) == [0, 0, 1, 1]
    assert decompose.newick(merges, list("abcd")) == "((a:1,b:1):3.5,(c:2,d:2):2.5);"


def test_more_kernels():
    g = np.random.default_rng(4)
    e = np.eye(3) + 0.1
    x = np.vstack([e, g.dirichlet(np.ones(3) * 2, 40) @ e])
    for pick in (decompose.vca(x, 3, 0), decompose.n_findr(x, 3, 0)):
        assert sorted(pick) == [0, 1, 2]
    assert decompose.ucls(e, x) @ e == pytest.approx(x, abs=1e-6)
    merges = decompose.upgma(np.array([[0, 1, 4], [1, 0, 4], [4, 4, 0]], float))
    other = decompose.upgma(np.array([[0, 4, 1], [4, 0, 4], [1, 4, 0]], float))
    assert decompose.clade_support(merges, [merges, other], 3) == [0.5, 1.0]
    assert decompose.nearest_pairs([("a", 10), ("b", 12)], [("x", 12), ("y", 11)], 3) == [("a", "y"), ("b", "x")]
    with pytest.raises(ValueError):
        decompose.nearest_pairs([("a", 10)], [("x", 20)], 3)
    same = np.array([[0, 0, 1, 1], [1, 1, 0, 0]])
    assert decompose.cophenetic(same) == pytest.approx(1.0)
    z = g.normal(size=(30, 1)) @ np.ones((1, 4)) + 0.01 * g.normal(size=(30, 4))
    assert abs(np.corrcoef(decompose.first_component(z), z.mean(1))[0, 1]) > 0.999


def plain_cophenetic(assignments):
    d = 1 - np.mean([a[:, None] == a[None, :] for a in assignments], 0)
    n = len(d)
    members, joined = [[i] for i in range(n)], np.zeros((n, n))
    for a, b, h, _ in decompose.upgma(d):
        joined[np.ix_(members[a], members[b])] = joined[np.ix_(members[b], members[a])] = h
        members.append(members[a] + members[b])
    upper = np.triu_indices(n, 1)
    x, y = (np.unique(m[upper].round(12), return_inverse=True) for m in (d, joined))
    ranks = [(np.cumsum(c := np.bincount(w)) - (c - 1) / 2)[w] for _, w in (x, y)]
    return float(np.corrcoef(*ranks)[0, 1])


def test_cophenetic_of_weighted_rows():
    g = np.random.default_rng(8)
    truth = g.integers(0, 3, 90)
    runs = np.array([np.where(g.random(90) < 0.1, g.integers(0, 3, 90), truth) for _ in range(5)])
    # rounding may settle ties between equally near rows otherwise; the query gives four digits
    assert decompose.cophenetic(runs) == pytest.approx(plain_cophenetic(runs), abs=5e-5)
    assert decompose.cophenetic(np.zeros((5, 7), int)) == 1.0
    assert decompose.cophenetic(np.zeros((5, 1), int)) == 1.0


def test_adapters(spark, tmp_path):
    from assayloom.sources import adapters

    p = tmp_path / "long.csv"
    p.write_text(";".join(adapters.LONG_EXPORT) + "\nP1_pre;1;OID1;Q1;GENE;0;Onc;L1;PL1;PASS;1.0;0.50;Plate control;PASS\nCONTROL_1;2;OID1;Q1;GENE;0;Onc;L1;PL1;WARN;1.0;NaN;Plate control;PASS\n")
    m, s = adapters.long_export(spark, str(p))
    rows = {r["sample_id"]: r for r in m.collect()}
    assert rows["P1_pre"]["below_lod"] and rows["P1_pre"]["abundance"] == 0.5 and rows["CONTROL_1"]["dropped_by_qc"]
    assert {tuple(r) for r in s.collect()} == {("P1_pre", "P1", "pre", False), ("CONTROL_1", None, None, True)}
    p.write_text(p.read_text().replace("Plate control", "Intensity", 1))
    with pytest.raises(ValueError):
        adapters.long_export(spark, str(p))
    raw = spark.createDataFrame([("Mean", "1", "1", "1", "1"), ("G1", "0.5", "9", "NA", "3")], ["Gene", "S1 Log Ratio", "S1 Unshared Log Ratio", "S2 Log Ratio", "Pool Log Ratio"])
    got = {(r["sample_id"], r["abundance"], r["dropped_by_qc"]) for r in adapters.log_ratio_matrix(raw).collect()}
    assert got == {("S1", 0.5, False), ("S2", None, True)}


def test_centralities():
    path = np.zeros((4, 4))
    for i in range(3):
        path[i, i + 1] = path[i + 1, i] = 1
    assert decompose.betweenness_centrality(path) == pytest.approx([0, 2, 2, 0])
    v = decompose.eigenvector_centrality(path)
    assert path @ v == pytest.approx(np.linalg.eigvalsh(path).max() * v, abs=1e-6)


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(column("(a + 1) * 2 - a / b")).collect()]
    assert got[0] == pytest.approx(3.5) and got[1] is None and got[2] is None
    assert [r[0] for r in df.select(column("log2(b)")).collect()] == [1.0, None, 0.0]
    assert [r[0] for r in df.select(column("z(b)")).collect()] == pytest.approx([1, -1, 0])
    for bad in ("a +", "z(a) + z(", "log2(z(a))", "a b"):
        with pytest.raises(ValueError):
            column(bad)
    assert design_terms("~ a + z(b)") == [("a", False), ("b", True)]
    for bad in ("~ a + a", "~ 0 + a", "~ a*b"):
        with pytest.raises(ValueError):
            design_terms(bad)


def test_predicates():
    assert checks.parse_predicates("a!=x; b==y;c=z") == [("a", "!=", "x"), ("b", "==", "y"), ("c", "==", "z")]
    with pytest.raises(ValueError):
        checks.parse_predicates("a")


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), *((f"n{i:03}", f"n{i + 1:03}") for i in range(60))], "a string, b string")
    got = {r["node"]: r["root"] for r in network.components(edges).collect()}
    assert got["c"] == "a" and got["y"] == "x" and {got[f"n{i:03}"] for i in range(61)} == {"n000"}
    with pytest.raises(ValueError):
        network.check_edges(100_000)


def test_tables(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("extra\tassay_id\tsample_id\tabundance\tabundance_raw\tqc_sample\tdropped_by_qc\nx\tA\tS\t1.5\t\tPASS\t0\nx\tB\tS\t\t2.5\t\t1\nx\tC\tS\tNaN\t\tWARN\t1\n")
    rows = {r["assay_id"]: r for r in tables.read_measurements(spark, str(p)).collect()}
    assert rows["A"]["abundance"] == 1.5 and rows["B"]["abundance"] == 2.5 and rows["C"]["abundance"] is None
    assert rows["B"]["qc_sample"] == "PASS" and rows["B"]["dropped_by_qc"] and not rows["A"]["below_lod"]
    with pytest.raises(ValueError):
        tables.read_canonical(spark, str(p), tables.SAMPLES | {"nowhere": "string*"})
    out = str(tmp_path / "out")
    tables.write_table(tables.read_measurements(spark, str(p)), out)
    assert tables.content_hash(tables.read_measurements(spark, out)) == tables.content_hash(tables.read_measurements(spark, str(p)))
    df = spark.createDataFrame([("1.500", "ab12c3")], "a string, b string")
    assert df.select(tables.trim_zeros("a"), tables.numeric_stem("b")).first() == ("1.5", "12")
    assert tables.numeric_columns(spark.createDataFrame([("1", "x"), (None, "2")], "n string, t string"), ["n", "t"]) == {"n": True, "t": False}
    assert json.loads(tables.sidecar("de", {"a": 1}, {}, {}, datetime.now(UTC)))["digest"]
    with pytest.raises(ValueError):
        tables.read_model("{}")


def test_covariates(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("# note\nsample_id\tprogram\tvalue\nS1\tp1\t1.0\nS1\tp2\t2.0\nS2\tp1\t3.0\n")
    wide = tables.read_covariates(spark, str(p))
    assert {r["sample_id"]: (r["p1"], r["p2"]) for r in wide.collect()} == {"S1": (1.0, 2.0), "S2": (3.0, None)}
    samples = spark.createDataFrame([("S1", False), ("S3", True)], "sample_id string, is_control boolean")
    assert tables.join_covariates(samples, wide).count() == 1
    with pytest.raises(ValueError):
        tables.join_covariates(samples.withColumn("is_control", F.lit(False)), wide)
    with pytest.raises(ValueError):
        tables.merge_covariates(wide, wide.withColumn("p1", F.col("p1") + 1))


def test_plan(spark):
    text = json.dumps({"name": "x", "plan_commit": "1", "vars": {"k": "2"}, "stages": [{"id": "a", "command": "twice", "inputs": ["in"], "outputs": ["out"], "arguments": {"by": "${k}"}}]})
    plan = runner.parse(text)
    commands = {"twice": lambda s, t, by: {"out": t["in"].select((F.col("id") * int(by)).alias("id"))}}
    held, record = runner.run(spark, plan, commands, {"in": spark.range(3)})
    assert [r[0] for r in held["out"].orderBy("id").collect()] == [0, 2, 4]
    assert runner.dry_run(plan, set()) == ["a: in is missing"]
    changed = runner.parse(text.replace('"k": "2"', '"k": "3"'))
    with pytest.raises(ValueError):
        runner.run(spark, changed, commands, {"in": spark.range(3)}, record)


def test_stream(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "e.parquet")
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    q = ingest.write_batches(ingest.stream_files(spark, str(tmp_path / "in"), schema).where("value > 0"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "in")).where("value > 0").count()


def test_ranks_by_buckets(spark, monkeypatch):
    """Ranks by buckets are those of one window, and no window has a whole group."""
    monkeypatch.setattr(normalise, "BUCKET", 5)
    r = random.Random(4)
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, 1e308, -1e308]
    rows = [(i, k, v) for k in ("a", "b", None) for i, v in enumerate([r.gauss(0, 1) for _ in range(40)] + [r.choice([0.25, 0.5, 2.0]) for _ in range(30)])]
    rows += [(i, "odd", v) for i, v in enumerate(odd * 3)] + [(i, "same", 3.0) for i in range(12)] + [(0, "one", 1.0)]
    x = spark.createDataFrame(rows, "i int, k string, v double")
    want = x.withColumn("r", columns.average_rank("v", "k"))
    found = normalise.average_ranks(x, ["k"], "v", "r")
    key = lambda row: (row["i"], str(row["k"]))
    assert [(key(a), a["r"]) for a in sorted(found.collect(), key=key)] == [(key(a), a["r"]) for a in sorted(want.collect(), key=key)]
    assert "_bucket" in found._jdf.queryExecution().optimizedPlan().toString().split("rank(", 1)[1].split("\n")[0]
