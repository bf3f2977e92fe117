"""The driver of differential abundance, its overrides, plexes, ensembles and shrinkage, against plain arithmetic."""

import itertools
import math
import random
import statistics
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.functions import dist
from assayloom.operators import differential as DA
from assayloom.operators import linear as L
from assayloom.operators import network, plex, resample

SAMPLES = "sample_id string, subject_id string, condition string, is_control boolean, batch string"
CELLS = "sample_id string, assay_id string, panel string, gene_symbol string, abundance double, dropped_by_qc boolean"


def tables(spark, n=8, seed=1):
    g = np.random.default_rng(seed)
    samples = [(f"s{i}{c}", f"p{i}", c, False, "x" if i % 2 else "y") for i in range(n) for c in "AB"]
    samples += [("c1", None, None, True, "x"), ("s99A", "p99", "A", False, ""), ("s98C", "p98", "C", False, "x")]
    cells = [(s[0], f"a{k}", "P", f"g{k}", float(g.normal(k + (s[2] == "A"), 1)), False) for s in samples for k in range(4)]
    cells += [("s1A", "a0", None, "g0", 99.0, False), ("s2A", "a5", "P", None, 99.0, False), ("s3A", "a6", "P", "g6", 99.0, True), ("nobody", "a0", "P", "g0", 99.0, False), ("s1A", "a7", "P", "g7", math.nan, False)]
    proteins = [("P", f"g{k}", f"a{k}", [f"U{k}", f"V{k}"]) for k in range(4)] + [("P", "g0", "a9", ["late"])]
    return (
        spark.createDataFrame(cells, CELLS), spark.createDataFrame(samples, SAMPLES),
        spark.createDataFrame(proteins, "panel string, gene_symbol string, assay_id string, uniprot array<string>"), cells, samples,
    )


def by_gene(df):
    return {r["gene_symbol"]: r for r in df.collect()}


def arms_of(cells, samples, gene):
    where = {s[0]: s for s in samples}
    out = {"A": {}, "B": {}, "C": {}}
    for c in cells:
        s = where.get(c[0])
        if s and not s[3] and c[3] == gene and c[2] and not c[5] and math.isfinite(c[4]):
            out[s[2]][s[1]] = c[4]
    return out


def test_paired(spark):
    m, s, p, cells, samples = tables(spark)
    got = by_gene(DA.differential(m, s, p, test="paired-t", groups="A-B"))
    assert set(got) == {"g0", "g1", "g2", "g3"} and list(got["g0"].asDict()) == list(DA.RESULTS)
    for gene, r in got.items():
        x = arms_of(cells, samples, gene)
        d = [x["A"][k] - x["B"][k] for k in x["A"] if k in x["B"]]
        t = statistics.mean(d) / (statistics.stdev(d) / math.sqrt(len(d)))
        half = float(dist.t_quantile(0.975, len(d) - 1)) * statistics.stdev(d) / math.sqrt(len(d))
        assert r["n_pairs"] == 8 and r["skip_reason"] == "" and r["effect_size_method"] == "cohen_dz" and r["uniprot"].startswith("U")
        assert (r["t"], r["p_value"], r["ci_low"], r["effect_size"]) == pytest.approx((t, float(dist.t_two_sided(t, 7)), statistics.mean(d) - half, statistics.mean(d) / statistics.stdev(d)))
    qs = sorted(r["bh_q"] for r in got.values())
    assert qs[-1] == pytest.approx(max(r["p_value"] for r in got.values()))
    few = by_gene(DA.differential(m, s, p, test="paired-t", groups="A-B", min_pairs=9))
    assert all(r["skip_reason"] == "insufficient_pairs" and r["t"] is None and r["effect_size"] is None for r in few.values())


def test_welch_and_covariates(spark):
    m, s, p, cells, samples = tables(spark)
    got = by_gene(DA.differential(m, s, p, test="welch-t", groups="A-B"))
    x = arms_of(cells, samples, "g1")
    a, b = list(x["A"].values()), list(x["B"].values())
    se = math.sqrt(statistics.variance(a) / len(a) + statistics.variance(b) / len(b))
    r = got["g1"]
    assert (r["n_a"], r["n_b"], r["n_pairs"], r["wilcoxon_method"]) == (9, 8, 17, "rank_sum")
    assert r["t"] == pytest.approx((statistics.mean(a) - statistics.mean(b)) / se) and r["median_diff"] == pytest.approx(statistics.median(a) - statistics.median(b))
    adjusted = by_gene(DA.differential(m, s.withColumn("age", F.crc32("subject_id").cast("double") % 50), p, test="welch-t", groups="A-B", numeric=["age"], factors={"batch": ["x", "y"]}))
    assert all(r["method"] == "ols" for r in adjusted.values()) and adjusted["g1"]["df"] == 17 - 4
    proxy = s.select("subject_id").distinct().withColumn("proxy", F.crc32("subject_id").cast("double") % 50)
    assert by_gene(DA.differential(m, s, p, test="paired-t", groups="A-B", proxy=proxy))["g1"]["method"] == "ols"
    with pytest.raises(ValueError, match="mixed"):
        DA.differential(m, s, p, test="mixed", groups="A-B", proxy=proxy)


def test_overrides(spark):
    m, s, p, _, _ = tables(spark)
    assert DA.parse_comparisons("A-B, C-D") == [("A", "B"), ("C", "D")]
    for bad in ("A-B-C", "A", "A-", "", "A-B,"):
        with pytest.raises(ValueError, match="comparison"):
            DA.parse_comparisons(bad)
    found = {r["sample_id"]: r["condition"] for r in DA.override_condition(s, "batch").collect()}
    assert found["s1A"] == "x" and found["s99A"] is None
    with pytest.raises(ValueError, match="no column"):
        DA.override_subject(s, "nothing")
    joined = {r["sample_id"]: r["condition"] for r in DA.collapse_others(s, [("A", "B")], "B").collect()}
    assert joined["s98C"] == "B" and joined["s1A"] == "A" and joined["c1"] is None
    with pytest.raises(ValueError, match="no side"):
        DA.collapse_others(s, [("A", "B")], "C")
    count = lambda scope: s.where(DA.in_scope(scope)).count()
    assert (count("all"), count("controls"), count("cases"), count("condition=A")) == (19, 1, 18, 9)
    with pytest.raises(ValueError, match="none of"):
        DA.in_scope("some")
    got = by_gene(DA.differential(m, s, p, test="welch-t", groups="x-y", condition_col="batch", subset="condition==A"))
    assert (got["g0"]["n_a"], got["g0"]["n_b"]) == (4, 4)
    last = DA.differential(m, s, p, test="paired-t", groups="A-B", paired_by="batch", min_pairs=2)
    assert by_gene(last)["g0"]["n_pairs"] == 2  # two batches, the last sample of each arm


def test_genes_of_several_assays(spark):
    rows = [("s1", "a2", "P", "g", 5.0, False), ("s1", "a1", "P", "g", 1.0, False), ("s2", "a2", "P", "g", 7.0, False)]
    s = spark.createDataFrame([("s1", "p1", "A", False, ""), ("s2", "p2", "A", False, "")], SAMPLES)
    m = spark.createDataFrame(rows, CELLS)
    told = lambda how: {r["sample_id"]: r["value"] for r in DA.gene_cells(m, s, how).collect()}
    assert told("none") == {"s1": 1.0} and told("max-observed") == {"s1": 5.0, "s2": 7.0} and told("mean") == {"s1": 3.0, "s2": 7.0}


def test_missing_share(spark):
    m, s, p, _, _ = tables(spark)
    thin = m.where("gene_symbol <> 'g2' OR sample_id IN ('s0A', 's1A', 's2A', 's0B', 's1B', 's2B')")
    assert "g2" in by_gene(DA.differential(thin, s, p, test="welch-t", groups="A-B"))
    assert "g2" not in by_gene(DA.differential(thin, s, p, test="welch-t", groups="A-B", max_missing=0.5))


def test_ensemble(spark):
    rows = [("c", "P", "a", "g", "u", "m1", 1.0, 0.01, 0.02), ("c", "P", "a", "g", "u", "m2", 2.0, 0.03, 0.04), ("c", "P", "b", "h", "u", "m1", 0.0, 0.2, 0.3), ("c", "P", "b", "h", "u", "m2", -1.0, 0.01, 0.04), ("c", "P", "z", "k", "u", "m1", None, None, None)]
    r = spark.createDataFrame(rows, "comparison string, panel string, assay_id string, gene_symbol string, uniprot string, method string, mean_diff double, p_value double, bh_q double")
    got = {x["assay_id"]: x for x in DA.ensemble(r).collect()}
    assert [got[k]["grade"] for k in "abz"] == ["VALIDATED", "PROVISIONAL", "INSUFFICIENT"]
    assert got["b"]["majority_sign"] == 1.0 and got["b"]["n_sign_consistent"] == 1 and got["z"]["n_applied"] == 0
    normal = statistics.NormalDist()
    z = sum(normal.inv_cdf(1 - p) for p in (0.01, 0.03)) / math.sqrt(2)
    assert got["a"]["ensemble_p"] == pytest.approx(1 - normal.cdf(z)) and got["a"]["methods_applied"] == "m1,m2"


def test_squeeze(spark):
    g = np.random.default_rng(3)
    fits = pd.DataFrame({"gene_symbol": [f"g{i}" for i in range(40)], "term": "b", "estimate": g.normal(size=40), "unscaled": 0.2, "s2": 0.5 * g.f(6, 9, size=40), "df": 6.0, "n_peptides": 3})
    got = L.squeeze(spark.createDataFrame(fits)).toPandas().set_index("feature")
    s0, d0 = L.prior(fits["s2"].to_numpy(), np.full(40, 6.0))
    assert math.isfinite(d0)
    for _, f in fits.iterrows():
        r = got.loc[f["gene_symbol"]]
        post = (6 * f["s2"] + d0 * s0) / (6 + d0)
        assert (r["s2_post"], r["df_total"], r["t"]) == pytest.approx((post, 6 + d0, f["estimate"] / math.sqrt(0.2 * post)))
    alone = L.squeeze(spark.createDataFrame(fits.head(1))).collect()[0]
    assert alone["s2_post"] == pytest.approx(fits["s2"][0]) and alone["df_prior"] is None


def test_plexes(spark):
    seen = {f"{i}_{c}": {f"f{k}" for k in range(12) if k % 3 != i % 3} for i in range(6) for c in "AB"} | {"9_A": set()}
    rows = [(s, f) for s, own in seen.items() for f in own]
    samples = spark.createDataFrame([(s, s[-1], "x") for s in seen], "sample_id string, condition string, plex string")
    d = plex.distances(spark.createDataFrame(rows, "sample_id string, assay_id string"), "sample_id", "assay_id", samples)
    every = set().union(*seen.values())
    got = {(r["a"], r["b"]): r["distance"] for r in d.collect()}
    assert len(got) == 13 * 12 // 2
    for (a, b), x in got.items():
        p, q = every - seen[a], every - seen[b]
        assert x == pytest.approx(1 - len(p & q) / len(p | q) if p | q else 0.0)
    found = {r["sample_id"]: r for r in plex.clusters(d, samples, 0.1).collect()}
    assert found["9_A"]["cluster_size"] == 1 and found["9_A"]["mean_within_distance"] is None
    assert {found[f"{i}_A"]["recovered_plex_id"] for i in (0, 3)} == {1} and found["1_B"]["cluster_size"] == 4
    q = plex.quality(d, plex.clusters(d, samples, 0.1), 0.1, 4).collect()[0]
    assert (q["n_clusters"], q["n_singletons"], q["diagnostic"]) == (4, 1, "plex_coherent")  # members lack the same: an infinite ratio


def absent_world(n: int, seed: int) -> tuple[dict, set]:
    r = random.Random(seed)
    seen = {f"s{i:02d}": {f"a{j:02d}" for j in range(30) if r.random() < 0.6} for i in range(n)}
    seen |= {f"c{i:02d}": set(seen[f"s{i % 4:02d}"]) for i in range(9)}  # copies
    return seen, set().union(*seen.values())


def far(a: set, b: set, every: set) -> float:
    p, q = every - a, every - b
    return 1 - len(p & q) / len(p | q) if p | q else 0.0


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_absence_pairs_over_any_limit(spark, monkeypatch, cells):
    """All pairs, though they are more than check_edges() allows, in tiles of some ids and slices of some cells."""
    monkeypatch.setattr(network.check_edges, "__defaults__", (1, 100))
    monkeypatch.setattr(network, "TILE", 8, raising=False)
    monkeypatch.setattr(network, "CELLS", cells, raising=False)
    seen, every = absent_world(40, 3)
    table = spark.createDataFrame([(s, a) for s, own in seen.items() for a in own], "sample_id string, assay_id string")
    got = {(r["a"], r["b"]): (r["both"], r["distance"]) for r in network.absence_pairs(table, "sample_id", "assay_id", 5, 0.7).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(seen), 2):
        p, q = every - seen[a], every - seen[b]
        if len(p) >= 5 and len(q) >= 5 and p & q and far(seen[a], seen[b], every) <= 0.7:
            want[a, b] = (len(p & q), pytest.approx(far(seen[a], seen[b], every)))
    assert got == want and len(got) > 200


@pytest.mark.parametrize("threshold", [0.3, 0.62, 1.0])
def test_plexes_over_any_limit(spark, monkeypatch, threshold):
    """Plexes and their mean distances in tiles of some classes; s99 has nothing, x00 no row among the samples."""
    monkeypatch.setattr(network.check_edges, "__defaults__", (1, 100))
    monkeypatch.setattr(network, "TILE", 8)
    seen, every = absent_world(36, 5)
    table = spark.createDataFrame([(s, a) for s, own in seen.items() for a in own] + [("x00", "a00")], "sample_id string, assay_id string")
    seen["s99"] = set()
    samples = spark.createDataFrame([(s,) for s in seen], "sample_id string")
    found, means = plex.recover(table, "sample_id", "assay_id", samples, threshold)
    root = {s: s for s in seen}
    pairs = {(a, b): far(seen[a], seen[b], every) for a, b in itertools.combinations(sorted(seen), 2)}
    for _ in seen:
        for (a, b), d in pairs.items():
            if d <= threshold:
                root[a] = root[b] = min(root[a], root[b])
    inside = {r: [d for (a, b), d in pairs.items() if root[a] == root[b] == r] for r in set(root.values())}
    number = {r: i + 1 for i, r in enumerate(sorted(inside))}
    want = {s: (number[r], list(root.values()).count(r), pytest.approx(np.mean(inside[r])) if inside[r] else None) for s, r in root.items()}
    assert {r["sample_id"]: tuple(r)[1:] for r in found.collect()} == want
    within, between = [d for v in inside.values() for d in v], [d for (a, b), d in pairs.items() if root[a] != root[b]]
    q = plex.diagnosed(found, means, 10).collect()[0]
    assert q["mean_within"] == pytest.approx(np.mean(within)) and (q["mean_between"] == pytest.approx(np.mean(between)) if between else q["mean_between"] is None)
    assert (q["n_samples"], q["n_clusters"]) == (len(seen), len(number))


def test_inferred_pairs(spark):
    rows = [("a10", "A", "x"), ("a12", "A", "x"), ("b11", "B", "x"), ("b13", "B", "x"), ("a1", "A", "y"), ("b2", "B", "y"), ("c5", "C", "y")]
    s = spark.createDataFrame(rows, "sample_id string, condition string, plex string")
    got = [(r["patient_id"], r["sample_a"], r["sample_b"], r["stem_diff"]) for r in plex.infer_pairs(s, "A-B", 5).orderBy("patient_id").collect()]
    assert got == [("pair_0001", "a10", "b11", 1), ("pair_0002", "a12", "b13", 1), ("pair_0003", "a1", "b2", 1)]
    with pytest.raises(Exception, match="no partner"):
        plex.infer_pairs(s.where("sample_id <> 'b13'"), "A-B", 5).collect()
    with pytest.raises(Exception, match="no number"):
        plex.infer_pairs(s.union(spark.createDataFrame([("none", "A", "x")], s.schema)), "A-B", 5).collect()
    more = plex.augmented(s, spark.createDataFrame([(r[0], 7) for r in rows], "sample_id string, recovered_plex_id bigint"), plex.infer_pairs(s, "A-B", 5))
    assert {(r["sample_id"], r["recovered_plex_id"], r["patient_id"]) for r in more.collect()} >= {("a10", "plex_0007", "pair_0001"), ("c5", "plex_0007", "")}


def test_edges_are_limited(spark, monkeypatch):
    rows = spark.createDataFrame([(f"f{i}", "s", 1.0) for i in range(30)], "f string, s string, v double")
    monkeypatch.setattr(network.check_edges, "__defaults__", (1, 100))
    with pytest.raises(ValueError, match="more than the limit"):
        network.pairwise(rows, "f", "s", "v", [])


def test_stratified_draws(spark):
    g = np.random.default_rng(2)
    x = resample.resample_within(g, [np.array([1.0, 2.0]), np.array([]), np.array([5.0] * 4)])
    assert [len(v) for v in x] == [2, 0, 4] and set(x[2]) == {5.0}
    lo, hi = resample.bca_interval(g.normal(3, 1, 60), np.mean, 400, 1, "k")
    assert lo < 3.3 and hi > 2.7 and hi - lo < 1
    rows = [(f"s{i}", "c", "a" if i % 2 else "b", float(i % 2) + i / 1000) for i in range(40)] + [("t", "alone", "a", 1.0)]
    got = resample.stratified_bootstrap(spark.createDataFrame(rows, "sample_id string, cohort string, arm string, v double"), ["cohort"], "arm", ("a", "b"), "v", 200, 5).collect()
    assert len(got) == 1 and got[0]["effect"] == pytest.approx(1.001) and got[0]["ci_low"] <= 1.001 <= got[0]["ci_high"]


def peak_of(run) -> tuple[float, object]:
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_draws_of_many_subjects(monkeypatch):
    """Draws in parts are those of one matrix, and take no more memory for more of them."""
    g, v, w = (lambda: np.random.default_rng(8)), np.random.default_rng(1).normal(size=301), np.random.default_rng(2).normal(size=150)
    whole = lambda: np.concatenate([v, w])[np.argsort(g().random((200, 451)), 1)]
    flips = g().choice([-1.0, 1.0], (200, 301)) * v
    want = [np.median(v[g().integers(0, 301, (200, 301))], 1), flips.mean(1) / (flips.std(1, ddof=1) / np.sqrt(301)), np.median(whole()[:, :301], 1) - np.median(whole()[:, 301:], 1)]
    monkeypatch.setattr(resample.draws_of, "__defaults__", (1000,))
    got = [resample.drawn(g(), v, 200, np.median), resample.flipped_t(g(), v, 200), resample.mixed_medians(g(), v, w, 200)]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    monkeypatch.undo()
    big = np.arange(100_000.0)
    for run in (lambda: resample.drawn(g(), big, 60, np.mean), lambda: resample.flipped_t(g(), big, 60), lambda: resample.mixed_medians(g(), big, big, 60)):
        assert peak_of(run)[0] < 60


def test_sign_tail_of_many_trials(spark):
    from assayloom.operators.combine import binomial_tail

    cases = [(2652, 5370), (2520, 5370), (0, 1200), (1200, 1200), (3, 4), (0, 0)]
    got = spark.createDataFrame(cases, "k int, n int").select(binomial_tail(F.col("k"), F.col("n")).alias("p")).collect()
    for (k, n), r in zip(cases, got, strict=True):
        assert r["p"] == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n, abs=1e-9)


def test_ratio_of_an_empty_side(spark):
    one = spark.createDataFrame([("A", "p1", 0.5), ("A", "p2", 0.7)], "condition string, subject_id string, log_ratio double")
    r = resample.ratio_test(one, "A", "B", 10, 1).collect()[0]
    assert (r["n_a"], r["n_b"], r["median_diff"]) == (2, 0, None)


def test_dunnett_of_uneven_groups():
    g = np.random.default_rng(6)
    n = np.array([4.0, 9.0, 30.0])
    share = n / (n + 12)
    z0 = g.standard_normal((400_000, 1))
    z = np.sqrt(1 - share) * g.standard_normal((400_000, 3)) + np.sqrt(share) * z0
    scale = np.sqrt(g.chisquare(20, 400_000) / 20)
    for q in (1.5, 2.3):
        assert dist.pdunnett(q, 3, 20, share) == pytest.approx((np.abs(z).max(1) / scale <= q).mean(), abs=3e-3)
    assert dist.pdunnett(2.0, 4, 15, np.full(4, 0.5)) == pytest.approx(dist.pdunnett(2.0, 4, 15), abs=1e-12)
    assert dist.pdunnett(2.0, 1, 15, np.array([0.3])) == pytest.approx(1 - float(dist.t_two_sided(2.0, 15)), abs=1e-6)


def test_moderated_f(spark):
    g = np.random.default_rng(7)
    rows = [(f"g{k}", c, float(g.normal(0, 1 + k % 3))) for k in range(30) for c in "abc" for _ in range(5)]
    fits = L.f_fits(spark.createDataFrame(rows, "feature string, c string, v double"), "feature", "v", [], {"c": ["a", "b", "c"]}, "c")
    plain = fits.toPandas().set_index("feature")
    got = L.moderate_f(fits).toPandas().set_index("feature")
    s0, d0 = L.prior(plain["s2"].to_numpy(), np.full(30, 12.0))
    assert math.isfinite(d0)
    for f, r in got.iterrows():
        post = (d0 * s0 + 12 * plain.loc[f, "s2"]) / (d0 + 12)
        want = plain.loc[f, "f"] * plain.loc[f, "s2"] / post
        assert (r["f"], r["s2_post"], r["p_value"]) == pytest.approx((want, post, float(dist.f_sf(want, 2, 12 + d0))))


def test_covariate_levels(spark):
    s = spark.createDataFrame([("1", "x", "u"), ("2.5", "y", "u"), (" ", None, "u")], "age string, site string, one string")
    assert L.covariate_levels(s, ["age", "site"]) == (["age"], {"site": ["x", "y"]})
    for bad, why in (("one", "1 levels"), ("gone", "no column")):
        with pytest.raises(ValueError, match=why):
            L.covariate_levels(s, [bad])


def test_leading_edge(spark):
    ranked = spark.createDataFrame([("c", f"g{i:02d}", float(10 - i)) for i in range(20)], "comparison string, gene_symbol string, stat double")
    sets = spark.createDataFrame([("top", f"g{i:02d}") for i in (0, 1, 3, 15)] + [("low", f"g{i:02d}") for i in (2, 17, 18, 19)] + [("all", f"g{i:02d}") for i in range(20)], "set_name string, gene_symbol string")
    got = {r["set_name"]: r for r in resample.gsea(ranked, sets, ["comparison"], 250, 1).collect()}
    assert set(got) == {"top", "low"} and got["top"]["leading_edge"] == "g00,g01,g03" and got["low"]["leading_edge"] == "g17,g18,g19"
    assert got["top"]["es"] > 0 > got["low"]["es"] and all(0 < r["p_value"] <= r["q_value"] <= 1 for r in got.values())
