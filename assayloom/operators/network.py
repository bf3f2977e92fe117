"""Similarity networks, topology of absence, alignment of programs, axes and harmonisation."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import average_rank, pearson_agg, top_abs, zscore
from ..functions.dist import normal_pvalue

MAX_EDGES = 100_000_000


def check_edges(n_features: int, n_groups: int = 1, limit: int = MAX_EDGES) -> int:
    """The number of feature pairs in n_groups groups; refuses what would be more than limit."""
    n = n_features * (n_features - 1) // 2 * n_groups
    if n > limit:
        raise ValueError(f"{n} feature pairs are more than the limit of {limit}; filter features or ask for the top edges")
    return n


def pairwise(df: DataFrame, feature: str, sample: str, value: str, by: list[str], metric: str = "pearson") -> DataFrame:
    """f1 < f2, r, n over the samples both have; an undefined r counts as 0 and is told by `undefined`.

    More feature pairs than check_edges() allows are refused; so features are counted first.
    """
    x = df.where(F.col(value).isNotNull()).select(*by, F.col(feature).alias("_f"), F.col(sample).alias("_s"), F.col(value).cast("double").alias("_v"))
    sizes = x.groupBy(*by).agg(F.count_distinct("_f").alias("n")).agg(F.max("n"), F.count("*")).first()
    check_edges(int(sizes[0] or 0), int(sizes[1] or 0))
    a, b = x.withColumnsRenamed({"_f": "f1", "_v": "_a"}), x.withColumnsRenamed({"_f": "f2", "_v": "_b"})
    both = a.join(b, [*by, "_s"]).where("f1 < f2")
    if metric == "spearman":
        both = both.withColumn("_ra", average_rank("_a", *by, "f1", "f2")).withColumn("_rb", average_rank("_b", *by, "f1", "f2"))
        r = pearson_agg("_ra", "_rb")
    elif metric == "cosine":
        r = F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b"))))
    else:
        r = pearson_agg("_a", "_b")
    g = both.groupBy(*by, "f1", "f2").agg(r.alias("r"), F.count("*").alias("n"))
    return g.withColumn("undefined", F.col("r").isNull()).withColumn("r", F.coalesce("r", F.lit(0.0)))


def adjacency(edges: DataFrame, policy: str, parameter: float) -> DataFrame:
    """Weights: "hard" keeps |r| at or over the threshold, "soft" raises |r| to a power."""
    w = F.abs("r")
    return edges.withColumn("weight", F.when(w >= parameter, w).otherwise(0.0) if policy == "hard" else F.pow(w, F.lit(parameter)))


def topological_overlap(edges: DataFrame) -> DataFrame:
    """(sum of shared neighbours + a_ij) / (min(k_i, k_j) + 1 - a_ij) for every pair, from weights of f1 < f2."""
    both = edges.select("f1", "f2", "weight").union(edges.select(F.col("f2"), F.col("f1"), "weight"))
    k = both.groupBy("f1").agg(F.sum("weight").alias("k"))
    via = both.select(F.col("f1").alias("i"), F.col("f2").alias("u"), F.col("weight").alias("w1")).join(both.select(F.col("f1").alias("u"), F.col("f2").alias("j"), F.col("weight").alias("w2")), "u")
    shared = via.where("i < j").groupBy("i", "j").agg(F.sum(F.col("w1") * F.col("w2")).alias("shared"))
    e = edges.select(F.col("f1").alias("i"), F.col("f2").alias("j"), "weight").join(shared, ["i", "j"], "left")
    e = e.join(k.select(F.col("f1").alias("i"), F.col("k").alias("ki")), "i").join(k.select(F.col("f1").alias("j"), F.col("k").alias("kj")), "j")
    tom = (F.coalesce("shared", F.lit(0.0)) + F.col("weight")) / (F.least("ki", "kj") + 1 - F.col("weight"))
    return e.select(F.col("i").alias("f1"), F.col("j").alias("f2"), tom.alias("tom"))


def edge_differences(edges: DataFrame, cohort: str, top_k: int | None = None) -> DataFrame:
    """Fisher-z differences of an edge between two cohorts, with p; top_k by size, ties by name."""
    e = edges.where("n >= 4").select(cohort, "f1", "f2", F.atanh(F.greatest(F.lit(-1 + 1e-9), F.least(F.lit(1 - 1e-9), F.col("r")))).alias("z"), (1 / (F.col("n") - 3)).alias("v"), "r")
    side = lambda s: e.select("f1", "f2", *(F.col(c).alias(f"{c}_{s}") for c in (cohort, "z", "v", "r")))
    out = side("a").join(side("b"), ["f1", "f2"]).where(F.col(f"{cohort}_a") < F.col(f"{cohort}_b"))
    out = out.withColumn("z", (F.col("z_a") - F.col("z_b")) / F.sqrt(F.col("v_a") + F.col("v_b"))).withColumn("p_value", normal_pvalue("z"))
    out = out.select(f"{cohort}_a", f"{cohort}_b", "f1", "f2", "r_a", "r_b", "z", "p_value")
    if top_k is None:
        return out
    return out.orderBy(F.round(F.abs("z"), 9).desc(), "f1", "f2", f"{cohort}_a", f"{cohort}_b").limit(top_k)


def edge_summary(edges: DataFrame) -> DataFrame:
    """Over cohorts: mean, sd, least and largest |r|, sign flips, conservation and divergence of each edge."""
    g = edges.groupBy("f1", "f2").agg(
        F.count("*").alias("n_cohorts"), F.avg("r").alias("mean_r"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd_r"), F.min(F.abs("r")).alias("min_abs"), F.max(F.abs("r")).alias("max_abs"),
        F.count_if(F.col("r") > 0).alias("_up"), F.count_if(F.col("r") < 0).alias("_down"),
    )
    g = g.withColumn("sign_flips", F.least("_up", "_down")).withColumn("conservation", F.greatest("_up", "_down") / F.col("n_cohorts"))
    return g.withColumn("divergence", F.col("sd_r") / (F.abs("mean_r") + 1e-3)).drop("_up", "_down")


def rewiring(edges: DataFrame, modules: DataFrame, cohort: str) -> DataFrame:
    """Mean |r| inside each module and cohort, and its sd over cohorts."""
    m = modules.select("module", F.col("gene_symbol").alias("_f"))
    inside = edges.join(m.withColumnRenamed("_f", "f1"), "f1").join(m.withColumnsRenamed({"_f": "f2", "module": "_m2"}), "f2").where("module = _m2")
    per = inside.groupBy("module", cohort).agg(F.avg(F.abs("r")).alias("mean_abs_r"), F.count("*").alias("n_edges"))
    return per.withColumn("sd_over_cohorts", F.stddev_samp("mean_abs_r").over(W.partitionBy("module")))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names (on one machine a temporary one where unset)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="assayloom-"))
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of undirected edges (a, b): least labels spread and jump until nothing changes.

    Labels are checkpointed each round.
    """
    both = checkpointed(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("root")).checkpoint()
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        near = labels.join(seen, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = near.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        new = jump.select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old").checkpoint()
        labels = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return labels
    raise RuntimeError("the components have not settled")


TILE = 2048
CELLS = 4_000_000


def absence(total: int, na: np.ndarray, nb: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of `total` both sides lack, and the Jaccard distance of what they lack, from what each and both have."""
    both, union = total - na - nb + have, total - have
    return both, np.where(union == 0, 0.0, 1 - both / np.where(union > 0, union, 1))


def tile_rows(sets: DataFrame, n_ids: int, *more: str) -> DataFrame:
    """Rows of ids `x` once for each pair of tiles lo <= hi that they are in (`low`: by the tile lo), grouped by lo, hi
    and `more`. A tile has about TILE ids; groups are spread over as many tasks as there are pairs of tiles."""
    n = max(1, math.ceil(n_ids / TILE))
    tile = sets.withColumn("_t", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")).withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = tile.withColumns({"lo": F.least("_t", "_u"), "hi": F.greatest("_t", "_u"), "low": F.col("_t") <= F.col("_u")}).drop("_t", "_u")
    return out.repartition(min(4000, max(n * (n + 1) // 2, 64 if more else 1)), "lo", "hi", *more)


def tile_pairs(rows: pa.Table, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places p of some rows, places q of others, and how many of the lists `y` both have, p by q; all pairs of the tiles
    lo and hi of the rows come once. In a tile by itself p and q are of the same rows, and only p < q counts."""
    low, one = rows["low"].to_numpy(), rows["lo"][0].as_py() == rows["hi"][0].as_py()
    left, right = (np.arange(len(low)),) * 2 if one else (np.flatnonzero(low), np.flatnonzero(~low))
    lists = rows["y"].combine_chunks()
    at = np.repeat(np.arange(len(low)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    have = np.zeros((len(left), len(right)), np.float32)  # whole numbers up to CELLS are exact
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        own = slice(*np.searchsorted(code, (first, first + 4096)))
        x = np.zeros((len(low), 4096), np.float32)
        x[at[own], code[own] - first] = 1
        have += x[left] @ x[right].T
    for first in range(0, len(left), block):
        yield left[first : first + block], right, have[first : first + block].astype(np.int64)


def absence_distances(observed: DataFrame, axis: str, other: str, every: DataFrame | None = None, min_absent: int = 0, min_both: int = 0, at_most: float = 1.0) -> DataFrame:
    """(a, b, both, distance), a < b: how many of `other` both ids of `axis` lack, and the Jaccard distance of what they
    lack; two that lack nothing have distance 0. Ids that lack fewer than min_absent take no part; pairs that both lack
    fewer than min_both, or are farther than at_most, have no row.

    observed: rows that exist, whatever their values; every: all ids of `axis`, where some have no row. What both lack
    follows from what each and both have, so the absent cells, which are most, are never made. All pairs are looked at,
    a task for each pair of tiles of TILE ids, so memory doesn't grow with them; what a pair of tiles has over CELLS cells
    is counted in slices of `other` and summed.
    """
    seen = checkpointed(observed.select(F.col(axis).alias("x"), F.col(other).alias("y")).distinct())  # it is read several times
    ids = seen.select("x").distinct() if every is None else every.select(F.col(axis).alias("x")).distinct()
    total = seen.select("y").distinct().count()
    sizes = ids.join(seen.groupBy("x").agg(F.count("*").alias("n")), "x", "left").select("x", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = sizes.where(total - F.col("n") >= min_absent)
    n_ids, cells = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind, width = ids.schema["x"].dataType.simpleString(), min(1.0, 2 * TILE / max(n_ids, 1))
    slices = max(1, math.ceil(cells * width / CELLS))
    if slices == 1:
        sets = sizes.join(seen.groupBy("x").agg(F.collect_list("y").alias("y")), "x", "left")

        def run(rows: pa.Table) -> pa.Table:
            rows, out = rows.sort_by("x"), []
            n, x = rows["n"].to_numpy(), rows["x"].combine_chunks()
            one = rows["lo"][0].as_py() == rows["hi"][0].as_py()
            for p, q, have in tile_pairs(rows):
                both, far = absence(total, n[p][:, None], n[q], have)
                i, j = np.nonzero((both >= min_both) & (far <= at_most) & ((p[:, None] < q) | (not one)))
                a, b = x.take(pa.array(np.minimum(p[i], q[j]))), x.take(pa.array(np.maximum(p[i], q[j])))
                out.append(pa.record_batch([a, b, pa.array(both[i, j]), pa.array(far[i, j])], ["a", "b", "both", "distance"]))
            return pa.Table.from_batches(out) if out else pa.table({"a": x[:0], "b": x[:0], "both": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

        return tile_rows(sets, n_ids).groupBy("lo", "hi").applyInArrow(run, f"a {kind}, b {kind}, both bigint, distance double")

    part = seen.join(sizes.select("x"), "x", "left_semi").withColumn("part", F.pmod(F.xxhash64("y"), F.lit(slices)).cast("int"))
    sets = part.groupBy("x", "part").agg(F.collect_list("y").alias("y"))

    def count(rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("x"), []
        x, one = rows["x"].combine_chunks(), rows["lo"][0].as_py() == rows["hi"][0].as_py()
        for p, q, have in tile_pairs(rows):
            i, j = np.nonzero((have > 0) & ((p[:, None] < q) | (not one)))
            out.append(pa.record_batch([x.take(pa.array(np.minimum(p[i], q[j]))), x.take(pa.array(np.maximum(p[i], q[j]))), pa.array(have[i, j])], ["a", "b", "have"]))
        return pa.Table.from_batches(out) if out else pa.table({"a": x[:0], "b": x[:0], "have": pa.array([], pa.int64())})

    counted = tile_rows(sets, n_ids, "part").groupBy("lo", "hi", "part").applyInArrow(count, f"a {kind}, b {kind}, have bigint")
    shared = counted.groupBy("a", "b").agg(F.sum("have").alias("have"))
    a, b = (sizes.select(F.col("x").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    x = a.join(b, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    x = x.withColumn("both", total - F.col("na") - F.col("nb") + F.col("have"))
    union = total - F.col("have")
    x = x.select("a", "b", "both", F.when(union == 0, 0.0).otherwise(1 - F.col("both") / F.when(union > 0, union)).alias("distance"))
    return x.where((F.col("both") >= min_both) & (F.col("distance") <= at_most))


def absence_pairs(observed: DataFrame, axis: str, other: str, min_absent: int, threshold: float) -> DataFrame:
    """Pairs of features whose sets of absent samples meet and are within a Jaccard distance (sides swapped for samples).

    observed: rows that exist, whatever their values.
    """
    return absence_distances(observed, axis, other, None, min_absent, 1, threshold)


def program_similarity(loadings: DataFrame, metric: str, top_n: int = 5) -> DataFrame:
    """Similarity of programs of different cohorts (cohort, program, feature, loading): Jaccard of the top features, or
    absolute cosine (centred: of loadings less their program's mean) or Spearman over shared ones; a_cohort < b_cohort."""
    rows = top_abs(loadings, "loading", top_n, ["cohort", "program"], "feature") if metric == "jaccard" else loadings
    if metric == "centred-cosine":
        rows = rows.withColumn("loading", F.col("loading") - F.avg("loading").over(W.partitionBy("cohort", "program")))
    side = lambda s: rows.select(F.col("cohort").alias(f"{s}_cohort"), F.col("program").alias(f"{s}_program"), "feature", F.col("loading").alias(f"{s}_l"))
    key = ["a_cohort", "a_program", "b_cohort", "b_program"]
    if metric == "jaccard":
        n = rows.groupBy("cohort", "program").agg(F.count("*").alias("n"))
        programs = lambda s: n.select(F.col("cohort").alias(f"{s}_cohort"), F.col("program").alias(f"{s}_program"), F.col("n").alias(f"{s}_n"))
        grid = programs("a").join(programs("b"), F.col("a_cohort") < F.col("b_cohort"))
        both = side("a").join(side("b"), "feature").where("a_cohort < b_cohort").groupBy(*key).agg(F.count("*").alias("k"))
        g = grid.join(both, key, "left").withColumn("k", F.coalesce("k", F.lit(0)))
        return g.select(*key, F.coalesce(F.try_divide(F.col("k").cast("double"), (F.col("a_n") + F.col("b_n") - F.col("k")).cast("double")), F.lit(0.0)).alias("similarity"))
    both = side("a").join(side("b"), "feature").where("a_cohort < b_cohort")
    if metric == "spearman":
        both = both.withColumn("_a", average_rank("a_l", *key)).withColumn("_b", average_rank("b_l", *key))
        return both.groupBy(*key).agg(F.coalesce(F.abs(pearson_agg("_a", "_b")), F.lit(0.0)).alias("similarity"))
    a, b = F.col("a_l"), F.col("b_l")
    return both.groupBy(*key).agg(F.coalesce(F.abs(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b)))), F.lit(0.0)).alias("similarity"))


def best_matches(similarity: DataFrame, tau: float, reciprocal: bool) -> DataFrame:
    """Each program's best partner in each other cohort, at tau or over; reciprocal: best both ways. First of equals wins."""
    best = lambda mine, yours: F.row_number().over(W.partitionBy(f"{mine}_cohort", f"{mine}_program", f"{yours}_cohort").orderBy(F.round("similarity", 12).desc(), f"{yours}_program"))
    s = similarity.withColumn("_a", best("a", "b")).withColumn("_b", best("b", "a"))
    return s.where((F.col("_a") == 1) & ((F.col("_b") == 1) if reciprocal else F.lit(True)) & (F.col("similarity") >= tau)).drop("_a", "_b")


def selectivity(similarity: DataFrame, tau: float) -> DataFrame:
    return similarity.agg(F.avg((F.col("similarity") >= tau).cast("double")).alias("admitted_share"), F.count("*").alias("n_pairs"))


def displacement(scores: DataFrame, columns: list[str], arm: str) -> DataFrame:
    """Mean of case less mean of control for each score, as long rows; nulls are left out."""
    long = scores.unpivot([arm], columns, "score", "value")
    return long.groupBy("score").agg((F.avg(F.when(F.col(arm) == "case", F.col("value"))) - F.avg(F.when(F.col(arm) == "control", F.col("value")))).alias("displacement"))


def leave_cohort_out(scores: DataFrame, column: str) -> DataFrame:
    """z-scores of the remaining rows, once without each cohort."""
    cohorts = scores.select(F.col("cohort").alias("left_out")).distinct()
    rest = scores.join(F.broadcast(cohorts), F.col("cohort") != F.col("left_out"))
    return rest.select("left_out", "sample_id", zscore(column, "left_out").alias("z"))


def harmonise_fit(rows: DataFrame) -> DataFrame:
    """(feature, direction): mean over cohorts of case less control after z-scoring within the cohort; features that
    every cohort has. rows: cohort, sample_id, feature, value, arm."""
    z = rows.withColumn("_z", zscore("value", "cohort", "feature"))
    per = z.groupBy("cohort", "feature").agg((F.avg(F.when(F.col("arm") == "case", F.col("_z"))) - F.avg(F.when(F.col("arm") == "control", F.col("_z")))).alias("_d"))
    n = rows.agg(F.count_distinct("cohort").alias("_n"))
    g = per.where("_d IS NOT NULL").groupBy("feature").agg(F.avg("_d").alias("direction"), F.count("*").alias("_in"))
    return g.crossJoin(F.broadcast(n)).where("_in = _n").select("feature", "direction")


def represent(rows: DataFrame, method: str, reference: list[str] | None = None) -> DataFrame:
    """A cohort's values as the model sees them: "zscore" per feature, "rank" within a sample from 0 to 1 (one feature:
    a half), "reference" less the mean of reference features."""
    if method == "zscore":
        return rows.withColumn("represented", zscore("value", "cohort", "feature"))
    w = W.partitionBy("cohort", "sample_id")
    if method == "rank":
        n = F.count("*").over(w)
        return rows.withColumn("represented", F.when(n == 1, 0.5).otherwise(F.try_divide(average_rank("value", "cohort", "sample_id") - 1, (n - 1).cast("double"))))
    return rows.withColumn("represented", F.col("value") - F.avg(F.when(F.col("feature").isin(reference or []), F.col("value"))).over(w))


def harmonise_apply(model: DataFrame, rows: DataFrame, trained_on: set[str], cohort: str) -> DataFrame:
    """Scores of a cohort's samples: mean of direction times z over the features used; a training cohort is refused."""
    if cohort in trained_on:
        raise ValueError(f"cohort {cohort} took part in the fit")
    z = represent(rows.where(F.col("cohort") == cohort), "zscore").where("represented IS NOT NULL").join(model, "feature")
    return z.groupBy("sample_id").agg(F.avg(F.col("direction") * F.col("represented")).alias("score"), F.count("*").alias("n_used"))


def components_for_variance(spectrum: DataFrame, target: float, low: int, high: int) -> DataFrame:
    """The least k whose first eigenvalues reach the target share of variance, held within bounds that are told."""
    w = W.orderBy(F.desc("eigenvalue"), "component")
    s = spectrum.withColumn("_k", F.row_number().over(w)).withColumn("_share", F.sum("eigenvalue").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("eigenvalue").over(W.partitionBy()))
    free = s.agg(F.min(F.when(F.col("_share") >= target - 1e-12, F.col("_k"))).cast("long").alias("free_k"))
    k = F.greatest(F.lit(low), F.least(F.lit(high), F.col("free_k"))).cast("long")
    return free.select("free_k", k.alias("k"), (F.col("free_k") < low).alias("at_lower"), (F.col("free_k") > high).alias("at_upper"))


def archetype_summary(members: DataFrame, programs: DataFrame) -> DataFrame:
    """One row on archetypes of two programs or more (root, cohort, category): how many, over several cohorts, over all
    of them, and the share whose known categories are all the same."""
    cohorts = programs.agg(F.count_distinct("cohort").alias("_all"))
    g = members.groupBy("root").agg(F.count("*").alias("_n"), F.count_distinct("cohort").alias("_c"), F.count("category").alias("_known"), F.count_distinct("category").alias("_kinds")).where("_n >= 2")
    g = g.crossJoin(F.broadcast(cohorts))
    return g.agg(
        F.count("*").alias("n_archetypes"), F.count_if(F.col("_c") >= 2).alias("n_multi_cohort"), F.count_if(F.col("_c") == F.col("_all")).alias("n_universal"),
        F.avg(F.when(F.col("_known") >= 2, (F.col("_kinds") == 1).cast("double"))).alias("category_recovery"),
    )


def alignment_sweep(loadings: DataFrame, metrics: list[tuple[str, int]], taus: list[float]) -> DataFrame:
    """For each metric (with a number of top features) and threshold: pairs of programs, admitted ones, reciprocally best
    ones among these."""
    parts = [program_similarity(loadings, metric, top_n or 5).withColumns({"metric": F.lit(metric), "top_n": F.lit(top_n).cast("long")}) for metric, top_n in metrics]
    s = reduce(DataFrame.unionByName, parts)
    best = lambda mine, yours: F.row_number().over(W.partitionBy("metric", "top_n", f"{mine}_cohort", f"{mine}_program", f"{yours}_cohort").orderBy(F.round("similarity", 12).desc(), f"{yours}_program"))
    s = s.withColumn("_a", best("a", "b")).withColumn("_b", best("b", "a")).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    admitted = F.col("similarity") >= F.col("tau")
    return s.groupBy("metric", "top_n", "tau").agg(
        F.count("*").alias("n_pairs"), F.count_if(admitted).alias("n_admitted"), F.avg(admitted.cast("double")).alias("admitted_share"),
        F.count_if(admitted & (F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_reciprocal"),
    )
