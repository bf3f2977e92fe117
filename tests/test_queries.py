"""Every registered query that has SQL, held against DuckDB on the smallest tables."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from assayloom.operators import decompose
from assayloom.plans import models, networks, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows) -> list[tuple]:
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.5f}".replace("-0.00000", "0.00000")
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    """Queries without SQL: the plan runs, its rows are the same in a second run, and numbers are numbers or null."""
    first, again = (plain(map(tuple, registry.queries()[name](spark, DIR).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_icc_takes_all_events(spark, duck):
    want = {}
    for kind in {r[0] for r in duck.sql("SELECT event_type FROM events").fetchall()}:
        users: dict = {}
        for u, v in duck.execute("SELECT user_id, value FROM events WHERE event_type = ? AND value IS NOT NULL", [kind]).fetchall():
            users.setdefault(u, []).append(v)
        groups = [g for g in users.values() if len(g) > 1]
        n, total = len(groups), sum(map(len, groups))
        mean, centre = sum(map(sum, groups)) / total, [sum(g) / len(g) for g in groups]
        msb = sum(len(g) * (c - mean) ** 2 for g, c in zip(groups, centre, strict=True)) / (n - 1)
        msw = sum((v - c) ** 2 for g, c in zip(groups, centre, strict=True) for v in g) / (total - n)
        k0 = (total - sum(len(g) ** 2 for g in groups) / total) / (n - 1)
        want[kind] = (n, len(users) - n, pytest.approx((msb - msw) / (msb + (k0 - 1) * msw), abs=1e-5))
    got = registry.queries()["icc_events"](spark, DIR).collect()
    assert {r["event_type"]: (r["n_subjects"], r["n_single"], r["icc"]) for r in got} == want


def test_consensus_takes_all_samples(spark, monkeypatch):
    g = np.random.default_rng(9)
    x = np.vstack([np.repeat([[3.0, 3.0, -3.0, -3.0]], 120, 0) + g.normal(size=(120, 4)), g.normal(size=(180, 4))])
    monkeypatch.setattr(models, "_scores", lambda spark, sf_dir: pd.DataFrame(x))
    got = {r["k"]: r["cophenetic"] for r in models.decompose_nmf_consensus(spark, DIR).collect()}
    up = np.power(2.0, np.clip(x, -6, 6))
    want = {k: decompose.cophenetic(np.array([decompose.nmf(up, k, s)["w"].argmax(1) for s in range(5)])) for k in range(2, 6)}
    assert got == pytest.approx(want, abs=1e-4)


def test_plex_pairs_of_all_samples(spark, monkeypatch):
    r = random.Random(10)
    seen = {f"s{i:02d}": {f"a{j:02d}" for j in range(30) if r.random() < 0.6} for i in range(50)}
    rows = [(s, a, int(s[1:]) * 2) for s, own in seen.items() for a in own]
    table = spark.createDataFrame(rows, "sample_id string, assay_id string, subject_id bigint")
    monkeypatch.setattr(networks.views, "measurements", lambda *a, **k: table)
    got = {(x["a"], x["b"]): (x["n_both"], x["distance"]) for x in networks.recover_plex_pairs(spark, DIR).collect()}
    every, want = set().union(*seen.values()), {}
    for a, b in itertools.combinations(sorted(seen), 2):
        p, q = every - seen[a], every - seen[b]
        if len(p) >= 5 and len(q) >= 5 and p & q and 1 - len(p & q) / len(p | q) <= 0.85:
            want[a, b] = (len(p & q), pytest.approx(1 - len(p & q) / len(p | q), abs=1e-6))
    assert got == want and any(int(b[1:]) >= 20 for _, b in got)
