"""SimHash, components and repeated passages against brute force."""

import collections
import random

import numpy as np
import xxhash
from corpus import SCHEMA, frame, rows, words

from assayloom.llm import simhash, suffixes
from assayloom.llm.components import connected_components
from assayloom.llm.queries import QUERIES


def roots(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_print(text):
    w = words(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(data):
    f = np.array([brute_print(x[1]) for x in data], np.uint64)
    pairs = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3).tolist()
    root = roots(len(data), pairs)
    least = collections.defaultdict(lambda: None)
    for r, x in zip(root, data, strict=True):
        if x[0] is not None:
            least[r] = x[0] if least[r] is None else min(least[r], x[0])
    return sorted(((str(x[0]), int(p), str(least[r])) for x, p, r in zip(data, f, root, strict=True)))


def test_fingerprints_and_components(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == brute_components(rows())


def test_deduplicate_keeps_one(spark):
    data = [x for x in rows() if x[0] is not None]
    want = sorted({int(c) for _, _, c in brute_components(data)})
    out = simhash.deduplicate(frame(spark, data))
    assert out.columns == frame(spark, data).columns
    assert sorted({r["doc_id"] for r in out.collect()}) == want


def test_links_in_large_buckets():
    r = random.Random(5)
    centre, seen = r.getrandbits(64), set()
    for _ in range(3000):
        x = centre
        for _ in range(r.randrange(7)):
            x ^= 1 << r.randrange(21)
        seen.add(x)
    f = np.array(sorted(seen), np.uint64)
    assert len(f) > 512
    key = int(simhash.outside(f[:1], 0)[0][0])
    got = roots(len(f), simhash.links_in_bucket(f, 0, key))
    assert got == roots(len(f), np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3).tolist())


def test_ball_meets_within_three_bits():
    r = random.Random(6)
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << r.randrange(64)
        ka, kb = (set(simhash.ball(np.array([x], np.uint64))[0].tolist()) for x in (a, b))
        assert ka & kb


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4400)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = roots(6000, edges)
    assert got == {n: want[n] for n in {n for a, b in edges if a != b for n in (a, b)}}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_covered(data, size):
    seen, tokens = collections.defaultdict(set), {}
    for x in data:
        if x[0] is not None:
            w = tokens[x[0]] = words(x[1])
            for i in range(len(w) - size + 1):
                seen[tuple(w[i : i + size])].add(x[0])
    out = {}
    for i, w in tokens.items():
        hit = [False] * len(w)
        for j in range(len(w) - size + 1):
            if len(seen[tuple(w[j : j + size])]) > 1:
                hit[j : j + size] = [True] * size
        out[i] = sum(hit)
    return {i: n for i, n in out.items() if n}


def test_repeated_passages(spark):
    got = collections.Counter()
    found = suffixes.repeated_passages(frame(spark)).collect()
    for r in found:
        got[r["doc_id"]] += r["n_words"]
        assert r["other_docs"] and r["doc_id"] not in r["other_docs"] and r["n_words"] == r["end_word"] - r["start_word"] >= 50
    assert dict(got) == brute_covered(rows(), 50)


def test_passage_of_very_many_documents(spark):
    r = random.Random(2)
    shared = " ".join(f"w{r.randrange(10**6)}" for _ in range(55))
    data = [(i, " ".join(f"v{r.randrange(10**9)}" for _ in range(r.randrange(60))) + " " + (shared if i % 3 else "") + " " + " ".join(f"u{r.randrange(10**9)}" for _ in range(r.randrange(60))), None, None, 1, None, None) for i in range(600)]
    got = {x["doc_id"] for x in suffixes.repeated_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {i for i in range(600) if i % 3}


def test_passages_of_few_inside_a_line_of_many(spark):
    r = random.Random(11)
    fresh = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    line, data = fresh(45), []
    before = {i: fresh(10) for i in range(40)}
    for i in range(300):
        data.append((i, " ".join(fresh(20) + before.get(i % 150, fresh(10)) + line + fresh(30)), None, None, 1, None, None))
    got = {x["doc_id"]: (x["n_words"], x["other_docs"]) for x in suffixes.repeated_passages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {i: (55, [(i + 150) % 300]) for i in range(300) if i % 150 < 40}


def test_first_documents_and_classes_of_copies(spark):
    r = random.Random(12)
    fresh = lambda n: " ".join(f"v{r.randrange(10**9)}" for _ in range(n))
    copy, a, b = fresh(80), fresh(50), fresh(50)
    data = [(i, copy) for i in range(100, 120)] + [(1, f"{a} x"), (2, f"y {a} {b}"), (3, f"{b} z")]
    frame_ = spark.createDataFrame([(i, t, None, None, 1, None, None) for i, t in data], SCHEMA)
    got = {x["doc_id"]: x for x in suffixes.repeated_passages(frame_).collect()}
    assert [i for i, x in got.items() if x["first_doc"] and i >= 100] == [100]
    assert all(got[i]["other_docs"] == [100] and got[i]["class_id"] == 100 and got[i]["n_links"] == 19 for i in range(101, 120))
    assert {(got[i]["class_id"], got[i]["n_links"]) for i in (1, 2, 3)} == {(1, 2)} and got[2]["other_docs"] == [1, 3]


def test_minimisers_cover_windows():
    g = np.random.default_rng(0)
    for values in (g.integers(0, 2**63, 500), g.integers(0, 3, 500), np.zeros(200, int), np.arange(7)):
        codes = values.astype(np.uint64)
        at = suffixes.minimisers(codes, 26)
        for s in range(max(1, len(codes) - 25)):
            part = codes[s : s + 26]
            inside = at[(at >= s) & (at < s + 26)]
            assert len(inside) and part.min() in codes[inside]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0 and suffixes.repeated_passages(none).count() == 0


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, d).collect()}
    for i, p, c in brute_components(docs):
        assert got[int(i)]["fingerprint"] == f"{p:016x}" and got[int(i)]["component_id"] == int(c)
    assert {r["doc_id"] for r in QUERIES["op1_suffix_dedup"](spark, d).collect()} == set(brute_covered(docs, 50))
