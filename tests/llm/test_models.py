"""Katz scores, language identification, BPE, token counts, and the pipeline."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import tiktoken
from corpus import crc, frame, rows, words
from tokenizers import Tokenizer

from assayloom.llm import bytebpe, katz, langid, tokencount
from assayloom.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def good_turing(n):
    """Katz's discounted counts 0..5 from numbers of things by count, smoothed by a line through logarithms."""
    seen = [r for r in sorted(n) if r <= 30]
    points = []
    for i, r in enumerate(seen):
        before = seen[i - 1] if i else 0
        after = seen[i + 1] if i + 1 < len(seen) else 2 * r - before
        points.append((math.log(r), math.log(n[r] * 2 / (after - before))))
    slope = -2.0
    if len(points) > 1:
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, y in points)
    slope = min(slope, -1.1)
    smooth = {r: r**slope for r in range(1, 8)}
    common = 6 * smooth[6] / smooth[1]
    return [0.0] + [r * ((r + 1) * smooth[r + 1] / smooth[r] / r - common) / (1 - common) for r in range(1, 6)]


def brute_katz(data):
    """Rows as (id, held, n, known, N, base, score), and the model's conditional probability."""
    teach = [x[0] is not None and crc(x[0]) % 7 != 2 for x in data]
    tokens = [[*words(x[1]), None] for x in data]
    uni, bi, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for t, w in zip(teach, tokens, strict=True):
        if t:
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
            hist.update(["<s>", *w[:-1]])
    total, distinct = sum(uni.values()), len(uni)

    def table(counts):
        t = good_turing(collections.Counter(counts.values()))
        return lambda c: t[c] if c <= 5 else c - 0.05

    du, db = table(uni), table(bi)
    unknown = 1 - sum(map(du, uni.values())) / total if total else 1.0

    def word(w):
        return du(uni[w]) / total if uni[w] else unknown

    up, low = collections.defaultdict(float), collections.defaultdict(float)
    for (h, w), c in bi.items():
        up[h] += db(c) / hist[h]
        low[h] += word(w)

    def given(h, w):
        if bi[h, w]:
            return db(bi[h, w]) / hist[h]
        return ((1 - up[h]) / (1 - low[h]) if hist[h] else 1.0) * word(w)

    out = []
    for x, w in zip(data, tokens, strict=True):
        score = sum(math.log10(given(h, v)) for h, v in zip(["<s>", *w], w, strict=False))
        base = sum(math.log10((uni[v] + 1) / (total + distinct + 1)) for v in w)
        out.append((str(x[0]), x[0] is not None and crc(x[0]) % 7 == 2, len(w), sum(uni[v] > 0 for v in w), total, base, score))
    return sorted(out), given, set(uni)


def check_katz(got, data):
    want = brute_katz(data)[0]
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-7, abs_tol=1e-7)


def test_katz(spark):
    check_katz(katz.katz_scores(frame(spark), tokens_per_block=700).collect(), rows())
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_katz_scores"](spark, DIR).collect()
    check_katz(got, docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_katz_is_normalised():
    data = rows()
    _, given, known = brute_katz(data)
    for h in ["<s>", "the", "tion", "never seen"]:
        assert abs(sum(given(h, w) for w in known) + given(h, "no such word") - 1) < 1e-9


def test_katz_of_frequent_history_with_few_continuations(spark):
    held = [i for i in range(100) if crc(i) % 7 == 2][:3]
    taught = [i for i in range(100) if crc(i) % 7 != 2][:12]
    texts = [(i, "a " * 300_000 + f"b{n % 3} c") for n, i in enumerate(taught)] + [(i, f"a c a new{i}") for i in held]
    data = [(i, t, None, None, len(t), None, None) for i, t in texts]
    got = {x["doc_id"]: x["score"] for x in katz.katz_scores(frame(spark, data), tokens_per_block=200_000).collect()}
    want = {int(x[0]): x[6] for x in brute_katz(data)[0]}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in held)


def test_katz_keeps_its_model(spark, tmp_path):
    first = katz.katz_scores(frame(spark), tokens_per_block=700, model_path=str(tmp_path / "m")).collect()
    again = katz.score_with(frame(spark), str(tmp_path / "m"), tokens_per_block=300).collect()
    plain = lambda found: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found)
    assert plain(first) == plain(again)
    new = [(1, "the never seen words", None, None, 20, None, None), (2, None, None, None, None, None, None)]
    given = brute_katz(rows())[1]
    got = {r["doc_id"]: r["score"] for r in katz.score_with(frame(spark, new), str(tmp_path / "m")).collect()}
    for i, t in ((1, ["the", "never", "seen", "words", None]), (2, [None])):
        assert abs(got[i] - sum(math.log10(given(h, w)) for h, w in zip(["<s>", *t], t, strict=False))) < 1e-6
    assert katz.score_with(frame(spark, []), str(tmp_path / "m")).count() == 0


def test_good_turing_of_word_pairs(spark):
    """On a real table the fitted line alone gives the discounts: no slope is held."""
    pairs = collections.Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        if crc(r[0]) % 7 != 2:
            w = [*words(r[1]), None]
            pairs.update(zip(["<s>", *w], w, strict=False))
    n = collections.Counter(pairs.values())
    want = good_turing(n)
    assert np.allclose(katz.discounts([float(n[i]) for i in range(1, katz.RANKS + 1)]), want)
    held = -0.1  # the power that a held slope would give
    common = 6**held
    assert abs(want[1] - (2**held - common) / (1 - common)) > 0.05 and all(0 < d < r for r, d in enumerate(want) if r)
    for few in ([], [3.0], [0.0, 0.0, 5.0], [1.0, 9.0, 9.0]):
        assert (0 < katz.discounts(few)[1:]).all() and (katz.discounts(few)[1:] < np.arange(1, 6)).all()


def test_katz_without_training(spark):
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    r = katz.katz_scores(frame(spark, [(held, "a b", None, None, 3, None, None)])).collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in r] == [(3, 0, 0, 0.0, 0.0)]
    assert katz.katz_scores(frame(spark, [])).count() == 0


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op5_language_id"](spark, d).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_languages_of_odd_rows(spark):
    got = langid.identify_languages(frame(spark)).collect()
    texts = {x[0]: x[1] for x in rows()}
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in ("und", "en", "de")
    unlearned = langid.identify_languages(frame(spark, [(1, "abc", None, None, 3, None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlearned] == [("und", 0.0)]
    assert langid.identify_languages(frame(spark, [])).count() == 0


def test_temperature():
    g = np.random.default_rng(0)
    logits = g.normal(size=(4000, 3))
    labels = np.array([g.choice(3, p=langid.softmax(x / 2.5)) for x in logits])
    assert abs(langid.fit_temperature(logits, labels) - 2.5) < 0.4


def library():
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(0)
    texts = [x[1] or "" for x in rows()] + ["<|endoftext|> a", "it's I'LL we'd", " " * 70 + "x", "\x1c\x1d \x85　y", "aaaa" * 50]
    return texts + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x3000), r.randrange(0x1F000, 0x1FFFF)])) for _ in range(150)) for _ in range(80)]


def test_bpe_is_the_library():
    ranks, enc = library()
    for limit in (150_000, 20):
        own = bytebpe.ByteBpe(ranks, public_tokenizers.PATTERN, max_pieces=limit)
        own.transducer.max_states = limit
        for t in odd_texts():
            ids = own.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and own.decode(ids, 8) == t


def test_words_and_white_space():
    """What stands between spaces is looked up as a whole: against the library, with white space of all kinds around."""
    ranks, enc = library()
    own = bytebpe.ByteBpe(ranks, public_tokenizers.PATTERN, max_pieces=300, max_words=200)
    r = random.Random(1)
    parts = ["a", "B", "é", "'s", "'", " ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", "1", "٣", "!", ".", ",", ")", "中", "\r\n", "don't", "ß", "word", "½", "Ⅷ"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(10)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == enc.encode_ordinary(t), t


def test_stream_decoding():
    raw = "aé🙂日ß\u0301x".encode() * 3
    for size in (1, 2, 3, 5, 7):
        m = bytebpe.Utf8Stream()
        assert "".join(m.feed(raw[i : i + size]) for i in range(0, len(raw), size)) + m.end() == raw.decode()
    for bad in (b"\xff", b"\xe6\x97", b"a\xc3", b"\xf0\x9f\x99 z"):
        m = bytebpe.Utf8Stream()
        assert "".join(m.feed(bad[i : i + 1]) for i in range(len(bad))) + m.end() == bad.decode("utf-8", "replace")


def test_bpe_query(spark):
    _, enc = library()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, DIR).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    made = bytebpe.bpe_round_trip(frame(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(r["decoded"] for r in made.collect()) == sorted(x[1] or "" for x in rows())


def test_token_counts_are_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*odd_texts(), "<|startoftext|>Hi<|endoftext|>x", "é<|endoftext|>\u0301", "J\u030c İΣ ΑΣ", *("a" + chr(c) + "b" + chr(c) for c in range(0x3100))]
    data = [(i, t, None, None, 1, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in tokencount.count_tokens(frame(spark, data), path, sample_docs=5, entries=20, cache_entries=500).collect()}
    for i, (t, e) in enumerate(zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert got[i]["n_tokens"] == len(e.ids) and got[i]["n_bytes"] == len(t.encode())
    assert tokencount.count_tokens(frame(spark, []), path).count() == 0
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in QUERIES["op10_token_counts"](spark, DIR).collect():
        n = len(lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 2048)


def test_pipeline(spark):
    import corpus_pipeline
    from test_dedup import brute_components
    from test_scans import brute_hits, brute_secrets

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    state, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, DIR)
        assert state.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in state.collect()}
    kept = {r["doc_id"] for r in QUERIES["op7_quality_rules"](spark, DIR).where("kept").collect()}
    assert set(seen["quality"]) == kept
    single = {int(c) for _, _, c in brute_components(sorted(seen["quality"].items()))}
    assert set(seen["near_duplicates"]) == single
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for i, t in seen["near_duplicates"].items():
        n, hit, _ = brute_hits(t, items)
        assert (i in seen["decontamination"]) == (not (hit and 20 * hit >= n))
        if i in seen["decontamination"] and not hit:
            assert seen["decontamination"][i] == t
    assert set(seen["secrets"]) == set(seen["decontamination"]) and not any(brute_secrets(t) for t in seen["secrets"].values())
    _, enc = library()
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(out) == set(seen["secrets"])
    for i, t in seen["secrets"].items():
        ids = enc.encode_ordinary(t)
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
