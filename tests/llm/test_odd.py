"""Odd input of every operator: empty tables, texts longer than a slice, one id with several texts, clashing columns."""

import collections
import random

import numpy as np
import public_tokenizers
import tiktoken
from corpus import SCHEMA, frame, prose, words
from test_dedup import brute_components, brute_covered
from test_scans import brute_secrets
from tokenizers import Tokenizer

from assayloom.llm import bytebpe, decontaminate, katz, langid, quality, secrets, simhash, suffixes, tokencount, urlfilter

RANKS, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def docs_of(spark, texts):
    return frame(spark, [(i, t, "en", None, None, "clash", "clash") for i, t in texts])


def test_empty_documents(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    made = [
        secrets.scan_secrets(none), secrets.scan_secrets(none, redact=True), decontaminate.decontaminate(none, bench), decontaminate.decontaminate(none, bench, clean="spans"),
        bytebpe.bpe_round_trip(none, RANKS, public_tokenizers.PATTERN), tokencount.count_tokens(none, WORDS), langid.identify_languages(none), quality.judge_quality(none, labels),
        katz.katz_scores(none), simhash.deduplicate(none), suffixes.repeated_passages(none),
        urlfilter.filter_urls(spark.createDataFrame([], "page_id bigint, url string"), [("block", "a", "")]),
    ]
    assert [m.count() for m in made] == [0] * len(made)


def test_texts_longer_than_a_slice(spark):
    """Slices are half a megabyte to eight; three texts of three megabytes stand among short ones."""
    r = random.Random(3)
    passage = [f"q{i}" for i in range(60)]
    body = [prose(r, 40) for _ in range(2000)]
    long = [" ".join(r.choice(body) for _ in range(14_000)) for _ in range(3)]
    long = [t + " " + " ".join(passage) + ' token="Hunter2Hunter2xx" deadbeefdeadbeef00' for t in long]
    texts = [(0, "short one"), *((10 + i, t) for i, t in enumerate(long)), (20, "short " + " ".join(passage))]
    docs, by_id = docs_of(spark, texts), dict(texts)
    assert min(map(len, long)) > 2_500_000
    for x in secrets.scan_secrets(docs).collect():
        assert [(s["start"], s["end"], s["kind"]) for s in x["spans"] if s["kind"] != "novel"] == [(s, e, k) for s, _, e, k in brute_secrets(by_id[x["doc_id"]])]
    hits = {x["doc_id"]: x["n_hit"] for x in decontaminate.decontaminate(docs, spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string")).collect()}
    assert hits == {i: 60 if i else 0 for i in by_id}
    lib = Tokenizer.from_file(WORDS)
    assert {x["doc_id"]: x["n_tokens"] for x in tokencount.count_tokens(docs, WORDS).collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in texts}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    for x in bytebpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(x["ids"], "<u4").tolist() == enc.encode_ordinary(by_id[x["doc_id"]]) and x["decoded"] == by_id[x["doc_id"]]
    for x in quality.judge_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect():
        assert x["n_words"] == len(words(by_id[x["doc_id"]]))
    assert {x["doc_id"]: x["n_tokens"] for x in katz.katz_scores(docs).collect()} == {i: len(words(t)) + 1 for i, t in texts}
    small = [(i, t if len(t) < 1000 else t[-3000:]) for i, t in texts]
    assert {x["doc_id"] for x in suffixes.repeated_passages(docs).collect()} >= set(brute_covered(small, 50))
    assert all(x["lang_pred"] == "en" for x in langid.identify_languages(docs).collect())
    assert simhash.near_duplicates(docs).count() == len(texts)


def test_texts_of_one_id(spark):
    r = random.Random(8)
    shared, other = prose(r, 80), prose(r, 200)
    data = [(1, shared + " x"), (1, "short text"), (2, "y " + shared), (2, other), (2, None), (3, other)]
    docs = docs_of(spark, data)
    found = suffixes.repeated_passages(docs).collect()
    covered = collections.Counter()
    for x in found:
        covered[x["doc_id"]] += 1
    assert set(covered) == {1, 2, 3} and all(x["doc_id"] not in x["other_docs"] for x in found)
    want = sorted((str(i), int(p), str(c)) for i, p, c in brute_components(data))
    assert sorted((str(x["doc_id"]), x["fp"] % 2**64, str(x["component_id"])) for x in simhash.near_duplicates(docs).collect()) == want
    for made in (secrets.scan_secrets(docs), tokencount.count_tokens(docs, WORDS), bytebpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN), katz.katz_scores(docs), langid.identify_languages(docs)):
        assert sorted(x["doc_id"] for x in made.collect()) == [1, 1, 2, 2, 2, 3]
    labels = spark.createDataFrame([(i % 3 + 1, i % 2) for i in range(60)], "doc_id bigint, quality int")
    x, y = quality.training_rows(docs, labels, 2)
    assert len(x) == len(y) == 2  # the bound holds although ids repeat


def test_clashing_columns(spark):
    docs = docs_of(spark, [(1, "a b c d"), (2, "x y")])
    bench = spark.createDataFrame([(7, "b c", 1, "clash", 5)], "item_id bigint, text string, doc_id bigint, n_words string, batch int")
    got = {x["doc_id"]: (x["n_hit"], x["items"]) for x in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (2, ["7"]), 2: (0, [])}
    assert decontaminate.decontaminate(docs, bench, clean="spans").columns == docs.columns
    labels = spark.createDataFrame([(1, 1, 0, "clash", "clash")], "doc_id bigint, quality int, toxic int, text string, quality_score string")
    assert quality.judge_quality(docs, labels).count() == 2
    pages = spark.createDataFrame([(1, "http://a/b", "clash", "clash")], "page_id bigint, url string, host string, verdict string")
    assert urlfilter.filter_urls(pages, [("block", "a", "")]).columns == ["page_id", "host", "path", "rule", "verdict"]
    more = docs.withColumnsRenamed({"fp": "first", "n_words": "component_id"})
    assert simhash.deduplicate(more).columns == more.columns and simhash.near_duplicates(more).count() == 2
    assert suffixes.repeated_passages(more).count() == 0 and docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


def test_novel_spans_of_every_token():
    """Against a plain reading of the rule: every string of context, whatever stands before it."""
    import math
    import re

    r, n = random.Random(5), secrets.Novelty()
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = ["token", "the key is", "internationalisation", "bearer:", "plain words", "x" * 17, "a1" * 12]
    for _ in range(300):
        text = " ".join(r.choice([*parts, "".join(r.choice(chars) for _ in range(r.randrange(14, 30))), "\n"]) for _ in range(8))
        base = secrets.base_spans(text)
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]*", text):
            word = m[0].rstrip(".=")
            near = any(0 <= m.start() - c.end() <= 40 and "\n" not in text[c.end() : m.start()] for c in re.finditer(r"(?i)auth|bearer|credential|private|signature|passphrase|pwd|passw|secret|token|key", text))
            end = m.start() + len(word)
            if len(m[0]) < 16 or len(word) < 16 or not near or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word) or any(s < end and m.start() < e for s, e, _ in base):
                continue
            around = text[max(0, m.start() - 160) : m.start()] + text[end : end + 160]
            share = (len(n.press.compress((around + word).encode())) - len(n.press.compress(around.encode()))) / len(word)
            size = sum(k for kind, k in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10)) if re.search(kind, word)) + len(set(word) & set("+/_.=-"))
            if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word):
                size = 16
            elif re.fullmatch("[A-Z2-7]+|[a-z2-7]+", word):
                size = 32
            if share >= 0.8 * math.log2(size) / 8:
                want.add((m.start(), end))
        got = {(s, e) for s, e, _, _ in secrets.novel_spans(text, base, n, 0.8)}
        assert got == want
