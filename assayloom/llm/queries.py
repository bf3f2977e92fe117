"""The registered queries of the text operators. Each module's queries are added by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.format_string("%.3f", x["novelty"])), ",").alias("novelty"),
    )


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytebpe import bpe_round_trip

    made = bpe_round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return counted.select("*", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_dedup, op2_simhash, op3_secret_scan, op4_katz_scores, op5_language_id, op6_url_filter, op7_quality_rules, op8_decontamination, op9_byte_bpe, op10_token_counts,
    )

}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    # documents and items are told apart by number, so that rows of one id stay apart
    "op8_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, len(w) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS v FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(v) AS n FROM g),
p AS (SELECT k, s, n, list_slice(w, s, s + n - 1) AS v FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n AND w[s] IN (SELECT v[1] FROM g)),
h AS (SELECT p.k, p.s, p.n, g.item FROM p JOIN g ON g.v = p.v),
c AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT k, s, n FROM h), unnest(range(s, s + n)) AS t(pos) GROUP BY k),
o AS (SELECT k, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN o USING (k)""",
    "op6_url_filter": rf"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}) AS t(v, h, q)),
m AS (
  SELECT page_id, host, path,
    (SELECT max_by(struct_pack(r := h || q, v := v), length(h) + length(q)) FROM r
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS best
  FROM p)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM m""",
}
