"""Enrichment by an annotation service over HTTP, with answers kept in a folder: what was asked once is never asked again."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_annotations


def _post(endpoint: str, body: str) -> str:
    request = urllib.request.Request(endpoint, body.encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=120) as answer:  # noqa: S310
        return answer.read().decode()


def request_key(request: dict) -> str:
    """SHA-256 of a request, whatever the order of its fields and genes."""
    told = {k: sorted(v) if isinstance(v, (list, set, tuple)) else v for k, v in request.items()}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def annotate(
    spark: SparkSession, queries: dict[str, list[str]], background: list[str], *, endpoint: str, cache: str, sources: tuple[str, ...], organism: str = "hsapiens", threshold: float = 0.05, offline: bool = False,
    post: Callable[[str, str], str] = _post,
) -> tuple[DataFrame, dict[str, str]]:
    """The service's rows for each query (query, source, term_id, name, p_value), and SHA-256 of each answer by query.

    Answers are kept in `cache` by their request's key. offline: an answer that isn't there is an error, nothing is sent.
    Genes are lists of a few thousand names on the driver.
    """
    if not 0 <= threshold <= 1 or not background or not sources:
        raise ValueError("there must be a background, sources, and a threshold within 0 and 1")
    os.makedirs(cache, exist_ok=True)
    parts, digests = None, {}
    for name, genes in queries.items():
        request = {"organism": organism, "query": sorted(set(genes)), "sources": sorted(sources), "background": sorted(set(background)), "user_threshold": threshold, "domain_scope": "custom"}
        path = os.path.join(cache, f"{request_key(request)}.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                answer = f.read()
        elif offline:
            raise FileNotFoundError(f"no answer is kept for {name}, and nothing may be asked")
        else:
            answer = post(endpoint, json.dumps(request))
            json.loads(answer)
            with open(f"{path}.part", "w", encoding="utf-8") as f:
                f.write(answer)
            os.replace(f"{path}.part", path)
        digests[name] = hashlib.sha256(answer.encode()).hexdigest()
        rows = read_annotations(spark, answer).select(F.lit(name).alias("query"), "*")
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        raise ValueError("there is no query")
    return parts, digests
