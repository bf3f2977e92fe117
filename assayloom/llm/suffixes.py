"""Repeated passages by sparse suffixes: windows around minimisers that documents share, grouped by their hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, staged
from .components import connected_components

#: Words are kept apart by space and U+0009-0D; A-Z count as a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when asked for longer texts."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 65_536)
            made = []
            for factor in (self.base, self.inverse):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    up, down = _BYTES.get(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    start, end = edge[::2], edge[1::2]
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def gram_codes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))
    return _mixed((total[k:] - total[:n]) * down[:n])


def minimisers(codes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least code in each window of w (in a shorter sequence: of the whole).

    Of equal codes a window's first counts; where copies of one code follow each other closely, as in a text that
    repeats a word, only so many are kept that every window still has one.
    """
    if len(codes) <= w:
        return np.argmin(codes, keepdims=True) if len(codes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(codes, w)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    if len(at) > 2 and (codes[at[1:]] == codes[at[:-1]]).any():
        kept = [int(at[0])]
        for i in range(1, len(at)):
            after = at[i + 1] if i + 1 < len(at) and codes[at[i + 1]] == codes[at[i]] else None
            if codes[at[i]] == codes[kept[-1]] and after is not None and after - kept[-1] <= w:
                continue
            kept.append(int(at[i]))
        at = np.array(kept)
    return at


def anchors(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(key, doc_id, pos): the hash of the k words at each minimiser position."""

    def run(batches):
        for batch in batches:
            for b in chunks(batch, 1):
                keys, ids, places = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    codes = gram_codes(word_codes(text), k)
                    at = minimisers(codes, w)
                    if len(at):
                        keys.append(codes[at].view(np.int64))
                        ids.append(np.full(len(at), doc, np.int64))
                        places.append(at.astype(np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (keys, ids, places)], names=["key", "doc_id", "pos"]
                    )

    return docs.mapInArrow(run, "key bigint, doc_id bigint, pos int")


def _least(codes: np.ndarray, w: int) -> np.ndarray:
    """The least code of each window of w, by doubling."""
    out, size = codes, 1
    while 2 * size <= w:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(out) - (w - size)], out[w - size :])


def windows(docs: DataFrame, places: DataFrame, k: int, size: int) -> DataFrame:
    """(code, doc_id, start): the hash of every window of `size` words whose least k-gram is one of the places."""
    by_doc = places.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))  # a text's own places, no more
    rows = docs.join(by_doc, "doc_id").select("doc_id", "text", "places")

    def run(batches):
        for batch in batches:
            for b in chunks(batch, 1, 2_000_000):
                codes, ids, starts = [], [], []
                for doc, text, where in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    words = word_codes(text)
                    if len(words) < size:
                        continue
                    grams = gram_codes(words, k)
                    pos = np.array(where, np.int64)
                    known = np.unique(grams[pos[pos < len(grams)]])  # rows of one doc_id may differ in length
                    at = np.flatnonzero(np.isin(_least(grams, size - k + 1), known))
                    codes.append(gram_codes(words, size)[at].view(np.int64))
                    ids.append(np.full(len(at), doc, np.int64))
                    starts.append(at.astype(np.int32))
                if codes:
                    made = pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (codes, ids, starts)], names=["code", "doc_id", "start"]
                    )
                    yield from (made.slice(i, 200_000) for i in range(0, made.num_rows, 200_000))

    return rows.mapInArrow(run, "code bigint, doc_id bigint, start int")


def _stretches(sorted_rows: DataFrame, size: int) -> DataFrame:
    """Windows (doc_id, start, other), sorted within partitions, merged where they overlap or touch."""

    def told(rows):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] + size for r in rows], pa.int64()),
                pa.array([r[2] + size - r[1] for r in rows], pa.int64()), pa.array([sorted(r[3]) for r in rows], pa.list_(pa.int64())),
                pa.array([r[0] < min(r[3]) for r in rows], pa.bool_()),
            ],
            names=["doc_id", "start_word", "end_word", "n_words", "other_docs", "first_doc"],
        )

    def run(batches):
        held = None  # document, first and last start, others
        for b in batches:
            if not b.num_rows:
                continue
            doc, start, other = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)) + 1
            out = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
                others = set(np.unique(other[i:j]).tolist())
                if held and held[0] == doc[i] and start[i] <= held[2] + size:
                    held[2] = int(start[j - 1])
                    held[3] |= others
                else:
                    if held:
                        out.append(held)
                    held = [int(doc[i]), int(start[i]), int(start[j - 1]), others]
            yield told(out)
        if held:
            yield told([held])

    return sorted_rows.select("doc_id", "start", "other").mapInArrow(
        run, "doc_id bigint, start_word bigint, end_word bigint, n_words bigint, other_docs array<bigint>, first_doc boolean"
    )


def repeated_passages(docs: DataFrame, *, min_words: int = 50, k: int = 25) -> DataFrame:
    """Passages of `min_words` words or more that also stand in another document, merged where they overlap.

    One row per stretch: doc_id, start_word, end_word (exclusive), n_words, other_docs, first_doc, class_id, n_links.
    other_docs (sorted) has for each window of `min_words` words the smallest id that shares it, or where that is the
    row's own, the largest; so it names every representative, not every sharer. first_doc: no document that shares a
    window of the stretch has a smaller id. class_id is the smallest doc_id that links from documents to the
    representatives of their windows lead to, n_links the number of these links in the class. Documents without such
    passages have no row. Words are kept apart by ASCII white space, A-Z count as a-z.

    Every window of `min_words` words holds a minimiser of its k-grams, about two in min_words - k + 2 positions, and
    windows alike have it at the same place. K-grams that only one document has are dropped by a pre-aggregated count;
    of the rest, each window around its own minimiser (all divisions into words before and after it) is grouped by its
    hash, with a pre-aggregated smallest and largest id. No pairs are made, and nothing depends on how many documents
    share a passage. Hashes of 64 bits stand for k-grams and windows.

    Rows need an integer doc_id; those without one are left out, null texts have no words. Rows of one doc_id count as
    one document. Repeats inside one document alone are no match. Empty tables give an empty one.
    """
    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lo_hi = F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    found = staged(anchors(source, k, min_words - k + 1), "anchors")
    # a table of its own, so that the join below has exchanges of its own and Spark can split a key that is everywhere
    shared = staged(found.groupBy("key").agg(*lo_hi).where("lo < hi").select("key"), "shared")
    places = found.join(shared, "key").select("doc_id", "pos")
    rows = staged(windows(source, places, k, min_words), "windows")
    dropped(found, shared)
    ends = staged(rows.groupBy("code").agg(*lo_hi).where("lo < hi"), "ends")
    other = F.when(F.col("lo") < F.col("doc_id"), F.col("lo")).otherwise(F.col("hi")).alias("other")
    seen = staged(rows.join(ends, "code").select("doc_id", "start", other), "seen")
    dropped(rows, ends)
    spans = staged(_stretches(seen.repartition("doc_id").sortWithinPartitions("doc_id", "start"), min_words), "stretches")
    dropped(seen)
    links = staged(spans.select(F.col("doc_id").alias("u"), F.explode("other_docs").alias("v")).where("v < u").distinct(), "links")
    roots = staged(connected_components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id")), "roots")
    sizes = links.withColumnRenamed("u", "doc_id").join(roots, "doc_id").groupBy("class_id").agg(F.count("*").alias("n_links"))
    classes = staged(roots.join(staged(sizes, "sizes"), "class_id"), "classes")
    return spans.join(classes, "doc_id").select(*spans.columns, "class_id", "n_links")
