"""Language-model scores: word bigrams with Katz backoff, counted and looked up through partitioned tables.

Documents are packed into blocks of tokens. What a block must know of the whole corpus, it asks for by 64-bit keys: it
sends each distinct key once to the key's bucket with its own amount, the bucket adds up what all blocks sent and
answers in the order of the question. So a key met everywhere is one entry a block, nothing is broadcast but a few
numbers, and what is shuffled grows with the corpus. A model is the buckets' own tables: counts of words and bigrams,
and backoff weights, by kind and bucket; later texts are scored by putting their questions to these.
"""

from __future__ import annotations

import json
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, staged
from .suffixes import _mixed, word_codes

CUT = 5  # counts up to this one are discounted by Good-Turing
RANKS = 30  # counts up to this one have their numbers fitted by a line
LEAST = 0.05  # what larger counts give up, so that every history has something to back off with
_END = np.uint64(0x0E4D0E4D0E4D0E4D)
_BEGIN = np.uint64(0xBE617BE617BE617B)
_REQUEST = "kind int, bucket int, block bigint, payload binary"
_ANSWER = "kind int, bucket int, block bigint, payload binary, stats array<double>"
_FIELDS = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())]
_SCHEMAS = {_REQUEST: pa.schema(_FIELDS), _ANSWER: pa.schema([*_FIELDS, ("stats", pa.list_(pa.float64()))])}


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes laid out column by column and plane by plane, compressed."""
    parts = []
    for a in arrays:
        flat = np.ascontiguousarray(a.T)
        parts.append((flat.dtype.str, flat.shape, np.ascontiguousarray(flat.view(np.uint8).reshape(flat.size, -1).T).tobytes() if flat.size else b""))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, shape, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        d = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8).reshape(d.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(d).reshape(shape).T if raw else np.zeros(shape, d).T)
    return out


def block_table(docs: DataFrame, tokens_per_block: int) -> DataFrame:
    """(block, payload): ids, flags and token numbers of the documents of a block, and its distinct words' hashes."""
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(part == 2, F.lit(False)).alias("held"),
        F.coalesce(part != 2, F.lit(False)).alias("train"), "text",
    )

    def run(batches):
        base = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = number = 0

        def block():
            words, tokens = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            known = np.array([x[0] is not None for x in held])
            payload = _pack(
                np.array([x[0] or 0 for x in held], np.int64), known, np.array([x[1] for x in held], bool),
                np.array([x[2] for x in held], bool), np.array([len(x[3]) for x in held], np.int32), words, tokens.astype(np.uint32),
            )
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for b in chunks(batch, 3):
                for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    codes = np.append(word_codes(row[3]), _END)
                    held.append((*row[:3], codes))
                    size += len(codes)
                    if size >= tokens_per_block:
                        yield block()
                        held, size, number = [], 0, number + 1
        if held:
            yield block()

    return rows.mapInArrow(run, "block bigint, payload binary")


class Block:
    """A block's documents: `words` (sorted hashes) with BEGIN as one more history at the end, `tokens` and `history`
    as numbers of words, and `pairs`, its distinct bigrams in the order of their keys, with each token's `pair`."""

    def __init__(self, payload: bytes):
        self.doc_id, self.known, self.held, self.train, self.length, self.words, tokens = _unpack(payload)
        self.tokens = tokens.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.length)), self.length)
        self.taught = self.train[self.doc]
        n = len(self.words)
        self.history = np.concatenate(([n], self.tokens[:-1]))
        self.history[np.cumsum(self.length)[:-1]] = n
        self.history[0] = n
        self.histories = np.append(self.words, _BEGIN)
        codes, pair = np.unique(self.history * n + self.tokens, return_inverse=True)
        h, w = codes // n, codes % n
        keys = _mixed(self.histories[h] * np.uint64(0x9E3779B97F4A7C15) + self.words[w])
        order = np.argsort(keys, kind="stable")
        self.keys, self.pair_history, self.pair_word = keys[order], h[order], w[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[pair]
        self.order = np.argsort(self.histories, kind="stable")  # BEGIN has its place among the words' hashes

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts in the block's training documents: of words, of bigrams."""
        return (
            np.bincount(self.tokens[self.taught], minlength=len(self.words)).astype(np.uint32),
            np.bincount(self.pair[self.taught], minlength=len(self.keys)).astype(np.uint32),
        )


def _dealt(kind: int, block: int, buckets: int, keys: np.ndarray, *values: np.ndarray):
    """Rows for the buckets of sorted keys; buckets are ranges, so answers put in their order fit the keys."""
    which = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(which, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[b], cuts[b + 1])
        yield kind, b, block, _pack(keys[s], *(v[s] for v in values))


def _batch(rows, ddl: str) -> pa.RecordBatch:
    schema = _SCHEMAS[ddl]
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _answered(requests: DataFrame, add_up) -> DataFrame:
    """Bring the requests of a bucket together and let add_up(kind, bucket, rows) give its answers, bucket by bucket.

    Rows of no block come first: what an earlier model's bucket holds.
    """

    def run(batches):
        held, at = [], None
        for b in batches:
            for kind, bucket, block, payload in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if at != (kind, bucket):
                    if held:
                        yield _batch(add_up(*at, held), _ANSWER)
                    held, at = [], (kind, bucket)
                held.append((block, payload))
        if held:
            yield _batch(add_up(*at, held), _ANSWER)

    return requests.repartition("bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(run, _ANSWER)


def _shared_out(kind: int, bucket: int, rows: list[tuple[int, bytes]], asked: list[list], answer: np.ndarray):
    at = 0
    for (block, _), a in zip(rows, asked, strict=True):
        if len(a[0]):
            yield kind, bucket, block, _pack(answer[at : at + len(a[0])]), None
        at += len(a[0])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x if (x >> np.uint64(32)).any() else x.astype(np.uint32)


def _count(kind: int, bucket: int, rows: list[tuple[int, bytes]]):
    """Totals for every question; a row for the model: keys and totals; and one row of figures: keys with a count,
    their sum, counts of counts 1..RANKS.

    An answer is the total times two; plus one for the first block that asks for a key, which speaks for it later.
    """
    asked = [_unpack(p) for _, p in rows]
    keys, counts = np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked])
    kinds, first, which = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(which, counts, len(kinds)).astype(np.uint64)
    answer = total[which] * np.uint64(2)
    answer[first] += np.uint64(1)
    yield from _shared_out(kind, bucket, rows, asked, _narrow(answer))
    small = np.bincount(np.minimum(total, RANKS + 1).astype(np.int64), minlength=RANKS + 2)
    known = total > 0
    model = _pack(kinds[known], _narrow(total[known]))
    yield kind, bucket, None, model, [float(known.sum()), float(total.sum()), *map(float, small[1 : RANKS + 1])]


def _backoff(model: Model):
    def add_up(kind: int, bucket: int, rows: list[tuple[int, bytes]]):
        """log10 of what a history's seen bigrams leave over, in counts, less that of the mass of words not seen after it.

        Both come as whole numbers, so they add up exactly, whoever tells them: bigrams by count and words by count.
        """
        asked = [_unpack(p) for _, p in rows]
        keys, wants, told = (np.concatenate([a[i] for a in asked]) for i in range(3))
        kinds, which = np.unique(keys, return_inverse=True)
        sums = np.stack([np.bincount(which, c, len(kinds)) for c in told.T], 1)
        weight = model.weight(sums)
        seen = sums[:, : CUT + 1].any(1)
        answers = [[a[0][a[1]]] for a in asked]
        yield from _shared_out(kind, bucket, rows, answers, weight[which[wants]])
        yield kind, bucket, None, _pack(kinds[seen], weight[seen]), None

    return add_up


def discounts(of_counts: list[float]) -> np.ndarray:
    """Discounted counts for 0..CUT by Katz's formula, from the numbers of things counted 1, 2, ... times.

    These numbers are smoothed as in simple Good-Turing: each is divided by half the distance between its neighbours
    that occur, and a straight line is fitted to their logarithms over those of the counts. A slope above -1.1 (or
    one that two numbers are lacking for: -2) is held there, so discounts always lie between nothing and the count.
    """
    n = np.array([0.0, *of_counts])
    r = np.flatnonzero(n)
    slope = -2.0
    if len(r) > 1:
        before = np.concatenate(([0], r[:-1]))
        after = np.append(r[1:], 2 * r[-1] - r[-2])
        slope = float(np.polyfit(np.log(r), np.log(2 * n[r] / (after - before)), 1)[0])
    power = min(slope, -1.1) + 1
    out, k = np.zeros(CUT + 1), np.arange(1, CUT + 1)
    common = (CUT + 1.0) ** power
    out[1:] = k * ((1 + 1 / k) ** power - common) / (1 - common)
    return out


def discounted(count: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(count > CUT, count - LEAST, table[np.minimum(count, CUT).astype(np.int64)])


def _joined(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """(block, payload, answers): each block with all its answers, which are no more than its own tokens."""
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    own = every.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "payload")).alias("answers"))
    return blocks.join(own, "block")


def _read(answers: list[dict], kind: int) -> np.ndarray:
    rows = sorted((a["bucket"], a["payload"]) for a in answers if a["kind"] == kind)
    return np.concatenate([_unpack(p)[0] for _, p in rows])


def _classes(count: np.ndarray) -> np.ndarray:
    """Columns for counts 1..CUT and above; counts of 0 have the last column, which is cut off."""
    return np.where(count > CUT, CUT, np.where(count > 0, count - 1, CUT + 1)).astype(np.int64)


class Model:
    """The numbers that every task needs: tokens, distinct tokens and documents of training, discounts of both orders."""

    def __init__(self, words: list[float], bigrams: list[float], documents: int):
        self.distinct, self.tokens = int(words[0]), int(words[1])
        self.documents = documents
        self.unigram, self.bigram = discounts(words[2:]), discounts(bigrams[2:])
        n, r = np.array(words[2:][:CUT]), np.arange(1, CUT + 1)
        large = self.distinct - n.sum()
        mass = (n * self.unigram[1:]).sum() + (self.tokens - (n * r).sum() - LEAST * large)
        self.unknown = 1 - mass / self.tokens if self.tokens else 1.0

    def word(self, count: np.ndarray) -> np.ndarray:
        """Probability of words by their training counts; all unknown words are one word."""
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, discounted(count, self.unigram) / self.tokens, self.unknown)

    def told(self, block: Block, answers: list[dict]):
        """Counts of histories, words and bigrams, and which bigrams the block speaks for."""
        words = (_read(answers, 0) >> 1).astype(np.int64)
        both = _read(answers, 1)
        return np.append(words, self.documents), words, (both >> 1).astype(np.int64), (both & 1).astype(bool)

    @staticmethod
    def share(block: Block, words: np.ndarray, pairs: np.ndarray, speaks: np.ndarray) -> np.ndarray:
        """Of each history, in whole numbers, from the bigrams that the block speaks for: bigrams by their count (1..CUT
        and above), their words by count likewise, and the sum of the counts of the words above."""
        seen = speaks & (pairs > 0)
        h, after, n = block.pair_history[seen], words[block.pair_word[seen]], len(block.histories)
        out = np.zeros((n, 2 * (CUT + 2) + 1), np.int64)
        np.add.at(out, (h, _classes(pairs[seen])), 1)
        np.add.at(out, (h, CUT + 2 + _classes(after)), 1)
        np.add.at(out[:, -1], h, np.where(after > CUT, after, 0))
        return np.delete(out, [CUT + 1, 2 * CUT + 3], 1).astype(np.uint64)

    def weight(self, sums: np.ndarray) -> np.ndarray:
        """log10 of the backoff weight times the history's count, from the sums of share()."""
        pairs, words, counts = sums[:, : CUT + 1], sums[:, CUT + 1 : 2 * CUT + 2], sums[:, -1]
        gives = np.append(np.arange(1, CUT + 1) - self.bigram[1:], LEAST)
        lower = words[:, :CUT] @ self.unigram[1:] + counts - LEAST * words[:, CUT]
        left = np.maximum(self.tokens - lower, self.tokens * 1e-12)
        return np.log10(np.where(pairs.any(1), pairs @ gives, 1.0)) - np.log10(left / max(self.tokens, 1))


def _lacking(block: Block, histories: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Histories that were counted, with a bigram in the block that wasn't."""
    out = np.zeros(len(block.histories), bool)
    out[block.pair_history[pairs == 0]] = True
    return out & (histories > 0)


def _scored(model: Model, block: Block, answers: list[dict]) -> pa.RecordBatch:
    histories, words, pairs, _ = model.told(block, answers)
    weight, h, o = np.zeros(len(histories)), block.pair_history, block.order
    asked = o[_lacking(block, histories, pairs)[o]]
    if len(asked):
        weight[asked] = _read(answers, 3) - np.log10(histories[asked])
    seen = np.log10(np.where(pairs > 0, discounted(pairs, model.bigram), 1.0)) - np.log10(np.maximum(histories[h], 1))
    pair = np.where(pairs > 0, seen, weight[h] + np.log10(model.word(words))[block.pair_word])
    count, docs_n = words[block.tokens], len(block.length)
    base = np.log10(count + 1) - np.log10(model.tokens + model.distinct + 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.doc_id, mask=~block.known), pa.array(block.held), pa.array(block.length.astype(np.int64)),
            pa.array(np.bincount(block.doc[count > 0], minlength=docs_n)), pa.array(np.full(docs_n, model.tokens)),
            pa.array(np.bincount(block.doc, base, docs_n)), pa.array(np.bincount(block.doc, pair[block.pair], docs_n)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _questions(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for b in batches:
            for k, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block = Block(payload)
                words, pairs = block.own_counts()
                rows = [*_dealt(0, k, buckets, block.words, words), *_dealt(1, k, buckets, block.keys, pairs)]
                rows.append((2, 0, k, _pack(np.zeros(1, np.uint64), np.array([block.train.sum()], np.uint32))))
                yield _batch(rows, _REQUEST)

    return blocks.mapInArrow(ask, _REQUEST)


def _wishes(told: DataFrame, model: Model, buckets: int, teach: bool) -> DataFrame:
    """Requests for backoff weights; with teach, along with what the block knows of its histories."""

    def run(batches):
        for b in batches:
            for k, payload, answers in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(payload)
                histories, words, pairs, speaks = model.told(block, answers)
                wants, o = _lacking(block, histories, pairs), block.order
                knows = model.share(block, words, pairs, speaks & teach)
                o = o[(wants | knows.any(1))[o]]
                yield _batch(list(_dealt(3, k, buckets, block.histories[o], wants[o], knows[o])), _REQUEST)

    return told.mapInArrow(run, _REQUEST)


def katz_scores(docs: DataFrame, *, tokens_per_block: int = 500_000, model_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens (N), base_score, score.

    Tokens are the words (kept apart by ASCII white space, A-Z as a-z) and one end. Counts come from the documents with
    crc32(id as text) mod 7 other than 2. score is log10 of the text's probability under P(w|h): the discounted count
    of (h, w) over that of h where (h, w) was counted, otherwise the backoff weight of h times P(w); an uncounted h
    has weight one. P(w) is Good-Turing discounted too, and what that leaves is the unknown word's. The weights make
    every P(.|h) sum to one over the counted words and the unknown one: what goes into them adds up as whole numbers.
    base_score is the add-one unigram score. 64-bit hashes stand for words and bigrams.

    Blocks hold about `tokens_per_block` tokens, and there is a bucket for every eight blocks at least, so both bound a
    task's memory whatever the corpus. model_path: keep the model there, for score_with(); else it goes with the session.

    Null text counts as empty: one token, the end. Null ids teach nothing and aren't held out. Repeated rows are scored
    (and counted) each, and equal texts have equal scores; an empty table gives an empty one; with nothing to learn
    from, every token is unknown and has probability one. Of few data, discounts() says what it makes. Ids must be integers.
    """
    spark = docs.sparkSession
    blocks = staged(block_table(docs, tokens_per_block), "blocks")
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 8)
    counted = staged(_answered(_questions(blocks, buckets), _count), "counts")
    figures = {
        r["kind"]: [r[f"s{i}"] for i in range(RANKS + 2)]
        for r in counted.where("stats IS NOT NULL")
        .groupBy("kind").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(RANKS + 2))).collect()
    }
    none = [0.0] * (RANKS + 2)
    told = (figures.get(0, none), figures.get(1, none), int(figures.get(2, none)[1]))
    model = Model(*told)
    weights = staged(_answered(_wishes(_joined(blocks, counted), model, buckets, True), _backoff(model)), "weights")
    if model_path:
        own = counted.where("kind < 2").unionByName(weights).where("block IS NULL").select("kind", "bucket", "payload")
        own.write.mode("overwrite").partitionBy("kind").parquet(f"{model_path}/tables")
        spark.createDataFrame([(json.dumps([*told, buckets]),)], "figures string").write.mode("overwrite").text(f"{model_path}/figures")

    def score(batches):
        for b in batches:
            for payload, answers in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield _scored(model, Block(payload), answers)

    return _joined(blocks, counted, weights).mapInArrow(score, _SCORES)


def score_with(docs: DataFrame, model_path: str, *, tokens_per_block: int = 500_000) -> DataFrame:
    """The columns of katz_scores() for other documents, which teach nothing, under a model that it has kept.

    Odd input has the results that it has there; held_out is of the id alone.
    """
    spark = docs.sparkSession
    words, bigrams, documents, buckets = json.loads(spark.read.text(f"{model_path}/figures").first()[0])
    model = Model(words, bigrams, documents)
    held = spark.read.parquet(f"{model_path}/tables").select("kind", "bucket", F.lit(None).cast("bigint").alias("block"), "payload")
    blocks = staged(block_table(docs, tokens_per_block), "blocks")

    def look_up(kind: int, bucket: int, rows: list[tuple[int, bytes]]):
        keys, values = _unpack(rows[0][1]) if rows[0][0] is None else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        rows = rows[1:] if rows[0][0] is None else rows
        asked = [_unpack(p) for _, p in rows]
        if not asked:
            return
        wanted = np.concatenate([a[0] for a in asked])
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        found = np.where(keys[at] == wanted, values[at], 0) if len(keys) else np.zeros(len(wanted), values.dtype)
        yield from _shared_out(kind, bucket, rows, asked, _narrow(found.astype(np.uint64) * np.uint64(2)) if kind < 2 else found)

    asked = _questions(blocks, buckets).where("kind < 2")
    counted = staged(_answered(asked.unionByName(held.where("kind < 2")), look_up), "counts")
    wishes = _wishes(_joined(blocks, counted), model, buckets, False)
    weights = staged(_answered(wishes.unionByName(held.where("kind = 3")), look_up), "weights")

    def score(batches):
        for b in batches:
            for payload, answers in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield _scored(model, Block(payload), answers)

    return _joined(blocks, counted, weights).mapInArrow(score, _SCORES)
