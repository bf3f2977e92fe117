"""SimHash near-duplicates: fingerprints, and meet-in-the-middle ball hashing to link those within three bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, staged
from .components import connected_components

RADIUS = 3
#: Three blocks of bits, (first, width). A difference of three bits leaves two at most outside some block.
BLOCKS = ((0, 21), (21, 22), (43, 21))
_ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half of the hashes of the text's word shingles. No words: 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    codes = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(codes), 65_536):
        part = codes[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(codes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for b in chunks(batch, 1):
                fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp bigint")


def outside(fp: np.ndarray, block: int) -> tuple[np.ndarray, int]:
    """The bits outside a block, moved together, and how many they are."""
    first, width = BLOCKS[block]
    low = fp & ((_ONE << np.uint64(first)) - _ONE)
    top = first + width
    high = fp >> np.uint64(top) if top < 64 else np.zeros_like(fp)
    return low | high << np.uint64(first), 64 - width


def ball(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of all variants: one block erased, and at most one of the other bits flipped."""
    keys, owners = [], []
    for block in range(len(BLOCKS)):
        rest, n = outside(fp, block)
        flips = np.concatenate((np.zeros(1, np.uint64), _ONE << np.arange(n, dtype=np.uint64)))
        keys.append(((rest[:, None] ^ flips[None, :]) | np.uint64(block << 60)).ravel())
        owners.append(np.repeat(fp, n + 1))
    return np.concatenate(keys), np.concatenate(owners)


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j) over 0..n-1."""
    up, out = list(range(n)), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def links_in_bucket(fp: np.ndarray, block: int, key: int) -> list[tuple[int, int]]:
    """Edges that connect what is within three bits among distinct fingerprints that share a key; fewer than members.

    A small bucket is verified pair by pair in memory. In a large one, members with the same block differ by two bits
    at most, those whose blocks differ in one bit by three at most: both need no pairs, only one representative for
    each value of the block. Left are those alike outside the block with three differing bits in it.
    """
    n = len(fp)
    if n <= 512:
        close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS
        return _forest(n, np.argwhere(np.triu(close, 1)).tolist())
    first, width = BLOCKS[block]
    value = ((fp >> np.uint64(first)) & ((_ONE << np.uint64(width)) - _ONE)).astype(np.int64)
    holder: dict[int, int] = {}
    pairs = []
    for i, v in enumerate(value.tolist()):
        j = holder.setdefault(v, i)
        if j != i:
            pairs.append((j, i))
    for v, i in holder.items():
        for bit in range(width):
            j = holder.get(v ^ (1 << bit))
            if j is not None and j < i:
                pairs.append((j, i))
    rest, _ = outside(fp, block)
    same = np.flatnonzero(rest == np.uint64(key & ((1 << 60) - 1)))
    if len(same) > 1:
        own = {int(value[i]): int(i) for i in same}
        trips = [(1 << a) | (1 << b) | (1 << c) for a in range(width) for b in range(a) for c in range(b)]
        if len(own) > len(trips):
            pairs += [(i, own[v ^ t]) for v, i in own.items() for t in trips if v ^ t in own]
        else:
            values, at = np.array(list(own)), np.array(list(own.values()))
            for x in range(1, len(values)):
                pairs += [(int(at[x]), int(at[y])) for y in np.flatnonzero(np.bitwise_count(values[:x] ^ values[x]) == RADIUS)]
    return _forest(n, pairs)


def _buckets(batches):
    """Whole buckets from rows sorted by key, a chunk of them at a time: (keys, fingerprints)."""
    held_k, held_f = [], []
    for b in batches:
        k, f = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)
        if not len(k):
            continue
        cut = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1], side="left"))
        if cut or (held_k and held_k[-1][-1] != k[0]):
            if cut:
                held_k.append(k[:cut])
                held_f.append(f[:cut])
            yield np.concatenate(held_k), np.concatenate(held_f)
            held_k, held_f = [], []
        held_k.append(k[cut:])
        held_f.append(f[cut:])
    if held_k:
        yield np.concatenate(held_k), np.concatenate(held_f)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within three bits. distinct: (fp), each once."""
    spark = distinct.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 1000):
                keys, owners = ball(fp[i : i + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], names=["k", "fp"])

    def meet(batches):
        for k, fp in _buckets(batches):
            edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a ^ b) <= RADIUS
            us, vs = [a[near]], [b[near]]
            for start, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own, key = fp[start : start + n], int(k[start])
                found = links_in_bucket(own, key >> 60, key)
                if found:
                    i, j = np.array(found).T
                    us.append(own[i])
                    vs.append(own[j])
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            u, v = np.maximum(u, v), np.minimum(u, v)
            pairs = np.unique(np.stack([u, v], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    variants = distinct.repartition(tasks).mapInArrow(emit, "k bigint, fp bigint")
    return variants.repartition("k").sortWithinPartitions("k").mapInArrow(meet, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    Documents are linked if their fingerprints differ in three bits or fewer; component_id is the smallest doc_id
    reachable. Exact copies of a fingerprint are first reduced to one, pre-aggregated before the shuffle. Each then
    emits the 131 variants of ball(): any two within three bits share one of them, or agree outside a block and differ
    in it. Rows of a key meet in one task as a stream; a fingerprint has one row there, and no pairs leave it, only a
    spanning forest. Components are found in the cluster.

    Null and wordless texts have fingerprint zero and are linked like any other. Null ids get the component of their
    fingerprint (null if it has no id at all); repeated rows give repeated results; an empty table gives an empty one.
    """
    printed = staged(fingerprints(docs), "fingerprints")
    first = staged(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(first.select("fp")))
    member = staged(roots.join(first, roots.node == first.fp).select("fp", "root", "first"), "members")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = member.join(least, "root").select("fp", "least")
    known = first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return printed.join(known, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id: one document of each component stays.

    Rows of one doc_id are one document and stay or go together; rows without an id stay. All columns are kept.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
