"""Benchmark decontamination: a generalised suffix automaton of the test items, read along each document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, with_columns, worker_state

#: Words are runs of other characters than U+0000-2F, 3A-60 and 7B-7F, after A-Z became a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of word sequences, each begun anew at the root, with the windows that its states stand for.

    A window is `width` consecutive words of an item, or all words of a shorter one. `whole[s]` is the state that
    holds the last `width` words of whatever state s has matched, or -1; `short[s]` the short windows that end there.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int = 13):
        self.width = width
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        sequences = []
        for key, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item_words(text)]
            if words:
                sequences.append((str(key), words))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        self.whole = [-1] * len(self.length)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= width:
                up = self.link[s]
                self.whole[s] = self.whole[up] if self.length[up] >= width else s
        self.items_of: dict[int, tuple[str, ...]] = {}
        own_short: dict[int, list[tuple[int, str]]] = {}
        gathered: dict[int, dict[str, None]] = {}
        self.least = width
        pairs = set()
        for key, words in sequences:
            pairs.update(zip(words, words[1:], strict=False))
            state = 0
            for w in words:
                state = self.next[state][w]
                if self.whole[state] >= 0:
                    gathered.setdefault(self.whole[state], {})[key] = None
            if len(words) < width:
                self.least = min(self.least, len(words))
                own_short.setdefault(state, []).append((len(words), key))
        self.items_of = {s: tuple(keys) for s, keys in gathered.items()}
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        for s in order:
            found = tuple(own_short.get(s, ())) + self.short.get(self.link[s], ())
            if found:
                self.short[s] = found
        n = len(self.vocabulary)
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that could hold a window: known words only, and from width 2 on only known neighbours."""
        if not len(codes):
            return []
        known = codes >= 0
        joined = known[:-1] & known[1:]
        if len(self.pairs) and joined.any():
            at = np.flatnonzero(joined)
            want = codes[at] * len(self.vocabulary) + codes[at + 1]
            spot = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
            joined[at[self.pairs[spot] != want]] = False
        else:
            joined[:] = False
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def scan(self, codes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        hit, items = np.zeros(len(codes), bool), set()
        nexts, links, lengths, width = self.next, self.link, self.length, self.width
        for start, end in self.runs(codes):
            state = matched = 0
            for i, w in enumerate(codes[start:end].tolist(), start):
                while state and w not in nexts[state]:
                    state = links[state]
                    matched = lengths[state]
                if w in nexts[state]:
                    state, matched = nexts[state][w], matched + 1
                if matched >= width:
                    hit[i + 1 - width : i + 1] = True
                    items.update(self.items_of[self.whole[state]])
                for n, key in self.short.get(state, ()):
                    if n <= matched:
                        hit[i + 1 - n : i + 1] = True
                        items.add(key)
        return hit, items

    def codes(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)


def automata(benchmark: DataFrame, width: int, words_per_automaton: int) -> list:
    """Broadcast automata of at most about `words_per_automaton` words each: the bound of what a worker holds."""
    sc = benchmark.sparkSession.sparkContext
    out, part, held = [], [], 0
    rows = benchmark.where("item_id IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    for key, text in rows.toLocalIterator():
        n = len(item_words(text))
        if part and held + n > words_per_automaton:
            out.append(sc.broadcast(ItemAutomaton(part, width)))
            part, held = [], 0
        part.append((key, text))
        held += n
    return out + [sc.broadcast(ItemAutomaton(part, width))] * bool(part)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text are, in UTF-8 bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], raw, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def without_hits(text: str, hit: np.ndarray) -> str:
    """The text without the stretches of hit words; what stood between two of them goes too."""
    raw, spans, out, at, k = text.encode("utf-8", "surrogatepass"), word_spans(text), [], 0, 0
    while k < len(spans):
        if not hit[k]:
            k += 1
            continue
        first = k
        while k < len(spans) and hit[k]:
            k += 1
        out.append(raw[at : spans[first][0]])
        at = spans[k - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 13,
    max_share: float = 0.05,
    words_per_automaton: int = 200_000,
    clean: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items (long), items (sorted list), contaminated.

    A document is contaminated where hit words are `max_share` of its words or more. clean: instead return docs' own
    columns, with "spans": hit stretches cut out of every text (n_chars follows where there is such a column), and
    contaminated documents gone; "drop": contaminated documents gone, the rest as they were.

    Documents are read once, each by itself: no shuffle, nothing to skew. The items are broadcast as automata of a
    fixed size; if there are several, tasks load them one after another. Null text has no words; null item ids are
    left out; repeated items or rows change nothing but repeated results (so there are no ties); an empty benchmark
    contaminates nothing, an empty table of documents gives an empty one.
    """
    held = automata(benchmark, width, words_per_automaton)
    source = docs if clean else docs.select("doc_id", "text")
    at = source.columns.index("text")
    if clean:
        out = T.StructType(docs.schema.fields)
    else:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        out = T._parse_datatype_string(
            f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean"
        )
    per_mille = round(max_share * 1000)

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        worker_state()  # what another operator may have left in this process
        schema = to_arrow_schema(out)
        for b in (part for batch in batches for part in chunks(batch, at, 2_000_000)):
            texts = b.column(at).to_pylist()
            words = [item_words(t) for t in texts]
            hits, items = [np.zeros(len(w), bool) for w in words], [set() for _ in words]
            for one in held:
                automaton = one.value if len(held) == 1 else one.load_from_path(one._path)
                for k, w in enumerate(words):
                    hit, found = automaton.scan(automaton.codes(w))
                    if found:
                        hits[k] |= hit
                        items[k] |= found
            n_words, n_hit = [len(w) for w in words], [int(h.sum()) for h in hits]
            bad = [h > 0 and 1000 * h >= per_mille * n for n, h in zip(n_words, n_hit, strict=True)]
            if not clean:
                yield with_columns(
                    b, schema, n_words=n_words, n_hit=n_hit, n_items=[len(x) for x in items],
                    items=[sorted(x) for x in items], contaminated=bad,
                )
                continue
            changed = {}
            if clean == "spans":
                new = [without_hits(t, h) if n else t for t, h, n in zip(texts, hits, n_hit, strict=True)]
                changed = {"text": new}
                if "n_chars" in schema.names:
                    old = b.column(b.schema.get_field_index("n_chars")).to_pylist()
                    changed["n_chars"] = [len(t) if n else o for t, o, n in zip(new, old, n_hit, strict=True)]
            yield with_columns(b, schema, **changed).filter(pa.array([not x for x in bad]))

    return source.mapInArrow(scan, out)
