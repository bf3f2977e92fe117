"""Token counts: lengths of frequent pre-tokens from a broadcast table, the rest from worker caches."""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import compiled
from .common import chunks, thin_out, worker_state


class PreTokens:
    """The normaliser and splitter of a tokenizer file of this kind, and the lengths of pre-tokens by the library.

    Its normaliser composes (NFC), turns white space into spaces and lower-cases code point by code point; its
    splitter keeps what the pattern matches. Strings of added special tokens in a text count as one token each; the
    stretches between them are normalised on their own.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, normalizers

        told = json.loads(definition)
        kinds = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        steps = [x["type"] for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"] or told["model"]["type"] != "BPE":
            raise ValueError("this tokenizer file is of another kind")
        self.split = compiled(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        special = [x["content"] for x in told["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = Tokenizer.from_str(definition)
        self.library.normalizer = normalizers.Sequence([])  # pieces come normalised; doing so again may change them

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and the number of special strings in it."""
        if self.special and "<|" in text and (parts := self.special.split(text))[1:]:
            out: list[str] = []
            for part in parts:
                out += self.split(self._normal(part))
            return out, len(parts) - 1
        return self.split(self._normal(text)), 0

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower() alone gives a last sigma another form
        return text.lower()

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class Counter:
    """Token counts of texts: words between ASCII spaces that are frequent pre-tokens, and the pre-tokens of the rest.

    No pre-token goes over a space, and composing characters doesn't either; so words can be counted apart. `table`
    (frequent pre-tokens, shared and never changed) is asked first, then the worker's own cache, which loses its later
    half when it holds `most` entries. What neither has goes through the library: pre-tokens met for the first time
    together, as only their sum is needed; those met again one by one, into the cache.
    """

    def __init__(self, tokens: PreTokens, table: dict[str, int], most: int):
        self.tokens, self.table, self.most = tokens, table, most
        self.cache: dict[str, int] = {}
        self.met: set[str] = set()

    def count(self, text: str) -> int:
        """Tokens of a text, in stretches of a limited length (but for words that are longer)."""
        if len(text) < 200_000:
            return self._count(text.split(" "))
        total = at = 0
        while at < len(text):
            end = text.find(" ", at + 100_000)
            end = len(text) if end < 0 else end
            total += self._count(text[at:end].split(" "))
            at = end + 1
        return total

    def _count(self, words: list[str]) -> int:
        get = self.table.get
        found = list(map(get, words))
        if None not in found:
            return sum(found)
        total = sum(filter(None, found))
        pieces, special = self.tokens.pieces(" ".join([w for w, n in zip(words, found, strict=True) if n is None]))
        total += special
        found = list(map(get, pieces))
        total += sum(filter(None, found))
        rest = [p for p, n in zip(pieces, found, strict=True) if n is None]
        return total + self._sum(rest) if rest else total

    def _sum(self, pieces: list[str]) -> int:
        found = list(map(self.cache.get, pieces))
        total = sum(filter(None, found))
        again: dict[str, int] = {}
        first: dict[str, None] = {}
        for p, n in zip(pieces, found, strict=True):
            if n is None:
                if p in again:
                    again[p] += 1
                elif p in first or p in self.met:
                    again[p] = 1 + (p in first)
                    first.pop(p, None)
                else:
                    first[p] = None
        if first:
            total += self.tokens.lengths([" ".join(first)])[0]
            if len(self.met) > 2 * self.most:
                self.met.clear()
            self.met.update(p for p in first if len(p) <= 40)
        if again:
            new = dict(zip(again, self.tokens.lengths(list(again)), strict=True))
            total += sum(n * again[p] for p, n in new.items())
            thin_out(self.cache, self.most)
            self.cache.update((p, n) for p, n in new.items() if len(p) <= 40)
            self.met.difference_update(again)
        return total


def frequent_lengths(docs: DataFrame, tokens: PreTokens, sample_docs: int, entries: int) -> dict[str, int]:
    """Lengths of the `entries` most frequent pre-tokens of about `sample_docs` documents, chosen by their ids' hash.

    Only speed depends on this table: what it lacks is encoded where it is met. Tasks choose by themselves, so no more
    than the sample leaves them; the driver reads it text by text and holds the counts of pre-tokens of up to 40
    characters. Where many rows share an id, at most `sample_docs` of them are read.
    """
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    share = min(1.0, sample_docs / max(1, docs.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("text").limit(sample_docs)
    counts: dict[str, int] = {}
    for (text,) in drawn.toLocalIterator():
        for p in tokens.pieces(text)[0]:
            if len(p) <= 40:
                counts[p] = counts.get(p, 0) + 1
        if len(counts) > 20 * entries:
            counts = {p: n for p, n in counts.items() if n > 1}
    chosen = [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    chosen = [p for p in chosen if tokens.pieces(p) == ([p], 0)]  # so that a word found here is one pre-token
    return dict(zip(chosen, tokens.lengths(chosen), strict=True)) if chosen else {}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, sample_docs: int = 1000, entries: int = 50_000, cache_entries: int = 200_000
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens.

    The tokenizer's definition (a fixed size) and the table of frequent pre-tokens are broadcast; misses go through
    the worker's cache of `cache_entries` entries and then the library. No pre-token is shuffled.
    Null text counts as empty: 0 bytes, 0 tokens; null ids and repeated rows stay (equal texts have equal counts, so
    there are no ties); an empty table gives an empty one; other columns aren't read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    table = frequent_lengths(docs, PreTokens(definition), sample_docs, entries)
    held = docs.sparkSession.sparkContext.broadcast((definition, table))
    key = ("tokens", uuid.uuid4().hex)  # of this call's tables in the workers
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = worker_state(key, lambda: Counter(PreTokens(held.value[0]), held.value[1], cache_entries))
        for batch in batches:
            for b in chunks(batch, 1, 500_000):
                texts = b.column(1)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                counts = pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, counts], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
