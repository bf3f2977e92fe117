"""Byte-level BPE: merges as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, thin_out, worker_state

#: Unicode's White_Space property, for a character class (fixed values).
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The usual splitting pattern: a piece takes at most one space, in front (fixed value).
SPACE_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARKS = frozenset(".,;:!?)]}\"")
_SPACES = frozenset(re.findall(f"[{WHITE_SPACE}]", "".join(map(chr, range(0x3001)))))


def compiled(pattern: str) -> regex.Pattern:
    r"""A splitting pattern in which \s and \S are White_Space; the library's own \s differs at some controls."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", WHITE_SPACE), pattern)
    return regex.compile(inside.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BpeTransducer:
    """Left-to-right BPE encoder of one piece at a time.

    Every prefix of a piece has one encoding; its last token is the one that ends there and that the merges leave
    apart from the token before it. A state is what may still change: the last token that is sure, the bytes after
    it, and the length of the last token at each place among them. Reading a byte gives the next state and the
    tokens that have become sure, that is, those on which all places agree where a token may still begin. A move that
    is asked for is only counted, and what is left of the piece (if short) is read without it; asked for `often` times,
    it is made, with the state it leads to. When there are `max_states`, all are dropped together.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 60_000, often: int = 8):
        self.ranks = ranks
        self.max_states, self.often = max_states, often
        # tokens as a trie: nodes by their parent and byte, each with its token's rank (or -1) and whether it goes on
        self.child: dict[int, int] = {}
        self.rank_at, self.goes_on = [-1], [True]
        for t, r in ranks.items():
            node = 0
            for byte in t:
                self.goes_on[node] = True
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.rank_at)
                    self.rank_at.append(-1)
                    self.goes_on.append(False)
                node = below
            self.rank_at[node] = r
        self.token = {r: t for t, r in ranks.items()}
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._near: dict[int, bool] = {}  # the same by ranks
        self._edges: tuple[dict, dict] = ({}, {})
        self._never = 1 << 40
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._flush: dict[int, tuple[int, ...]] = {}
        self._asked: dict[int, int] = {}  # how often moves that aren't made were asked for
        self._state((b"", b"", (0,), (0,)))

    def _state(self, state: tuple) -> int:
        k = self._ids.get(state)
        if k is None:
            k = self._ids[state] = len(self._states)
            self._states.append(state)
            self._moves.append({})
        return k

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens that the last merge of a token joins."""
        parts = [token[i : i + 1] for i in range(len(token))]
        get = self.ranks.get
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                raise ValueError("a token can't be made by merges")
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at the left (0) or right (1) edge of a token as it is made: token, ranks of the
        merges that make it and that use it up."""
        found = self._edges[side].get(token)
        if found is None:
            if len(token) == 1:
                found = [(token, -1, self._never)]
            else:
                inner, made = self._edge(self._halves(token)[side], side), self.ranks[token]
                found = [(token, made, self._never)] + [(t, m, made if i == 0 else u) for i, (t, m, u) in enumerate(inner)]
            self._edges[side][token] = found
        return found

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        """Whether merging leaves the neighbours a and b as they are (an empty a: b at the start).

        Merges happen in the order of their ranks, equal ones from the left. A merge across the border happens if
        its two sides stand there when its turn comes.
        """
        if not a:
            return True
        key = (a, b)
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 100_000:
                self._apart.clear()
            found, get = True, self.ranks.get
            right_edge = self._edges[0].get(b) or self._edge(b, 0)
            for left, made_l, used_l in self._edges[1].get(a) or self._edge(a, 1):
                for right, made_r, used_r in right_edge:
                    rank = get(left + right)
                    if rank is not None and made_l < rank < used_l and made_r < rank <= used_r:
                        found = False
                        break
            self._apart[key] = found
        return found

    def _node(self, text: bytes) -> int | None:
        node: int | None = 0
        for byte in text:
            node = self.child.get(node << 8 | byte)
            if node is None:
                return None
        return node

    def _move(self, k: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, text, last, live = self._states[k]
        text += bytes((byte,))
        end, ranks = len(text), self.ranks
        still = []
        size = 0
        for j in live:
            token = text[j:]
            node = self._node(token)
            if node is None:
                continue
            if not size and self.rank_at[node] >= 0 and self.stay_apart(text[j - last[j] : j] if j else before, token):
                size = end - j
            if self.goes_on[node]:
                still.append(j)
        if not size:
            raise ValueError("the vocabulary has no token for a byte")
        still.append(end)
        last = (*last, size)
        masks = [1]  # the places on the way back from each place, as bits
        for j in range(1, end + 1):
            masks.append(masks[j - last[j]] | 1 << j if last[j] else 0)
        common, used = masks[end], 0
        for j in still:
            common &= masks[j]
            used |= masks[j]
        sure = common.bit_length() - 1
        out, j = [], sure
        while j:
            out.append(ranks[text[j - last[j] : j]])
            j -= last[j]
        if sure:
            before = text[sure - last[sure] : sure]
            last = (0, *(last[j] if used >> j & 1 else 0 for j in range(sure + 1, end + 1)))
            text, still = text[sure:], [j - sure for j in still]
        if still[0]:
            before = b""  # no token begins at the first place any more
        move = (self._state((before, text, last, tuple(still))), tuple(reversed(out)))
        self._moves[k][byte] = move
        return move

    def _rest(self, k: int) -> tuple[int, ...]:
        found = self._flush.get(k)
        if found is None:
            _, text, last, _ = self._states[k]
            out, j = [], len(text)
            while j:
                out.append(self.ranks[text[j - last[j] : j]])
                j -= last[j]
            found = self._flush[k] = tuple(reversed(out))
        return found

    def _read_on(self, k: int, more: bytes) -> list[int]:
        """What is still to come of a piece that is in state k and ends after `more`, without making states."""
        before, text, last, live = self._states[k]
        start, text, last, live = len(text), text + more, [*last], [*live]
        ranks, child, rank_at, goes_on, known = self.ranks, self.child.get, self.rank_at, self.goes_on, self._near
        if len(known) > 400_000:
            known.clear()
        ends = [ranks[before] if before else -1, *(ranks[text[j - last[j] : j]] if last[j] else -1 for j in range(1, start + 1))]  # tokens by their ends
        open_ = [(j, self._node(text[j:start])) for j in live]
        for end in range(start + 1, len(text) + 1):
            still, size, token, byte = [], 0, -1, text[end - 1]
            for j, node in open_:
                node = child(node << 8 | byte)
                if node is None:
                    continue
                if not size:
                    rank = rank_at[node]
                    if rank >= 0:
                        left = ends[j]
                        if left >= 0:
                            key = left << 24 | rank
                            fits = known.get(key)
                            if fits is None:
                                fits = known[key] = self.stay_apart(self.token[left], text[j:end])
                        if left < 0 or fits:
                            size, token = end - j, rank
                if goes_on[node]:
                    still.append((j, node))
            if not size:
                raise ValueError("the vocabulary has no token for a byte")
            still.append((end, 0))
            last.append(size)
            ends.append(token)
            open_ = still
        out, j = [], len(text)
        while j:
            out.append(ends[j])
            j -= last[j]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._reset()
        k, out, moves = 0, [], self._moves
        for i, byte in enumerate(piece):
            move = moves[k].get(byte)
            if move is None:
                if len(piece) - i <= 64:
                    if len(self._asked) > 4 * self.max_states:
                        self._asked.clear()
                    times = self._asked[k << 8 | byte] = self._asked.get(k << 8 | byte, 0) + 1
                    if times < self.often:
                        out.extend(self._read_on(k, piece[i:]))
                        return out
                move = self._move(k, byte)
            k = move[0]
            if move[1]:
                out.extend(move[1])
            if len(self._states) > 2 * self.max_states:
                state = self._states[k]
                self._reset()
                k, moves = self._state(state), self._moves
        out.extend(self._rest(k))
        return out


class Utf8Stream:
    """Incremental UTF-8: text for what is complete, holding back at most three bytes of a begun character."""

    def __init__(self, errors: str = "replace"):
        self.errors, self.held = errors, b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if back < need:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", self.errors)


class ByteBpe:
    """Texts to packed ids (little-endian unsigned 32-bit integers) and back, with caches of words and pieces.

    A word is what stands between two ASCII spaces. No piece goes over a single space that has other characters on
    both sides, but to begin with it; so the ids of " word" are the same in every such text, and words met before need
    no splitting. Texts with white space around a space are split as a whole. Caches are emptied when full.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 700_000, max_words: int = 150_000):
        self.split = compiled(pattern).findall
        self.apart = pattern == SPACE_FIRST
        self.transducer = BpeTransducer(ranks)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.max_pieces, self.max_words = max_pieces, max_words

    def _joined(self, text: str) -> bytes:
        pieces = self.split(text)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            thin_out(self.pieces, self.max_pieces)
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    ids = self.pieces.get(piece)
                    if ids is None:
                        ids = np.array(self.transducer.encode(piece.encode("utf-8", "replace")), "<u4").tobytes()
                        if len(piece) <= 40:
                            self.pieces[piece] = ids
                    found[i] = ids
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        """Ids of a word that isn't in the cache, with the space before it. One mark after a letter or digit is a piece
        of its own."""
        core = self.words.get(word[:-1]) if word[-1] in _MARKS and len(word) > 1 and word[-2].isalnum() else None
        if core is None:
            ids = self._joined(" " + word)
        else:
            ids = core + (self.pieces.get(word[-1]) or self._joined(word[-1]))
        if len(word) <= 40:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self._joined(text)
        words = text.split(" ")
        known = self.words
        found = list(map(known.get, words))
        found[0] = self._joined(words[0])  # the only one without a space before it
        if None in found:
            thin_out(known, self.max_words)
            space = False  # whether the word before ends in white space or is empty
            for i, ids in enumerate(found):
                if ids is not None and i:
                    space = False
                    continue
                word = words[i]
                if word and word[0] not in _SPACES and word[-1] not in _SPACES:
                    space = False
                    if i:
                        ids = known.get(word) or self._word(word)
                else:
                    if (not word or word[0] in _SPACES) and (space or i == 1 and not words[0]):
                        return self._joined(text)  # white space on both sides of a space
                    space = not word or word[-1] in _SPACES
                    ids = self._joined(" " + word) if i else ids
                found[i] = ids
        return b"".join(found)

    def decode_stream(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids that come in parts."""
        machine, get = Utf8Stream(), self.tokens.__getitem__
        for part in ids:
            yield machine.feed(b"".join(map(get, np.frombuffer(part, "<u4").tolist())))
        yield machine.end()

    def decode(self, packed: bytes, part: int = 262_144) -> str:
        return "".join(self.decode_stream(packed[i : i + part] for i in range(0, len(packed), part)))


def encoder(held) -> ByteBpe:
    """The worker's encoder for broadcast (ranks, pattern, key); a worker keeps one from task to task."""
    return worker_state(held.value[2], lambda: ByteBpe(*held.value[:2]))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), decoded (text).

    The driver reads the rank file and broadcasts it (a vocabulary's size is fixed). Each text is encoded and decoded
    by itself: no shuffle, nothing to skew; the caches and the transducer's states are bounded. Null text counts as empty
    and gives no ids and an empty text; null ids and repeated rows stay (equal texts give equal results, so there are
    no ties); an empty table gives an empty one; only doc_id and text are read.
    """
    ranks = read_ranks(ranks_path)
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern, ("bpe", ranks_path, len(ranks), pattern)))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = encoder(held)
        for batch in batches:
            for b in chunks(batch, 1, 1_000_000):
                ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids binary, decoded string")
