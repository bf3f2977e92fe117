"""Secret scan: fixed patterns, and the novelty of candidate strings under dictionary-primed zstandard."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, with_columns, worker_state

#: Kinds in their order of report; "novel" spans come from the compression test.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Words of sensitive context, and strings of 16 or more characters that count where they start at most REACH after one.
_CONTEXT = re.compile(r"auth|bearer|credential|private|signature|passphrase|pwd|passw|secret|token|key", re.IGNORECASE | re.ASCII)
_STRING = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{15,}")
REACH = 40
#: The head of a key block, and the lines after it, broken by newlines or by "\\n" in a quoted string: headers or base64.
_BLOCK = re.compile(r"BEGIN [A-Z0-9 ]*PRIVATE KEY[^\n\\]*")
_BLOCK_LINE = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*(?:([A-Za-z0-9+/=]*)|[A-Za-z][A-Za-z-]*:[^\n\\]*)[\x20\t]*(?=[\r\n\\\"']|\Z)")
_CONTEXT_HINTS = ("auth", "bearer", "credential", "private", "signature", "passphrase", "pwd", "passw", "secret", "token", "key")
#: Identifiers and phrases that are no secrets; the compressor knows them beforehand.
IDENTIFIERS = (
    "password passwd secret token api_key apikey api-key access_key access-key private_key public_key client_secret "
    "client_id session_token refresh_token bearer authorization authentication authenticate credential credentials "
    "signature certificate passphrase username user_name account administrator localhost example.com example.org "
    "https://www. http:// postgres:// mysql:// redis:// mongodb:// ssh-rsa ssh-ed25519 BEGIN RSA PRIVATE KEY END "
    "environment variable configuration settings default placeholder changeme your_password_here your-token-here "
    "xxxxxxxxxxxxxxxx 0000000000000000 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ self. this. return import from None null true false undefined function const let "
    "string integer boolean os.environ getenv process.env request.headers Content-Type application/json "
)


class Novelty:
    """Marginal compressed bytes of a candidate after its surroundings, as a share of its length."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.dictionary = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(
            level=3, dict_data=self.dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def share(self, surroundings: str, candidate: str) -> float:
        plain = surroundings.encode("utf-8", "replace")
        more = plain + candidate.encode("utf-8", "replace")
        return (len(self.press.compress(more)) - len(self.press.compress(plain))) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def measured(text: str, start: int, end: int, novelty: Novelty, around: int = 160) -> float:
    """Novelty of a stretch of a text after what stands around it."""
    return novelty.share(text[max(0, start - around) : start] + text[end : end + around], text[start:end])


def candidates(text: str) -> list[tuple[int, int]]:
    """Every string of 16 or more characters that starts within REACH of a context word on its line, or that is in a
    key block; whether others were met before or not."""
    found = {}
    for c in _CONTEXT.finditer(text):
        at, line = c.end(), text.find("\n", c.end(), c.end() + REACH + 1)
        last = line if line >= 0 else c.end() + REACH
        while m := _STRING.search(text, at, last + 16):
            at = found[m.start()] = _STRING.match(text, m.start()).end()
    for b in _BLOCK.finditer(text):
        at = b.end()
        while m := _BLOCK_LINE.match(text, at):
            at = m.end()
            if m[1]:
                found[m.start(1)] = m.end(1)
    return sorted((start, start + len(text[start:end].rstrip(".="))) for start, end in found.items())


def random_share(word: str) -> float:
    """Bytes a character that random strings over the word's kinds of characters take at least, however long."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word):
        size = 16
    elif re.fullmatch("[A-Z2-7]+|[a-z2-7]+", word):
        size = 32
    else:
        size = sum(n for kind, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10)) if re.search(kind, word)) + len(set(word) & set("+/_.=-"))
    return math.log2(max(size, 2)) / 8


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, least: float, around: int = 160):
    """Spans of sensitive context that overlap no taken one, hold letters and digits, and compress to no less than
    `least` of what random strings of their alphabet take."""
    low = text.lower()
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out = []
    for start, end in candidates(text):
        word = text[start:end]
        if len(word) < 16 or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word):
            continue
        if any(s < end and start < e for s, e, _ in taken):
            continue
        share = measured(text, start, end, novelty, around)
        if share >= least * random_share(word):
            out.append((start, end, "novel", share))
    return out


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by mark."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(
    docs: DataFrame, *, least_novelty: float = 0.8, redact: bool = False, mark: str = "[secret]"
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex (long) and spans, an array of (kind, start, end, novelty).

    Spans are in code points, the end exclusive, by start and then kind. Every candidate
    is measured against its surroundings and the identifier dictionary; base spans stay whatever their novelty, further
    ones ("novel") are reported from `least_novelty` on, as a share of what random strings of their alphabet take. redact: return docs' own
    columns instead, with every span replaced by `mark` (n_chars follows where there is such a column); no row goes.

    Each text is scanned whole and by itself: no shuffle, nothing to skew. Null text counts as empty (with redact it
    stays null); null ids and repeated rows stay (equal texts have equal spans, so there are no ties); an empty table gives an empty one; other columns aren't read
    unless they are returned.
    """
    source = docs if redact else docs.select("doc_id", "text")
    at = source.columns.index("text")
    if redact:
        out = T.StructType(docs.schema.fields)
    else:
        out = T._parse_datatype_string(
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, "
            "spans array<struct<kind: string, start: bigint, end: bigint, novelty: double>>"
        )

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        worker_state()  # what another operator may have left in this process
        schema, novelty = to_arrow_schema(out), Novelty()
        for b in (part for batch in batches for part in chunks(batch, at, 4_000_000)):
            texts = b.column(at).to_pylist()
            found = []
            for t in texts:
                base = base_spans(t or "")
                spans = [(*x, measured(t, x[0], x[1], novelty)) for x in base] + novel_spans(t or "", base, novelty, least_novelty)
                found.append(sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))
            if redact:
                new = [t and redacted(t, [x[:2] for x in f], mark) for t, f in zip(texts, found, strict=True)]
                changed = {"text": new}
                if "n_chars" in schema.names:
                    old = b.column(b.schema.get_field_index("n_chars")).to_pylist()
                    changed["n_chars"] = [len(t) if f else o for t, o, f in zip(new, old, found, strict=True)]
                yield with_columns(b, schema, **changed)
            else:
                count = {k: [sum(x[2] == k for x in f) for f in found] for k in KINDS}
                yield with_columns(
                    b, schema, n_assign=count["assign"], n_access=count["access"], n_hex=count["hex"],
                    spans=pa.array([[{"kind": k, "start": s, "end": e, "novelty": v} for s, e, k, v in f] for f in found], schema.field("spans").type),
                )

    return source.mapInArrow(scan, out)
