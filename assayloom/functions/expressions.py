"""Formulas as text: arithmetic over columns, and designs of linear models."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import finite, zscore

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z0-9_.]*)|(.))")
_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "log2": lambda c: F.when(c > 0, F.log2(c)),
    "log10": lambda c: F.when(c > 0, F.log10(c)),
    "ln": lambda c: F.when(c > 0, F.ln(c)),
}


def column(text: str) -> Column:
    """+ - * / ( ) log2 log10 ln over column names and numbers, z() at the outermost place only.

    Whatever step has no finite value makes the whole null.
    """
    tokens = [(n or w or o, "n" if n else "w" if w else "o") for n, w, o in _TOKEN.findall(text.strip())]
    at = 0

    def peek() -> str | None:
        return tokens[at][0] if at < len(tokens) else None

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or (expected and tokens[at][0] != expected):
            raise ValueError(f"{text!r}: expected {expected or 'a value'} at token {at + 1}")
        at += 1
        return tokens[at - 1]

    def atom(outer: bool) -> Column:
        word, kind = take()
        if word == "-":
            return -atom(False)
        if word == "(":
            inner = total(False)
            take(")")
            return inner
        if kind == "n":
            return F.lit(float(word))
        if kind == "w" and peek() == "(":
            if word != "z" and word not in _FUNCTIONS or word == "z" and not outer:
                raise ValueError(f"{text!r}: {word} can't stand here")
            take("(")
            inner = total(False)
            take(")")
            return zscore(inner) if word == "z" else finite(_FUNCTIONS[word](inner))
        if kind == "w":
            return finite(F.col(word).cast("double"))
        raise ValueError(f"{text!r}: unexpected {word!r}")

    def product(outer: bool) -> Column:
        out = atom(outer)
        while peek() in ("*", "/"):
            op, _ = take()
            out = finite(out * atom(False) if op == "*" else F.try_divide(out, atom(False)))
        return out

    def total(outer: bool) -> Column:
        out = product(outer)
        while peek() in ("+", "-"):
            op, _ = take()
            right = product(False)
            out = finite(out + right if op == "+" else out - right)
        return out

    out = total(True)
    if at < len(tokens):
        raise ValueError(f"{text!r}: {tokens[at][0]!r} is left over")
    return out


def design_terms(text: str) -> list[tuple[str, bool]]:
    """The terms of "~ a + z(b)" as (column, standardised); the intercept is always in."""
    body = text.strip().removeprefix("~").strip()
    out: list[tuple[str, bool]] = []
    for part in filter(None, (p.strip() for p in body.split("+"))):
        if part in ("0", "-1") or part.startswith("-"):
            raise ValueError("the intercept can't be taken out")
        if part == "1":
            continue
        m = re.fullmatch(r"z\(\s*([A-Za-z_][\w.]*)\s*\)|([A-Za-z_][\w.]*)", part)
        if not m:
            raise ValueError(f"not a term: {part!r}")
        term = (m[1] or m[2], bool(m[1]))
        if any(t[0] == term[0] for t in out):
            raise ValueError(f"{term[0]} stands in the design twice")
        out.append(term)
    return out
