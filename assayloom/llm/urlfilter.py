"""URL filter: a trie over reversed host labels and path segments, longest match between allow and block entries."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

ALLOW, BLOCK = "allow", "block"
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Null, or no "://": both empty. Only A-Z of the host are lower-cased; a port stays part of it."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "#?":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class RuleTrie:
    """Rules (verdict, host, path) by reversed host labels, then path segments.

    A host node's "paths" is a tree of whole segments. At a tree node, "here" is the rule whose path ends with the
    slash before it, and "starts" holds, by length, rules whose last segment is only a beginning. The longest rule
    wins (characters of host and path together, then of the host); where one entry is both allowed and blocked,
    block wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"a rule allows or blocks, it can't {verdict!r}")
            self._add(verdict, host.translate(_UPPER), path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"any": None, "tree": None}
        rule = (len(host) + len(path), len(host), host + path, verdict)
        if not path.startswith("/"):
            if path:
                raise ValueError(f"the path {path!r} of a rule must be empty or start with a slash")
            node["paths"]["any"] = self._stronger(node["paths"]["any"], rule)
            return
        if node["paths"]["tree"] is None:
            node["paths"]["tree"] = self._empty()
        tree = node["paths"]["tree"]
        *whole, last = path[1:].split("/")
        for segment in whole:
            tree = tree["next"].setdefault(segment, self._empty())
        if last:
            by_length = tree["starts"].setdefault(len(last), {})
            by_length[last] = self._stronger(by_length.get(last), rule)
        else:
            tree["here"] = self._stronger(tree["here"], rule)

    @staticmethod
    def _empty() -> dict:
        return {"next": {}, "here": None, "starts": {}}

    @staticmethod
    def _stronger(old, new):
        return new if old is None or new[3] == BLOCK else old

    def match(self, host: str, path: str) -> tuple | None:
        """The longest rule that fits, as (length, host length, text, verdict), or None."""
        best, node = None, self.root
        segments = path[1:].split("/") if path.startswith("/") else None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            paths = node["paths"]
            if paths is None:
                continue
            if paths["any"] and (best is None or paths["any"] > best):
                best = paths["any"]
            tree = paths["tree"] if segments is not None else None
            depth = 0
            while tree is not None:
                if tree["here"] and (best is None or tree["here"] > best):
                    best = tree["here"]
                segment = segments[depth]
                for n, begun in tree["starts"].items():
                    rule = begun.get(segment[:n])
                    if rule and (best is None or rule > best):
                        best = rule
                depth += 1
                tree = tree["next"].get(segment) if depth < len(segments) else None
        return best


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
    rules_per_trie: int = 200_000,
) -> DataFrame:
    """Judge every row: id_col, host, path, rule (text of the winning rule or null), verdict (its, else `default`).

    A trie holds at most `rules_per_trie` rules, so a broadcast has a fixed bound; a longer list is dealt over several
    tries, which each task loads one after another. Each url is judged by itself: no shuffle, nothing to skew.
    Null url: empty host and path, no rule, the default verdict. Repeated rows give repeated results, an empty table
    an empty one, a null id stays null; other columns are not read.
    """
    rules = list(dict.fromkeys(rules))
    sc = pages.sparkSession.sparkContext
    tries = [sc.broadcast(RuleTrie(rules[i : i + rules_per_trie]).root) for i in range(0, len(rules), rules_per_trie)]
    id_type = pages.schema[id_col].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            best: list = [None] * len(parts)
            for held in tries:
                trie = RuleTrie(())
                trie.root = held.value if len(tries) == 1 else held.load_from_path(held._path)
                for i, (host, path) in enumerate(parts):
                    found = trie.match(host, path)
                    if found and (best[i] is None or found > best[i]):
                        best[i] = found
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([b and b[2] for b in best], pa.string()),
                    pa.array([b[3] if b else default for b in best], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return pages.select(id_col, url_col).mapInArrow(
        judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string"
    )


__all__ = ["ALLOW", "BLOCK", "RuleTrie", "filter_urls", "split_url"]
