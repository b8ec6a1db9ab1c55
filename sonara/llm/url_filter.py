"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

The rules are a small, size-checked list; the trie built from them is broadcast and every URL walks it once.  The walk
follows host labels from the right; each node that ends a rule's host owns a second trie over path segments.  Of all
rules that fit, the one with the most host labels wins, then the one with the longest path; of two equal rules with
different verdicts, block wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_rows

#: Most rules, and bytes in them, that are broadcast.
MAX_RULES = 1_000_000
MAX_RULE_BYTES = 64 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rule(verdict: str, text: str) -> Rule:
    """``net/`` or ``example.com/de/``: the host up to the first slash, and the path from it on."""
    host, slash, rest = text.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {verdict!r} {text!r}")
    return Rule(verdict, host.lower(), slash + rest)


class RuleTrie:
    """Host labels from the right; under each complete host, path segments; under those, begun last segments."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("label", label), {})
            *whole, begun = rule.path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            ends = node.setdefault("begun", {})
            if begun not in ends or rule.verdict == "block":
                ends[begun] = rule
            node["lengths"] = sorted({*node.get("lengths", ()), len(begun)}, reverse=True)

    def find(self, host: str, path: str) -> Rule | None:
        """The rule that decides, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            if "paths" in node:
                best = self._find_path(node["paths"], path) or best
        return best

    @staticmethod
    def _find_path(node: dict, path: str) -> Rule | None:
        best = None
        for segment in path.split("/"):
            begun = node.get("begun", {})
            longest = next((segment[:n] for n in node.get("lengths", ()) if segment[:n] in begun), None)
            if longest is not None:
                best = begun[longest]
            node = node.get(("segment", segment))
            if node is None:
                break
        return best


def url_parts(url: str = "url") -> tuple:
    """Columns for host and path; both empty for a null URL or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (as written, or null) and ``verdict`` to every row of ``pages``.

    A rule fits its own host and all subdomains if the path starts with the rule's path; without a fitting rule the
    verdict is ``default``.  Null, empty and malformed URLs have empty host and path and get ``default``.  Repeated rows
    are judged alike; an empty table gives an empty result; columns of these names already present, in whatever case, are
    replaced.
    """
    if len(rules) > MAX_RULES or sum(len(t.encode()) for _, t in rules) > MAX_RULE_BYTES:
        raise ValueError("too many rules to broadcast; split the list and apply it in parts")
    parsed = {parse_rule(v, t): t for v, t in rules}
    trie = pages.sparkSession.sparkContext.broadcast((RuleTrie(parsed), parsed))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree, written = trie.value
        for host, path in parts:
            found = [tree.find(h, p) for h, p in zip(host, path)]
            yield pd.DataFrame(
                {"rule": [f and written[f] for f in found], "verdict": [f.verdict if f else default for f in found]}, dtype=object
            )

    host, path = url_parts(url)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    judged = packed_rows(pages, host=host, path=path).withColumn("_judged", judge("host", "path"))
    return judged.select(*[F.col(f"_row.`{c}`") for c in kept], "host", "path", "_judged.rule", "_judged.verdict")
