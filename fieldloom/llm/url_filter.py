"""URL allow and block rules, looked up in a trie of reversed host labels and path segments.

Semantics: the host of a URL is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path is what follows it up to ``?``, ``#`` or the end. A rule fits its
own host and every subdomain of it when the URL's path starts with the rule's path. Of several
fitting rules the one with most characters (host and path) wins, then the longer host; of two
entries with the same host and path ``block`` wins. A URL that no rule fits gets ``default``.

Null URLs and those without ``://`` have an empty host and path and get ``default``. Rules with a null
part are left out. An empty
rule set gives every URL ``default``. Repeated rows are judged one by one; other columns of the
input pass through, and replace nothing: result columns are prefixed on a clash.

The trie is broadcast only while the rules are at most ``max_broadcast_rules`` rows. A larger rule
set stays distributed: each URL is expanded to its (host suffix, path prefix) keys, which are
joined with the rules by an ordinary shuffled equi-join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
#: Rules up to this many are sent to every executor as one trie (a few tens of MB at most).
MAX_BROADCAST_RULES = 100_000
RESULT = ("host", "path", "rule", "verdict")


@dataclass
class Node:
    """A trie node: children by reversed host label, then by path segment."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: (unfinished last segment, verdict, rule) of the rules that end here, longest first.
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class RuleTrie:
    """Longest-match lookup of allow and block rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = Node()
        best: dict[tuple[str, str], str] = {}
        for host, path, verdict in rules:
            key = (host.lower(), path)
            best[key] = "block" if "block" in (verdict, best.get(key)) else verdict
        for (host, path), verdict in best.items():
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, Node())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            node.ends.append((rest, verdict, host + path))
            node.ends.sort(key=lambda end: -len(end[0]))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, or (None, None)."""
        found: tuple[tuple[int, int], str, str] | None = None
        node, depth = self.root, 0
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            depth += len(label) + 1
            end = self._in_path(node, path)
            if end is not None and (found is None or (len(end[2]), depth) > found[0]):
                found = ((len(end[2]), depth), end[2], end[1])
        return (None, None) if found is None else found[1:]

    @staticmethod
    def _in_path(node: Node, path: str) -> tuple[str, str, str] | None:
        """The longest rule below a host node that is a prefix of the path."""
        best, segments = None, path.split("/")
        for k, segment in enumerate(segments):
            for end in node.ends:
                if segment.startswith(end[0]):
                    best = end
                    break
            if k == len(segments) - 1 or segment not in node.segments:
                break
            node = node.segments[segment]
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a URL column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _out_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"url_{name}"
    return name


def _with_trie(parsed: DataFrame, rules: list[Rule], names: dict[str, str]) -> DataFrame:
    shared = parsed.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = shared.value
        return pd.DataFrame([trie.match(h, p) for h, p in zip(host, path)], columns=["rule", "verdict"], dtype=object)

    return parsed.withColumn("_found", judge(names["host"], names["path"]))


def _with_join(parsed: DataFrame, rules: DataFrame, names: dict[str, str]) -> DataFrame:
    """The same answer from an equi-join of every URL's (host suffix, closed path prefix) keys."""
    entries = (
        rules.select(F.lower("host").alias("_rule_host"), F.col("path").alias("_rule_path"), "verdict")
        .groupBy("_rule_host", "_rule_path")
        .agg(F.min(F.struct(F.col("verdict") != "block", "verdict"))["verdict"].alias("_verdict"))
        .withColumn("_prefix", F.regexp_extract("_rule_path", r"^(.*/)?", 0))
    )
    keyed = parsed.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split(F.col(names["host"]), r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    parts = F.split(F.col(names["path"]), "/", -1)
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))),
    )
    slim = keyed.select(F.xxhash64(names["host"], names["path"]).alias("_url"), names["host"], names["path"]).distinct()
    keys = slim.withColumn("_rule_host", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    fits = keys.join(entries, ["_rule_host", "_prefix"]).filter(F.col(names["path"]).startswith(F.col("_rule_path")))
    rule = F.concat("_rule_host", "_rule_path")
    best = fits.groupBy("_url", F.col(names["host"]).alias("_h"), F.col(names["path"]).alias("_p")).agg(
        F.max_by(F.struct(rule.alias("rule"), F.col("_verdict").alias("verdict")), F.struct(F.length(rule), F.length("_rule_host"))).alias("_found")
    )
    same = (F.xxhash64(names["host"], names["path"]) == best["_url"]) & (keyed[names["host"]] == best["_h"]) & (keyed[names["path"]] == best["_p"])
    return keyed.join(best, same, "left").drop("_url", "_h", "_p", "_row")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | list[Rule],
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict; see the module docstring for every case.

    ``rules`` is a list or a DataFrame of (host, path, verdict). Its size is measured before anything
    is broadcast.
    """
    names = {name: _out_name(pages, name) for name in RESULT}
    host, path = split_url(F.col(url_col))
    parsed = pages.withColumns({names["host"]: host, names["path"]: path})
    if not isinstance(rules, DataFrame):
        rows = [rule for rule in rules if None not in rule]
        if len(rows) > max_broadcast_rules:
            rules = pages.sparkSession.createDataFrame(rows, "host string, path string, verdict string")
    if isinstance(rules, DataFrame):
        rules = rules.filter("host is not null and path is not null and verdict is not null")
        rows = [tuple(r) for r in rules.select("host", "path", "verdict").limit(max_broadcast_rules + 1).collect()]
    found = _with_trie(parsed, rows, names) if len(rows) <= max_broadcast_rules else _with_join(parsed, rules, names)
    return found.withColumns({names["rule"]: F.col("_found.rule"), names["verdict"]: F.coalesce("_found.verdict", F.lit(default))}).drop("_found")


#: The rules of the production query.
RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under ``RULES``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
       coalesce(max_by(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM parsed LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""


def brute_force(url: str | None, rules: Iterable[Rule], default: str = "allow") -> tuple[str, str, str | None, str]:
    """The same answer by trying every rule; used by the tests."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[4]


__all__ = ["RULES", "RuleTrie", "brute_force", "judge_urls", "op8_url_filter", "split_url"]
