"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host || path`` plus the literal tokens that every URL it
matches must contain.  Each rule is filed under the one of its tokens that the fewest URLs hold
(counted over all URLs).  A URL's tokens fetch the rules filed under them by an equi join; only
these candidate rules run their regular expression.  Host/path rules (``org/``,
``example.org/en/1``) are compiled into the same form.

The rule list is an argument of the job (a Python list), so its size is known before planning:
up to ``MAX_BROADCAST_RULES`` rules the index is broadcast, beyond it the same join shuffles.

Defined cases: null URLs and URLs without ``://`` have empty host and path, match no host/path
rule and get the default verdict; repeated rows give one output row each (a verdict is a function
of the URL alone, so every distinct URL is judged once); an empty table gives no rows; columns
other than the id and the URL are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 20_000
TOKEN_SPLIT = r"[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``kind`` is "site" (host/path rule; ``name`` is host + path) or "pattern"; ``regex`` is
    matched with find semantics on ``host || path``; ``tokens`` are its literal tokens."""

    name: str
    verdict: str
    kind: str
    regex: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for a host, its subdomains and the paths that start with ``path``.

    All host labels are whole tokens of a matching URL; in the path only what a further
    character closes is (``/en/1`` also fits ``/en/10``)."""
    closed = path[: max((i for i, c in enumerate(path) if not re.match("[A-Za-z0-9]", c)), default=0)]
    tokens = [t for t in re.split(TOKEN_SPLIT, f"{host.lower()}/{_ascii_lower(closed)}") if t]
    regex = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    return Rule(host + path, verdict, "site", regex, tuple(dict.fromkeys(tokens)))


def pattern_rule(verdict: str, name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    """A free pattern; ``tokens`` must be whole tokens of every URL that it matches (an empty
    tuple files the rule under the empty token, which every URL holds)."""
    return Rule(name, verdict, "pattern", regex, tuple(tokens))


def _ascii_lower(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def url_host(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_tokens(site: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of ``host || path``, with the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(site, _UPPER, _LOWER), TOKEN_SPLIT)))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule with the rarest of its tokens over ``urls(site)`` (ties: the smallest)."""
    spark = urls.sparkSession
    rows = [(r.name, r.verdict, r.kind, r.regex, t) for r in rules for t in (r.tokens or ("",))]
    df = spark.createDataFrame(rows, "rule string, rule_verdict string, kind string, regex string, token string")
    small = F.broadcast if len(rules) <= MAX_BROADCAST_RULES else (lambda x: x)
    counts = (urls.select(F.explode(url_tokens(F.col("site"))).alias("token"))
              .join(small(df.select("token").distinct()), "token", "left_semi")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n_urls")))
    key = F.struct(F.coalesce(F.col("n_urls"), F.lit(0)).alias("n"), F.col("token"))
    return (df.join(counts, "token", "left")
            .groupBy("rule", "rule_verdict", "kind", "regex").agg(F.min(key).alias("k"))
            .select("rule", "rule_verdict", "kind", "regex", F.col("k.token").alias("token")))


def judge_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id",
               default: str = "allow") -> DataFrame:
    """(id, host, path, rule, pattern, verdict) for every row.

    ``rule`` is the longest fitting site rule (ties: the longer host, then the smaller name);
    without one, ``pattern`` is the smallest fitting pattern rule (block before allow) and gives
    the verdict; otherwise the verdict is ``default``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.select("*", F.concat("host", "path").alias("site"))
    # Judged once per distinct site: repeats collapse in the map-side combine.
    sites = rows.filter(F.col("site") != "").select("site").distinct()
    index = rule_index(sites, rules)
    small = F.broadcast if len(rules) <= MAX_BROADCAST_RULES else (lambda x: x)
    hits = (sites.select("site", F.explode(url_tokens(F.col("site"))).alias("token"))
            .join(small(index), "token")
            .filter(F.regexp_like(F.col("site"), F.col("regex"))))
    host_len = F.length(F.substring_index(F.col("rule"), "/", 1))
    site_rank = F.struct((-F.length("rule")).alias("a"), (-host_len).alias("b"), F.col("rule").alias("rule"),
                         F.col("rule_verdict").alias("verdict"))
    pattern_rank = F.struct((F.col("rule_verdict") != "block").alias("a"), F.col("rule").alias("rule"),
                            F.col("rule_verdict").alias("verdict"))
    best = hits.groupBy("site").agg(
        F.min(F.when(F.col("kind") == "site", site_rank)).alias("s"),
        F.min(F.when(F.col("kind") == "pattern", pattern_rank)).alias("p"))
    return (rows.join(best, "site", "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("s.rule").alias("rule"),
                    F.when(F.col("s").isNull(), F.col("p.rule")).alias("pattern"),
                    F.coalesce("s.verdict", "p.verdict", F.lit(default)).alias("verdict")))
