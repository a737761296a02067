"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host + rest of the url`` with literal tokens (runs of a-z and
0-9) that every url it matches must hold as whole tokens. Each rule is filed once, under that of
its tokens which occurs in the fewest urls. The tokens of a url fetch candidate rules, and only
those run their expressions.

Equal urls are judged once. No url meets rules other than those of its own tokens, and the shuffle
by url carries urls only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import free_name, free_prefix

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"
# An index of so many rules is sent to all tasks; a larger one is joined by shuffling.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False  # a site rule decides before all others, the longest name first


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the url's path starts with ``path``."""
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    # The path's last token may go on in the url, unless something else ends it.
    inner = re.findall(_TOKEN, host + re.sub(r"[A-Za-z0-9]+$", "", path).lower())
    return Rule(host + path, verdict, pattern, tuple(inner), True)


def host_word_rule(verdict: str, word: str) -> Rule:
    """Fits a host that holds the word between dots, hyphens or its ends."""
    pattern = rf"^(?:[^/?#]*[-.])?{re.escape(word)}(?:[-.][^/?#]*)?(?:[/?#]|$)"
    return Rule(word, verdict, pattern, tuple(re.findall(_TOKEN, word)))


SITE_RULES = [
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
]
# Words of hosts that sell, gamble or show what a corpus does not want.
HOST_WORDS = [
    host_word_rule("block", w)
    for w in (
        "adult", "bets", "betting", "casino", "casino-win", "cheap-pills", "escort", "free-bets", "gambling", "pills",
        "poker", "porn", "sex", "slots", "torrent", "viagra", "warez", "xxx",
    )
]
RULES = SITE_RULES + HOST_WORDS


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path, and all that follows the host; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return fold(host), F.regexp_extract(tail, r"^[^?#]*", 0), tail


def _rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule {rule.name!r} has no literal token to be filed under")
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.site) for r in rules]
    return spark.createDataFrame(rows, "rule string, rule_verdict string, pattern string, tokens array<string>, site boolean")


def build_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules under their rarest token; ``urls`` has a row per url with its distinct ``tokens``."""
    table = _rule_table(urls.sparkSession, rules)
    small = len(rules) <= BROADCAST_RULES
    each = table.withColumn("token", F.explode("tokens")).drop("tokens")
    used = each.select("token").distinct()
    counted = (
        urls.select(F.explode("tokens").alias("token"))
        .join(F.broadcast(used) if small else used, "token")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = Window.partitionBy("rule", "pattern").orderBy("n", "token")
    ranked = each.join(counted, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.withColumn("nth", F.row_number().over(rarest)).filter("nth = 1").drop("nth", "n")


def judge(pages: DataFrame, url: str = "url", rules: Sequence[Rule] = tuple(RULES), default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``filter``.

    The longest fitting site rule decides (``rule``). Without one, the url is blocked if a blocking
    pattern rule fits (``filter``, the first by name) and no allowing one, else ``default``. A null
    url and one without ``://`` have an empty host and path and fit no rule. Repeated urls and rows
    are judged alike; columns of the input with an output's name give way.
    """
    key, to = free_name(pages.columns, "_key"), free_prefix(pages.columns, "_judged")
    keyed = pages.withColumn(key, F.coalesce(F.col(f"`{url}`"), F.lit("")))
    host, path, tail = url_parts(F.col(key))
    urls = keyed.select(key).distinct().select(F.col(key).alias("url"), F.concat(host, tail).alias("subject"))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all(fold(F.col("subject")), F.lit(_TOKEN), F.lit(0))))
    index = build_index(urls, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fits = (
        urls.select("url", "subject", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.expr("subject RLIKE pattern"))
    )
    length = F.when(F.col("site"), F.length("rule"))
    other = lambda verdict: F.min(F.when(~F.col("site") & (F.col("rule_verdict") == verdict), F.col("rule")))
    judged = fits.groupBy(F.col("url").alias(f"{to}_url")).agg(
        F.max(F.when(F.col("site"), F.struct(length.alias("n"), "rule", "rule_verdict"))).alias(f"{to}_site"),
        other("block").alias(f"{to}_blocks"),
        other("allow").alias(f"{to}_allows"),
    )
    filter_ = F.when(F.col(f"{to}_allows").isNull(), F.col(f"{to}_blocks"))
    site = F.col(f"{to}_site")
    joined = keyed.join(judged, F.col(key) == F.col(f"{to}_url"), "left")
    out = {
        "host": host,
        "path": path,
        "rule": site["rule"],
        "verdict": F.coalesce(site["rule_verdict"], F.when(filter_.isNotNull(), F.lit("block")), F.lit(default)),
        "filter": filter_,
    }
    kept = [c for c in pages.columns if c.lower() not in out]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(n) for n, v in out.items()])
