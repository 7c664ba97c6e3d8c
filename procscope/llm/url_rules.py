"""URL filtering by pattern rules indexed by their rarest literal token.

Two kinds of rules, as text:

* ``host/path`` fits the host and its subdomains where the path starts with the rule's path;
* a wildcard pattern for the whole URL, in lower case, with ``*`` for anything and ``^`` for a
  separator or the end.

A rule is indexed under one token that every URL it fits must contain: the token that the fewest of
all URLs have. Tokens of a URL fetch rules by an equality join, and only fetched rules run their
regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are sent to every executor; beyond, the join is shuffled.
BROADCAST_RULES = 50_000
RULES = "rule string, action string, on_host boolean, weight long, regex string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    text: str
    action: str  # allow or block
    on_host: bool  # a host rule overrules every wildcard rule

    def row(self) -> tuple:
        build = self._host if self.on_host else self._wildcard
        regex, tokens = build()
        return self.text, self.action, self.on_host, len(self.text), regex, sorted(set(tokens))

    def _host(self) -> tuple[str, list[str]]:
        host, _, path = self.text.partition("/")
        # The last run of the path may go on in the URL, so it is no whole token.
        inner = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", "/" + path.lower())
        return (
            rf"(?s)\A(?:[^/?#]*\.)?{re.escape(host.lower())}/{re.escape(path)}",
            re.findall("[a-z0-9]+", host.lower()) + inner,
        )

    def _wildcard(self) -> tuple[str, list[str]]:
        text = self.text.lower()
        regex = "".join(
            {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(c, re.escape(c)) for c in text
        )
        return "(?s)" + regex, re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text)


def rule_table(spark, rules: Iterable[Rule]) -> DataFrame:
    rows = [r.row() for r in rules]
    return spark.createDataFrame(rows, RULES)


def split_url(url: str = "url") -> tuple[str, str]:
    """SQL of (host, path). Both empty for a null or a text without ``://``."""
    after = f"substring({url}, locate('://', {url}) + 3)"
    host = f"regexp_extract({after}, '(?s)^([^/?#]*)', 1)"
    path = f"regexp_extract(substring({after}, length({host}) + 1), '(?s)^([^?#]*)', 1)"
    known = f"locate('://', {url}) > 0"
    return (
        f"CASE WHEN {known} THEN translate({host}, '{UPPER}', '{LOWER}') ELSE '' END",
        f"CASE WHEN {known} THEN {path} ELSE '' END",
    )


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under its rarest token: (_token, rule, ...). ``tokens``: (_url, _token). A rule
    without a whole token is under '', which every URL has."""
    listed = rules.select("*", F.explode_outer("tokens").alias("_token"))
    wanted = listed.select("_token").where("_token IS NOT NULL").distinct()
    counts = tokens.join(wanted, "_token", "left_semi").groupBy("_token").agg(
        F.count("*").alias("_n")
    )
    best = listed.join(counts, "_token", "left").groupBy("rule", "action", "on_host").agg(
        F.expr("min_by(_token, struct(coalesce(_n, 0L), _token))").alias("_token"),
        F.first("weight").alias("weight"),
        F.first("regex").alias("regex"),
    )
    return best.withColumn("_token", F.coalesce("_token", F.lit("")))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and pattern.

    ``rule`` and its verdict come from the longest fitting host rule. Where none fits, ``rule`` is
    null and the verdict is that of the longest fitting wildcard rule, given in ``pattern``, or
    ``default``. Ties: block before allow, then the greater text. A null URL, or one without
    ``://``, has an empty host and path, so no host rule fits it. Rows are judged one by one:
    repeated or null page_id change nothing. Other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    host, path = split_url("_url")
    urls = pages.selectExpr("url AS _url").where("_url IS NOT NULL").distinct()
    whole = f"translate(_url, '{UPPER}', '{LOWER}')"
    urls = urls.selectExpr("_url", f"concat({host}, {path}) AS _hp", f"{whole} AS _low")
    tokens = urls.selectExpr(
        "_url", "_hp", "_low",
        "explode(array_append(array_distinct(regexp_extract_all(_low, '[a-z0-9]+', 0)), ''))"
        " AS _token",
    )
    index = indexed(rule_table(spark, rules), tokens.select("_url", "_token"))
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    best = "struct(on_host, weight, action = 'block' AS blocks, rule, action)"
    hits = (
        tokens.join(index, "_token")
        .where("CASE WHEN on_host THEN _hp ELSE _low END RLIKE regex")
        .groupBy("_url")
        .agg(F.expr(f"max({best})").alias("_hit"))
    )
    own, of_path = split_url("url")
    return (
        pages.select("page_id", "url")
        .join(hits, F.col("url") == F.col("_url"), "left")
        .selectExpr(
            "page_id", f"{own} AS host", f"{of_path} AS path",
            "CASE WHEN _hit.on_host THEN _hit.rule END AS rule",
            f"coalesce(_hit.action, '{default}') AS verdict",
            "CASE WHEN NOT _hit.on_host THEN _hit.rule END AS pattern",
        )
    )
