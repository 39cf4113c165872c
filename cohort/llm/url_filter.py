"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over the URL with a list of literal tokens (runs of a-z, 0-9 in lower case) that
every match must contain.  The index files each rule under the token that fewest of the given URLs
hold.  A URL's tokens fetch the candidate rules, and only those run their expression.  Rules without a literal are
candidates of every URL.

Up to ``LOCAL_RULES`` rules the index is a Spark broadcast and URLs are judged where they are read, without a shuffle.
Beyond that, the index stays a table: tokens of the distinct URLs join with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, ref

LOCAL_RULES = 50_000
TOKEN = re.compile("[0-9a-z]+")
#: Only A-Z have small letters here, as in patterns and hosts: other letters that Unicode lower-cases into a-z are none of theirs.
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


@dataclass(frozen=True)
class Rule:
    """``text`` names the rule, ``rank`` orders the rules that fit (largest wins, then the text)."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True


def host_rule(verdict: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the path starts with the rule's path; longer rules win."""
    host, slash, path = text.partition("/")
    if not host or not slash:
        raise ValueError(f"not host/path: {text!r}")
    host = host.translate(_LOWER)
    pattern = r"^://(?:[^/?#]*\.)?" + re.escape(host) + re.escape(slash + path)
    # a token at the path's end may go on in the URL, so it is none of the URL's tokens for sure
    closed = [m[0] for m in TOKEN.finditer(path.translate(_LOWER)) if m.end() < len(path)]
    return Rule(text, verdict, pattern, tuple(dict.fromkeys(TOKEN.findall(host) + closed)), len(text))


def keyword_rule(verdict: str, *words: str) -> Rule:
    """The words, in order, as whole tokens of the URL's host; weaker than every host rule."""
    body = r"[^/?#]*(?<![0-9a-z])".join(re.escape(w) + r"(?![0-9a-z])" for w in words)
    return Rule("-".join(words), verdict, r"^://(?:[^/?#]*(?<![0-9a-z]))?" + body, words, 0, listed=False)


#: Verdicts for hosts that no listed rule names, by the method: gambling, adult, advertising and spam words.
KEYWORDS = tuple(
    keyword_rule("block", *w.split())
    for w in ("casino", "poker", "porn", "xxx", "ads track", "spam", "adserver", "doubleclick", "viagra", "torrent", "free money")
)
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host with A-Z lower-cased, path, URL with that host); host and path empty for null or without ``://``."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host = rest[:cut].translate(_LOWER)
    end = min((i for i in (rest.find("?", cut), rest.find("#", cut)) if i >= 0), default=len(rest))
    return host, rest[cut:end], "://" + host + rest[cut:end]


def url_tokens(host_and_path: str) -> set[str]:
    return set(TOKEN.findall(host_and_path.translate(_LOWER)))


def best(rules: Iterable[tuple], url: str):
    """Of candidate rules (rank, text, verdict, compiled, listed), the largest that fits."""
    fits = [r for r in rules if r[3].search(url)]
    return max(fits, key=lambda r: (r[0], r[1]), default=None)


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many rows of ``urls(url)`` each literal of the rules stands: at most one row a literal comes back."""
    spark = urls.sparkSession
    literals = sorted({t for r in rules for t in r.tokens})
    if not literals:
        return {}
    known = spark.createDataFrame([(t,) for t in literals], "token string")
    # counted before the join: of a token that stands in most URLs, each task hands on one row
    seen = urls.select(F.explode(F.array_distinct(F.split(F.translate("url", ascii_uppercase, ascii_lowercase), "[^0-9a-z]+"))).alias("token"))
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r.token: r.n for r in counts.join(known, "token", "left_semi").collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal; those without one under the empty string."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


JUDGED = "host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = DEFAULT, local_rules: int = LOCAL_RULES) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict``; of several rules that fit, the longest wins.

    A null URL, or one without ``://``, has an empty host and path, no rule, and the default verdict.  Every input row, repeated
    or not, gives one output row; an empty table none; URLs of any length are judged whole.  Input columns called host, path, rule or
    verdict are replaced, others stay.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url_col]
    counts = token_counts(pages.select(ref(url_col).alias("url")), rules)
    index = build_index(rules, counts)
    if len(rules) > local_rules:
        return _judge_by_join(pages, index, url_col, default, kept)
    shared = spark.sparkContext.broadcast({t: [(r.rank, r.text, r.verdict, r.pattern, r.listed) for r in rs] for t, rs in index.items()})
    compiled: dict[str, list[tuple]] = {}

    @F.pandas_udf(JUDGED)
    def judge(urls: pd.Series) -> pd.DataFrame:
        def fetch(token: str) -> list[tuple]:
            if token not in compiled:
                compiled[token] = [(*r[:3], re.compile(r[3]), r[4]) for r in shared.value.get(token, ())]
            return compiled[token]

        rows = []
        for url in urls:
            host, path, whole = split_url(url)
            # only tokens that head the index are looked up, so `compiled` stays as small as the index
            heads = [t for t in url_tokens(whole) if t in shared.value] if whole else []
            won = best([r for t in [*heads, ""] for r in fetch(t)], whole) if whole else None
            rows.append((host, path, won[1] if won and won[4] else None, won[2] if won else default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    (tmp,) = fresh(pages, "judged_")
    return pages.withColumn(tmp, judge(ref(url_col))).select(
        *[ref(c) for c in kept], *[ref(tmp)[c].alias(c) for c in ("host", "path", "rule", "verdict") if c not in kept]
    )


def _judge_by_join(pages: DataFrame, index: dict[str, list[Rule]], url_col: str, default: str, kept: list[str]) -> DataFrame:
    """As above with the index as a table: tokens of distinct URLs fetch candidates by a join."""
    spark = pages.sparkSession

    @F.pandas_udf("host string, path string, whole string, tokens array<string>")
    def parts(urls: pd.Series) -> pd.DataFrame:
        rows = [(*s, sorted(url_tokens(s[2])) + [""] if s[2] else []) for s in map(split_url, urls)]
        return pd.DataFrame(rows, columns=["host", "path", "whole", "tokens"])

    @F.pandas_udf("boolean")
    def fits(patterns: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([bool(re.search(p, u)) for p, u in zip(patterns, urls, strict=True)])

    rules = spark.createDataFrame(
        [(t, r.rank, r.text, r.verdict, r.pattern, r.listed) for t, rs in index.items() for r in rs],
        "token string, rank int, text string, verdict string, pattern string, listed boolean",
    )
    urls = pages.select(ref(url_col).alias("u")).distinct().withColumn("p", parts("u")).select("u", "p.*")
    won = (
        urls.select("u", "whole", F.explode("tokens").alias("token")).join(rules, "token")
        .where(fits("pattern", "whole"))
        .groupBy("u").agg(F.max(F.struct("rank", "text", "verdict", "listed")).alias("w"))
    )
    judged = checkpointed(
        urls.join(won, "u", "left").select(
            "u", "host", "path", F.when(F.col("w.listed"), F.col("w.text")).alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict")
        )
    )
    (u,) = fresh(pages, "u_")
    right = judged.withColumnRenamed("u", u)
    return pages.drop(*[c for c in pages.columns if c not in kept]).join(right, ref(url_col).eqNullSafe(ref(u))).select(
        *[ref(c) for c in kept], *[right[c] for c in ("host", "path", "rule", "verdict") if c not in kept]
    )
