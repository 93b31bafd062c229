"""URL filters, with DataFrame functions only: pattern rules indexed by their
rarest literal token. The tokens of a URL fetch candidate rules, and regular
expressions run for those alone."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
#: Above so many rules the index is joined by token rather than held in the plan.
MAP_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path. It is a host suffix and a path
    prefix (``example.net/en/``: that host, its subdomains, paths that start so),
    or, where it holds a ``*``, a wildcard pattern of the whole, in which ``*``
    stands for any characters. Rules of a higher ``rank`` go before the others;
    within a rank the longest pattern wins, then the first by code point."""

    verdict: str
    pattern: str
    rank: int = 0

    @property
    def regex(self) -> str:
        if "*" in self.pattern:
            return "(?s)^" + ".*".join(re.escape(x) for x in self.pattern.split("*")) + "$"
        return r"(?s)^([^/]*\.)?" + re.escape(self.pattern)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every match holds as whole tokens: no wildcard, nor the open end of a prefix, touches them."""
        text = self.pattern
        found = [(m.group(), m.start(), m.end()) for m in re.finditer(TOKEN, text.lower())]
        whole = lambda a, b: (a == 0 or text[a - 1] != "*") and (b < len(text) and text[b] != "*" or b == len(text) and "*" in text)
        return sorted({t for t, a, b in found if whole(a, b)})


#: fixed values: the rules of the query's contract
CONTRACT_RULES = (Rule("block", "net/", 1), Rule("allow", "example.net/en/", 1), Rule("block", "example.com/de/", 1), Rule("allow", "org/fr/", 1))
#: fixed values: words of host names that mark unwanted sites, each with the forms in which a label holds it
UNWANTED = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
PATTERN_RULES = tuple(Rule("block", form) for name in UNWANTED for form in (f"{name}.*", f"*.{name}.*"))


def parsed(url: str):
    """host and path columns: the host after the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z
    lower-cased; the path from there up to ``?``, ``#`` or the end. Both are empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def indexed(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """The rules by their rarest token: the one that the fewest urls of ``pages`` hold. Rules without a token stand under ''.
    Only the counts of the rules' own tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = pages.sparkSession
    counts: dict[str, int] = {}
    if wanted:
        own = spark.createDataFrame([(t,) for t in wanted], "token string")
        held = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), 1))).alias("token"))
        counts = dict(held.join(F.broadcast(own), "token").groupBy("token").count().collect())
    out: dict[str, list[Rule]] = {}
    for r in rules:
        best = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        out.setdefault(best, []).append(r)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, rank, verdict of every row of ``pages``.

    Null urls, and urls without ``://``, have an empty host and path; only rules
    that match the empty string fit them. Repeated rows are judged alike, and an
    empty table gives no rows. Where no rule fits, rule and rank are null and the
    verdict is ``default``. Other columns of ``pages`` play no part.
    """
    host, path = parsed("url")
    seen = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    index = indexed(seen, rules)
    row = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(len(r.pattern)).alias("length"), F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))
    seen = seen.withColumn("whole", F.concat("host", "path"))
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(F.lower("whole"), F.lit(f"({TOKEN})"), 1), F.array(F.lit(""))))
    if len(rules) <= MAP_RULES:
        by_token = F.create_map(*(x for t, held in index.items() for x in (F.lit(t), F.array(*map(row, held)))))
        fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(by_token, t)), lambda x: x.isNotNull()))
        seen = seen.withColumn("fetched", fetched)
    else:
        flat = [(t, r.rank, len(r.pattern), r.pattern, r.verdict, r.regex) for t, held in index.items() for r in held]
        by_token = pages.sparkSession.createDataFrame(flat, "token string, rank int, length int, rule string, verdict string, regex string")
        fits = seen.select("whole").distinct().withColumn("token", F.explode(F.array_distinct(F.concat(F.regexp_extract_all(F.lower("whole"), F.lit(f"({TOKEN})"), 1), F.array(F.lit("")))))).join(by_token, "token").where("whole rlike regex")
        best = fits.groupBy("whole").agg(F.array(F.min_by(F.struct("rank", "length", "rule", "verdict", "regex"), F.struct(-F.col("rank"), -F.col("length"), "rule"))).alias("fetched"))
        seen = seen.join(best, "whole", "left")
    fits = F.filter("fetched", lambda r: F.rlike(F.col("whole"), r["regex"]))
    best = F.array_sort(fits, lambda a, b: F.when(a["rank"] != b["rank"], b["rank"] - a["rank"]).when(a["length"] != b["length"], b["length"] - a["length"]).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    seen = seen.withColumn("best", F.try_element_at(best, F.lit(1)))
    return seen.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rank").alias("rank"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
