"""URL filter: rules indexed by their rarest literal token, run only where a URL has that token.

DataFrame functions only. A rule is a row of (rule, verdict, base, whole, pattern, tokens): ``pattern`` is a regular expression
over ``host + path`` (or over the whole URL, lower case, where ``whole`` is set) and ``tokens``
are whole letter-digit runs that every URL it matches must contain, so a run at the end of a
rule's path, which may go on in the URL, is none. Of those the token that the
fewest URLs of the input contain is the rule's index key; the counts cover all URLs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumic.llm._arrow import named

#: Indexes up to this many rules are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")

# Host and path rules, the longest that fits wins.
BASE_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Patterns over the whole URL in lower case, each with tokens that any match contains.
PATTERN_RULES = (
    (r"[/.-]spam[.-]", ("spam",)),
    (r"[/.-]cheap-pills[./-]", ("cheap", "pills")),
    (r"[/.-]online-casino[./-]", ("online", "casino")),
    (r"[/.-]casino[./-]", ("casino",)),
    (r"[/.-]viagra[./-]", ("viagra",)),
    (r"[/.-]porn[./-]", ("porn",)),
    (r"[/.-]xxx[./-]", ("xxx",)),
    (r"[/.-]link-farm[./-]", ("link", "farm")),
    (r"/wp-login\.php(?:[^a-z0-9]|$)", ("wp", "login", "php")),
    (r"/cgi-bin/", ("cgi", "bin")),
)


def host_path_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host, its subdomains and the paths that start with ``path`` (empty, or from a slash)."""
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path) if path else '(?:/|$)'}"
    tokens = _TOKEN.findall(host) + [m[0].lower() for m in re.finditer("[A-Za-z0-9]+", path) if m.end() < len(path)]
    return (host + path, verdict, True, False, pattern, tokens)


def rules(spark: SparkSession, base=BASE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """The rule table, built from literals."""
    rows = [host_path_rule(*r) for r in base]
    rows += [(p, "block", False, True, p, list(tokens)) for p, tokens in patterns]
    names = ("rule", "verdict", "base", "whole", "pattern", "tokens")
    literals = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*literals)))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(df: DataFrame, rule_table: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, rule and verdict of every URL.

    Returns ``id_col``, ``host``, ``path``, ``rule`` (the longest host and path rule that
    fits, of equals the least; else null), ``pattern`` (of the further rules that match, if no
    host and path rule fits, the longest, of equals the least; else null) and ``verdict``. A
    null URL or one without ``://`` has an empty host and path and no host and path rule; a
    null id stays null; repeated rows each give a row; other columns are not read; an empty
    table gives an empty result. A rule without tokens is an error, as nothing would fetch it.

    Candidates are fetched and run in each URL's own row, and what they find is gathered by row,
    so a URL that very many rows share costs no task more than others.
    """
    after = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    pages = df.select(named(id_col, "id"), F.coalesce(named(url_col, "url"), F.lit("")).alias("url"))
    # Rows of a scan keep their place in it, so these numbers are the same when a task is repeated.
    pages = pages.select(F.monotonically_increasing_id().alias("row"), "id", "url", ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)).alias("host"), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    numbered = rule_table.select(F.xxhash64("rule", "base").alias("number"), "*")
    wanted = numbered.select("number", F.explode("tokens").alias("token"))
    distinct = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("url")), F.lit(r"[a-z0-9]+"), F.lit(0)))
    n_rules, without = rule_table.agg(F.count("*"), F.min(F.when(F.coalesce(F.size("tokens"), F.lit(0)) <= 0, F.col("rule")))).first()
    if without is not None:
        raise ValueError(f"no token to fetch the rule {without!r} by")
    small = n_rules <= BROADCAST_RULES
    sized = F.broadcast if small else lambda x: x

    # Rarity of the rules' tokens over all URLs, then one index row for each rule.
    counts = pages.select(F.explode(distinct).alias("token")).join(sized(wanted.select("token").distinct()), "token").groupBy("token").count()
    rarest = wanted.join(sized(counts) if small else counts, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
    index = rarest.select("number", F.col("r.token").alias("token")).join(numbered.drop("tokens"), "number")

    subject = F.when(F.col("whole"), ascii_lower(F.col("url"))).otherwise(F.concat("host", "path"))
    # Least of (kind, -length, text): host and path rules first, then the longest, then the least.
    found = F.when(F.col("token") != "", F.struct((~F.col("base")).alias("further"), (-F.length("rule")).alias("shorter"), "rule", "verdict"))
    # The empty token, which fetches nothing, keeps the row of a URL without hits.
    fetched = pages.select("*", F.explode(F.concat(F.array(F.lit("")), distinct)).alias("token")).join(sized(index), "token", "left")
    hits = fetched.where((F.col("token") == "") | F.rlike(subject, F.col("pattern")))
    out = hits.groupBy("row", "id", "host", "path").agg(F.min(found).alias("b"))
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(~F.col("b.further"), F.col("b.rule")).alias("rule"),
        F.when(F.col("b.further"), F.col("b.rule")).alias("pattern"),
        F.coalesce("b.verdict", F.lit(default)).alias("verdict"),
    )
