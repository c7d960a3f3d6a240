"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any matching URL
must hold. Each rule is filed under the one of its tokens that the fewest URLs
have. A URL's own tokens fetch its candidate rules; only those run their
regular expression. DataFrame functions only.

Host rules (host, path) become such rules over host and path; among those that
fit, the longest wins and decides. Where none fits, pattern rules decide:
an allow pattern that matches beats block patterns, and without any the URL is
allowed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, spread_join, stored


class Rule(NamedTuple):
    name: str
    verdict: str
    regex: str  # over lower-case host followed by path, query and fragment
    tokens: tuple[str, ...]
    weight: int  # of rules that fit, the largest decides; 0: pattern rule


def host_rule(verdict: str, rule: str) -> Rule:
    """`example.com/en/`: the host, its subdomains, and paths that start with the rule's."""
    host, _, path = rule.partition("/")
    regex = r"^(?:[^/?#]*\.)?" + re.escape(host) + re.escape("/" + path)
    # The last piece of a path goes on in the URL, so it is no whole token unless a slash ends it.
    closed = rule if rule.endswith("/") else rule.rpartition("/")[0]
    return Rule(rule, verdict, regex, tuple(re.findall(r"[a-z0-9]+", closed.lower())), len(rule))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A pattern with `*` for any run and `^` for a separator or the end, or in front for a separator or the start, anywhere in the URL.

    Tokens are its literal runs that stand between separators; one is needed.
    """
    rest = pattern.removeprefix("^")
    start = r"(?:^|[^\w%-])" if rest != pattern else ""
    regex = start + "".join({"*": ".*", "^": r"(?:[^\w.%-]|$)"}.get(c, re.escape(c)) for c in rest)
    tokens = tuple(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern.lower()))
    if not tokens:
        raise ValueError(f"no whole literal token in {pattern!r}")
    return Rule(pattern, verdict, regex, tokens, 0)


HOST_RULES = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
PATTERN_RULES = (
    pattern_rule("block", "spam-farm."),
    pattern_rule("block", "casino-win."),
    pattern_rule("block", "free-bets."),
    pattern_rule("block", "cheap-pills."),
    pattern_rule("block", "adult-x."),
    pattern_rule("block", "?affiliate="),
    pattern_rule("allow", "/en/help/"),
)
RULE = "name string, verdict string, regex string, tokens array<string>, weight int"


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules of a text file: a line each with verdict, `host` or `pattern`, and the rule; `#` starts a comment."""
    found = []
    for r in spark.read.text(path).collect():  # a rule list is a small file, made by hand
        parts = r.value.partition("#")[0].split(maxsplit=2) if not r.value.startswith("#") else []
        if parts:
            verdict, kind, rule = (*parts, "", "")[:3]
            if verdict not in ("allow", "block") or kind not in ("host", "pattern") or not rule:
                raise ValueError(f"no rule: {r.value!r}")
            found.append({"host": host_rule, "pattern": pattern_rule}[kind](verdict, rule.strip()))
    return tuple(found)


def host_of(url: Column) -> Column:
    """Behind the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _ascii_lower(host)


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _target(url: Column) -> Column:
    """Host and all that follows it, the host lower-cased."""
    rest = _rest(url)
    return F.concat(host_of(url), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)", 1))


def _tokens(target: Column) -> Column:
    return F.filter(F.array_distinct(F.split(_ascii_lower(target), "[^a-z0-9]+")), lambda t: t != "")


def token_counts(urls: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token that a rule names, over all URLs; as many rows as such tokens."""
    named = sorted({t for r in rules for t in r.tokens})
    held = _tokens(_target(F.col(url_col)))
    counts = (
        urls.select(F.explode(F.array_intersect(held, F.array(*map(F.lit, named)))).alias("token"))
        .groupBy("token")
        .count()
        .collect()
    )
    return dict.fromkeys(named, 0) | {r.token: r["count"] for r in counts}


def judge(
    urls: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] | DataFrame = HOST_RULES + PATTERN_RULES,
    max_rules: int = 500,
) -> DataFrame:
    """Per row: id, host, path, rule (the host rule that decides, else null), verdict.

    Null URLs, and those without `://`, have empty host and path and are
    allowed, as is all that no rule fits. Rows repeat as they come. An index of up to
    max_rules rules is a literal of the plan, so it reaches tasks without a shuffle. A
    longer list, or one that is a table (name, verdict, regex, tokens, weight), is joined by token:
    both ways give the same rows.
    """
    if isinstance(rules, DataFrame) or len(rules) > max_rules:
        if not isinstance(rules, DataFrame):
            rows = [(r.name, r.verdict, r.regex, list(r.tokens), r.weight) for r in rules]
            rules = urls.sparkSession.createDataFrame(rows, RULE)
        return _by_table(urls, rules, id_col, url_col)
    counts = token_counts(urls, rules, url_col) if rules else {}
    url = F.col(url_col)
    read = urls.select(
        F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), _target(url).alias("target")
    ).withColumn("tokens", _tokens(F.col("target")))
    found = F.array().cast("array<struct<weight:int,name:string,verdict:string>>")
    judged = read.withColumn("found", _fitting(rules, counts) if rules else found)
    hosts = F.filter("found", lambda r: r["weight"] > 0)
    best = F.array_max(hosts)
    plain = F.filter("found", lambda r: r["weight"] == 0)
    fallback = F.when(
        F.exists(plain, lambda r: r["verdict"] == "block") & ~F.exists(plain, lambda r: r["verdict"] == "allow"),
        F.lit("block"),
    ).otherwise(F.lit("allow"))
    return judged.select(
        id_col, "host", "path", best["name"].alias("rule"), F.coalesce(best["verdict"], fallback).alias("verdict")
    )


def _by_table(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """Distinct URLs' tokens meet the index in an equi-join; what it fetches is tried, and goes back by the URL's digest.

    Tokens are counted before they meet the rules, so none moves as rows there. A token that holds more than
    a thousandth of what all named ones hold is spread over salts.
    """
    url = F.col(url_col)
    rows = urls.select(F.col(id_col), url.alias("__url"), F.unhex(F.sha2(F.encode(url, "UTF-8"), 256)).alias("key"))
    texts = stored(rows.where("key is not null").groupBy("key").agg(F.first("__url").alias("u"), F.count("*").alias("copies")), "urls")
    target = texts.select("key", _target(F.col("u")).alias("target"))
    held = target.select("key", F.explode(_tokens(F.col("target"))).alias("token"))
    named = rules.withColumn("rule", F.struct("weight", "name", "verdict", "regex")).select("rule", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").count().join(named.select("token").distinct(), "token", "left_semi")
    counts = stored(counts, "url-tokens")
    limit = (counts.agg(F.sum("count")).first()[0] or 0) // HOT + 1
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))
    filed = named.join(counts, "token", "left").groupBy("rule").agg(rarest.alias("r")).select("rule", "r.*")
    filed = stored(filed.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("count") / limit)).cast("int")), "url-rules")
    # At most HOT tokens are spread. URLs that hold one are dealt to its salts, and its rules go to all of them.
    hot = F.broadcast(filed.where("salts > 1").select("token", "salts").distinct())
    salt = F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = held.join(hot, "token", "left").select("key", "token", salt.alias("salt"))
    spread = filed.select("rule", "token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    fetched = dealt.join(spread, ["token", "salt"]).select("key", "rule")
    tried = fetched.join(target, "key").where(F.regexp_like("target", F.col("rule.regex")))
    host = F.col("rule.weight") > 0
    best = tried.groupBy("key").agg(
        F.max(F.when(host, F.struct("rule.weight", "rule.name", "rule.verdict"))).alias("best"),
        F.bool_or(F.when(~host, F.col("rule.verdict") == "block")).alias("block"),
        F.bool_or(F.when(~host, F.col("rule.verdict") == "allow")).alias("allow"),
    )
    known = stored(best.join(texts.select("key", "copies"), "key"), "url-verdicts")
    joined = spread_join(rows, known, "key", rows.count(), "left")
    fallback = F.when(F.coalesce("block", F.lit(False)) & ~F.coalesce("allow", F.lit(False)), "block").otherwise("allow")
    return joined.select(
        id_col, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"),
        F.col("best.name").alias("rule"), F.coalesce("best.verdict", fallback).alias("verdict"),
    )


def _fitting(rules: tuple[Rule, ...], counts: dict[str, int]) -> Column:
    """The rules that fit: fetched by token from the index, then tried."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(r)
    entries = []
    for token in sorted(index):
        filed = [
            F.struct(
                F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"),
                F.lit(r.regex).alias("regex"),
            )
            for r in index[token]
        ]
        entries += [F.lit(token), F.array(*filed)]
    by_token = F.create_map(*entries)
    keys = F.array(*map(F.lit, sorted(index)))
    fetched = F.flatten(F.transform(F.array_intersect(F.col("tokens"), keys), lambda t: by_token[t]))
    tried = F.filter(fetched, lambda r: F.regexp_like(F.col("target"), r["regex"]))
    return F.transform(tried, lambda r: F.struct(r["weight"], r["name"], r["verdict"]))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '(?s)^[^/?#]*(.*)', 1) AS tail
  FROM u),
r(host_part, path_part, name, rule_verdict) AS (
  VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
         ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
         ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(rule_verdict, length(name)) AS rule_verdict
  FROM p, r
  WHERE (p.host = host_part OR ends_with(p.host, '.' || host_part)) AND starts_with(p.path, path_part)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.rule_verdict,
    CASE WHEN (contains(host || tail, 'spam-farm.') OR contains(host || tail, 'casino-win.')
               OR contains(host || tail, 'free-bets.') OR contains(host || tail, 'cheap-pills.')
               OR contains(host || tail, 'adult-x.') OR contains(host || tail, '?affiliate='))
              AND NOT contains(host || tail, '/en/help/')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
