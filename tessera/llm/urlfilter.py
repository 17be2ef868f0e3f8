"""URL filter: host-suffix and path-prefix expressions matched by short hash, then by full digest.

Every url is expanded into the expressions that some rule could equal. They meet the rules in an
equi-join on the first hex digits of their SHA-256, and on nothing else; the rules of one short hash
come as a list, in which equal full digests confirm a match. The longest confirmed rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest on which expressions and rules are joined.
PREFIX_DIGITS = 8
#: Up to so many rules (200 bytes each, about) travel to every task; beyond, rules and expressions are
#: dealt by short hash, the expressions of a hot one to so many tasks, each with a copy of its rules.
MAX_BROADCAST_RULES = 100_000
SALTS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then
    up to ``?``, ``#`` or the end. Both are empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _lengths(rules: DataFrame, column: str) -> list[int]:
    """Distinct lengths of a rule column: no more numbers than the longest rule has characters."""
    return sorted(x[0] for x in rules.select(F.length(column)).distinct().collect())


def _listed(rules: DataFrame) -> DataFrame:
    """short, rules: one row per short hash, with the digest and the rank of each rule that has it.

    Rules are distinct, so a list holds what 32 bits of their digests have in common: a few at most.
    """
    whole = F.concat("host", "path")
    found = F.struct(F.length(whole).alias("length"), F.length("host").alias("host_length"), (F.col("action") == "block").alias("block"), whole.alias("rule"))
    each = rules.select(F.sha2(whole, 256).alias("digest"), found.alias("found"))
    return each.groupBy(F.substring("digest", 1, PREFIX_DIGITS).alias("short")).agg(F.collect_list(F.struct("digest", "found")).alias("rules"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and action ("block" or "allow"). A rule fits its host and all subdomains
    if the url's path starts with its path. The longest rule (host and path together) wins; of equally
    long ones that with the longer host, then block before allow. Without a fitting rule the rule is
    null and the verdict is ``default``. Rules with a null are ignored, rules may have any length; null
    urls have an empty host and path; urls are read whole, whatever their length; repeated pages give
    a row each; an empty table gives an empty result, no rules the default everywhere; other columns
    of ``pages`` are ignored.

    A page's expressions stay in the task that made them until its best rule is known: the only
    shuffle deals one row per page and task, so neither a frequent host, nor a frequent rule, nor a
    page that is repeated very often gathers rows in one task.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin("block", "allow"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").distinct()
    host_lengths, path_lengths = _lengths(rules, "host"), _lengths(rules, "path")
    listed = _listed(rules)

    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    ints = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    fits = F.filter(ints(host_lengths), lambda n: (n == F.length("host")) | ((n < F.length("host")) & (F.substr("host", F.length("host") - n, F.lit(1)) == ".")))
    suffixes = F.transform(fits, lambda n: F.right("host", n))
    prefixes = F.transform(F.filter(ints(path_lengths), lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    expressions = (
        judged.select("page_id", "host", "path", F.spark_partition_id().alias("task"), F.posexplode_outer(pairs).alias("place", "expression"))
        .withColumn("digest", F.sha2("expression", 256)).drop("expression")
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    if rules.count() <= MAX_BROADCAST_RULES:
        met = expressions.join(F.broadcast(listed), "short", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
        copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", salt).join(copies, ["short", "salt"], "left")
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("digest"))
    best = met.groupBy("page_id", "host", "path", "task").agg(
        F.max(F.array_max(F.transform(confirmed, lambda r: r["found"]))).alias("found"),
        F.sum((F.coalesce("place", F.lit(0)) == 0).cast("int")).alias("times"),
    )
    verdict = F.when(F.col("found").isNull(), default).when(F.col("found.block"), "block").otherwise("allow")
    best = best.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    return best.drop("time")
