"""Allow and block rules on URLs, by host suffix and path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which they are broadcast; more are joined by shuffle.
BROADCAST_RULES = 200_000
#: Hexadecimal digits of a digest that the join compares first.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(labels: list[int], lengths: list[int]) -> Column:
    """The host's suffixes of as many labels as some rule has, joined to the path's prefixes of the rules' lengths."""
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]).cast("array<string>"))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]),
                        lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(
        s.alias("s"), p.alias("p")))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per input row: its id as ``page_id``, host, path, rule, verdict.

    ``rules``: host, path and verdict (``allow`` or ``block``). A rule fits its host and all subdomains if the path of
    the URL starts with the rule's. The longest rule wins; of equally long ones the one with the longer host, of the same
    rule given twice the block. URLs that no rule fits get ``default`` and a null rule, null URLs and those without
    ``://`` too, with empty host and path. Each distinct URL is judged once, whatever the number of its pages. Expressions
    are joined on the first digits of their digests and confirmed by the whole digest, then by the text.
    """
    listed = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
              .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
              .select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict",
                      F.concat("host", F.lit("\n"), "path").alias("key"))
              .withColumn("r_digest", F.sha2("key", 256))
              .withColumn("short", F.substring("r_digest", 1, SHORT)).drop("key"))
    # as many numbers as there are different lengths of paths and numbers of labels
    sizes = listed.agg(F.collect_set(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path"))).first()
    labels, lengths = map(sorted, sizes)
    urls = pages.select(F.col(url_col).cast("string").alias("url")).distinct().select(
        "url", host_of("url").alias("host"), path_of("url").alias("path"))
    tried = (urls.select("url", F.explode(_expressions(labels, lengths)).alias("x"))
             .withColumn("digest", F.sha2(F.concat("x.s", F.lit("\n"), "x.p"), 256))
             .withColumn("short", F.substring("digest", 1, SHORT)))
    few = listed.limit(broadcast_rules + 1).count() <= broadcast_rules
    hit = (tried.join(F.broadcast(listed) if few else listed, "short")
           .where("digest = r_digest AND x.s = r_host AND x.p = r_path"))
    best = hit.groupBy("url").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), "verdict",
        F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .join(best, "url", "left")
            .select("page_id", host_of("url").alias("host"), path_of("url").alias("path"),
                    F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
