"""URL allow and block rules by a sorted sweep over reversed-host keys.

A rule (host, path) fits its host and all subdomains, where the url's path starts with the rule's. With
the host's labels reversed, ``net.example./en/``, everything below a rule's host and path is one interval
of keys, and intervals of rules are nested or apart. A url is looked up once under each of its host's
suffixes that some rule names, which turns "and all subdomains" into equality and leaves the path as
the interval.

Rules and lookups are sorted together by range partitions. The sweep's state at a key is the stack of
nested rules opened last, of which those still open are the ones the key starts with. Each partition
takes over the state of the one before it, one row per partition, so a host that holds a third of all
urls is spread like any other range. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, ascii_lower


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _stacked(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule, the rules around it and itself, outermost first.

    Around a rule are rules of its host, found by cutting its path to the lengths that rules of the host
    have, and rules without a path of the hosts above.
    """
    key = _key(F.col("host"), F.col("path"))
    rule = F.struct(F.length(key).alias("size"), F.length("path").alias("n"), key.alias("key"),
                    F.concat("host", "path").alias("rule"), "verdict")
    known = rules.select("host", "path", rule.alias("of"))
    lengths = known.select("host", F.col("of.n").alias("n")).distinct()
    cut = known.join(lengths, "host").filter(F.col("n") <= F.col("of.n")).select(
        "host", F.col("of.key").alias("key"), F.substr("path", F.lit(1), F.col("n")).alias("path")
    )
    labels = F.split("host", r"\.", -1)
    above = known.filter(F.size(labels) > 1).select(
        F.explode(F.transform(F.sequence(F.lit(2), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))).alias("host"),
        F.col("of.key").alias("key"), F.lit("").alias("path"),
    )
    around = cut.unionByName(above).join(known, ["host", "path"])
    return around.groupBy("key").agg(F.sort_array(F.collect_list("of")).alias("stack"))


def _key(host: Column, path: Column) -> Column:
    return F.concat(_reversed(host), path)


def _sweep(rules: DataFrame, lookups: DataFrame, scratch: Scratch) -> DataFrame:
    """Each lookup (key, host, path) with the innermost rule around its key as ``of``, if there is one."""
    none = F.lit(None)
    opened = rules.select("key", F.lit(0).alias("kind"), none.cast("string").alias("host"), none.cast("string").alias("path"), "stack")
    asked = lookups.select("key", F.lit(1).alias("kind"), "host", "path").withColumn("stack", none.cast(rules.schema["stack"].dataType))
    order = ["key", "kind", "host", "path"]
    swept = opened.unionByName(asked).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    swept = scratch.keep(swept, "swept")
    ends = swept.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    parts = swept.select("part").distinct().join(ends, "part", "left")
    # One row per partition.
    carried = parts.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.last("stack", True).over(Window.partitionBy("part").orderBy(*order))
    state = swept.withColumn("here", here).filter("kind = 1").join(carried, "part")
    still = F.filter(F.coalesce("here", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    return state.select("host", "path", F.try_element_at(still, F.lit(-1)).alias("of"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (null if none fits), verdict (the rule's, else ``default``).

    ``rules`` has host, path and verdict; the longest fitting rule wins, as measured by host and path
    together, and of equal ones that of the longer host. Of contradicting rules ``block`` wins. A null url
    or one without ``://`` has an empty host and path. Ids may be null or repeated; each row has a result.
    """
    scratch = Scratch(pages.sparkSession)
    # Paths of urls are empty or begin with a slash; no other rule can fit.
    rules = rules.filter("host IS NOT NULL AND (path = '' OR startswith(path, '/'))").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = scratch.keep(rules, "rules")
    labels = F.size(F.split("host", r"\.", -1))
    longest = rules.agg(F.max(labels)).first()[0] or 0
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, longest)))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    asked = asked.join(rules.select(F.col("host").alias("suffix")).distinct(), "suffix", "left_semi")
    lookups = asked.select(_key(F.col("suffix"), F.col("path")).alias("key"), "host", "path")
    fitting = _sweep(_stacked(rules), lookups, scratch).filter("of IS NOT NULL")
    size = F.struct(F.length("of.rule"), -F.col("of.n"))
    best = fitting.groupBy("host", "path").agg(F.max_by("of", size).alias("of"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("of.rule").alias("rule"),
        F.coalesce("of.verdict", F.lit(default)).alias("verdict"),
    )
