"""URL filters: rules for hosts and paths, and for the other urls a tree of path templates with labels.

Each host has a tree of its paths' segments. Level by level, a segment with enough pages below its node stays, whatever
share of the node that is, and all rarer ones are variable and become a wildcard. Branches of one node whose labels do not differ significantly are merged, from the leaves up. A
template is rejected when the smoothed share of its labelled pages that are bad reaches a limit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from clickwarden.llm.common import saved

#: Levels of the tree at least, and the pages that a segment needs to stay. The tree goes on as deep as any segment of a host's
#: paths has that many pages in one place; only what is deeper, where nothing can stay, becomes one last segment.
LEVELS, LEAST_PAGES = 4, 5
#: Branches merge if their bad share is within so many standard errors of their common one.
ALIKE = 1.96
#: The smoothing adds so many pages with the corpus' bad share; a template with at least the limit is rejected.
SMOOTHING, LIMIT = 10.0, 0.5
WILD, DEEPER, MERGED = "*", "**", "~"
#: Broadcast a table of this many rows at most.
BROADCAST_ROWS = 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, in small letters, and path; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), letters, letters.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (`host/path prefix`, verdict)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda one: len(one[0])):  # the longest is looked at first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def _segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def _depth(pages: DataFrame) -> int:
    """Levels below which no segment can stay; LEVELS at least."""
    deep = pages.where(F.size("segments") > LEVELS).select("host", F.posexplode("segments").alias("at", "segment"))
    often = deep.where(F.col("at") >= LEVELS).groupBy("host", "at", "segment").agg(F.count(F.lit(1)).alias("n"))
    last = often.where(F.col("n") >= LEAST_PAGES).agg(F.max("at").alias("last")).first()["last"]
    return LEVELS if last is None else last + 1


def path_templates(pages: DataFrame) -> DataFrame:
    """Pages with host and `segments` get `template`: the segments with variable ones as wildcards."""
    levels = _depth(pages)
    state = saved(pages.withColumn("template", F.array().cast("array<string>")))
    for level in range(levels):
        state = state.withColumn("segment", F.get("segments", F.lit(level)))
        common = saved(state.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment")
                       .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
                       .select("host", "template", "segment", F.lit(True).alias("stays")))
        small = common.count() <= BROADCAST_ROWS
        joined = state.join(F.broadcast(common) if small else common, ["host", "template", "segment"], "left")
        step = F.when(F.col("stays"), F.col("segment")).otherwise(F.lit(WILD))
        state = saved(joined.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(
            F.concat("template", F.array(step)))).drop("segment", "stays"))
    deeper = F.size("segments") > levels
    return state.withColumn("template", F.when(deeper, F.concat("template", F.array(F.lit(DEEPER)))).otherwise(F.col("template")))


@F.pandas_udf(ArrayType(IntegerType()))
def _groups(labelled: pd.Series, bad: pd.Series) -> pd.Series:
    """The number of each one's group; they come in the order of their bad shares, those without labels first."""
    out = []
    for ns, bads in zip(labelled, bad, strict=True):
        group, n, sum_bad, numbers = 0, 0.0, 0.0, []
        for own, own_bad in zip(ns, bads, strict=True):
            differs = n == 0 and own > 0 and bool(numbers)
            if n and own:
                pooled = (sum_bad + own_bad) / (n + own)
                differs = own_bad / own - sum_bad / n > ALIKE * max(pooled * (1 - pooled) * (1 / own + 1 / n), 0.0) ** 0.5
            if differs:
                group, n, sum_bad = group + 1, 0.0, 0.0
            n, sum_bad = n + own, sum_bad + own_bad
            numbers.append(group)
        out.append(numbers)
    return pd.Series(out, dtype=object)


def merged_templates(templates: DataFrame) -> DataFrame:
    """host, template, labelled, bad get `branch`: the template with merged segments marked and numbered, and its sums.

    The branches of a node stand in the order of their bad shares, those with equal shares being one. One that does not differ
    by a two-proportion test from all labels of the group before it joins that group, else it begins the next. Branches without
    labels make up a group of their own.
    """
    levels = templates.agg(F.max(F.size("template")).alias("levels")).first()["levels"] or 0
    state = templates.withColumn("branch", F.col("template"))
    for level in reversed(range(levels)):
        before, after = F.slice("branch", 1, level), F.slice("branch", level + 2, levels)
        siblings = F.concat(before, F.array(F.lit(MERGED)), after)
        branches = saved(state.where(F.size("branch") > level).groupBy("host", "branch")
                         .agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"))
                         .withColumns({"siblings": siblings, "share": F.try_divide("bad", "n")}))
        # A row for each node, with its different shares: with N labels of 0 or 1 fewer than 3 N^(2/3).
        shares = (branches.groupBy("host", "siblings", "share").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").alias("bad"))
                  .groupBy("host", "siblings").agg(F.sort_array(F.collect_list(F.struct("share", "n", "bad"))).alias("own")))
        grouped = shares.select("host", "siblings", "own", _groups("own.n", "own.bad").alias("groups")).select(
            "host", "siblings", F.inline(F.arrays_zip(F.col("own.share").alias("share"), F.col("groups").alias("group"))))
        grouped = grouped.select(*[F.col(name).alias(f"of_{name}") for name in ("host", "siblings", "share")], "group")
        numbered = branches.join(grouped, (F.col("host") == F.col("of_host")) & (F.col("siblings") == F.col("of_siblings"))
                                 & F.col("share").eqNullSafe(F.col("of_share")))
        joined = F.concat(before, F.array(F.concat(F.lit(MERGED), F.col("group").cast("string"))), after)
        alone = F.count(F.lit(1)).over(Window.partitionBy("host", "siblings", "group")) == 1
        merged = numbered.select("host", "branch", F.when(alone, F.col("branch")).otherwise(joined).alias("merged"))
        state = saved(state.join(merged, ["host", "branch"], "left").withColumn(
            "branch", F.coalesce("merged", "branch")).drop("merged"))
    branch = Window.partitionBy("host", "branch")
    return state.withColumns({"branch_labelled": F.sum("labelled").over(branch), "branch_bad": F.sum("bad").over(branch)})


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and bad_share, a row for each row of `pages`.

    `labels` has (key, bad): key is what `page_key` gives for a url, bad is 0 or 1; of several for one key the mean
    counts, and null ones count nothing. Urls without a rule are blocked when their template's smoothed bad share reaches LIMIT.
    Null urls and urls without `://` have an empty host and path and share one template. Without any label all
    urls without a rule are allowed.
    """
    host, path = url_parts(F.col("url"))
    known = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    marks = labels.where("key is not null and bad is not null").groupBy("key").agg(F.avg("bad").alias("bad"))
    keyed = known.withColumn("key", page_key(F.col("path"))).join(marks, "key", "left").drop("key")
    templated = path_templates(keyed.withColumn("segments", _segments(F.col("path"))))
    templated = saved(templated.drop("segments"))
    templates = saved(templated.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    base = templates.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("base"))
    shares = merged_templates(templates).join(F.broadcast(base)).select(  # base is one row
        "host", "template", F.concat(F.lit("/"), F.array_join("branch", "/")).alias("branch"),
        ((F.col("branch_bad") + SMOOTHING * F.col("base")) / (F.col("branch_labelled") + SMOOTHING)).alias("bad_share"))
    shares = saved(shares)
    small = shares.count() <= BROADCAST_ROWS
    judged = templated.join(F.broadcast(shares) if small else shares, ["host", "template"], "left")
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= LIMIT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"),
                         F.col("branch").alias("template"), "bad_share")


def page_key(path: Column) -> Column:
    """The number that a path's last segment starts with, as text without leading zeros; null if there is none."""
    digits = F.regexp_extract(path, r"/0*([0-9]+)[^/]*/*$", 1)
    return F.when(digits != "", digits)
