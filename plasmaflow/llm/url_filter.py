"""URL filters by path-template trees.

Urls that a rule judges are the labelled ones; a page that no rule judges counts as `silent` of an allowed one, as whoever wrote
the rules let it pass. Every host has a tree of path segments, grown level by level over counts of distinct paths, never over
pages. At each node:

1. segments that vary become a wildcard: numbers and long hex strings with their extension, and in a node with more than
   `max_children` different segments every one that holds less than `common` of the node's pages;
2. siblings whose statistics are alike merge into one branch, labelled or not: their blocked shares must not differ by more than
   the Hoeffding bound allows, nor by more than a half, and they must continue with the same kinds of segments;
3. a path of wildcards and merged branches is a template. Its purity is its blocked share, smoothed by `strength` pages at the
   purity of the template above it; a host's root is smoothed at the share of all pages.

A page without a rule is blocked if the deepest of its templates that holds `support` pages has a purity of at least `purity`.

The rules are a short list that the caller states. A node has at most max_children or 1 / common + 2 branches after step 1, so the
merge of step 2 sees a bounded group. Defined cases: a null url or one without `://` has empty host and path and no rule, so its
template is the root of the empty host; an empty table gives no rows; repeated urls count each; extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm.common import Scratch

#: (verdict, host, path): the first rules of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host() -> Column:
    raw = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path() -> Column:
    return F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled(rules: list[tuple[str, str, str]], value) -> Column:
    """value(verdict, rule) of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1:])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        out = F.when(fits, F.lit(value(verdict, h + p))).otherwise(out)
    return out


def segment_kind(segment: Column) -> Column:
    """A segment with its variable part as a wildcard: numbers and long hex strings, before an extension if there is one."""
    return F.regexp_replace(segment, r"^(?:[0-9]+|[0-9a-fA-F-]{8,})(\.[A-Za-z0-9]{1,5})?$", r"*$1")


def _merge(above: str, alpha: float):
    """Give each branch of a node the name of the merged branch: the first alike one in order of size, then name."""
    bound = math.sqrt(math.log(2 / alpha) / 2)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "branch"], ascending=[False, True])
        merged: list[dict] = []
        names = []
        for row in group.to_dict("records"):
            kind = row["varies"], row["named"], row["branch"].startswith("*")
            for m in merged:
                gap = abs(m["blocked"] / m["weight"] - row["blocked"] / row["weight"])
                if m["kind"] == kind and gap <= min(0.5, bound * (m["weight"] ** -0.5 + row["weight"] ** -0.5)):
                    m["weight"] += row["weight"]
                    m["blocked"] += row["blocked"]
                    names.append(m["branch"])
                    break
            else:
                merged.append(row | {"kind": kind})
                names.append(row["branch"])
        return pd.DataFrame({"host": group["host"], above: group[above], "branch": group["branch"], "name": names})

    return run


SUMS = ("n", "weight", "blocked")


def templates(paths: DataFrame, depth: int, max_children: int, common: float, alpha: float, scratch: Scratch) -> DataFrame:
    """paths (host, kinds, n, weight, blocked) with its template at each level as columns t0 (the root) to t<depth>, null beyond its end."""
    level = paths.withColumn("t0", F.lit(""))
    for k in range(1, depth + 1):
        above, own = f"t{k - 1}", F.get("kinds", F.lit(k - 1))
        after = F.coalesce(F.get("kinds", F.lit(k)), F.lit(""))
        level = level.withColumn("own", own)
        kinds = F.max(after.startswith("*").cast("int")).alias("varies"), F.max(((after != "") & ~after.startswith("*")).cast("int")).alias("named")
        child = level.where("own is not null").groupBy("host", above, "own").agg(*(F.sum(c).alias(c) for c in SUMS), *kinds)
        node = child.groupBy("host", above).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("total"))
        child = child.join(node, ["host", above])
        rare = (F.col("children") > max_children) & (F.col("n") < common * F.col("total"))
        child = scratch.cut(child.withColumn("branch", F.when(rare, "*").otherwise(F.col("own"))), "children")
        branches = child.groupBy("host", above, "branch").agg(*(F.sum(c).alias(c) for c in SUMS), F.max("varies").alias("varies"), F.max("named").alias("named"))
        named = branches.groupBy("host", above).applyInPandas(_merge(above, alpha), f"host string, {above} string, branch string, name string")
        step = child.select("host", above, "own", "branch").join(named, ["host", above, "branch"]).select("host", above, "own", "name")
        level = level.join(step, ["host", above, "own"], "left").withColumn(f"t{k}", F.when(F.col("name").isNotNull(), F.concat(above, F.lit("/"), "name"))).drop("own", "name")
        level = scratch.cut(level, "templates")
    return level


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, depth: int = 3, max_children: int = 50, common: float = 0.02, alpha: float = 0.05,
    support: int = 5, silent: float = 0.5, purity: float = 0.8, strength: float = 2.0, hidden: Column | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (its own, also where a rule decides) of each row of pages(page_id, url).

    Segments beyond `depth` take the verdict of the template at that depth. Rows that are `hidden` count as if no rule judged them."""
    scratch = Scratch(pages.sparkSession, "url_filter")
    parsed = pages.select("page_id", host().alias("host"), path().alias("path"))
    known = F.lit(True) if hidden is None else ~hidden
    parsed = parsed.withColumn("rule", F.when(known, _ruled(rules, lambda v, r: r))).withColumn("ruled", F.when(known, _ruled(rules, lambda v, r: v)))
    kinds = F.transform(F.slice(F.filter(F.split("path", "/"), lambda s: s != ""), 1, depth), segment_kind)
    parsed = parsed.withColumn("kinds", kinds)
    n, blocked = F.count(F.lit(1)), F.count(F.when(F.col("ruled") == "block", 1))
    weight = F.count("ruled") + silent * (n - F.count("ruled"))
    level = templates(scratch.cut(parsed.groupBy("host", "kinds").agg(n.alias("n"), weight.alias("weight"), blocked.alias("blocked")), "paths"), depth, max_children, common, alpha, scratch)
    whole = level.agg(F.sum("weight").alias("weight"), F.sum("blocked").alias("blocked")).first()

    pure = F.lit((whole["blocked"] or 0) / whole["weight"] if whole["weight"] else 0.0)
    best = F.lit(None).cast("struct<template:string,purity:double>")
    for k in range(depth + 1):
        at = f"t{k}"
        sums = level.where(F.col(at).isNotNull()).groupBy("host", at).agg(*(F.sum(c).alias(f"{c}{k}") for c in SUMS))
        level = level.join(sums, ["host", at], "left")
        pure = (F.col(f"blocked{k}") + strength * pure) / (F.col(f"weight{k}") + strength)
        enough = F.col(f"n{k}") >= support if k else F.lit(True)
        best = F.when(F.col(at).isNotNull() & enough, F.struct(F.col(at).alias("template"), pure.alias("purity"))).otherwise(best)
    out = parsed.join(level.select("host", "kinds", best.alias("best")), ["host", "kinds"], "left")
    learned = F.when(F.round("best.purity", 6) >= purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), F.col("best.template").alias("template"), F.round("best.purity", 6).alias("purity"))


def agreement(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, parts: int = 5, seed: int = 5, **parameters) -> DataFrame:
    """One row: of the ruled pages of which a seeded part was hidden, how many there are and how many the templates judge as the rules do."""
    hidden = F.pmod(F.xxhash64("page_id", F.lit(seed)), F.lit(parts)) == 0
    judged = judge(pages, rules, hidden=hidden, **parameters).withColumn("truth", _ruled(rules, lambda v, r: v)).where(hidden & F.col("truth").isNotNull())
    return judged.groupBy("truth").agg(F.count(F.lit(1)).alias("hidden"), F.count(F.when(F.col("truth") == F.col("verdict"), 1)).alias("agree"))
