"""Filtering pages by url: rules on host and path, then a list of canonical urls.

The listed urls fill a blocked Bloom filter, a table of blocks of bits. A page whose bits are not all set
cannot be listed and passes at once; the possible hits go on to an exact join with the list, which
removes the false positives. The number of blocks follows the list up to ``max_blocks``, so the broadcast
filter has a fixed bound; beyond it more pages go through the exact join, with the same result. A url that very many pages share is a skewed key on the page side of that join only, which
Spark splits at run time.

Defined results: a null url, or one without ``://``, has empty host and path and no canonical form, fits
no rule and is allowed. Of rules that fit equally long the one with the longer host holds, then the later one.
A very long url is judged like any other. Repeated rows each get their verdict. Empty pages give an empty table; an empty
list blocks nothing. Only the named columns of the pages are read; others do not come along.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm import bloom
from rankloom.session import materialise

# Query parameters that only follow the visitor; names of this form are dropped.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


class Rule(NamedTuple):
    """``host`` and all its subdomains, for paths that start with ``path``."""

    action: str
    host: str
    path: str


def _after_scheme(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substr(url, place + 3))


def host_of(url: Column) -> Column:
    """A-Z lower-cased; empty for a null url or one without a scheme mark."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(found, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without leading `www.`, path without ending slash, query sorted and without tracking.

    Scheme, fragment and the ports 80 and 443 do not count. Null where there is no ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&"
    )
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, else nulls. The rules are a list written by hand."""
    names, actions = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        names = F.when(fits, F.lit(rule.host + rule.path)).otherwise(names)
        actions = F.when(fits, F.lit(rule.action)).otherwise(actions)
    return names, actions


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    page_id: str = "page_id",
    url: str = "url",
    max_blocks: int = bloom.MAX_BLOCKS,
) -> DataFrame:
    """page_id, url, host, path, rule, listed (boolean) and verdict, one row per page.

    ``listed`` has a column url. The longest fitting rule decides; without one, listed urls are blocked.
    """
    entries = materialise(
        listed.select(canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL").distinct(), "listed-urls"
    )
    blocks = bloom.block_count(entries.count(), max_blocks)

    address = F.col("url")
    rule, action = rule_for(rules, F.col("host"), F.col("path"))
    rows = (
        pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
        .withColumns({"host": host_of(address), "path": path_of(address), "canonical": canonical(address)})
        .withColumns({"rule": rule, "action": action})
    )
    rows = bloom.mark(rows, "canonical", bloom.build(entries, "canonical", blocks), blocks)

    passed = rows.where(~F.col("possible")).withColumn("listed", F.lit(False))
    checked = (
        rows.where("possible")
        .join(entries.withColumn("found", F.lit(True)), "canonical", "left")
        .withColumn("listed", F.coalesce("found", F.lit(False)))
        .drop("found")
    )
    verdict = F.coalesce("action", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return passed.unionByName(checked).select(
        "page_id", "url", "host", "path", "rule", "listed", verdict.alias("verdict")
    )
