"""Connected components of a link table, without collecting links or nodes.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce
and Beyond"): each round re-hangs links on the smallest neighbour until every link points at its
component's smallest node. All steps are joins and aggregations on node ids; each round is written
to the shared checkpoint folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round over links (u > v). Large: neighbours above u re-hang on the smallest of u's
    neighbourhood. Small: u and its neighbours below re-hang on it."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = both.join(low, "u")
    if large:
        out = rows.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _mark(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Null ends and self-links are ignored; an empty table gives an empty result."""
    cur = stage(
        links.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "links")
    before = _mark(cur)
    while before[0]:
        cur = stage(_star(_star(cur, True), False), "links")
        after = _mark(cur)
        if after == before:
            break
        before = after
    hung = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct().join(
        hung.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return hung.select(F.col("u").alias("node"), "component").unionByName(roots)
