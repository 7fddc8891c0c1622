"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hot_keys, lookup, scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of a link, the smallest node it can reach.

    Each round every node hooks to its smallest neighbour if that is smaller, pointers are jumped until they point to nodes that
    hook nowhere, and the links are rewritten between those; links inside one of them go, so settled components take no further
    part. All tables are keyed by node and stay distributed; a node with a great share of the links is dealt to many tasks (see
    lookup). The only thing asked of the driver's jobs is whether pointers moved and links are left. Null ends are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = scratch(edges.union(edges.select("v", "u")).distinct(), "links")
    of: DataFrame | None = None
    while not edges.isEmpty():
        hook = scratch(edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("root")), "hooks")
        while True:  # each jump doubles the height that is climbed
            above = hook.where("u <> root").select("u", "root").toDF("root", "above")
            up = lookup(hook.select("u", "root"), "root", above, "u", hot_keys(hook, "root"))
            hook = scratch(up.select("u", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
            if hook.where("moved").isEmpty():
                break
        hook = hook.select("u", "root")
        if of is None:
            of = hook.toDF("node", "component")
        else:
            step = hook.where("u <> root").toDF("component", "root")
            of = lookup(of, "component", step, "node", hot_keys(of, "component")).select("node", F.coalesce("root", "component").alias("component"))
        of = scratch(of, "components")
        hot = hot_keys(edges, "u")  # links are held in both directions, so v has the same hot keys
        near = lookup(edges, "u", hook.toDF("u", "ru"), "v", hot).select("ru", "v")
        edges = lookup(near, "v", hook.toDF("v", "rv"), "ru", hot).where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        edges = scratch(edges.distinct(), "links")
    if of is None:
        of = edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return of
