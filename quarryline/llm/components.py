"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_hot, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each linked node reaches; nodes without links don't appear.

    Each round, every node points to the smallest node that it or a neighbour points to (one join
    and one aggregation, both combined before the shuffle), and then takes over where that node
    points (pointer jumping), so rounds grow with the logarithm of the longest path. Pointers only
    ever fall, so after the first round only neighbours whose pointer has changed are asked. Hubs, and
    nodes that very many point to, are joined by broadcast. Each round's table is written to the shared
    folder, and rounds end when no pointer changes.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    # The table of edges holds both directions, so a node's rows as u are as many as those as v.
    state = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"), F.count("*").alias("degree")).select("node", "degree", F.col("node").alias("was"), F.least("least", "node").alias("component")), "components")
    n, links_n = state.count(), edges.count()
    while True:
        news = state.where("component <> was").select(F.col("node").alias("v"), "component", "degree")
        seen = join_hot(edges, news, "v", "degree", links_n).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        hooked = written(state.join(seen, "node", "left").select("node", "degree", F.col("component").alias("was"), F.least("component", "near").alias("p")), "hooked")
        to = written(hooked.groupBy("p").agg(F.count("*").alias("followers")).join(state.select(F.col("node").alias("p"), F.col("component").alias("beyond")), "p"), "to")
        new = written(join_hot(hooked, to, "p", "followers", n).select("node", "degree", "was", F.least("p", "beyond").alias("component")), "components")
        for done in (state, hooked, to):
            drop_written(done)
        if new.where("component <> was").isEmpty():
            drop_written(edges)
            return new.select("node", "component")
        state = new
