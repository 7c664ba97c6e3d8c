"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.session import materialize, materialize_counted


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. ``links``: a, b.

    Each round hangs the larger neighbours of a node under its smallest one, then the smaller ones;
    it ends when a round changes nothing, after about log(longest path) rounds. Every step is a
    partial aggregate and a join with one row per node, so hubs are split.
    """
    e = materialize(
        links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(),
        label,
    )
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v")
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        small = small.unionByName(low.selectExpr("u", "m AS v")).distinct()
        new, n = materialize_counted(small, label)
        same = new.join(e, ["u", "v"], "left_anti").limit(1).count() == 0
        if same and n == e.count():
            return new.selectExpr("u AS node", "v AS root")
        e = new
