"""Structure of one layer. ``edges(u, v)`` hold each undirected edge once, ``arcs(src, dst)`` both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running


def canonical(pairs: DataFrame) -> DataFrame:
    """Any pairs (u, v) as simple undirected edges, without self loops."""
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))


def active(arcs: DataFrame, removed: DataFrame | None) -> DataFrame:
    """Arcs whose ends both are alive."""
    if removed is None:
        return arcs
    return arcs.join(removed.select(F.col("node").alias("src")), "src", "left_anti").join(removed.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def degree(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, deg) for every node; isolated nodes have 0."""
    counts = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg"))


def two_hop(arcs: DataFrame) -> DataFrame:
    """Distinct (src, dst) over two arcs, the node itself left out; direct neighbours count only if a triangle closes."""
    first = arcs.select("src", F.col("dst").alias("mid"))
    second = arcs.select(F.col("src").alias("mid"), "dst")
    return first.join(second, "mid").filter("src <> dst").select("src", "dst").distinct()


def coverage(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, coverage): how many nodes are two hops away."""
    counts = two_hop(arcs).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("coverage"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("coverage", F.lit(0)).cast("bigint").alias("coverage"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): each triangle is found once, from its smallest node, and counted at its three corners."""
    a = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    b = edges.select(F.col("u").alias("y"), F.col("v").alias("z"))
    c = edges.select(F.col("u").alias("x"), F.col("v").alias("z"))
    found = a.join(b, "y").join(c, ["x", "z"])
    return found.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, deg, cc): closed share of the neighbour pairs, 0 below two neighbours."""
    base = degree(nodes, symmetric(edges)).join(triangles(edges), "node", "left")
    pairs = F.col("deg") * (F.col("deg") - 1)
    cc = F.when(F.col("deg") < 2, 0.0).otherwise(2.0 * F.coalesce("triangles", F.lit(0)) / F.nullif(pairs, F.lit(0)))
    return base.select("node", "deg", cc.alias("cc"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges between kept nodes."""
    return edges.join(keep.select(F.col("node").alias("u")), "u", "left_semi").join(keep.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(node, idx): the nodes that have edges, numbered by their order."""
    used = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return running(used, [F.asc("node")], idx=F.lit(1)).select("node", (F.col("idx") - 1).alias("idx"))


def padded(features: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Feature rows for every node, zeros where there are none."""
    return nodes.join(features, "node", "left").select("node", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in columns])


def quality(layers: dict[int, DataFrame], nodes: DataFrame) -> DataFrame:
    """(layer, n_nodes, n_edges, n_isolated, ok): a layer without edges is not ok."""
    out = None
    for k, edges in layers.items():
        deg = degree(nodes, symmetric(edges))
        row = deg.agg(F.count("*").alias("n_nodes"), (F.sum("deg") / 2).cast("bigint").alias("n_edges"), F.count_if(F.col("deg") == 0).alias("n_isolated"))
        row = row.select(F.lit(k).alias("layer"), "*", (F.col("n_edges") > 0).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def feature_quality(features: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, n_infinite, max_value, ok): ok where every value is finite and one is above 0."""
    out = None
    for c in columns:
        x = F.col(c).cast("double")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        row = features.agg(F.count_if(x.isNull()).alias("n_missing"), F.count_if(odd).alias("n_infinite"), F.max(F.when(~odd, x)).alias("max_value"))
        row = row.select(F.lit(c).alias("column"), "*", ((F.col("n_missing") + F.col("n_infinite") == 0) & (F.coalesce("max_value", F.lit(0.0)) > 0)).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
