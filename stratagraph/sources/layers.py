"""Two layers of parts derived from the order tables, and their seed sets."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored


class Layers:
    """The multilayer network over ``part``: ``l1`` of parts ordered together, ``l2`` of parts shipped one after the other.

    Scans read two to six columns and push their filters; a layer is written once
    when first asked for, since plans mention it many times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("node"))

    @cached_property
    def l1(self) -> DataFrame:
        """Edges (u < v) of parts returned together in bulk."""
        rows = self.table("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 25.0))
        pairs = rows.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
        a, b = pairs.select("o", F.col("p").alias("u")), pairs.select("o", F.col("p").alias("v"))
        return stored(a.join(b, "o").filter("u < v").select("u", "v").distinct())

    @cached_property
    def l2(self) -> DataFrame:
        """Edges (u < v) of parts that one supplier shipped consecutively at a high discount."""
        rows = self.table("lineitem").filter((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.08))
        w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
        p, q = F.col("l_partkey"), F.col("q")
        rows = rows.select("l_partkey", F.lead("l_partkey").over(w).alias("q")).filter(q.isNotNull() & (q != p))
        return stored(rows.select(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")).distinct())

    def top_degree(self, edges: DataFrame, k: int = 10) -> DataFrame:
        """(pos, node): the k nodes of highest degree, smaller ids first among equals; at most k rows."""
        ends = edges.select(F.col("u").alias("node")).union(edges.select("v"))
        best = ends.groupBy("node").agg(F.count("*").alias("deg")).orderBy(F.desc("deg"), "node").limit(k)
        return best.select((F.row_number().over(Window.orderBy(F.desc("deg"), "node")) - 1).cast("bigint").alias("pos"), "node")

    def stars(self, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Seed lists that overlap on purpose: a hub with its smallest neighbours, and their neighbours with one of the first list."""
        arcs = self.l1.union(self.l1.select("v", "u")).toDF("src", "dst")
        hub = self.top_degree(self.l1, 1).select(F.col("node").alias("src"))
        near = arcs.join(F.broadcast(hub), "src").select("dst").orderBy("dst").limit(k - 1)
        order = Window.orderBy("node")
        rest = near.select(F.row_number().over(Window.orderBy("dst")).cast("bigint").alias("pos"), F.col("dst").alias("node"))
        first = hub.select(F.lit(0).cast("bigint").alias("pos"), F.col("src").alias("node")).union(rest)
        others = arcs.join(F.broadcast(rest.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()
        others = others.join(F.broadcast(first.select("node")), "node", "left_anti").orderBy("node").limit(k - 1)
        others = others.select((F.row_number().over(order) - 1).cast("bigint").alias("pos"), "node")
        second = others.union(rest.filter("pos = 1").select(F.lit(k - 1).cast("bigint").alias("pos"), "node"))
        # 2 k rows at most: collected once, so that plans over them stay short
        shape = "pos bigint, node bigint"
        return tuple(self.spark.createDataFrame([tuple(r) for r in s.orderBy("pos").collect()], shape) for s in (first, second))
