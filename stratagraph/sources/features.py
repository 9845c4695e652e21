"""Features kept between runs, by graph, layer and feature, each with a fingerprint of the edges it was made from.

Rows are written aside, in a folder of their run; a row in the table of markers
publishes them for one (graph, layer, feature, fingerprint). Nothing is ever
overwritten: a run that fails leaves rows that no marker names, and readers see
what was published before. A layer whose edges changed has another fingerprint,
so that only its own features are made again, all such layers in one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

KEY = ["graph", "layer"]


@dataclass(frozen=True)
class Feature:
    """A name, what makes (node, values ...) of ``nodes(node)`` and ``edges(u, v)``, and the settings it depends on, in words; other settings are another feature to the store."""

    name: str
    build: Callable[[DataFrame, DataFrame], DataFrame]
    settings: str = ""


def over_layers(networks: DataFrame, build: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(graph, layer, node, values ...): an operator of one layer over all layers of ``networks(graph, layer, u, v)`` at once.

    Nodes are named by graph, layer and node together, so layers never meet; a
    layer's nodes are the ends of its edges.
    """
    named = lambda c: F.struct("graph", "layer", F.col(c).alias("node"))
    edges = networks.select(named("u").alias("u"), named("v").alias("v"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    made = build(nodes, edges)
    return made.select("node.graph", "node.layer", F.col("node.node").alias("_node"), *[c for c in made.columns if c != "node"]).withColumnRenamed("_node", "node")


def fingerprints(networks: DataFrame) -> DataFrame:
    """(graph, layer, content): number, sum and parity of the edges' hashes; the order of rows doesn't matter, repeated edges do."""
    h = F.xxhash64("u", "v")
    rows = networks.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return rows.select(*KEY, F.concat_ws(":", "n", "s", "x").alias("content"))


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Store:
    """Features below the folder ``root``, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def markers(self) -> DataFrame:
        """(graph, layer, feature, fingerprint, run, rows): what is published."""
        found = _found(self.spark, f"{self.root}/markers")
        return self.spark.createDataFrame([], "graph string, layer bigint, feature string, fingerprint string, run string, rows bigint") if found is None else found

    @staticmethod
    def _wanted(prints: DataFrame, feature: Feature) -> DataFrame:
        mark = F.sha2(F.concat_ws("|", F.lit(feature.name), F.lit(feature.settings), "content"), 256)
        return prints.select(F.col("graph").cast("string").alias("graph"), F.col("layer").cast("bigint").alias("layer"), F.lit(feature.name).alias("feature"), mark.alias("fingerprint"))

    def _make(self, networks: DataFrame, prints: DataFrame, feature: Feature) -> int:
        """Makes what no marker names; the number of layers made."""
        lacking = stored(self._wanted(prints, feature).join(self.markers(), [*KEY, "feature", "fingerprint"], "left_anti"))
        layers = lacking.count()
        if layers:
            run = f"r{uuid.uuid4().hex}"
            path = f"{self.root}/data/{feature.name}/run={run}"
            over_layers(networks.join(lacking, KEY, "left_semi"), feature.build).sortWithinPartitions(*KEY).write.parquet(path)
            counts = self.spark.read.parquet(path).groupBy(*KEY).agg(F.count("*").alias("rows"))
            done = lacking.join(counts, KEY, "left").select(*KEY, "feature", "fingerprint", F.lit(run).alias("run"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
            done.coalesce(1).write.mode("append").parquet(f"{self.root}/markers")
        return layers

    def _read(self, networks: DataFrame, prints: DataFrame, feature: Feature) -> DataFrame:
        data = _found(self.spark, f"{self.root}/data/{feature.name}")
        if data is None:  # there are no layers at all
            return over_layers(networks.limit(0), feature.build)
        # two runs at once may both have published: one of them counts
        current = self._wanted(prints, feature).join(self.markers(), [*KEY, "feature", "fingerprint"]).groupBy(*KEY).agg(F.min("run").alias("run"))
        return data.join(current, [*KEY, "run"]).drop("run")

    def get(self, networks: DataFrame, features: list[Feature]) -> tuple[dict[str, DataFrame], dict[str, int]]:
        """Each feature's (graph, layer, node, values ...) for ``networks(graph, layer, u, v)``, and how many layers had to be made for it.

        Layers made before from the same edges are only read.
        """
        typed = networks.select(F.col("graph").cast("string").alias("graph"), F.col("layer").cast("bigint").alias("layer"), "u", "v")
        prints = stored(fingerprints(typed))
        made = {f.name: self._make(typed, prints, f) for f in features}
        return {f.name: self._read(typed, prints, f) for f in features}, made

    def stale(self, networks: DataFrame, features: list[Feature]) -> DataFrame:
        """(graph, layer, feature, run): published rows that no given feature of the networks as they are would read."""
        prints = stored(fingerprints(networks))
        wanted = None
        for f in features:
            one = self._wanted(prints, f)
            wanted = one if wanted is None else wanted.unionByName(one)
        return self.markers().join(wanted, [*KEY, "feature", "fingerprint"], "left_anti").select(*KEY, "feature", "run")
